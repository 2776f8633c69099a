"""Queries on decoded scores: matrices, curves, working points, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setframe.config import WORKING_POINTS
from setframe.functions.labels import argmax
from setframe.operators import confusion, histograms, roc, sets
from setframe.operators.scoring import loss_and_accuracy
from setframe.plans import report
from setframe.session import materialise
from workload import fixtures as fx
from workload.dialect import r, with_parts
from workload.registry import Area, rd

AREA = Area()
query = AREA.query


def is_signal() -> Column:
    return ~F.col("is_fake")


def classifiers() -> dict[str, Column]:
    return {"network": fx.network_score(), "baseline": fx.baseline_score()}


# ---- confusion matrices -------------------------------------------------------------------

GRID = """grid as (select (i // 6)::int as pred, (i % 6)::int as truth from range(36) g(i))"""
CELLS = f"""{GRID}, m as (
  select grid.pred, grid.truth, coalesce(sum(w_mc), 0::double) as weight
  from grid left join decoded d on d.pred = grid.pred and d.label = grid.truth
  group by grid.pred, grid.truth)"""
NORMED = f"""{CELLS}, normed as (
  select pred, truth, weight,
         weight / (sum(weight) over (partition by truth) + 1e-12::double) as by_truth,
         weight / (sum(weight) over (partition by pred) + 1e-12::double) as by_pred,
         case when sum(weight) over (partition by pred) = 0 then 0::double
              else weight / sum(weight) over (partition by pred) end as by_pred_exact
  from m)"""


def weighted_confusion(rows: DataFrame, **options) -> DataFrame:
    return confusion.confusion_matrix(rows, F.col("pred"), F.col("label"), F.col("w_mc"),
                                      **options)


@query(with_parts("decoded", """
select id, label, pred from decoded"""))
def argmax_decode(spark: SparkSession, d: str) -> DataFrame:
    return fx.decoded(spark, d).select("id", "label", "pred")


@query(with_parts("decoded", f"with {CELLS} select pred, truth, {r('weight')} as weight from m"))
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    matrix = weighted_confusion(fx.decoded(spark, d))
    return matrix.select("pred", "truth", rd("weight").alias("weight"))


@query(with_parts("decoded", f"""
with {NORMED}
select pred, truth, {r('weight')} as weight, {r('by_truth')} as norm_by_truth,
       {r('by_pred')} as norm_by_pred, {r('by_pred_exact', 2)} as norm_by_pred_2dp from normed"""))
def confusion_normalised(spark: SparkSession, d: str) -> DataFrame:
    normed = confusion.normalised(weighted_confusion(fx.decoded(spark, d)))
    return normed.select("pred", "truth", rd("weight").alias("weight"),
                         rd("norm_by_truth").alias("norm_by_truth"),
                         rd("norm_by_pred").alias("norm_by_pred"), "norm_by_pred_2dp")


@query(with_parts("decoded", f"""
with {NORMED}
select {r('sum(by_truth) filter (where pred = truth) / 6')} as diag_by_truth,
       {r('sum(by_pred) filter (where pred = truth) / 6')} as diag_by_pred,
       {r('sum(by_truth) filter (where pred = truth and pred > 0) / 5')} as signal_diag_by_truth,
       {r('sum(by_pred) filter (where pred = truth and pred > 0) / 5')} as signal_diag_by_pred
from normed"""))
def diagonal_score(spark: SparkSession, d: str) -> DataFrame:
    normed = confusion.normalised(weighted_confusion(fx.decoded(spark, d)))
    whole = confusion.diagonal_score(normed)
    signal = confusion.diagonal_score(normed, drop_first=True)
    picked = signal.select(F.struct("diag_by_truth", "diag_by_pred").alias("s")).scalar()
    return whole.select(rd("diag_by_truth").alias("diag_by_truth"),
                        rd("diag_by_pred").alias("diag_by_pred"),
                        rd(picked["diag_by_truth"]).alias("signal_diag_by_truth"),
                        rd(picked["diag_by_pred"]).alias("signal_diag_by_pred"))


PRED5 = """(case greatest(s1, s2, s3, s4, s5) when s1 then 0 when s2 then 1 when s3 then 2
           when s4 then 3 else 4 end)::int"""
TRUTH5 = "(case when label = 0 then 0 else label - 1 end)::int"


@query(with_parts("scores", f"""
with grid5 as (select (i // 5)::int as pred, (i % 5)::int as truth from range(25) g(i)),
five as (select {PRED5} as pred, {TRUTH5} as truth, w_mc from scores)
select grid5.pred, grid5.truth, {r('coalesce(sum(w_mc), 0::double)')} as weight
from grid5 left join five using (pred, truth) group by grid5.pred, grid5.truth"""))
def confusion_no_background(spark: SparkSession, d: str) -> DataFrame:
    pred, truth = report.signal_class_decode(fx.score_vector(), F.col("label"))
    matrix = confusion.confusion_matrix(fx.scores(spark, d), pred, truth, F.col("w_mc"), 5)
    return matrix.select("pred", "truth", rd("weight").alias("weight"))


@query(with_parts("scores", f"""
with e as (select * from range(4) g(epoch)),
shifted as (
  select e.epoch::int as epoch, label, w_mc,
         {', '.join(f"s{c} + case when label = {c} then 0.01::double * e.epoch else 0 end as t{c}"
                    for c in range(6))}
  from scores, e),
p as (select epoch, label, w_mc, (case greatest(t0, t1, t2, t3, t4, t5) when t0 then 0
        when t1 then 1 when t2 then 2 when t3 then 3 when t4 then 4 else 5 end)::int as pred
      from shifted),
{GRID}
select e.epoch::int as epoch, grid.pred, grid.truth, {r('coalesce(sum(w_mc), 0::double)')} as weight
from e cross join grid left join p
  on p.epoch = e.epoch and p.pred = grid.pred and p.label = grid.truth
group by e.epoch, grid.pred, grid.truth"""))
def confusion_by_epoch(spark: SparkSession, d: str) -> DataFrame:
    """Score vectors of four epochs per row, decoded and counted in one pass."""
    rows = fx.scores(spark, d).select("label", "w_mc", *fx.SCORE_NAMES,
                                      F.explode(F.sequence(F.lit(0), F.lit(3))).alias("epoch"))
    vector = F.array(*[
        F.col(s) + F.when(F.col("label") == c, F.lit(0.01) * F.col("epoch")).otherwise(0.0)
        for c, s in enumerate(fx.SCORE_NAMES)])
    decoded = rows.withColumn("_v", vector).withColumn("pred", argmax(F.col("_v")))
    matrix = weighted_confusion(decoded, group=["epoch"])
    return matrix.select("epoch", "pred", "truth", rd("weight").alias("weight"))


# ---- loss, slices -------------------------------------------------------------------------

LOSS_SQL = """-ln(least(greatest(case label when 0 then s0 when 1 then s1 when 2 then s2
              when 3 then s3 when 4 then s4 else s5 end, 1e-7::double), 1 - 1e-7::double))"""


@query(with_parts("decoded", f"""
select {r(f'avg({LOSS_SQL})')} as loss, {r('avg((pred = label)::int::double)')} as accuracy,
       count(*)::bigint as n from decoded"""))
def xent_accuracy(spark: SparkSession, d: str) -> DataFrame:
    summary = loss_and_accuracy(fx.decoded(spark, d), fx.score_vector(), F.col("label"),
                                F.col("pred"))
    return summary.select(rd("loss").alias("loss"), rd("accuracy").alias("accuracy"), "n")


@query(with_parts("decoded", " union all ".join(f"""
select '{name}' as slice, {r(f'avg(w_mc * {LOSS_SQL})')} as loss,
       {r('avg((pred = label)::int::double)')} as accuracy, count(*)::bigint as n
from decoded where {where}""" for name, where in
    (("all", "true"), ("1-prong", "prong = 1"), ("3-prong", "prong = 3")))))
def slice_metrics(spark: SparkSession, d: str) -> DataFrame:
    """All rows and each prong in one aggregation over grouping sets."""
    from setframe.operators.scoring import row_loss
    rows = fx.decoded(spark, d)
    loss = F.avg(F.col("w_mc") * row_loss(fx.score_vector(), F.col("label")))
    sliced = rows.groupingSets([[F.col("prong")], []], "prong").agg(
        rd(loss).alias("loss"),
        rd(F.avg((F.col("pred") == F.col("label")).cast("double"))).alias("accuracy"),
        F.count(F.lit(1)).alias("n"))
    name = F.when(F.col("prong").isNull(), "all").otherwise(
        F.concat(F.col("prong").cast("string"), F.lit("-prong")))
    return sliced.select(name.alias("slice"), "loss", "accuracy", "n")


@query(with_parts("decoded", f"""
with {GRID},
slices as (select 'all' as slice, * from decoded
           union all select prong::varchar || '-prong', * from decoded),
names as (select distinct slice from slices)
select n.slice, grid.pred, grid.truth, {r('coalesce(sum(w_mc), 0::double)')} as weight
from names n cross join grid left join slices s
  on s.slice = n.slice and s.pred = grid.pred and s.label = grid.truth
group by n.slice, grid.pred, grid.truth"""))
def confusion_by_slice(spark: SparkSession, d: str) -> DataFrame:
    """One matrix for each prong and one for all rows; the last is summed from the others' cells."""
    matrices = weighted_confusion(fx.decoded(spark, d), group=["prong"])
    sliced = matrices.groupingSets(
        [[F.col("prong"), F.col("pred"), F.col("truth")], [F.col("pred"), F.col("truth")]],
        "prong", "pred", "truth").agg(F.sum("weight").alias("weight"))
    name = F.when(F.col("prong").isNull(), "all").otherwise(
        F.concat(F.col("prong").cast("string"), F.lit("-prong")))
    return sliced.select(name.alias("slice"), "pred", "truth", rd("weight").alias("weight"))


# ---- histograms of scores -----------------------------------------------------------------

TWO_SCORES = """both_scores as (
  select 'network' as classifier, net as score, label, is_fake, w_mc, s1, s2, s3, s4, s5 from scores
  union all
  select 'baseline', rnn, label, is_fake, w_mc, s1, s2, s3, s4, s5 from scores)"""


@query(with_parts("scores", f"""
with {TWO_SCORES},
e as (select classifier, is_fake, min(score) as lo0, max(score) as hi0 from both_scores group by 1, 2)
select classifier, truth, bin, {r('lo0 + bin * ((hi0 - lo0) / 100)', 6)} as lo,
       {r('lo0 + (bin + 1) * ((hi0 - lo0) / 100)', 6)} as hi, count(*)::bigint as n
from (select classifier, (not is_fake)::int as truth, lo0, hi0,
             least(floor((score - lo0) / (hi0 - lo0) * 100::double), 99)::int as bin
      from both_scores join e using (classifier, is_fake)) t
group by classifier, truth, bin, lo0, hi0"""))
def score_histograms(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.scores(spark, d).withColumn("truth", is_signal().cast("int"))
    long = sets.side_by_side(rows, classifiers(), ["truth"])
    found = histograms.auto_histograms(long, ["score"], 100, group=["classifier", "truth"],
                                       max_groups=4)
    return found.select("classifier", "truth", "bin", rd("lo").alias("lo"), rd("hi").alias("hi"),
                        "n")


# ---- ROC ----------------------------------------------------------------------------------

def _curve_sql(source: str, group: str = "") -> str:
    """Points by counting, for every distinct score, what lies at or above it."""
    by = f"partition by {group}" if group else ""
    keys = f"{group}, " if group else ""
    return f"""steps as (
      select {keys}score, sum(case when is_fake then 0::double else w_mc end) as pos,
             sum(case when is_fake then w_mc else 0::double end) as neg
      from {source} group by {keys}score),
    points as (
      select {keys}score as threshold,
             sum(neg) over ({by} order by score desc) / sum(neg) over ({by}) as fpr,
             sum(pos) over ({by} order by score desc) / sum(pos) over ({by}) as tpr
      from steps
      union all
      select {keys}max(score) + 1, 0, 0 from {source} {f'group by {group}' if group else ''})"""


# A curve without background (or signal) above its cut has no rate.
NO_NAN = "case when isnan({0}) then null else {0} end"
NET_ONLY = "net_only as (select net as score, is_fake, w_mc from scores)"


def network_counts(spark: SparkSession, d: str) -> DataFrame:
    return roc.score_counts(fx.scores(spark, d), fx.network_score(), is_signal(), F.col("w_mc"))


@query(with_parts("scores", f"""
with {NET_ONLY}, {_curve_sql('net_only')}
select {r('threshold')} as threshold, {r('fpr')} as fpr, {r('tpr')} as tpr from points"""))
def roc_curve(spark: SparkSession, d: str) -> DataFrame:
    curve = roc.roc_curve(network_counts(spark, d))
    return curve.select(*[rd(c).alias(c) for c in ("threshold", "fpr", "tpr")])


@query(with_parts("scores", f"""
with {NET_ONLY}, {_curve_sql('net_only')}
select {r('tpr')} as efficiency, {r('1 / fpr')} as rejection from points where fpr > 0"""))
def eff_rejection(spark: SparkSession, d: str) -> DataFrame:
    pairs = roc.efficiency_rejection(roc.roc_curve(network_counts(spark, d)))
    return pairs.select(rd("efficiency").alias("efficiency"), rd("rejection").alias("rejection"))


def _pair_auc_sql(source: str, group: str = "") -> str:
    """Chance that a signal row outscores a background row, by comparing distinct scores."""
    same = f"and a.{group} = b.{group}" if group else ""
    keys = f"a.{group}, " if group else ""
    grouped = f"group by a.{group}" if group else ""
    inner = f"{group}, score" if group else "score"
    return f"""h as (select {inner}, sum(case when is_fake then 0 else w_mc end) as pos,
                            sum(case when is_fake then w_mc else 0 end) as neg
                     from {source} group by {inner})
    select {keys}{r('''sum(a.pos * b.neg * case when a.score > b.score then 1::double
                       when a.score = b.score then 0.5::double else 0 end)
                       / sum(a.pos * b.neg)''')} as auc
    from h a join h b on true {same} {grouped}"""


@query(with_parts("scores", f"with {NET_ONLY}, {_pair_auc_sql('net_only')}"))
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return roc.auc(network_counts(spark, d)).select(rd("auc").alias("auc"))


@query(with_parts("scores", f"with {TWO_SCORES}, {_pair_auc_sql('both_scores', 'classifier')}"))
def classifier_comparison(spark: SparkSession, d: str) -> DataFrame:
    counts = report.curve_counts(fx.scores(spark, d), classifiers(), is_signal(), F.col("w_mc"))
    return roc.auc(counts, ["classifier"]).select("classifier", rd("auc").alias("auc"))


@query(with_parts("scores", f"""
with sliced as (
  select 'all' as slice, net as score, is_fake, w_mc from scores
  union all select '1-prong', net, is_fake, w_mc from scores where prong = 1
  union all select '3-prong', net, is_fake, w_mc from scores where prong = 3),
{_curve_sql('sliced', 'slice')}
select slice, {r('threshold')} as threshold, {r('fpr')} as fpr, {r('tpr')} as tpr from points"""))
def roc_by_slice(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.scores(spark, d).withColumn("score", fx.network_score())
    slices = {"all": F.lit(True), "1-prong": F.col("prong") == 1, "3-prong": F.col("prong") == 3}
    sliced = sets.with_slices(rows, slices, ["score", "is_fake", "w_mc"])
    counts = roc.score_counts(sliced, F.col("score"), is_signal(), F.col("w_mc"), ["slice"], 3)
    curve = roc.roc_curve(counts, ["slice"])
    return curve.select("slice", *[rd(c).alias(c) for c in ("threshold", "fpr", "tpr")])


# ---- working points -----------------------------------------------------------------------

POINTS = ", ".join(f"({w})" for w in WORKING_POINTS)


def _quantile(column: str, q: str) -> str:
    return f"(select quantile_cont({column}, {q}) from scores where not is_fake)"


@query(with_parts("scores", " union all ".join(
    f"select {w}::int as wp, {r(_quantile('net', str((100 - w) / 100)))} as cut,"
    f" {r(_quantile('net', str(w / 100)))} as raw_percentile_cut" for w in WORKING_POINTS)))
def working_points(spark: SparkSession, d: str) -> DataFrame:
    points = roc.working_points(network_counts(spark, d), WORKING_POINTS)
    return points.select("wp", rd("cut").alias("cut"),
                         rd("raw_percentile_cut").alias("raw_percentile_cut"))


@query(with_parts("scores", " union all ".join(
    f"select {w}::int as wp, count(*)::bigint as n_signal, true as within_bound from scores where not is_fake"
    for w in WORKING_POINTS)))
def sketch_working_points(spark: SparkSession, d: str) -> DataFrame:
    """Cuts from one stored sketch for each source, merged; and whether each cut's true rank among all
    signal scores is within the sketch's error of the wanted one."""
    rows = fx.scores(spark, d).withColumn("score", fx.network_score()).withColumn(
        "part", F.floor(F.col("id") / F.lit(500.0)))
    parts = materialise(roc.signal_sketches(rows, F.col("score"), is_signal(), ["part"]), "sketches")
    points = roc.sketched_working_points(parts, WORKING_POINTS)
    cuts = {r["wp"]: r["cut"] for r in points.collect()}
    places = F.inline(F.array(*[F.struct(F.lit(w).alias("wp"), F.lit(cut).alias("cut"))
                                for w, cut in cuts.items()]))
    signal = rows.where(is_signal()).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    ranks = signal.select("score", "n", places).groupBy("wp").agg(
        F.sum("n").alias("n_signal"), F.sum(F.when(F.col("score") < F.col("cut"), F.col("n")).otherwise(0))
        .alias("below"), F.sum(F.when(F.col("score") <= F.col("cut"), F.col("n")).otherwise(0)).alias("upto"))
    wanted = (F.lit(100) - F.col("wp")) / F.lit(100.0)
    error = F.lit(roc.rank_error())
    within = ((F.col("below") / F.col("n_signal") - error <= wanted)
              & (wanted <= F.col("upto") / F.col("n_signal") + error))
    return ranks.select("wp", "n_signal", within.alias("within_bound"))


CUTS = "cuts as (" + " union all ".join(
    f"select '{name}' as classifier, {w}::int as wp, {_quantile(c, str((100 - w) / 100))} as cut"
    for name, c in (("network", "net"), ("baseline", "rnn")) for w in WORKING_POINTS) + ")"


@query(with_parts("scores", f"""
with {CUTS}
select wp, count(*) filter (where not is_fake)::bigint as n_signal,
       {r('sum(w_mc) filter (where not is_fake)')} as w_signal,
       count(*) filter (where is_fake)::bigint as n_background,
       {r('coalesce(sum(w_mc) filter (where is_fake), 0)')} as w_background
from cuts join scores on net > cut where classifier = 'network' group by wp"""))
def wp_pass_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = network_counts(spark, d)
    points = roc.working_points(counts, WORKING_POINTS)
    passed = roc.above_cuts(counts, points, len(WORKING_POINTS))
    return passed.select("wp", "n_signal", rd("w_signal").alias("w_signal"), "n_background",
                         rd("w_background").alias("w_background"))


@query(with_parts("scores", f"""
with {TWO_SCORES}, {CUTS},
passing as (select c.classifier || ':' || c.wp as curve, b.score, b.is_fake, b.w_mc
            from cuts c join both_scores b on b.classifier = c.classifier and b.score > c.cut),
{_curve_sql('passing', 'curve')}
select curve, {r('threshold')} as threshold, {r(NO_NAN.format('fpr'))} as fpr,
       {r(NO_NAN.format('tpr'))} as tpr from points"""))
def wp_curves(spark: SparkSession, d: str) -> DataFrame:
    """The curve above each working point of each classifier."""
    counts = report.curve_counts(fx.scores(spark, d), classifiers(), is_signal(), F.col("w_mc"))
    points = roc.working_points(counts, WORKING_POINTS, ["classifier"])
    curves = roc.curves_above_cuts(counts, points, len(WORKING_POINTS), ["classifier"], 2)
    name = F.concat_ws(":", "classifier", F.col("wp").cast("string"))
    return curves.select(name.alias("curve"), *[rd(c).alias(c) for c in ("threshold", "fpr", "tpr")])


@query(with_parts("scores", f"""
with {TWO_SCORES}, {CUTS},
passing as (select c.classifier, c.wp, c.cut, b.score, b.is_fake, b.w_mc,
                   {PRED5} as pred, {TRUTH5} as truth
            from cuts c join both_scores b on b.classifier = c.classifier and b.score > c.cut),
totals as (select classifier, sum(case when is_fake then 0 else w_mc end) as p,
                  sum(case when is_fake then w_mc else 0 end) as n from both_scores group by 1),
summary as (
  select classifier, wp, any_value(cut) as cut, count(*)::bigint as n_pass,
         sum(case when is_fake then 0 else w_mc end) as p,
         sum(case when is_fake then w_mc else 0 end) as n
  from passing group by 1, 2),
h as (select classifier, wp, score, sum(case when is_fake then 0 else w_mc end) as pos,
             sum(case when is_fake then w_mc else 0 end) as neg from passing group by 1, 2, 3),
area as (select a.classifier, a.wp,
                sum(a.pos * b.neg * case when a.score > b.score then 1::double
                    when a.score = b.score then 0.5::double else 0 end)
                / nullif(sum(a.pos * b.neg), 0) as auc
         from h a join h b on a.classifier = b.classifier and a.wp = b.wp group by 1, 2),
cells as (select classifier, wp, pred, truth, sum(w_mc) as w from passing group by 1, 2, 3, 4),
normed as (
  select *, w / (sum(w) over (partition by classifier, wp, truth) + 1e-12::double) as bt,
         w / (sum(w) over (partition by classifier, wp, pred) + 1e-12::double) as bp from cells),
diag as (select classifier, wp, sum(bt) filter (where pred = truth) / 5 as dt,
                sum(bp) filter (where pred = truth) / 5 as dp from normed group by 1, 2)
select s.classifier, s.wp, {r('s.cut')} as cut, s.n_pass, {r('s.p / t.p')} as efficiency,
       {r('t.n / nullif(s.n, 0)')} as rejection, {r('area.auc')} as auc,
       {r('diag.dt')} as diag_by_truth, {r('diag.dp')} as diag_by_pred
from summary s join totals t using (classifier) join area using (classifier, wp)
join diag using (classifier, wp)"""))
def evaluation_report(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.scores(spark, d)
    table = report.evaluation_report(rows, classifiers(), fx.score_vector(), F.col("label"),
                                     is_signal(), F.col("w_mc"))
    return table.select("classifier", "wp", "n_pass", *[rd(c).alias(c) for c in (
        "cut", "efficiency", "rejection", "auc", "diag_by_truth", "diag_by_pred")])

"""Queries that apply or fit a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setframe.functions.labels import argmax
from setframe.functions.ragged import masked_sum
from setframe.operators import importance, scoring, splitting, training
from setframe.operators.assemble import model_inputs
from setframe.session import scratch_path
from setframe.sources import sinks
from workload import fixtures as fx
from workload.dialect import r, with_parts
from workload.registry import Area, rd

AREA = Area()
query = AREA.query


def network_inputs(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.with_model_scalars(fx.cand(spark, d))
    rows = fx.with_tracks(rows, spark, d, fx.OBJECT_FEATURES)
    return model_inputs(rows, {"tracks": (fx.OBJECT_FEATURES, fx.CAPS["tracks"])},
                        fx.SCALAR_FEATURES, ["id", "label", "w_mc", "source"])


# ---- the tiny network written out in SQL --------------------------------------------------

def _num(x: float) -> str:
    return f"({x!r}::double)"


def _pooled_sql(slot: dict[str, str]) -> list[str]:
    """Two pooled units; ``slot[f'{feature}_{s}']`` is the SQL of one tensor entry."""
    w, b = fx.phi_weights()
    pooled = []
    for k in range(2):
        terms = []
        for s in range(3):
            xs = [slot[f"{f}_{s}"] for f in fx.OBJECT_FEATURES]
            z = " + ".join(f"{x} * {_num(w[i][k])}" for i, x in enumerate(xs)) + f" + {_num(b[k])}"
            absent = " and ".join(f"{x} = -999" for x in xs)
            terms.append(f"(case when {absent} then 0::double when {z} > 0 then {z}"
                         f" else exp(least({z}, 0)) - 1 end)")
        pooled.append(" + ".join(terms))
    return pooled


def _logits_sql(inputs: list[str]) -> list[str]:
    w, b = fx.head_weights()
    return [" + ".join(f"{x} * {_num(w[i][c])}" for i, x in enumerate(inputs)) + f" + {_num(b[c])}"
            for c in range(6)]


SLOTS = [f"{f}_{s}" for f in fx.OBJECT_FEATURES for s in range(3)]
WIDE = f"""wide as (
  select c.id, any_value(label) as label, any_value(w_mc) as w_mc, any_value(source) as source,
         any_value(pt) / 500000::double as x_pt, any_value(eta) / 3::double as x_eta,
         {', '.join(f"coalesce(max(case when idx = {s + 1} then {f} end), -999::double) as {f}_{s}"
                    for f in fx.OBJECT_FEATURES for s in range(3))}
  from cand c left join obj o on o.id = c.id group by c.id)"""


def _scored_sql(source: str, keep: str) -> str:
    """CTEs ``pooled`` -> ``logits`` -> ``probs`` over a table of (h0, h1, x_pt, x_eta)."""
    logits = _logits_sql(["h0", "h1", "x_pt", "x_eta"])
    top = "greatest(l0, l1, l2, l3, l4, l5)"
    total = " + ".join(f"exp(l{c} - {top})" for c in range(6))
    return f"""logits as (select {keep}, {', '.join(f'{z} as l{c}' for c, z in enumerate(logits))}
                          from {source}),
    probs as (select {keep}, {', '.join(f'exp(l{c} - {top}) / ({total}) as p{c}'
                                         for c in range(6))} from logits)"""


BASE_POOLED = _pooled_sql({s: s for s in SLOTS})
SCORED = f"""{WIDE},
pooled as (select id, label, w_mc, source, x_pt, x_eta, {BASE_POOLED[0]} as h0,
                  {BASE_POOLED[1]} as h1 from wide),
{_scored_sql('pooled', 'id, label, w_mc, source')}"""


@query(with_parts("cand obj", f"""
with {SCORED}
select id, {', '.join(f'{r(f"p{c}")} as s{c}' for c in range(6))} from probs"""))
def batch_score(spark: SparkSession, d: str) -> DataFrame:
    scored = scoring.batch_score(network_inputs(spark, d), fx.tiny_model(), ["id"])
    return scored.select("id", *[rd(F.col("scores")[c]).alias(f"s{c}") for c in range(6)])


# ---- permutation importance ---------------------------------------------------------------

def _variant_sql() -> str:
    selects = [f"select '' as feature, id, label, w_mc, x_pt, x_eta, {BASE_POOLED[0]} as h0,"
               f" {BASE_POOLED[1]} as h1 from moved"]
    for f in fx.OBJECT_FEATURES:
        slots = {s: (f"d_{s}" if s.startswith(f) else s) for s in SLOTS}
        h0, h1 = _pooled_sql(slots)
        selects.append(f"select '{f}', id, label, w_mc, x_pt, x_eta, {h0}, {h1} from moved")
    for f in fx.SCALAR_FEATURES:
        x = {"x_pt": "x_pt", "x_eta": "x_eta", f: f"d_{f}"}
        selects.append(f"select '{f}', id, label, w_mc, {x['x_pt']}, {x['x_eta']},"
                       f" {BASE_POOLED[0]}, {BASE_POOLED[1]} from moved")
    return " union all ".join(selects)


MOVED = ", ".join(f"coalesce(lead({c}) over w, first_value({c}) over w) as d_{c}"
                  for c in [*SLOTS, *fx.SCALAR_FEATURES])


@query(with_parts("cand obj", f"""
with {WIDE},
moved as (select *, {MOVED} from wide
          window w as (order by substr(md5('42:' || id::varchar), 1, 16), id)),
variants as ({_variant_sql()}),
{_scored_sql('variants', 'feature, id, label, w_mc')},
summed as (
  select feature,
         avg(w_mc * -ln(least(greatest(case label when 0 then p0 when 1 then p1 when 2 then p2
             when 3 then p3 when 4 then p4 else p5 end, 1e-7::double), 1 - 1e-7::double))) as loss,
         avg(((case greatest(p0, p1, p2, p3, p4, p5) when p0 then 0 when p1 then 1 when p2 then 2
              when p3 then 3 when p4 then 4 else 5 end) = label)::int::double) as accuracy
  from probs group by feature),
deltas as (select f.feature, f.loss - b.loss as loss_delta, b.accuracy - f.accuracy as acc_delta
           from summed f, summed b where b.feature = '' and f.feature <> '')
select feature, {r('loss_delta')} as loss_delta, {r('acc_delta')} as accuracy_delta,
       rank() over (order by loss_delta desc)::int as importance_rank from deltas"""))
def permutation_rank(spark: SparkSession, d: str) -> DataFrame:
    ranked = importance.permutation_importance(
        network_inputs(spark, d), fx.tiny_model(), dict(fx.MODEL_FEATURES), "id", "label", "w_mc")
    path = scratch_path(spark, "importance")
    sinks.write_importance(ranked, path)
    back = spark.read.csv(path, header=True, schema=ranked.schema)
    return back.select("feature", rd("loss_delta").alias("loss_delta"),
                       rd("accuracy_delta").alias("accuracy_delta"), "importance_rank")


# ---- training -----------------------------------------------------------------------------

TRAIN_FEATURES = ["x_pt", "x_eta", "rnn", "g1_sum", "g2_sum", "g3_sum"]


@query(with_parts("cand", f"""
with s as (select label, case when substr(md5('42-test:' || file), 1, 8) < '33333333' then 'test'
                              when substr(md5('42-val:' || file), 1, 8) < '33333333' then 'val'
                              else 'train' end as split from cand)
select split, count(*)::bigint as n,
       {', '.join(f"count(*) filter (where label = {c})::bigint as n_{c}" for c in range(6))},
       true as fit_beats_chance from s group by split"""))
def train_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Fit on the train share with class weights; for every share its rows by class, and whether the
    fit beats on the train share what the class shares alone give (``training_metrics``)."""
    scored = _trained(spark, d)
    table = scored.groupBy("split").agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(F.col("label") == c).alias(f"n_{c}") for c in range(6)])
    fitted = _metrics(scored).where("split = 'train'").select("beats_shares").scalar()
    return table.select("split", "n", *[f"n_{c}" for c in range(6)],
                        fitted.alias("fit_beats_chance"))


def training_metrics(spark: SparkSession, d: str) -> DataFrame:
    """What SQL cannot state of ``train_classifier``, for every share: loss and accuracy of the fit, by
    rows and by training weight, against those of the train share's weighted class shares."""
    return _metrics(_trained(spark, d))


def _metrics(scored: DataFrame) -> DataFrame:
    plain = scoring.loss_and_accuracy(scored, F.col("scores"), F.col("label"), F.col("pred"),
                                      group=["split"])
    return plain.join(training.against_class_shares(
        scored, F.col("scores"), "label", F.col("pred"), "train_weight", "split", "train"), "split")


def _trained(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.with_model_scalars(fx.cand_with_file(spark, d))
    rows = fx.with_tracks(rows, spark, d, fx.OBJECT_FEATURES)
    pooled = masked_sum("tracks", fx.OBJECT_FEATURES, fx.CAPS["tracks"])
    rows = rows.select("id", "file", "label", "w_mc", "x_pt", "x_eta", "rnn",
                       *[p.alias(f"{f}_sum") for f, p in zip(fx.OBJECT_FEATURES, pooled)])
    rows = training.with_class_weight(splitting.hash_split(rows, "file"), "label", "w_mc")
    path = scratch_path(spark, "training")
    rows.write.partitionBy("split").parquet(path)
    stored = spark.read.parquet(path)
    model = training.fit_classifier(stored.where("split = 'train'"), TRAIN_FEATURES, "label",
                                    "train_weight", max_iter=20)
    return training.predict(model, stored).withColumn("pred", argmax(F.col("scores")))

"""Queries on a real fit: its epochs, its checkpoints, and what its newest model scores and ranks.

The SQL makes the same steps: every step is a table of one row that holds the weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setframe.operators import descent, importance, splitting, training
from setframe.functions.ragged import masked_sum
from setframe.operators.linear import LinearModel
from setframe.plans import train
from setframe.session import scratch_path
from workload import fixtures as fx
from workload.dialect import r, with_parts
from workload.registry import Area, rd

AREA = Area()
query = AREA.query

FEATURES = ["x_pt", "x_eta", "rnn", "g1_sum", "g2_sum", "g3_sum"]
RUN = descent.Descent(epochs=4, steps=3, rate=0.1, momentum=0.5)
CLASSES = range(6)


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with one number per feature, a split by file and a training weight."""
    rows = fx.with_model_scalars(fx.cand_with_file(spark, d))
    rows = fx.with_tracks(rows, spark, d, fx.OBJECT_FEATURES)
    pooled = masked_sum("tracks", fx.OBJECT_FEATURES, fx.CAPS["tracks"])
    rows = rows.select("id", "file", "label", "is_fake", "w_mc", "x_pt", "x_eta", "rnn",
                       *[p.alias(f"{f}_sum") for f, p in zip(fx.OBJECT_FEATURES, pooled)])
    return training.with_class_weight(splitting.hash_split(rows, "file"), "label", "w_mc")


def fitted(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """The history of a run, and the folder that holds its runs."""
    runs = scratch_path(spark, "runs")
    epochs = train.fit_pooled(samples(spark, d), FEATURES, "id", f"{runs}/first", "label",
                              "train_weight", "w_mc", RUN)
    return epochs, runs


# ---- the same run in SQL ------------------------------------------------------------------

def _samples_sql() -> str:
    sums = ", ".join(f"coalesce(sum({f}) filter (where idx <= 3), 0::double) as f{j}"
                     for j, f in enumerate(fx.OBJECT_FEATURES, 3))
    return f"""weights as materialized (
      select label, sum(count(*)) over ()::double / 2 / count(*) as class_weight,
             count(*)::double / sum(count(*)) over () as share from cand group by label),
    samples as materialized (
      select t.*, class_weight * w_mc as tw,
             case when substr(md5('42-test:' || file), 1, 8) < '33333333' then 'test'
                  when substr(md5('42-val:' || file), 1, 8) < '33333333' then 'val'
                  else 'train' end as split
      from (select c.id, c.file, c.label, c.is_fake, c.w_mc, c.pt / 500000::double as f0,
                   c.eta / 3::double as f1, c.rnn as f2, {sums}
            from cand c left join obj o on o.id = c.id group by all) t join weights using (label)),
    ranked as materialized (
      select *, row_number() over (partition by is_fake
                  order by substr(md5('42:' || id::varchar), 1, 16), id) - 1 as place,
             count(*) over (partition by is_fake) as n_kind, count(*) over () as n_all
      from samples where split = 'train'),
    batches as materialized (
      select * from (select *, place // greatest(1, floor(n_kind::double / n_all
                       * (n_all // {RUN.steps}))::bigint) as batch from ranked) t
      where batch < {RUN.steps}),
    moments as materialized (select {', '.join(
        f'avg(f{j}) as m{j}, stddev_pop(f{j}) + 1e-8::double as s{j}' for j in range(6))}
      from batches)"""


def _model(c: int, inputs: list[str]) -> str:
    return " + ".join([f"b{c}", *(f"w{c}_{j} * {x}" for j, x in enumerate(inputs))])


def _probabilities_sql(source: str, keep: str, model: str, inputs: list[str]) -> str:
    """A subquery with ``p0 .. p5`` of the rows of ``source``."""
    logits = ", ".join(f"{_model(c, inputs)} as l{c}" for c in CLASSES)
    top = "greatest(l0, l1, l2, l3, l4, l5)"
    total = " + ".join(f"exp(l{c} - {top})" for c in CLASSES)
    return f"""(select *, {', '.join(f'exp(l{c} - {top}) / ({total}) as p{c}' for c in CLASSES)}
        from (select {keep}, {logits} from {source}, moments, {model}) l)"""


OWN = "case label when 0 then p0 when 1 then p1 when 2 then p2 when 3 then p3 when 4 then p4 else p5 end"
LOSS = f"-ln(least(greatest({OWN}, 1e-7::double), 1 - 1e-7::double))"
PRED = """(case greatest(p0, p1, p2, p3, p4, p5) when p0 then 0 when p1 then 1 when p2 then 2
           when p3 then 3 when p4 then 4 else 5 end)"""
SCALED = [f"((f{j} - m{j}) / s{j})" for j in range(6)]
COLUMNS = [*(f"b{c}" for c in CLASSES), *(f"w{c}_{j}" for c in CLASSES for j in range(6))]


def _run_sql() -> str:
    """CTEs up to ``epochs`` (losses by epoch) and ``model_<epoch>``."""
    first = [f"ln(greatest(coalesce(max(share) filter (where label = {c}), 0), 1e-9::double)) as b{c}"
             for c in CLASSES]
    zeros = [f"0::double as w{c}_{j}" for c in CLASSES for j in range(6)]
    still = [f"0::double as v_{name}" for name in COLUMNS]
    parts = [_samples_sql(), f"step_0 as materialized (select {', '.join([*first, *zeros, *still])},"
                             " 0::double as loss, 0::double as total from weights)"]
    epochs = []
    for k in range(RUN.epochs * RUN.steps):
        sums = []
        for c in CLASSES:
            off = f"tw * (p{c} - (label = {c})::int)"
            sums.append(f"sum({off}) as g_b{c}")
            sums += [f"sum({off} * {x}) as g_w{c}_{j}" for j, x in enumerate(
                f"x{j}" for j in range(6))]
        keep = "label, tw, " + ", ".join(f"{x} as x{j}" for j, x in enumerate(SCALED))
        rows = _probabilities_sql(f"(select * from batches where batch = {k % RUN.steps}) b", keep,
                                  f"step_{k}", SCALED)
        parts.append(f"""grad_{k} as materialized (select {', '.join(sums)}, sum(tw * {LOSS}) as batch_loss,
            sum(tw) as batch_total from {rows} p)""")
        speed = {c: f"({RUN.momentum}::double * v_{c} - {RUN.rate}::double * g_{c} / batch_total)"
                 for c in COLUMNS}
        new = k % RUN.steps == 0
        parts.append(f"""step_{k + 1} as materialized (select {', '.join(
            [f'{c} + {v} as {c}' for c, v in speed.items()] + [f'{v} as v_{c}' for c, v in speed.items()])},
            {'0' if new else 'loss'} + batch_loss as loss, {'0' if new else 'total'} + batch_total as total
            from step_{k}, grad_{k})""")
        if (k + 1) % RUN.steps == 0:
            e = k // RUN.steps
            rows = _probabilities_sql("(select * from samples where split = 'val') b", "label, w_mc",
                                      f"step_{k + 1}", SCALED)
            parts.append(f"""val_{e} as materialized (select label, w_mc, {PRED} as pred, {LOSS} as row_loss
                from {rows} p)""")
            epochs.append(f"""select {e} as epoch, (select loss / total from step_{k + 1}) as loss,
                sum(w_mc * row_loss) / sum(w_mc) as val_loss, avg((pred = label)::int::double) as val_accuracy,
                count(*) as val_rows from val_{e}""")
    parts.append(f"epochs as materialized ({' union all '.join(epochs)})")
    parts.append("best as materialized (select epoch from epochs order by val_loss, epoch limit 1)")
    models = " union all ".join(f"select {e} as epoch, {', '.join(COLUMNS)} from step_{(e + 1) * RUN.steps}"
                                for e in range(RUN.epochs))
    parts.append(f"newest as materialized (select * from ({models}) m where epoch = (select epoch from best))")
    return ", ".join(parts)


SQL_RUN = _run_sql()


@query(with_parts("cand obj", f"""
with {SQL_RUN}
select epoch::int as epoch, {r('loss')} as loss, {r('val_loss')} as val_loss,
       {r('val_accuracy')} as val_accuracy, val_rows::bigint as val_rows from epochs"""))
def fit_history(spark: SparkSession, d: str) -> DataFrame:
    """Losses and accuracy of every epoch of a fit by gradient descent."""
    epochs, _ = fitted(spark, d)
    return epochs.select("epoch", *[rd(c).alias(c) for c in ("loss", "val_loss", "val_accuracy")],
                         "val_rows")


@query(with_parts("cand obj", f"""
with {SQL_RUN}
select 'first' as run, epoch::int as epoch, {r('val_loss')} as val_loss, {r('val_accuracy')} as val_accuracy
from epochs where epoch = (select epoch from best)"""))
def fit_best_epoch(spark: SparkSession, d: str) -> DataFrame:
    epochs, _ = fitted(spark, d)
    best = training.best_epoch(epochs.withColumn("run", F.lit("first")), carry=("val_accuracy",))
    return best.select("run", "epoch", rd("val_loss").alias("val_loss"),
                       rd("val_accuracy").alias("val_accuracy"))


@query(with_parts("cand obj", f"""
with {SQL_RUN}
select epoch::int as epoch, {r('val_loss')} as val_loss from epochs e
where not exists (select 1 from epochs o where o.epoch < e.epoch and o.val_loss <= e.val_loss)"""))
def fit_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """The epochs whose model was stored, from the files themselves, with the loss of each."""
    epochs, runs = fitted(spark, d)
    stored = (spark.read.option("basePath", f"{runs}/first/weights").parquet(f"{runs}/first/weights")
              .select("epoch"))
    return stored.join(epochs.select("epoch", "val_loss"), "epoch").select(
        "epoch", rd("val_loss").alias("val_loss"))


@query(with_parts("cand obj", f"""
with {SQL_RUN},
decoded as ({' union all '.join(f'select {e} as epoch, * from val_{e}' for e in range(RUN.epochs))}),
cells as (select epoch, pred, truth from range({RUN.epochs}) a(epoch), range(6) b(pred), range(6) c(truth))
select c.epoch::int as epoch, c.pred::int as pred, c.truth::int as truth,
       {r('coalesce(sum(w_mc), 0::double)')} as weight
from cells c left join decoded d on d.epoch = c.epoch and d.pred = c.pred and d.label = c.truth
group by c.epoch, c.pred, c.truth"""))
def fit_confusion(spark: SparkSession, d: str) -> DataFrame:
    epochs, _ = fitted(spark, d)
    return descent.confusion_by_epoch(epochs).select("epoch", "pred", "truth",
                                                     rd("weight").alias("weight"))


def newest_model(spark: SparkSession, d: str) -> LinearModel:
    """Train, store, and read back the newest stored model."""
    return train.newest(spark, fitted(spark, d)[1])


@query(with_parts("cand obj", f"""
with {SQL_RUN}
select id, {', '.join(f'{r(f"p{c}")} as s{c}' for c in CLASSES)}
from {_probabilities_sql("(select * from samples where split = 'test') b", 'id', 'newest', SCALED)} p"""))
def fit_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the test rows by the newest model of a fit; no Python on the way."""
    rows = samples(spark, d).where("split = 'test'")
    scored = newest_model(spark, d).score(rows, ["id"])
    return scored.select("id", *[rd(F.col("scores")[c]).alias(f"s{c}") for c in CLASSES])


def _ranked_sql() -> str:
    moved = ", ".join(f"coalesce(lead(f{j}) over w, first_value(f{j}) over w) as d{j}" for j in range(6))
    variants = []
    for name, at in [("", None), *((f, j) for j, f in enumerate(FEATURES))]:
        inputs = [f"({'d' if j == at else 'f'}{j} - m{j}) / s{j}" for j in range(6)]
        variants.append(f"""select '{name}' as feature, label, w_mc, p0, p1, p2, p3, p4, p5
            from {_probabilities_sql('moved b', 'label, w_mc', 'newest', [f'({x})' for x in inputs])} p""")
    return f"""moved as (select *, {moved} from samples where split = 'test'
        window w as (order by substr(md5('42:' || id::varchar), 1, 16), id)),
    variants as ({' union all '.join(variants)}),
    summed as (select feature, avg(w_mc * {LOSS}) as loss, avg(({PRED} = label)::int::double) as accuracy
               from variants group by feature)"""


@query(with_parts("cand obj", f"""
with {SQL_RUN}, {_ranked_sql()}
select f.feature, {r('f.loss - b.loss')} as loss_delta, {r('b.accuracy - f.accuracy')} as accuracy_delta,
       rank() over (order by f.loss - b.loss desc)::int as importance_rank
from summed f, summed b where b.feature = '' and f.feature <> ''"""))
def fit_rank(spark: SparkSession, d: str) -> DataFrame:
    """Permutation importance of the test rows by the newest model of a fit."""
    model = newest_model(spark, d)
    rows = model.vectors(samples(spark, d).where("split = 'test'"), ["id", "label", "w_mc"])
    ranked = importance.permutation_importance(rows, model.network(), {"scalars": model.features}, "id",
                                               "label", "w_mc")
    return ranked.select("feature", rd("loss_delta").alias("loss_delta"),
                         rd("accuracy_delta").alias("accuracy_delta"), "importance_rank")

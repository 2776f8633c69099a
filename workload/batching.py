"""Queries on ordering, splitting, batching, row sets and training histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setframe.operators import batching, sets, splitting, training
from workload import fixtures as fx
from workload.dialect import r, with_parts
from workload.registry import Area, rd

AREA = Area()
query = AREA.query

KEYED = """keyed as (select *, substr(md5('42:' || id::varchar), 1, 16) as k,
                            case when is_fake then 'fake' else 'signal' end as kind from cand)"""


def kinds(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("is_fake"), "fake").otherwise("signal")
    return fx.cand(spark, d).select("id", "label", kind.alias("kind"))


# ---- order and permutation ----------------------------------------------------------------

@query(with_parts("cand", """
select id, (ntile(7) over (order by id) - 1)::int as part from cand"""))
def ntile_split(spark: SparkSession, d: str) -> DataFrame:
    return splitting.contiguous_parts(fx.cand(spark, d).select("id"), "id", 7)


HOT = "case when id % 3 = 0 then 150000::double when id % 7 = 0 then 99::double else pt end"


@query(with_parts("cand", f"""
with {KEYED}
select id, (ntile(11) over (order by {HOT}, k, id) - 1)::int as part from keyed"""))
def ntile_hot(spark: SparkSession, d: str) -> DataFrame:
    """Contiguous parts in the order of a column in which two values hold close to half of the rows."""
    value = F.when(F.col("id") % 3 == 0, 150000.0).when(F.col("id") % 7 == 0, 99.0).otherwise(F.col("pt"))
    rows = fx.cand(spark, d).select("id", value.alias("value"))
    return splitting.contiguous_parts(rows, "value", 11, unit="id").select("id", "part")


@query(with_parts("cand", f"""
with {KEYED}
select id, (row_number() over (order by k, id) - 1)::bigint as position from keyed"""))
def shuffled_order(spark: SparkSession, d: str) -> DataFrame:
    return splitting.shuffled_positions(fx.cand(spark, d).select("id"), "id")


@query(with_parts("cand", f"""
with {KEYED}
select id, pt, coalesce(lead(pt) over w, first_value(pt) over w) as pt_permuted,
       coalesce(lead(eta) over w, first_value(eta) over w) as eta_permuted
from keyed window w as (order by k, id)"""))
def permute_feature(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.cand(spark, d).select("id", "pt", "eta")
    return splitting.permute_columns(rows, ["pt", "eta"], "id").drop("eta")


# ---- splits -------------------------------------------------------------------------------

@query(with_parts("cand", """
select id, file, case when substr(md5('42-test:' || file), 1, 8) < '33333333' then 'test'
                      when substr(md5('42-val:' || file), 1, 8) < '33333333' then 'val'
                      else 'train' end as split from cand"""))
def split_hash(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.cand_with_file(spark, d).select("id", "file")
    return splitting.hash_split(rows, "file")


@query(with_parts("split_files", "select source, file, split from split_files"))
def split_exact(spark: SparkSession, d: str) -> DataFrame:
    return splitting.exact_split(fx.files(spark, d).select("source", "file"), "file")


@query(with_parts("cand", """
select count(*)::bigint as n_whole, count(*)::bigint as n_parts, 0::bigint as n_missing,
       0::bigint as n_extra, 0::bigint as n_overlap from cand"""))
def split_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = splitting.hash_split(fx.cand_with_file(spark, d).select("id", "file"), "file")
    parts = {s: rows.where(F.col("split") == s) for s in ("train", "val", "test")}
    return sets.split_coverage(fx.cand(spark, d).select("id"), parts, "id")


@query(with_parts("cand", """
with parts as (
  select id from cand where id % 4 <> 0 union all select id from cand where id % 5 = 0
  union all select -id from cand where id % 50 = 1),
units as (select id, count(*) as p from parts group by id)
select (select count(*) from cand)::bigint as n_whole, (select count(*) from parts)::bigint as n_parts,
       (select count(*) from cand where id not in (select id from units))::bigint as n_missing,
       (select count(*) from units where id not in (select id from cand))::bigint as n_extra,
       (select count(*) from units where p > 1)::bigint as n_overlap"""))
def split_faults(spark: SparkSession, d: str) -> DataFrame:
    """The same proof on parts that overlap, miss units of the whole, and hold others."""
    whole = fx.cand(spark, d).select("id")
    parts = {"a": whole.where("id % 4 <> 0"), "b": whole.where("id % 5 = 0"),
             "c": whole.where("id % 50 = 1").select((-F.col("id")).alias("id"))}
    return sets.split_coverage(whole, parts, "id")


@query(with_parts("cand", "select id, is_fake::int as is_fake, pt from cand"))
def union_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.cand(spark, d).select("id", F.col("is_fake").cast("int").alias("is_fake"), "pt")
    signal = rows.where("is_fake = 0")
    background = rows.where("is_fake = 1").select("pt", "is_fake", "id")
    return sets.union_classes([signal, background])


# ---- batches ------------------------------------------------------------------------------

PLAN = f"""{KEYED}, total as (select count(*) as n from cand),
plan as (
  select kind, count(*)::bigint as n_rows,
         floor(count(*)::double / (select n from total) * 526)::int as batch_rows,
         ceil(count(*)::double / (select n from total) * 526)::int as batch_rows_ceil,
         ((select n from total) // 526)::bigint as steps
  from keyed group by kind)"""


@query(with_parts("cand", f"with {PLAN} select * from plan"))
def batch_plan(spark: SparkSession, d: str) -> DataFrame:
    return batching.batch_plan(kinds(spark, d), "kind")


@query(with_parts("cand", f"""
with {PLAN},
ranked as (select id, label, kind, row_number() over (partition by kind order by k, id) - 1 as place
           from keyed)
select id, label, kind, (place // batch_rows)::bigint as batch_id,
       (place % batch_rows)::bigint as slot, (place // batch_rows < steps) as in_epoch
from ranked join plan using (kind)"""))
def mixed_batches(spark: SparkSession, d: str) -> DataFrame:
    return batching.mixed_batches(kinds(spark, d), "id", "kind")


@query(with_parts("cand", f"""
with {PLAN},
ranked as (select id, kind, row_number() over (partition by kind order by k, id) - 1 as place
           from keyed),
slots as (
  select kind, b.batch_id, s.slot, (b.batch_id * greatest(batch_rows, 1) + s.slot) % n_rows as place
  from plan, (select unnest(range(ceil(2.5 * (select max(steps) from plan))::bigint)) as batch_id) b,
       (select unnest(range(526)) as slot) s
  where s.slot < greatest(batch_rows, 1))
select id, kind, batch_id::bigint as batch_id, slot::bigint as slot
from slots join ranked using (kind, place)"""))
def batches_cyclic(spark: SparkSession, d: str) -> DataFrame:
    """Two and a half epochs of batches: both kinds start over twice."""
    return batching.cyclic_batches(kinds(spark, d).drop("label"), "id", "kind", 2.5)


# ---- training history ---------------------------------------------------------------------

@query(with_parts("history", f"""
select run, epoch, {r('val_loss')} as val_loss, {r('val_acc')} as val_acc
from (select *, row_number() over (partition by run order by val_loss, epoch) as rk
      from history) t where rk = 1"""))
def best_epoch(spark: SparkSession, d: str) -> DataFrame:
    best = training.best_epoch(fx.history(spark, d))
    return best.select("run", "epoch", rd("val_loss").alias("val_loss"),
                       rd("val_acc").alias("val_acc"))


@query(with_parts("history", f"""
select run, epoch, {r('val_loss')} as val_loss from history h
where not exists (select 1 from history e where e.run = h.run and e.epoch < h.epoch
                  and e.val_loss <= h.val_loss)"""))
def best_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    kept = training.best_checkpoints(fx.history(spark, d))
    return kept.select("run", "epoch", rd("val_loss").alias("val_loss"))

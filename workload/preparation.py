"""Queries on reading, cutting, cleaning, padding and summarising records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setframe.config import Collection, Cuts, DatasetConfig
from setframe.functions.clean import clean_nonfinite, zero_outliers
from setframe.functions.labels import onehot
from setframe.functions.ragged import (masked_sum, object_tensor, pad_clip,
                                       scalar_vector)
from setframe.operators import histograms, selection, splitting, stats
from setframe.operators.assemble import model_inputs
from setframe.session import materialise, scratch_path
from setframe.sources import scan, sinks
from workload import fixtures as fx
from workload.dialect import r, with_parts
from workload.registry import Area, rd

AREA = Area()
query = AREA.query


# ---- sources ------------------------------------------------------------------------------

OBJECT_CONFIG = DatasetConfig(
    collections=(Collection("tracks", ("l_quantity", "l_extendedprice"), 3),
                 Collection("neutral", ("l_extendedprice", "l_discount"), 6)),
    passthrough=("l_orderkey",), label="l_returnflag", weight="l_quantity")


@query("select l_quantity, l_extendedprice, l_discount, l_orderkey, l_returnflag from lineitem")
def scan_project(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan_dataset(spark, f"{d}/lineitem.parquet", OBJECT_CONFIG)


@query("""select l_orderkey, l_linenumber, l_extendedprice, l_discount from lineitem
          where l_extendedprice > 15000 and abs(l_discount) < 0.055""")
def scan_cut(spark: SparkSession, d: str) -> DataFrame:
    view = selection.CutView(scan.scan(spark, f"{d}/lineitem.parquet", [
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"]))
    narrower = view.with_cut("(l_extendedprice > 40000)")
    return narrower.with_cut("(l_extendedprice > 15000) & (abs(l_discount) < 5.5e-2)").rows


@query(with_parts("cand", """
select id, source, (case when source like 'JZ%' then 1 else 0 end)::int as is_fake from cand"""))
def label_from_source(spark: SparkSession, d: str) -> DataFrame:
    named = fx.cand(spark, d).select("id", "source")
    labelled = scan.with_source_label(named, F.col("source"))
    return labelled.withColumn("is_fake", F.col("is_fake").cast("int"))


@query(with_parts("cand", f"""
select source, count(*)::bigint as n_rows,
       {r('100::double * count(*) / (select count(*) from cand)', 4)} as percent
from cand group by source"""))
def rows_per_source(spark: SparkSession, d: str) -> DataFrame:
    counts = scan.rows_per_source(fx.cand(spark, d), "source")
    return counts.withColumn("percent", rd("percent", 4))


@query(with_parts("split_files", """
select id, source, file from cand
where file in (select file from split_files where split = 'train')"""))
def manifest_scan(spark: SparkSession, d: str) -> DataFrame:
    manifest = materialise(splitting.exact_split(fx.files(spark, d), "file"), "manifest")
    rows = fx.cand_with_file(spark, d)
    return scan.scan_manifest(rows, manifest, "train").select("id", "source", "file")


@query(with_parts("files", """
select source, file, date_diff('day', date '1970-01-01', created::date)::int as created_day
from (select *, row_number() over (partition by source order by created desc, file desc) as rk
      from files) t where rk = 1"""))
def latest_artifact(spark: SparkSession, d: str) -> DataFrame:
    newest = scan.latest_by(fx.files(spark, d), ["source"], "created", "file")
    day = F.datediff(F.col("created").cast("date"), F.lit("1970-01-01").cast("date"))
    return newest.select("source", "file", day.alias("created_day"))


@query(with_parts("cand", """
select 'JZ' || i::varchar as source from range(1, 13) g(i)
where 'JZ' || i::varchar not in (select source from cand)"""))
def missing_inputs(spark: SparkSession, d: str) -> DataFrame:
    expected = ["signal", *[f"JZ{i}" for i in range(1, 13)]]
    return scan.missing_inputs(fx.cand(spark, d), "source", expected)


@query(with_parts("files", """
select source, file, n_rows::bigint as n_rows from files
order by substr(md5('42:' || file), 1, 16), file limit 5"""))
def sample_sources(spark: SparkSession, d: str) -> DataFrame:
    return splitting.sample_units(fx.files(spark, d), "file", 5).select("source", "file", "n_rows")


# ---- sinks --------------------------------------------------------------------------------

@query(with_parts("cand", """
select source, chunk, count(*)::bigint as n_rows, min(id) as first_id, max(id) as last_id
from (select source, id, floor((row_number() over (partition by source order by id) - 1)
             / (case when source = 'JZ4' then 250 else 500 end))::int as chunk from cand) t
group by source, chunk"""))
def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    chunks = splitting.chunk_ids(fx.cand(spark, d).select("id", "source"), "id", 500, "source",
                                 {"JZ4": 250}, max_groups=len(fx.SOURCES))
    return chunks.groupBy("source", "chunk").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("id").alias("first_id"),
        F.max("id").alias("last_id"))


SCORE_OUTPUT = ["is_fake_score", "is_1p0n", "is_1p1n", "is_1pxn", "is_3p0n", "is_3pxn"]


@query(with_parts("scores", f"""
select {', '.join(f'{r(f"s{i}")} as {n}' for i, n in enumerate(SCORE_OUTPUT))},
       id, label, prong, pt, rnn, -999::double as mu, source from scores"""))
def scored_output(spark: SparkSession, d: str) -> DataFrame:
    passthrough = ["id", "label", "prong", "pt", "rnn", "mu", "source"]
    out = sinks.scored_output(fx.scores(spark, d), fx.score_vector(), SCORE_OUTPUT, passthrough)
    path = scratch_path(spark, "scored")
    sinks.write_scored(out, path)
    back = spark.read.parquet(path).select(out.columns)
    return back.select(*[rd(n).alias(n) for n in SCORE_OUTPUT],
                       *[rd(n).alias(n) if n == "rnn" else n for n in passthrough])


def _stats_sql(table: str, columns: list[str], places: int = 4) -> str:
    return " union all ".join(
        f"select '{c}' as feature, {r(f'avg({c})', places)} as mean,"
        f" {r(f'stddev_pop({c})', places)} as stddev from {table}" for c in columns)


STATS_COLUMNS = ["pt", "eta", "truth_pt", "truth_eta"]


@query(with_parts("cand", _stats_sql("cand", STATS_COLUMNS)))
def stats_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "stats")
    sinks.write_stats(stats.column_stats(fx.cand(spark, d), STATS_COLUMNS), path)
    back = sinks.read_stats(spark, path)
    return back.select("feature", rd("mean", 4).alias("mean"), rd("stddev", 4).alias("stddev"))


@query(with_parts("files", """
select source, file, (case when source like 'JZ%' then 0 else 1 end)::int as is_signal,
       case when rk <= ceil(n * 0.2::double) then 'test'
            when rk <= ceil(n * 0.2::double) + ceil((n - ceil(n * 0.2::double)) * 0.2::double)
              then 'val'
            else 'train' end as split
from (select source, file,
             row_number() over (partition by source
                                order by substr(md5('42:' || file), 1, 16), file) as rk,
             count(*) over (partition by source) as n from files) t"""))
def split_manifest(spark: SparkSession, d: str) -> DataFrame:
    manifest = splitting.exact_split(fx.files(spark, d).select("source", "file"), "file",
                                     ["source"], len(fx.SOURCES))
    manifest = scan.with_source_label(manifest, F.col("source"))
    manifest = manifest.select("split", "source", "file",
                               (~F.col("is_fake")).cast("int").alias("is_signal"))
    path = scratch_path(spark, "manifest")
    sinks.write_manifest(manifest, path)
    return sinks.read_manifest(spark, path).select("split", "source", "file", "is_signal")


# ---- cuts, cleaning, normalising ----------------------------------------------------------

CAND_CUTS = Cuts(shared=fx.BASE_CUT, signal_only=fx.SIGNAL_CUT)


@query(with_parts("cand", """
select id, source, label, pt, eta from cand
where pt > 15000 and abs(eta) < 2.5::double
  and (is_fake or (matched and abs(truth_eta) < 2.5::double and truth_pt > 15000))"""))
def apply_cuts(spark: SparkSession, d: str) -> DataFrame:
    kept = selection.apply_class_cuts(fx.cand(spark, d), CAND_CUTS, F.col("is_fake"))
    return kept.select("id", "source", "label", "pt", "eta")


@query("""select l_orderkey as "object_key", l_quantity as "object_quantity",
                 l_extendedprice as "object_price" from lineitem""")
def tidy_columns(spark: SparkSession, d: str) -> DataFrame:
    raw = fx.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("object.key"), F.col("l_quantity").alias("object.quantity"),
        F.col("l_extendedprice").alias("object.price"), F.col("l_tax").alias("cluster.tax"),
        F.col("l_discount").alias("cluster.discount"))
    return selection.tidy_columns(raw, ["cluster"])


@query(with_parts("cand", f"""
select id, rnn, {r('(pt - mp) / (sp + 1e-8::double)')} as pt_normed,
       {r('(eta - me) / (se + 1e-8::double)')} as eta_normed,
       {r('(truth_pt - mt) / (st + 1e-8::double)')} as truth_pt_normed
from cand, (select avg(pt) as mp, stddev_pop(pt) as sp, avg(eta) as me, stddev_pop(eta) as se,
                   avg(truth_pt) as mt, stddev_pop(truth_pt) as st from cand) s"""))
def normalise_scalar(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.cand(spark, d).select("id", "pt", "eta", "truth_pt", "rnn")
    known = stats.stats_lookup(stats.column_stats(rows, ["pt", "eta", "truth_pt"]))
    normed = stats.normalise_columns(rows, known, ["pt", "eta", "truth_pt", "rnn"])
    return normed.select("id", "rnn", *[rd(f"{c}_normed").alias(f"{c}_normed") for c in known])


@query(f"""
with long as (
  select vec_id, unnest(embedding)::double as x,
         unnest(range(len(embedding)))::int as pos from embeddings),
s as (select avg(x) as m, stddev_pop(x) as sd from long)
select vec_id, pos, {r('(x - m) / (sd + 1e-8::double)')} as value from long, s""")
def normalise_array(spark: SparkSession, d: str) -> DataFrame:
    """Every element of every list is normalised by the moments of all elements."""
    lists = fx.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    known = stats.stats_lookup(stats.column_stats(stats.flatten_lists(lists, ["x"]), ["x"]))
    normed = stats.normalise_lists(lists, known, ["x"])
    return normed.select("vec_id", F.posexplode("x_normed").alias("pos", "value")) \
        .withColumn("value", rd("value"))


@query(with_parts("obj", """
select id, l_linenumber, l_partkey, case when abs(f1) < 40 then f1 else 0::double end as f1,
       case when abs(f3) < 40 then f3 else 0::double end as f3 from obj"""), name="zero_outliers")
def zero_outlier_rows(spark: SparkSession, d: str) -> DataFrame:
    return fx.objects(spark, d).select(
        "id", "l_linenumber", "l_partkey",
        *[zero_outliers(F.col(c), 40.0).alias(c) for c in ("f1", "f3")])


@query(with_parts("obj", """
select id, l_linenumber, l_partkey,
       case when isnan(f1) then 0::double when f1 = 'Infinity'::double
            then 1.7976931348623157e308::double else f1 end as f1, f2 from obj"""), name="clean_nonfinite")
def clean_rows(spark: SparkSession, d: str) -> DataFrame:
    return fx.objects(spark, d).select(
        "id", "l_linenumber", "l_partkey",
        *[clean_nonfinite(F.col(c)).alias(c) for c in ("f1", "f2")])



@query(with_parts("obj cand", """
select 'f1' as feature, count(*) filter (where isnan(f1))::bigint as n_nan,
       count(*)::bigint as n_rows from obj
union all select 'f2', 0, count(*) from obj
union all select 'label', count(*) filter (where not is_fake and (id % 50 = 0 or id % 51 = 0)),
       count(*) from cand
union all select 'w_mc', 0, count(*) from cand"""))
def nan_audit(spark: SparkSession, d: str) -> DataFrame:
    from setframe.functions.labels import class_label
    decay = (F.when(F.col("id") % 50 == 0, -1).when(F.col("id") % 51 == 0, 5)
             .otherwise(F.col("decay_mode")))
    rows = fx.cand(spark, d).select(class_label(F.col("is_fake"), decay).alias("label"), "w_mc")
    return stats.nan_audit(fx.objects(spark, d), ["f1", "f2"]).unionByName(
        stats.nan_audit(rows, ["label", "w_mc"]))


# ---- ragged lists -------------------------------------------------------------------------

def _cleaned(x: str) -> str:
    return (f"case when isnan({x}) then 0::double when {x} = 'Infinity'::double"
            f" then 1.7976931348623157e308::double else {x} end")


def _slot_sql(feature: str, slot: int, where: str = "true", idx: str = "idx",
              clean: bool = True) -> str:
    value = _cleaned(feature) if clean else feature
    return (f"coalesce(max(case when {where} and {idx} = {slot + 1} then {value} end),"
            f" -999::double)")


@query(with_parts("cand obj", f"""
select c.id, {', '.join(f"{_slot_sql('f3', s, clean=False)} as f3_{s}" for s in range(3))}
from cand c left join obj o on o.id = c.id group by c.id"""), name="pad_clip")
def padded_lists(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.with_tracks(fx.cand(spark, d).select("id"), spark, d, ["f3"])
    padded = rows.select("id", F.col("tracks.f3").alias("f3")).select(
        "id", pad_clip("f3", 3).alias("t"))
    return padded.select("id", *[F.col("t")[s].alias(f"f3_{s}") for s in range(3)])



@query(with_parts("cand obj", f"""
select c.id, {', '.join(f"{_slot_sql(f, s)} as {f}_{s}" for f in ('f1', 'f2', 'f3')
                        for s in range(3))}
from cand c left join obj o on o.id = c.id group by c.id"""))
def branch_tensor(spark: SparkSession, d: str) -> DataFrame:
    features = ["f1", "f2", "f3"]
    rows = fx.with_tracks(fx.cand(spark, d).select("id"), spark, d, features)
    tensor = rows.select("id", object_tensor("tracks", features, 3).alias("t"))
    return tensor.select("id", *[F.col("t")[i][s].alias(f"{f}_{s}")
                                 for i, f in enumerate(features) for s in range(3)])


VECTOR = ["pt", "eta", "truth_pt", "truth_eta", "rnn", "w_mc"]


@query(with_parts("cand", f"""
select id, {', '.join(f'{r(c)} as v{i}' for i, c in enumerate(VECTOR))} from cand"""), name="scalar_vector")
def scalar_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.cand(spark, d).select("id", scalar_vector(VECTOR).alias("v"))
    return rows.select("id", *[rd(F.col("v")[i]).alias(f"v{i}") for i in range(len(VECTOR))])


INPUT_FEATURES = ["f1", "f2", "f3"]


def _model_inputs_sql() -> str:
    slots = []
    for name, cap in fx.CAPS.items():
        where, idx = ("true", "idx") if name == "tracks" else (f"kind = '{name}'", "kidx")
        slots += [f"{_slot_sql(f, s, where, idx)} as {name}_{f}_{s}"
                  for f in INPUT_FEATURES for s in range(cap)]
    vector = [f"{r(f'any_value(c.{c})')} as scalar_{c}" for c in VECTOR]
    return f"""select c.id, any_value(c.label)::int as label, any_value(c.w_mc) as weight,
        {', '.join(slots)}, {', '.join(vector)}
        from cand c left join obj o on o.id = c.id group by c.id"""


def assembled_inputs(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.with_collections(fx.cand(spark, d), spark, d, INPUT_FEATURES)
    rows = rows.withColumn("weight", F.col("w_mc"))
    collections = {c: (INPUT_FEATURES, cap) for c, cap in fx.CAPS.items()}
    return model_inputs(rows, collections, VECTOR, ["id", "label", "weight"])


@query(with_parts("cand obj", _model_inputs_sql()), name="model_inputs")
def model_input_columns(spark: SparkSession, d: str) -> DataFrame:
    inputs = assembled_inputs(spark, d)
    slots = []
    for name, cap in fx.CAPS.items():
        slots += [F.col(name)[i * cap + s].alias(f"{name}_{f}_{s}")
                  for i, f in enumerate(INPUT_FEATURES) for s in range(cap)]
    vector = [rd(F.col("scalars")[i]).alias(f"scalar_{c}") for i, c in enumerate(VECTOR)]
    return inputs.select("id", "label", "weight", *slots, *vector)



@query(with_parts("cand obj", """
select collection, n_objects, count(*)::bigint as n_rows from (
  select c.id, count(o.id) as tracks, count(*) filter (where kind = 'neutral') as neutral,
         count(*) filter (where kind = 'shot') as shot,
         count(*) filter (where kind = 'conv') as conv
  from cand c left join obj o on o.id = c.id group by c.id) t
unpivot (n_objects for collection in (tracks, neutral, shot, conv))
group by collection, n_objects"""))
def multiplicity(spark: SparkSession, d: str) -> DataFrame:
    kinds = ["neutral", "shot", "conv"]
    counts = fx.objects(spark, d).groupBy("id").agg(
        F.count(F.lit(1)).alias("tracks"),
        *[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    rows = fx.cand(spark, d).select("id").join(counts, "id", "left").na.fill(0)
    return stats.multiplicity_histogram(rows, ["tracks", *kinds])


@query(with_parts("cand", f"""
select id, {', '.join(f'(label = {i})::int as y{i}' for i in range(6))} from cand"""))
def onehot_label(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.cand(spark, d).select("id", onehot(F.col("label")).alias("y"))
    return rows.select("id", *[F.col("y")[i].alias(f"y{i}") for i in range(6)])


@query(with_parts("cand obj", f"""
select c.id, {r('coalesce(sum(f2) filter (where idx <= 3), 0)')} as f2_sum,
       {r('coalesce(sum(f3) filter (where idx <= 3), 0)')} as f3_sum
from cand c left join obj o on o.id = c.id group by c.id"""))
def masked_pool(spark: SparkSession, d: str) -> DataFrame:
    features = ["f2", "f3"]
    rows = fx.with_tracks(fx.cand(spark, d).select("id"), spark, d, features)
    pooled = masked_sum("tracks", features, 3)
    return rows.select("id", *[rd(p).alias(f"{f}_sum") for f, p in zip(features, pooled)])


# ---- statistics ---------------------------------------------------------------------------

@query(with_parts("cand", """
select i::int as class_index, (select count(*) from cand where label = i)::bigint as total
from range(6) g(i)"""))
def class_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.vector_sums(fx.cand(spark, d), onehot(F.col("label")))


@query(with_parts("cand", f"""
select label, n, {r('(1::double / n) * (total / 2::double)')} as class_weight,
       {r('ln(n / total)')} as log_prior
from (select label, count(*)::bigint as n, (sum(count(*)) over ())::double as total
      from cand group by label) t"""))
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    weights = stats.class_weights(stats.class_counts(fx.cand(spark, d)))
    return weights.select("label", "n", rd("class_weight").alias("class_weight"),
                          rd("log_prior").alias("log_prior"))


def _rounded_stats(table: DataFrame) -> DataFrame:
    return table.select("feature", rd("mean", 4).alias("mean"), rd("stddev", 4).alias("stddev"),
                        "n")


def _counted_stats_sql(table: str, columns: list[str]) -> str:
    return " union all ".join(
        f"select '{c}' as feature, {r(f'avg({c})', 4)} as mean,"
        f" {r(f'stddev_pop({c})', 4)} as stddev, count({c})::bigint as n from {table}"
        for c in columns)


@query(with_parts("cand obj", _counted_stats_sql("cand", ["pt", "eta", "rnn"]) + " union all "
                  + _counted_stats_sql("obj", ["f2", "f3", "l_quantity"])))
def column_stats(spark: SparkSession, d: str) -> DataFrame:
    records = stats.column_stats(fx.cand(spark, d), ["pt", "eta", "rnn"])
    flattened = stats.column_stats(fx.objects(spark, d), ["f2", "f3", "l_quantity"])
    return _rounded_stats(records.unionByName(flattened))


def _robust_sql(table: str, column: str) -> str:
    return f"""select '{column}' as feature, {r('avg(x)', 4)} as mean,
        {r('stddev_pop(x)', 4)} as stddev, count(*)::bigint as n
        from (select {column}::double as x from {table}) t
        where x - (select avg({column}) from {table})
              < 5 * (select stddev_pop({column}) from {table})"""


@query(" union all ".join([_robust_sql("events", "value"), _robust_sql("documents", "n_chars"),
                           _robust_sql("lineitem", "l_extendedprice")]))
def robust_stats(spark: SparkSession, d: str) -> DataFrame:
    parts = [stats.robust_stats(fx.table(spark, d, t), [c]) for t, c in
             (("events", "value"), ("documents", "n_chars"), ("lineitem", "l_extendedprice"))]
    return _rounded_stats(parts[0].unionByName(parts[1]).unionByName(parts[2]))


BIN_SQL = "floor((pt - 15e3::double) / (1e7::double - 15e3::double) * 500::double)::int"
EDGES_SQL = f"""{r('15e3::double + i * (9985e3::double / 500)', 4)} as lo,
                {r('15e3::double + (i + 1) * (9985e3::double / 500)', 4)} as hi"""


def _rounded_edges(df: DataFrame, *rest: str) -> DataFrame:
    return df.select("bin", rd("lo", 4).alias("lo"), rd("hi", 4).alias("hi"), *rest)


@query(with_parts("cand", f"""
with b as (select {BIN_SQL} as bin, count(*) as n from cand
           where pt >= 15e3::double and pt < 1e7::double group by 1)
select i::int as bin, {EDGES_SQL}, coalesce(n, 0)::bigint as value
from range(500) g(i) left join b on b.bin = i"""))
def hist_fixed(spark: SparkSession, d: str) -> DataFrame:
    return _rounded_edges(histograms.fixed_histogram(fx.cand(spark, d), "pt"), "value")


RATIO_SQL = f"""ratio as (
  select bin, signal, background,
         case when background = 0 then 0::double else signal / background end as value
  from (select {BIN_SQL} as bin, (count(*) filter (where not is_fake))::double as signal,
               (count(*) filter (where is_fake))::double as background
        from cand where pt >= 15e3::double and pt < 1e7::double group by 1) t)"""


@query(with_parts("cand", f"""
with {RATIO_SQL}
select i::int as bin, {EDGES_SQL}, coalesce(signal, 0)::double as signal,
       coalesce(background, 0)::double as background, {r('coalesce(value, 0)')} as value
from range(500) g(i) left join ratio on ratio.bin = i"""))
def reweight_hist(spark: SparkSession, d: str) -> DataFrame:
    histogram = histograms.ratio_histogram(fx.cand(spark, d), "pt", F.col("is_fake"))
    path = scratch_path(spark, "histogram")
    sinks.write_histogram(histogram, path)
    back = sinks.read_histogram(spark, path)
    return _rounded_edges(back.withColumn("value", rd("value")), "signal", "background", "value")


def _reweighted(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.cand(spark, d).select("id", "is_fake", "pt")
    histogram = histograms.ratio_histogram(rows, "pt", F.col("is_fake"))
    return histograms.apply_reweight(rows, "pt", F.col("is_fake"), histogram)


@query(with_parts("cand", f"""
with {RATIO_SQL}
select id, pt, is_fake::int as is_fake,
       {r('case when is_fake then coalesce(value, 1::double) else 1::double end')} as pt_reweight
from cand left join ratio on pt >= 15e3::double and pt < 1e7::double and ratio.bin = {BIN_SQL}"""))
def pt_reweight(spark: SparkSession, d: str) -> DataFrame:
    return _reweighted(spark, d).select("id", "pt", F.col("is_fake").cast("int").alias("is_fake"),
                                        rd("pt_reweight").alias("pt_reweight"))


@query(with_parts("cand", f"""
with {RATIO_SQL}
select bin, {r('signal')} as signal, {r('background * value')} as background,
       {r('signal - background * value')} as difference from ratio"""))
def reweight_closure(spark: SparkSession, d: str) -> DataFrame:
    closure = histograms.reweight_closure(_reweighted(spark, d), "pt", F.col("is_fake"),
                                          "pt_reweight")
    return closure.select("bin", *[rd(c).alias(c)
                                   for c in ("signal", "background", "difference")])


def _auto_hist_sql(table: str, column: str, n_bins: int) -> str:
    return f"""select feature, bin, {r('lo0 + bin * ((hi0 - lo0) / ' + str(n_bins) + ')', 4)} as lo,
        {r('lo0 + (bin + 1) * ((hi0 - lo0) / ' + str(n_bins) + ')', 4)} as hi,
        count(*)::bigint as n
      from (select '{column}' as feature, lo0, hi0,
                   least(floor(({column} - lo0) / (hi0 - lo0) * {n_bins}::double),
                         {n_bins - 1})::int as bin
            from {table}, (select min({column})::double as lo0, max({column})::double as hi0
                           from {table}) e) t
      group by feature, bin, lo0, hi0"""


@query(with_parts("cand obj", " union all ".join(
    [_auto_hist_sql("cand", c, 500) for c in ("pt", "eta", "label", "w_mc")]
    + [_auto_hist_sql("obj", c, 500) for c in ("f2", "f3", "l_quantity")])))
def control_histograms(spark: SparkSession, d: str) -> DataFrame:
    pad = -999.0
    records = histograms.auto_histograms(fx.cand(spark, d), ["pt", "eta", "label", "w_mc"],
                                         pad=pad)
    listed = histograms.auto_histograms(fx.objects(spark, d), ["f2", "f3", "l_quantity"], pad=pad)
    both = records.unionByName(listed)
    return both.select("feature", "bin", rd("lo", 4).alias("lo"), rd("hi", 4).alias("hi"), "n")


ODD = """odd as (
  select case when l_linenumber = 1 then -999::double when l_linenumber = 2 then null else f1 end as f1,
         case when l_linenumber = 3 then -999::double else f3 end as f3 from obj)"""


@query(with_parts("obj", f"with {ODD}, usable as (select * from odd), " + ", ".join(
    f"{c}_rows as (select {c} from odd where {c} is not null and {c} <> -999 and isfinite({c}))"
    for c in ("f1", "f3")) + " " + " union all ".join(_auto_hist_sql(f"{c}_rows", c, 500) for c in ("f1", "f3"))))
def padded_histograms(spark: SparkSession, d: str) -> DataFrame:
    """Histograms of columns that hold pads, NULL, NaN and infinities, which are left out."""
    line = F.col("l_linenumber")
    rows = fx.objects(spark, d).select(
        F.when(line == 1, -999.0).when(line != 2, F.col("f1")).alias("f1"),
        F.when(line == 3, -999.0).otherwise(F.col("f3")).alias("f3"))
    found = histograms.auto_histograms(rows, ["f1", "f3"], pad=-999.0)
    return found.select("feature", "bin", rd("lo", 4).alias("lo"), rd("hi", 4).alias("hi"), "n")


SIDES = """sides as (
  select [x for x in embedding if x > 0] as up, [x for x in embedding if x <= 0] as down,
         vec_id from embeddings)"""


def _list_robust_sql(column: str) -> str:
    return f"""select '{column}' as feature, {r('avg(x)')} as mean, {r('stddev_pop(x)')} as stddev,
        count(*)::bigint as n from {column}_values
        where x - (select avg(x) from {column}_values) < 1.5 * (select stddev_pop(x) from {column}_values)"""


@query(f"""with {SIDES},
    up_values as (select unnest(up)::double as x from sides),
    down_values as (select unnest(down)::double as x from sides),
    vec_id_values as (select vec_id::double as x from sides)
""" + " union all ".join(_list_robust_sql(c) for c in ("vec_id", "up", "down")))
def list_stats(spark: SparkSession, d: str) -> DataFrame:
    """Trimmed moments of a scalar and of two list columns whose lists differ in length, one scan a pass."""
    rows = fx.table(spark, d, "embeddings").select(
        "vec_id", F.filter("embedding", lambda x: x > 0).alias("up"),
        F.filter("embedding", lambda x: x <= 0).alias("down"))
    found = stats.mixed_stats(rows, ["vec_id"], ["up", "down"], n_sigma=1.5)
    return found.select("feature", rd("mean").alias("mean"), rd("stddev").alias("stddev"), "n")


@query(with_parts("obj", f"""
with {ODD}
select 'f1' as feature, count(*) filter (where f1 is null or isnan(f1))::bigint as n_nan,
       count(*)::bigint as n_rows from odd
union all
select 'f2', count(*) filter (where l_partkey % 53 = 0 or l_suppkey % 7 = 0)::bigint, count(*)::bigint from obj"""))
def nan_audit_odd(spark: SparkSession, d: str) -> DataFrame:
    """The audit on columns that hold both NaN and NULL."""
    line = F.col("l_linenumber")
    f2 = (F.when(F.col("l_partkey") % 53 == 0, F.lit(float("nan")))
          .when(F.col("l_suppkey") % 7 != 0, F.col("f2")))
    rows = fx.objects(spark, d).select(
        F.when(line == 1, -999.0).when(line != 2, F.col("f1")).alias("f1"), f2.alias("f2"))
    return stats.nan_audit(rows, ["f1", "f2"])

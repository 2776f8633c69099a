"""Streams over several files, in several triggers, against the batch result."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from setframe.functions.ragged import pad_clip
from setframe.streaming import ingest


@pytest.fixture
def arriving(spark, tmp_path):
    path = f"{tmp_path}/in"
    spark.range(1000).select(
        "id", (F.col("id") % 3).cast("int").alias("label"), (F.col("id") * 0.5).alias("x"),
        F.transform(F.sequence(F.lit(0), F.col("id") % 5), lambda i: i * 1.0).alias("l")
    ).repartition(9).write.parquet(path)
    return path, spark.read.parquet(path).schema


def test_prepare_equals_batch_over_many_triggers(spark, arriving, tmp_path):
    path, schema = arriving
    stream = ingest.stream_files(spark, path, schema, files_per_trigger=2)

    def prepare(df):
        return df.where("x > 20").select("id", "label", pad_clip("l", 3).alias("l"))

    written = ingest.process_stream(prepare(stream), lambda d: d, "t", ["label"])
    want = prepare(spark.read.parquet(path))
    columns = ["id", "label", "l"]
    assert written.select(columns).exceptAll(want.select(columns)).count() == 0
    assert written.count() == want.count()


def test_running_stats_equal_batch(spark, arriving):
    path, schema = arriving
    stream = ingest.stream_files(spark, path, schema, files_per_trigger=2)
    out = ingest.keep_latest_totals(ingest.running_stats(stream, "label", ["x"]), "t")
    got = {r["label"]: r for r in ingest.latest_totals(spark, out).collect()}
    want = {r["label"]: r for r in
            ingest.running_stats(spark.read.parquet(path), "label", ["x"]).collect()}
    assert set(got) == set(want)
    for k, r in want.items():
        assert got[k]["n"] == r["n"]
        assert got[k]["x_mean"] == pytest.approx(r["x_mean"])
        assert got[k]["x_stddev"] == pytest.approx(r["x_stddev"])


def test_restart_continues_after_the_last_commit(spark, arriving, tmp_path):
    path, schema = arriving
    out, state = f"{tmp_path}/out", f"{tmp_path}/state"

    def once():
        stream = ingest.stream_files(spark, path, schema)
        ingest.write_until_done(stream.select("id"), "t", out, state)
        return spark.read.parquet(out).count()

    assert once() == 1000
    assert once() == 1000
    spark.range(1000, 1010).select(
        "id", F.lit(0).alias("label"), F.lit(0.5).alias("x"),
        F.array(F.lit(1.0)).alias("l")).write.mode("append").parquet(path)
    assert once() == 1010


def test_processing_and_totals_continue_after_a_restart(spark, arriving, tmp_path):
    path, schema = arriving
    seen = []

    def once():
        stream = ingest.stream_files(spark, path, schema)
        rows = ingest.process_stream(stream, lambda df: df.select("id"), "t",
                                     path=f"{tmp_path}/rows", checkpoint=f"{tmp_path}/rows-state")
        totals = ingest.keep_latest_totals(ingest.running_stats(stream, "label", ["x"]), "t",
                                           f"{tmp_path}/totals", f"{tmp_path}/totals-state")
        n = ingest.latest_totals(spark, totals).agg({"n": "sum"}).first()[0]
        seen.append((rows.count(), n))

    once()
    once()
    spark.range(1000, 1010).select(
        "id", F.lit(0).alias("label"), F.lit(0.5).alias("x"),
        F.array(F.lit(1.0)).alias("l")).write.mode("append").parquet(path)
    once()
    assert seen == [(1000, 1000), (1000, 1000), (1010, 1010)]


def test_totals_keep_few_states(spark, arriving, tmp_path):
    """State for a few groups is one task and one file a trigger; the session's setting is as before."""
    path, schema = arriving
    before = spark.conf.get("spark.sql.shuffle.partitions")
    out, state = f"{tmp_path}/totals", tmp_path / "state"
    for _ in range(2):  # the second run has nothing to add
        stream = ingest.stream_files(spark, path, schema, files_per_trigger=3)
        ingest.keep_latest_totals(ingest.running_stats(stream, "label", ["x"]), "t", out, str(state), partitions=1)
        assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert [p.name for p in (state / "state" / "0").iterdir() if p.name.isdigit()] == ["0"]
    assert spark.read.parquet(out).select("batch_id").distinct().count() == 3
    got = {r["label"]: r["n"] for r in ingest.latest_totals(spark, out).collect()}
    assert got == {0: 334, 1: 333, 2: 333}


def test_first_run_takes_only_the_named_folders(spark, tmp_path):
    """A stream over a part of the folders, as `stream_files` runs it, goes on over the whole folder."""
    path, out, state = f"{tmp_path}/in", f"{tmp_path}/totals", f"{tmp_path}/state"
    spark.range(60).select("id", F.lit(1).alias("label"), (F.col("id") % 6).alias("file")).coalesce(1).write.partitionBy(
        "file").parquet(path)  # one task: all files have one name
    schema = spark.read.parquet(path).drop("file").schema
    seen = []
    for source in (f"{path}/{{file=0,file=1,file=2}}", path):
        stream = ingest.stream_files(spark, source, schema, "*.parquet", files_per_trigger=3)
        ingest.keep_latest_totals(ingest.running_stats(stream, "label", ["id"]), "t", out, state, partitions=1)
        seen.append((spark.read.parquet(out).select("batch_id").distinct().count(),
                     ingest.latest_totals(spark, out).first()["n"]))
    assert seen == [(1, 30), (2, 60)]


def test_a_trigger_of_one_task(spark, arriving, tmp_path):
    """Files brought to one task need no shuffle before the state; totals are as before, over a restart too,
    and no trigger writes a mark of success."""
    path, schema = arriving
    out, state = tmp_path / "totals", f"{tmp_path}/state"
    for _ in range(2):
        stream = ingest.stream_files(spark, path, schema, files_per_trigger=2).coalesce(1)
        ingest.keep_latest_totals(ingest.running_stats(stream, "label", ["x"]), "t", str(out), state, partitions=1)
    stored = [p for p in out.rglob("*") if p.is_file()]
    assert not [p for p in stored if p.name == "_SUCCESS"]
    assert len([p for p in stored if p.suffix == ".parquet"]) == 5
    got = {r["label"]: r for r in ingest.latest_totals(spark, str(out)).collect()}
    for r in ingest.running_stats(spark.read.parquet(path), "label", ["x"]).collect():
        assert got[r["label"]]["n"] == r["n"]
        assert got[r["label"]]["x_mean"] == pytest.approx(r["x_mean"])
        assert got[r["label"]]["x_stddev"] == pytest.approx(r["x_stddev"])

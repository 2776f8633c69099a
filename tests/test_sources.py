from __future__ import annotations

import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from setframe.operators import selection, splitting
from setframe.session import MAX_BROADCAST_ROWS, broadcast_bounded, scratch_path
from setframe.sources import scan, sinks


@pytest.fixture
def files(spark, tmp_path):
    for name, n in (("signal", 30), ("JZ1", 20), ("JZ2", 10)):
        spark.range(n).withColumn("x", F.col("id") * 1.0).withColumn("unused", F.lit("u")) \
            .repartition(2).write.parquet(f"{tmp_path}/{name}")
    return str(tmp_path)


def test_scan_prunes_and_pushes(spark, files):
    df = scan.scan(spark, [f"{files}/signal", f"{files}/JZ1"], ["x", "x"],
                   "(x > 3) & (abs(x) < 9.5)")
    assert df.columns == ["x"] and df.count() == 12
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<x:double>" in plan
    for pushed in ("GreaterThan(x,3.0)", "LessThan(x,9.5)", "GreaterThan(x,-9.5)"):
        assert pushed in plan


def test_glob_label_and_counts(spark, files):
    rows = scan.with_file(spark.read.parquet(f"{files}/*"))
    labelled = scan.with_source_label(rows, F.col("file"))
    assert labelled.where("is_fake").count() == 30
    shares = scan.rows_per_source(labelled, "file").collect()
    assert sum(r["n_rows"] for r in shares) == 60
    assert sum(r["percent"] for r in shares) == pytest.approx(100.0)


def test_missing_inputs(spark):
    df = spark.createDataFrame([("a",), ("b",)], "source string")
    scan.require_inputs(df, "source", ["a", "b"])
    with pytest.raises(ValueError, match="c, d"):
        scan.require_inputs(df, "source", ["d", "a", "c"])


def test_manifest_round_trip(spark, files, tmp_path_factory):
    tmp_path = tmp_path_factory.mktemp("manifest")
    listed = scan.with_file(spark.read.parquet(f"{files}/*")).select("file").distinct()
    listed = listed.withColumn("source", F.regexp_extract("file", "/([^/]+)/[^/]+$", 1))
    manifest = splitting.exact_split(listed, "file", ["source"], 3)
    sinks.write_manifest(manifest, f"{tmp_path}/manifest")
    back = sinks.read_manifest(spark, f"{tmp_path}/manifest")
    assert back.count() == listed.count()
    whole = spark.read.parquet(f"{files}/*").count()
    parts = {r["split"] for r in back.select("split").distinct().collect()}
    opened = sum(scan.read_split(spark, back, s, ["id"]).count() for s in parts)
    joined = sum(scan.scan_manifest(scan.with_file(spark.read.parquet(f"{files}/*")), back,
                                    s).count() for s in parts)
    assert opened == joined == whole
    assert sum(r["n_files"] for r in sinks.split_sizes(back).collect()) == listed.count()


def test_latest_path(spark, tmp_path):
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text(name)
        time.sleep(0.05)
    assert scan.latest_path(spark, str(tmp_path)).endswith("b.txt")


def test_write_chunks_bounds_files(spark, tmp_path):
    sinks.write_chunks(spark.range(0, 1000, 1, 2), f"{tmp_path}/c", 150)
    sizes = [r["count"] for r in
             scan.with_file(spark.read.parquet(f"{tmp_path}/c")).groupBy("file").count().collect()]
    assert max(sizes) <= 150 and sum(sizes) == 1000


def test_scored_output_fills_missing(spark):
    df = spark.createDataFrame([([0.1, 0.9], 5)], "s array<double>, mu int")
    out = sinks.scored_output(df, F.col("s"), ["a", "b"], ["mu", "absent"])
    assert tuple(out.first()) == (0.1, 0.9, 5, -999.0)


def test_cut_view_keeps_its_base(spark):
    view = selection.CutView(spark.range(10), "id > 5")
    assert view.rows.count() == 4
    assert view.with_cut("id < 3").rows.count() == 3
    assert view.with_cut(None).rows.count() == 10 and view.rows.count() == 4


def test_tidy_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("x.a", "Clu.b", "c")
    assert selection.tidy_columns(df, ["Clu_"]).columns == ["x_a", "c"]


def test_broadcast_needs_a_bound(spark):
    df = spark.range(5)

    def hinted(d):
        return "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()

    assert hinted(broadcast_bounded(df, 5))
    assert not hinted(broadcast_bounded(df, None))
    assert not hinted(broadcast_bounded(df, MAX_BROADCAST_ROWS + 1))


def test_scratch_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch_path(spark, "x")
    assert base is None or path.startswith(base)
    assert path != scratch_path(spark, "x")


def unset(master, folder=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: folder)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default),
                           sparkContext=context)


def test_scratch_without_a_setting():
    Unset = unset("local[4]")  # noqa: N806
    first, second = scratch_path(Unset, "x"), scratch_path(Unset, "x")
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]
    assert scratch_path(unset("local-cluster[2,1,1024]", "hdfs://x/y/"), "z").startswith("hdfs://x/y/z-")
    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch_path(unset(master), "x")

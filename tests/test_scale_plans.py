"""Operators whose cost must not follow the number of columns, cuts or equal values."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from setframe.operators import ordering, roc, splitting, stats
from setframe.plans import report
from setframe.session import scratch_path
from workload import fixtures as fx
from workload.evaluation import classifiers

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _plain(values, n_sigma=None, two_sided=False):
    mean = sum(values) / len(values)
    std = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    if n_sigma is None:
        return mean, std, len(values)
    kept = [v for v in values if (abs(v - mean) if two_sided else v - mean) < n_sigma * std]
    return _plain(kept) if kept else (mean, std, len(values))


@pytest.fixture(scope="module")
def lists(spark):
    rng = random.Random(5)
    rows = [(float(rng.randint(0, 9)), [1e9 + rng.gauss(0, 1) for _ in range(rng.randint(0, 6))],
             [rng.choice([1, 2, 50]) for _ in range(rng.randint(0, 3))], [7.0] * (i % 3), [])
            for i in range(300)]
    rows += [(None, None, None, [None, 7.0], None), (3.0, [None], [], [], [])]
    path = scratch_path(spark, "lists")
    spark.createDataFrame(rows, "s double, far array<double>, few array<int>, same array<double>, "
                                "none array<double>").write.parquet(path)
    return spark.read.parquet(path), rows


@pytest.mark.parametrize("robust,two_sided", [(False, False), (True, False), (True, True)])
def test_list_moments_equal_flattening(lists, robust, two_sided):
    table, rows = lists
    found = {r.feature: r for r in stats.mixed_stats(table, ["s"], ["far", "few", "same", "none"], robust,
                                                     1.5, two_sided).collect()}
    for at, name in enumerate(["s", "far", "few", "same"]):
        values = [r[at] for r in rows] if at == 0 else [v for r in rows for v in (r[at] or [])]
        want = _plain([float(v) for v in values if v is not None], 1.5 if robust else None, two_sided)
        got = found[name]
        assert got.n == want[2], name
        assert got["mean"] == pytest.approx(want[0], rel=1e-12) and got.stddev == pytest.approx(
            want[1], rel=1e-6, abs=1e-6), name
    assert found["none"]["mean"] is None and found["none"].n == 0


def test_any_number_of_list_columns_is_one_scan(spark, lists):
    table, _ = lists
    plan = plan_of(stats.mixed_stats(table, ["s"], ["far", "few", "same", "none"], robust=True))
    assert plan.count("FileScan") == 1 and "Generate" not in plan.split("LocalTableScan")[0].replace(
        "Generate inline", "")


def test_cuts_are_counted_and_not_listed(spark):
    rows = fx.scores(spark, SF_DIR)
    points = spark.createDataFrame([("network", 10, 0.9), ("network", 50, 0.5), ("network", 75, 0.5),
                                    ("baseline", 10, 0.4), ("baseline", 95, None)],
                                   "classifier string, wp int, cut double")
    matrices = report.working_point_matrices(rows, classifiers(), fx.score_vector(), F.col("label"),
                                             F.col("w_mc"), points)
    plan = plan_of(matrices)
    first = plan[plan.rindex("Exchange hashpartitioning(classifier"):]
    assert "explode" not in first and first.count("inline") == first.count("Generate inline")
    pred, truth = report.signal_class_decode(fx.score_vector(), F.col("label"))
    for r in points.where("cut is not null").collect():
        passing = rows.where(classifiers()[r.classifier] > r.cut)
        want = {(x[0], x[1]): x[2] for x in passing.groupBy(pred, truth).agg(F.sum("w_mc")).collect()}
        got = {(x.pred, x.truth): x.weight for x in matrices.where(
            (F.col("classifier") == r.classifier) & (F.col("wp") == r.wp)).collect() if x.weight}
        assert got == pytest.approx(want)


def test_cut_places(spark):
    cuts = [0.1, 0.2, 0.5, 0.7, 0.9]
    rows = spark.createDataFrame([(x,) for x in [None, -1.0, 0.1, 0.15, 0.2, 0.21, 0.6, 0.9, 5.0]], "x double")
    for own in (cuts, cuts[:1], []):
        for r in rows.select("x", report.cuts_below(F.col("x"), own).alias("n")).collect():
            assert r.n == (0 if r.x is None else sum(r.x > c for c in own))


def test_hot_values_are_spread(spark):
    rows = spark.range(40_000).select("id", F.when(F.col("id") % 3 == 0, 5.0).when(
        F.col("id") % 7 == 0, 2.0).otherwise(F.col("id") % 1000 / 100.0).alias("x"))
    numbered = ordering.numbered_by_value(rows, "x", unit="id", name="n")
    again = {r.id: r.n for r in ordering.numbered_by_value(rows.repartition(3), "x", unit="id", name="n").collect()}
    got = numbered.collect()
    assert sorted(r.n for r in got) == list(range(1, 40_001))
    assert {r.id: r.n for r in got} == again
    ordered = sorted(got, key=lambda r: r.n)
    assert all(a.x <= b.x for a, b in zip(ordered, ordered[1:]))
    # The windows' partitions: none holds much more than a bucket's share, hot values or not.
    buckets = ordering.default_buckets(spark)
    seen = {}
    original = ordering.row_numbers

    def spy(df, order, bucket, *rest, **named):
        seen["sizes"] = [r["count"] for r in df.groupBy(bucket).count().collect()]
        return original(df, order, bucket, *rest, **named)

    ordering.row_numbers = spy
    try:
        ordering.numbered_by_value(rows, "x", unit="id", name="n")
    finally:
        ordering.row_numbers = original
    assert max(seen["sizes"]) < 2 * 40_000 / buckets


def test_parts_of_a_hot_value(spark):
    rows = spark.range(1000).select("id", F.lit(1.0).alias("x"))
    parts = splitting.contiguous_parts(rows, "x", 7, unit="id").groupBy("part").count().collect()
    assert sorted(r["count"] for r in parts) == [142] + [143] * 6


def test_sketches_merge_within_their_error(spark):
    rows = spark.range(50_000).select((F.col("id") * 7919 % 50_000 / 50_000.0).alias("score"),
                                      (F.col("id") % 5).alias("file"), (F.col("id") % 2 == 0).alias("sig"))
    parts = roc.signal_sketches(rows, F.col("score"), F.col("sig"), ["file"])
    assert parts.count() == 5
    exact = sorted(r.score for r in rows.where("sig").collect())
    for k in (roc.SKETCH_K, 200):
        parts = roc.signal_sketches(rows, F.col("score"), F.col("sig"), ["file"], k)
        for r in roc.sketched_working_points(parts, [95, 50, 10]).collect():
            rank = sum(x <= r.cut for x in exact) / len(exact)
            assert r.n == len(exact) and abs(rank - (100 - r.wp) / 100) <= roc.rank_error(k) + 1e-4
    none = roc.signal_sketches(rows.where("false"), F.col("score"), F.col("sig"), ["file"])
    assert roc.sketched_working_points(none, [50]).collect() == []

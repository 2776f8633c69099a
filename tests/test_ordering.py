"""Two-level ordering against brute force, with many buckets and one hot group."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from setframe.functions.hashing import order_key
from setframe.operators import ordering, splitting


@pytest.fixture
def skewed(spark):
    """2,000 rows; one group holds two thirds of them."""
    rng = random.Random(1)
    ids = rng.sample(range(100_000), 2000)
    rows = [(i, "hot" if n % 3 else f"g{n % 7}") for n, i in enumerate(ids)]
    return rows, spark.createDataFrame(rows, "id bigint, g string").repartition(5)


def ranks(rows, key):
    out, seen = {}, {}
    for i, g in sorted(rows, key=key):
        seen[g] = seen.get(g, 0) + 1
        out[i] = seen[g]
    return out


def test_numbered_by_value_within_groups(skewed):
    rows, df = skewed
    got = ordering.numbered_by_value(df, "id", ["g"], 8, total="total").collect()
    want = ranks(rows, lambda r: r[0])
    assert {r["id"]: r["row_number"] for r in got} == want
    hot = sum(g == "hot" for _, g in rows)
    assert {r["total"] for r in got if r["g"] == "hot"} == {hot}


def test_numbered_by_value_without_broadcast(skewed):
    rows, df = skewed
    got = ordering.numbered_by_value(df, "id", ["g"], max_groups=None).collect()
    assert {r["id"]: r["row_number"] for r in got} == ranks(rows, lambda r: r[0])


def test_numbered_by_key_is_the_digest_order(spark, skewed):
    rows, df = skewed
    keyed = df.withColumn("k", order_key(F.col("id"), 7))
    key = {r["id"]: r["k"] for r in keyed.collect()}
    got = ordering.numbered_by_key(keyed, "k", "id", ["g"], 8).collect()
    assert {r["id"]: r["row_number"] for r in got} == ranks(rows, lambda r: (key[r[0]], r[0]))


def test_null_group_is_kept(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id bigint, g string")
    got = ordering.numbered_by_value(df, "id", ["g"], 2).collect()
    assert sorted((r["id"], r["row_number"]) for r in got) == [(1, 1), (2, 2), (3, 1)]


@pytest.mark.parametrize("per_bucket", [10, 1_000_000])
def test_cumulative_sums(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", per_bucket)
    rng = random.Random(2)
    # One value is shared by a third of all rows.
    rows = [(rng.choice("ab"), 0.5 if n % 3 == 0 else round(rng.random(), 2), float(n % 5))
            for n in range(1500)]
    df = spark.createDataFrame(rows, "g string, x double, w double")
    got = ordering.cumulative_sums(df, "x", {"w": F.sum("w"), "n": F.count(F.lit(1))}, ["g"], 2)
    for r in got.collect():
        mine = [row for row in rows if row[0] == r["g"]]
        assert r["w"] == sum(w for _, x, w in mine if x == r["x"])
        assert r["w_before"] == sum(w for _, x, w in mine if x < r["x"])
        assert r["w_total"] == sum(w for _, _, w in mine)
        assert r["n_before"] == sum(1 for _, x, _ in mine if x < r["x"])


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("size", [1, 2, 501])
def test_percentiles_match_numpy(spark, monkeypatch, size, descending):
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", 20)
    rng = np.random.default_rng(size)
    data = np.round(rng.random(size), 2)
    df = spark.createDataFrame([(float(v), float(-v)) for v in data], "x double, y double")
    percents = [0.0, 5.0, 37.5, 50.0, 95.0, 100.0]
    if descending:
        counts = ordering.cumulative_sums(df, "y", {"n": F.count(F.lit(1))})
        counts = counts.withColumn("x", -F.col("y"))
    else:
        counts = ordering.cumulative_sums(df, "x", {"n": F.count(F.lit(1))})
    found = ordering.percentiles(counts, "x", "n", percents, descending=descending)
    got = found.first()["percentiles"]
    assert [got[p] for p in percents] == pytest.approx(list(np.percentile(data, percents)))


def test_empty_input(spark):
    df = spark.createDataFrame([], "id bigint, g string")
    assert ordering.numbered_by_value(df, "id", ["g"], 1).count() == 0
    assert ordering.cumulative_sums(df, "id", {"n": F.count(F.lit(1))}).count() == 0


@pytest.mark.parametrize("n,parts", [(10, 3), (7, 7), (3, 5), (100, 8), (1, 4)])
def test_contiguous_parts(spark, n, parts):
    df = spark.range(n).select((F.col("id") * 10).alias("id"))
    got = [r["part"] for r in splitting.contiguous_parts(df, "id", parts).orderBy("id").collect()]
    whole = np.array_split(np.arange(n), parts)
    assert got == [i for i, part in enumerate(whole) for _ in part]

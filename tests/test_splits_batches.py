from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from setframe.operators import batching, sets, splitting, training


def test_exact_split_sizes_and_disjointness(spark):
    df = spark.range(103).select(F.format_string("f%d", "id").alias("file"),
                                 (F.col("id") < 90).alias("big"))
    got = splitting.exact_split(df, "file", ["big"], 2).collect()
    assert len(got) == len({r["file"] for r in got}) == 103
    for big, n in ((True, 90), (False, 13)):
        sizes = Counter(r["split"] for r in got if r["big"] == big)
        test = math.ceil(0.2 * n)
        val = math.ceil(0.2 * (n - test))
        assert sizes == {"test": test, "val": val, "train": n - test - val}


def test_hash_split_is_stable_and_near_its_shares(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("file"))
    first = splitting.hash_split(df, "file")
    again = splitting.hash_split(df.repartition(7), "file")
    assert first.exceptAll(again).count() == 0
    shares = {r["split"]: r["count"] / 4000 for r in first.groupBy("split").count().collect()}
    assert shares == pytest.approx({"train": 0.64, "val": 0.16, "test": 0.2}, abs=0.03)


def test_split_coverage_reports_problems(spark):
    whole = spark.range(10)
    good = {"a": spark.range(0, 4), "b": spark.range(4, 10)}
    bad = {"a": spark.range(0, 5), "b": spark.range(4, 9), "c": spark.range(20, 21)}
    assert tuple(sets.split_coverage(whole, good, "id").first()) == (10, 10, 0, 0, 0)
    assert tuple(sets.split_coverage(whole, bad, "id").first()) == (10, 11, 1, 1, 1)


@pytest.mark.parametrize("n", [2, 3, 500])
def test_permutation_is_one_cycle(spark, n):
    df = spark.range(n).select("id", (F.col("id") * 2).alias("x"), F.array("id").alias("y"))
    got = splitting.permute_columns(df.repartition(3), ["x", "y"], "id").collect()
    donor = {r["id"]: r["x_permuted"] // 2 for r in got}
    assert all(r["y_permuted"] == [donor[r["id"]]] for r in got)
    assert sorted(donor.values()) == list(range(n))
    at, steps = 0, 0
    while steps == 0 or at != 0:
        at, steps = donor[at], steps + 1
    assert steps == n


def test_sample_is_without_replacement(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("f"))
    a = [r["f"] for r in splitting.sample_units(df, "f", 7).collect()]
    b = [r["f"] for r in splitting.sample_units(df.repartition(4), "f", 7).collect()]
    assert a == b and len(set(a)) == 7


def rows_of(spark, signal, fake):
    return spark.range(signal + fake).select(
        "id", F.when(F.col("id") < signal, "signal").otherwise("fake").alias("kind"))


def test_mixed_batches_follow_the_plan(spark):
    df = rows_of(spark, 70, 33)
    plan = batching.plan_lookup(batching.batch_plan(df, "kind", 10), "kind")
    assert plan == {"signal": (70, 6, 10), "fake": (33, 3, 10)}
    got = batching.mixed_batches(df, "id", "kind", 10).collect()
    assert len(got) == 103
    per_batch = Counter((r["kind"], r["batch_id"]) for r in got)
    assert all(per_batch[("signal", b)] == 6 for b in range(11))
    assert per_batch[("signal", 11)] == 4  # last, partial
    assert per_batch[("fake", 10)] == 3 and ("fake", 11) not in per_batch
    assert {r["batch_id"] for r in got if r["in_epoch"]} == set(range(10))


def test_cyclic_batches_restart(spark):
    got = batching.cyclic_batches(rows_of(spark, 7, 3), "id", "kind", 4.5, 5).collect()
    # shares are 3 and 1 of 5: 27 signal slots over 7 rows, 9 fake slots over 3 rows
    per_batch = Counter((r["kind"], r["batch_id"]) for r in got)
    assert per_batch == {**{("signal", b): 3 for b in range(9)},
                         **{("fake", b): 1 for b in range(9)}}
    uses = Counter(r["id"] for r in got)
    assert sorted(uses.values()) == [3, 3, 3, 3, 4, 4, 4, 4, 4, 4]
    assert len({(r["kind"], r["batch_id"], r["slot"]) for r in got}) == len(got)


def test_cyclic_batches_shorter_than_one_epoch(spark):
    got = batching.cyclic_batches(rows_of(spark, 70, 30), "id", "kind", 0.2, 10).collect()
    assert len(got) == 20 and max(Counter(r["id"] for r in got).values()) == 1


def test_rare_kind_is_in_every_batch_and_listed_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(batching, "REPEATS", 3)
    got = batching.cyclic_batches(rows_of(spark, 99, 1), "id", "kind", 2, 10).collect()
    fakes = sorted(r["batch_id"] for r in got if r["kind"] == "fake")
    assert fakes == list(range(20))
    assert Counter(r["kind"] for r in got)["signal"] == 9 * 20


def test_whole_share_takes_every_row(spark):
    rows = spark.range(500).withColumn("unit", F.col("id").cast("string"))
    assert splitting.hash_split(rows, "unit", test=1.0).where("split <> 'test'").count() == 0
    with pytest.raises(ValueError, match="fraction"):
        splitting.hash_split(rows, "unit", test=1.5)


def test_history(spark):
    rows = [(0, e, loss, e / 10) for e, loss in enumerate([3.0, 2.0, 2.0, 1.0, 1.5, 1.0])]
    history = spark.createDataFrame(rows, "run int, epoch int, val_loss double, val_acc double")
    assert tuple(training.best_epoch(history).first()) == (0, 3, 1.0, 0.3)
    kept = training.best_checkpoints(history).orderBy("epoch").collect()
    assert [r["epoch"] for r in kept] == [0, 1, 3]


def test_slices_and_side_by_side(spark):
    df = spark.createDataFrame([(1, 0.1, 0.2), (3, 0.3, 0.4)], "p int, a double, b double")
    long = sets.side_by_side(df, {"A": F.col("a"), "B": F.col("b")}, ["p"])
    assert sorted(map(tuple, long.collect())) == [(1, "A", 0.1), (1, "B", 0.2), (3, "A", 0.3),
                                                  (3, "B", 0.4)]
    sliced = sets.with_slices(df, {"all": F.lit(True), "one": F.col("p") == 1}, ["p"])
    assert sorted(map(tuple, sliced.collect())) == [(1, "all"), (1, "one"), (3, "all")]

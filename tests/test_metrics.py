from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from setframe.operators import confusion, histograms, ordering, roc, stats, training
from setframe.operators.scoring import loss_and_accuracy


def curve_by_hand(y, s, w):
    """(threshold, fpr, tpr) for every distinct score, from the definition."""
    points = []
    for t in sorted(set(s), reverse=True):
        at = s >= t
        points.append((t, w[at & ~y].sum() / w[~y].sum(), w[at & y].sum() / w[y].sum()))
    return points


@pytest.mark.parametrize("per_bucket", [15, 1_000_000])
def test_roc_against_definition(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", per_bucket)
    rng = np.random.default_rng(3)
    y = rng.random(400) < 0.6
    s = np.where(rng.random(400) < 0.33, 0.5, np.round(rng.random(400), 2))
    w = rng.integers(1, 4, 400).astype(float)
    df = spark.createDataFrame(list(zip(map(bool, y), map(float, s), map(float, w))),
                               "y boolean, s double, w double")
    counts = roc.score_counts(df, F.col("s"), F.col("y"), F.col("w"))
    curve = [tuple(r) for r in roc.roc_curve(counts).orderBy(F.desc("threshold")).collect()]
    want = [(s.max() + 1, 0.0, 0.0), *curve_by_hand(y, s, w)]
    assert np.allclose(np.array(curve), np.array(want))
    assert curve[-1][1:] == (1.0, 1.0)
    x, t = np.array(want)[:, 1], np.array(want)[:, 2]
    area = float((np.diff(x) * (t[1:] + t[:-1]) / 2).sum())
    assert roc.auc(counts).first()["auc"] == pytest.approx(area)
    points = {r["wp"]: r for r in roc.working_points(counts, (95, 50, 10)).collect()}
    for wp, r in points.items():
        assert r["cut"] == pytest.approx(np.percentile(s[y], 100 - wp))
        assert r["raw_percentile_cut"] == pytest.approx(np.percentile(s[y], wp))
    above = {r["wp"]: r for r in roc.above_cuts(
        counts, roc.working_points(counts, (95, 50, 10)), 3).collect()}
    for wp, r in above.items():
        passed = s > r["cut"]
        assert r["n_pass"] == passed.sum() and r["n_signal"] == (passed & y).sum()
        assert r["w_background"] == w[passed & ~y].sum()


def test_roc_with_one_class_or_zero_weight(spark):
    df = spark.createDataFrame([(True, 0.1, 1.0), (True, 0.2, 1.0)],
                               "y boolean, s double, w double")
    counts = roc.score_counts(df, F.col("s"), F.col("y"), F.col("w"))
    assert roc.auc(counts).first()["auc"] is None
    assert roc.efficiency_rejection(roc.roc_curve(counts)).count() == 0
    zero = roc.score_counts(df, F.col("s"), F.col("y"), F.lit(0.0))
    assert roc.auc(zero).first()["auc"] is None


def test_confusion_matrix(spark):
    rows = [(0, 0, 1.0), (0, 1, 2.0), (1, 1, 3.0), (0, 0, 1.0), (1, None, 9.0)]
    df = spark.createDataFrame(rows, "p int, t int, w double")
    matrix = confusion.confusion_matrix(df, F.col("p"), F.col("t"), F.col("w"), 3)
    cells = {(r["pred"], r["truth"]): r["weight"] for r in matrix.collect()}
    assert len(cells) == 9 and cells[(0, 0)] == 2.0 and cells[(0, 1)] == 2.0
    assert cells[(1, 1)] == 3.0 and sum(cells.values()) == 7.0
    normed = confusion.normalised(matrix)
    by = {(r["pred"], r["truth"]): r for r in normed.collect()}
    assert by[(0, 1)]["norm_by_truth"] == pytest.approx(0.4)
    assert by[(0, 1)]["norm_by_pred"] == pytest.approx(0.5)
    assert by[(2, 2)]["norm_by_truth"] == by[(2, 2)]["norm_by_pred"] == 0.0  # never predicted
    diag = confusion.diagonal_score(normed, 3).first()
    assert diag["diag_by_truth"] == pytest.approx((1 + 0.6 + 0) / 3)
    dropped = confusion.diagonal_score(normed, 3, drop_first=True).first()
    assert dropped["diag_by_truth"] == pytest.approx(0.6 / 2)


def test_unit_weights_and_empty_input(spark):
    df = spark.createDataFrame([(1, 1)], "p int, t int")
    one = confusion.confusion_matrix(df, F.col("p"), F.col("t"), n_classes=2)
    assert one.agg(F.sum("weight")).first()[0] == 1.0
    empty = confusion.confusion_matrix(df.where("p > 5"), F.col("p"), F.col("t"), n_classes=2)
    assert [r["weight"] for r in empty.collect()] == [0.0] * 4


def test_fixed_histogram_edges(spark):
    values = [0.0, 9.99, 10.0, 99.0, 100.0, -1.0, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r["bin"]: r["value"] for r in
           histograms.fixed_histogram(df, "x", 10, (0.0, 100.0)).collect()}
    assert len(got) == 10
    assert {b: n for b, n in got.items() if n} == {0: 2, 1: 1, 9: 1}


def test_reweight_edges_and_closure(spark):
    rows = [(5.0, False), (5.0, True), (6.0, True), (15.0, False), (25.0, True), (-3.0, True),
            (99.0, True)]
    df = spark.createDataFrame(rows, "x double, bg boolean")
    histogram = histograms.ratio_histogram(df, "x", F.col("bg"), 3, (0.0, 30.0))
    assert [r["value"] for r in histogram.orderBy("bin").collect()] == [0.5, 0.0, 0.0]
    weighted = histograms.apply_reweight(df, "x", F.col("bg"), histogram, 3, (0.0, 30.0))
    got = [(r["x"], r["bg"], r["pt_reweight"]) for r in weighted.collect()]
    assert sorted(got) == [(-3.0, True, 1.0), (5.0, False, 1.0), (5.0, True, 0.5),
                           (6.0, True, 0.5), (15.0, False, 1.0), (25.0, True, 0.0),
                           (99.0, True, 1.0)]
    closure = histograms.reweight_closure(weighted, "x", F.col("bg"), "pt_reweight", 3,
                                          (0.0, 30.0))
    assert closure.where("bin = 0").first()["difference"] == 0.0


def test_auto_histogram_matches_numpy(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=300)
    df = spark.createDataFrame([(float(x), 2.0, -999.0 if i < 5 else float(i))
                                for i, x in enumerate(a)], "a double, b double, c double")
    got = histograms.auto_histograms(df, ["a", "b", "c"], 20, pad=-999.0).collect()
    for name, data in (("a", a), ("b", np.full(300, 2.0)), ("c", np.arange(5, 300.0))):
        counts, edges = np.histogram(data, 20)
        mine = {r["bin"]: r for r in got if r["feature"] == name}
        assert {b: r["n"] for b, r in mine.items()} == {
            b: int(n) for b, n in enumerate(counts) if n}
        assert all(r["lo"] == pytest.approx(edges[b]) for b, r in mine.items())


def test_robust_stats_trims_one_side(spark):
    data = [float(i % 10) for i in range(200)] + [1e4, -1e4]
    df = spark.createDataFrame([(v,) for v in data], "x double")
    arr = np.array(data)
    kept = arr[arr - arr.mean() < 5 * arr.std()]
    got = stats.robust_stats(df, ["x"]).first()
    assert (got["mean"], got["stddev"], got["n"]) == (
        pytest.approx(kept.mean()), pytest.approx(kept.std()), len(kept))
    both = stats.robust_stats(df, ["x"], two_sided=True).first()
    assert both["n"] == 200


def test_stats_skip_unknown_features(spark):
    df = spark.createDataFrame([(1.0, 5.0, [1.0]), (3.0, 6.0, [])],
                               "a double, b double, l array<double>")
    known = stats.stats_lookup(stats.column_stats(df, ["a"]))
    assert known == {"a": (2.0, 1.0)}
    assert stats.normalise_columns(df, known, ["a", "b"]).columns == ["a", "b", "l", "a_normed"]
    assert stats.normalise_lists(df, {"l": (0.0, 1.0)}, ["l"]).columns[-1] == "l_normed"
    flat = stats.flatten_lists(df, ["l"])
    assert [r["l"] for r in flat.collect()] == [1.0]


def test_nan_audit(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), 2)], "a double, b int")
    got = {r["feature"]: (r["n_nan"], r["n_rows"]) for r in stats.nan_audit(df, ["a", "b"]).collect()}
    assert got == {"a": (1, 2), "b": (1, 2)}


def test_class_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "label int")
    got = {r["label"]: r for r in stats.class_weights(stats.class_counts(df)).collect()}
    assert got[0]["class_weight"] == pytest.approx(4 / 2 / 3)
    assert got[1]["log_prior"] == pytest.approx(np.log(0.25))


def test_loss_is_clipped(spark):
    df = spark.createDataFrame([([1.0, 0.0], 1, 0, 2.0)],
                               "s array<double>, label int, pred int, w double")
    got = loss_and_accuracy(df, F.col("s"), F.col("label"), F.col("pred"), F.col("w")).first()
    assert got["loss"] == pytest.approx(-2 * np.log(1e-7)) and got["accuracy"] == 0.0


def test_auto_histogram_leaves_out_what_is_not_finite(spark):
    rows = [(v,) for v in (1.0, 2.0, 3.0, float("nan"), float("inf"), float("-inf"), None, -999.0)]
    df = spark.createDataFrame(rows, "x double")
    got = sorted(map(tuple, histograms.auto_histograms(df, ["x"], 2, pad=-999.0).collect()))
    assert got == [("x", 0, 1.0, 2.0, 1), ("x", 1, 2.0, 3.0, 2)]


def test_confusion_leaves_out_classes_that_are_none(spark):
    df = spark.createDataFrame([(0, 7), (1, -1), (6, 0), (2, 2), (None, 1)], "p int, t int")
    cells = confusion.confusion_matrix(df, F.col("p"), F.col("t")).where("weight > 0").collect()
    assert [tuple(r) for r in cells] == [(2, 2, 1.0)]


def test_constant_column_keeps_its_plain_moments(spark):
    df = spark.createDataFrame([(5.0, None), (5.0, None)], "x double, y double")
    table = stats.robust_stats(df, ["x", "y"])
    assert stats.stats_lookup(table) == {"x": (5.0, 0.0)}
    normed = stats.normalise_columns(df, stats.stats_lookup(table), ["x", "y"])
    assert [r["x_normed"] for r in normed.collect()] == [0.0, 0.0]


def test_cut_with_nothing_above_is_a_row_of_zeros(spark):
    df = spark.createDataFrame([(0.9, True)] * 8 + [(0.1, False)] * 2, "score double, sig boolean")
    counts = roc.score_counts(df, F.col("score"), F.col("sig"))
    points = roc.working_points(counts, [50, 10])
    rows = roc.above_cuts(counts, points, 2).collect()
    assert sorted((r["wp"], r["n_pass"], r["n_signal"], r["rejection"], r["auc"]) for r in rows) == [
        (10, 0, 0, None, None), (50, 0, 0, None, None)]


def test_rows_without_a_class_stay_with_weight_zero(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (None, 3.0)], "label int, w double")
    got = training.with_class_weight(df, "label", "w").orderBy(F.col("label").asc_nulls_last())
    rows = got.collect()
    assert len(rows) == 3 and rows[2]["train_weight"] == 0.0 and rows[1]["train_weight"] > 0

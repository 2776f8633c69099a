from __future__ import annotations

import math
import sys

import pytest
from pyspark.sql import functions as F

from setframe.config import DEFAULT_DATASET, Cuts, cut_to_sql
from setframe.functions import clean, labels, ragged

NAN, INF = float("nan"), float("inf")


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_clean_nonfinite(spark):
    rows = [(NAN,), (INF,), (-INF,), (-999.0,), (100.0,), (None,)]
    big = sys.float_info.max
    assert values(spark, clean.clean_nonfinite(F.col("x")), rows, "x double") == [
        0.0, big, -big, -999.0, 100.0, None]


def test_zero_outliers_keeps_only_small_values(spark):
    rows = [(NAN,), (INF,), (-INF,), (-999.0,), (100.0,), (99.9,), (-99.9,)]
    assert values(spark, clean.zero_outliers(F.col("x")), rows, "x double") == [
        0.0, 0.0, 0.0, 0.0, 0.0, 99.9, -99.9]


def test_normalise_constant_feature(spark):
    assert values(spark, clean.normalise(F.col("x"), 3.0, 0.0), [(3.0,)], "x double") == [0.0]
    got = values(spark, clean.normalise_array(F.col("x"), 1.0, 2.0), [([1.0, 3.0],), ([],)],
                 "x array<double>")
    assert got[1] == [] and got[0] == pytest.approx([0.0, 1.0])


def test_drop_pads(spark):
    assert values(spark, clean.drop_pads(F.col("x")), [([1.0, -999.0, 2.0],)],
                  "x array<double>") == [[1.0, 2.0]]


def test_pad_clip(spark):
    rows = [([],), ([1.0],), ([1.0, 2.0, 3.0, 4.0],), (None,), ([None, 2.0],)]
    assert values(spark, ragged.pad_clip("x", 3), rows, "x array<double>") == [
        [-999.0] * 3, [1.0, -999.0, -999.0], [1.0, 2.0, 3.0], [-999.0] * 3,
        [-999.0, 2.0, -999.0]]


def test_list_tensor_cleans_and_is_feature_major(spark):
    rows = [([1.0, NAN], [5.0]), ([INF], [])]
    got = values(spark, ragged.list_tensor(["a", "b"], 2), rows,
                 "a array<double>, b array<double>")
    assert got == [[1.0, 0.0, 5.0, -999.0],
                   [sys.float_info.max, -999.0, -999.0, -999.0]]


OBJECTS = "o array<struct<f:double,g:double>>"


def test_object_tensor(spark):
    rows = [([(1.0, 2.0), (3.0, NAN)],), (None,)]
    got = values(spark, ragged.object_tensor("o", ["f", "g"], 3), rows, OBJECTS)
    assert got == [[[1.0, 3.0, -999.0], [2.0, 0.0, -999.0]], [[-999.0] * 3] * 2]


def test_masked_sum_ignores_pads_only(spark):
    rows = [([(1.0, 2.0), (NAN, 4.0), (5.0, 6.0), (7.0, 8.0)],), ([],), ([(NAN, NAN)],)]
    df = spark.createDataFrame(rows, OBJECTS)
    got = df.select(*ragged.masked_sum("o", ["f", "g"], 3)).collect()
    assert [tuple(r) for r in got] == [(6.0, 12.0), (0.0, 0.0), (0.0, 0.0)]


def test_multiplicity_of_null_list_is_zero(spark):
    assert values(spark, ragged.multiplicity("x"), [([1.0],), (None,)],
                  "x array<double>") == [1, 0]


def test_labels(spark):
    rows = [(True, 3), (False, -1), (False, 5), (False, 0), (False, 4)]
    label = labels.class_label(F.col("b"), F.col("d"))
    assert values(spark, label, rows, "b boolean, d int") == [0, None, None, 1, 5]
    assert values(spark, labels.onehot(label), rows, "b boolean, d int")[3:] == [
        [0, 1, 0, 0, 0, 0], [0, 0, 0, 0, 0, 1]]
    assert values(spark, labels.onehot(label), rows, "b boolean, d int")[1] is None


def test_argmax_first_wins(spark):
    rows = [([0.2, 0.4, 0.4],), ([0.5, 0.5, 0.0],), ([0.0, 0.0, 0.0],)]
    assert values(spark, labels.argmax(F.col("v")), rows, "v array<double>") == [1, 0, 0]


def test_signal_score_and_drop_background(spark):
    rows = [([0.25, 0.5, 0.25],)]
    assert values(spark, labels.signal_score(F.col("v")), rows, "v array<double>") == [0.75]
    assert values(spark, labels.drop_background(F.col("v"), 3), rows, "v array<double>") == [
        [0.5, 0.25]]


def test_cut_text(spark):
    assert cut_to_sql("(pt > 15000) & (abs(eta) < 2.5)") == \
        "(pt > 15000)  AND  ((eta > -2.5 AND eta < 2.5))"
    rows = [(NAN,), (2.5,), (-2.4,)]
    df = spark.createDataFrame(rows, "eta double").where(F.expr(cut_to_sql("abs(eta) < 2.5")))
    assert [r[0] for r in df.collect()] == [-2.4]
    both = Cuts("a > 1", signal_only="b")
    assert both.signal == "(a > 1) & (b)" and both.background == "a > 1"


def test_cut_with_exponent():
    assert cut_to_sql("abs(x) < 1e-3") == "(x > -1e-3 AND x < 1e-3)"
    assert cut_to_sql("(abs(x) < 2.5E+2)") == "((x > -2.5E+2 AND x < 2.5E+2))"


def test_default_layout():
    widths = [c.width for c in DEFAULT_DATASET.collections]
    assert widths == [42, 132, 18, 40, 6] and sum(widths) == 238
    names = DEFAULT_DATASET.input_columns()
    assert len(names) == len(set(names))
    assert not any(math.isnan(w) for w in widths)

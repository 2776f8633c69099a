"""Plan shapes that must hold for the operators to survive large and skewed inputs."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from setframe.config import DEFAULT_DATASET
from setframe.operators import assemble, splitting
from setframe.session import scratch_path
from workload import fixtures as fx

SF_DIR = "/root/testdata/sf0.001"
QUERIES = entry.queries()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["scan_project", "scan_cut", "apply_cuts", "zero_outliers",
                                  "clean_nonfinite", "scalar_vector", "onehot_label",
                                  "argmax_decode", "split_hash", "union_classes",
                                  "tidy_columns", "label_from_source"])
def test_row_wise_queries_do_not_shuffle(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if not re.match(
    r"op\d+_|pipeline$|fit_(?!scores)", n) and n not in ("batch_score", "permutation_rank",
                                       "train_classifier", "stream_score")])
def test_no_python_and_no_cross_join(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert "ArrowPython" not in plan and "BatchEvalPython" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_are_narrow(spark):
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_orderpriority:string>" \
        in plan_of(QUERIES["confusion_matrix"](spark, SF_DIR))


def test_object_lists_are_limited_before_the_shuffle(spark):
    plan = plan_of(assemble.collect_objects(fx.objects(spark, SF_DIR), "id", fx.OBJECT_ORDER,
                                            ["f3"], 3))
    assert re.search(r"row_number\(\), 3, Partial", plan)
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["shuffled_order", "ntile_split", "mixed_batches",
                                  "permute_feature", "chunk_rows"])
def test_row_windows_are_partitioned(spark, name):
    """A window over records must be split by bucket; only the bucket table may be one task."""
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    row_windows = [line for line in plan.splitlines()
                   if "Window [" in line and "row_number()" in line]
    assert all("_bucket" in line for line in row_windows)


def test_hot_record_stays_whole_and_capped(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"), "id")
    got = assemble.collect_objects(rows, "key", ["id"], ["id"], 4)
    assert got.count() == 20_001
    hot = got.where("key = 0").first()["objects"]
    assert [o["id"] for o in hot] == [0, 3, 6, 9]


def test_permutation_shuffles_rows_once(spark):
    rows = fx.cand(spark, SF_DIR).select("id", "pt", "eta", "rnn")
    plan = plan_of(splitting.permute_columns(rows, ["pt", "eta", "rnn"], "id"))
    wide = [line for line in plan.splitlines()
            if "Exchange hashpartitioning(_bucket" in line]
    assert len(wide) <= 3  # the rows once, plus the minima and heads of the buckets


def test_default_layout_compiles(spark):
    """The 238 values compile, and add nothing to the code that turns the 58 columns into rows."""
    columns = {c: "array<double>" if coll.ragged else "double"
               for coll in DEFAULT_DATASET.collections for c in coll.features}
    columns |= {DEFAULT_DATASET.label: "int", DEFAULT_DATASET.weight: "double"}
    df = spark.range(4).select(*[F.lit(None).cast(t).alias(c) for c, t in columns.items()])
    path = scratch_path(spark, "layout")
    df.write.parquet(path)
    plan = assemble.dataset_inputs(spark.read.parquet(path), DEFAULT_DATASET)._jdf.queryExecution()
    debug = getattr(spark._jvm.org.apache.spark.sql.execution, "debug")
    stages = getattr(getattr(debug, "package$"), "MODULE$").codegenStringSeq(plan.executedPlan())
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    rows = spark.read.parquet(path)._jdf.queryExecution().executedPlan()
    plain = getattr(getattr(debug, "package$"), "MODULE$").codegenStringSeq(rows)
    limit = max(8000, *[plain.apply(i)._3().maxMethodCodeSize() for i in range(plain.size())])
    assert sizes and all(0 < size <= limit for size in sizes), (sizes, limit)

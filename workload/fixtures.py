"""The engine's concepts mapped onto the supplied tables (see FIXTURES.md).

Everything is a projection of one table, except ``history`` and ``files``, which are small
aggregates, and ``with_objects``, which attaches capped object lists.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setframe.config import N_CLASSES
from setframe.functions.labels import argmax, class_label
from setframe.operators.assemble import collect_collections, collect_objects
from setframe.operators.scoring import Branch, DeepSet, Dense

SCORE_NAMES = [f"s{c}" for c in range(N_CLASSES)]
SOURCES = ["signal", *[f"JZ{i}" for i in range(1, 9)]]
OBJECT_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
CAPS = {"tracks": 3, "neutral": 6, "shot": 3, "conv": 4}
BASE_CUT = "(pt > 15000) & (abs(eta) < 2.5)"
SIGNAL_CUT = "(matched) & (abs(truth_eta) < 2.5) & (truth_pt > 15000)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_name() -> Column:
    key = F.col("o_orderkey")
    return F.when(F.col("o_orderstatus") == "F",
                  F.concat(F.lit("JZ"), (F.lit(1) + key % 8).cast("string"))).otherwise("signal")


def cand_from(orders: DataFrame) -> DataFrame:
    """One row per candidate. A projection, so it also works on a stream of ``orders``."""
    key = F.col("o_orderkey")
    fake = F.col("o_orderstatus") == "F"
    decay = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    rnn = ((key * 31) % 97).cast("double")
    eta = (F.col("o_custkey") % 121).cast("double") / F.lit(20.0) - F.lit(3.0)
    return orders.select(
        key.alias("id"), source_name().alias("source"), fake.alias("is_fake"),
        decay.alias("decay_mode"), class_label(fake, decay).alias("label"),
        F.when(key % 3 == 0, 3).otherwise(1).alias("prong"),
        F.col("o_totalprice").alias("pt"), eta.alias("eta"),
        (key % 10 != 0).alias("matched"),
        (F.col("o_totalprice") * F.lit(0.9)).alias("truth_pt"),
        (eta + F.lit(0.25)).alias("truth_eta"),
        (F.lit(1) + key % 3).cast("double").alias("w_mc"),
        F.when(fake, rnn / F.lit(140.0)).otherwise(rnn / F.lit(97.0)).alias("rnn"))


def cand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cand_from(table(spark, sf_dir, "orders"))


def cand_with_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    file_no = F.floor(F.col("id") / F.lit(500.0)).cast("string")
    return cand(spark, sf_dir).withColumn(
        "file", F.concat("source", F.lit("_"), file_no, F.lit(".parquet")))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per object; ``f1`` carries NaN and infinities."""
    part = F.col("l_partkey")
    f1 = (F.when(part % 97 == 0, F.lit(float("nan")))
          .when(part % 89 == 0, F.lit(float("inf"))).otherwise(F.col("l_quantity")))
    kind = (F.when(F.col("l_returnflag") == "A", "shot")
            .when(F.col("l_returnflag") == "R", "neutral").otherwise("conv"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), *OBJECT_ORDER, kind.alias("kind"), f1.alias("f1"),
        F.col("l_discount").alias("f2"), (F.col("l_extendedprice") / F.lit(1000.0)).alias("f3"),
        (F.col("l_quantity") / F.lit(50.0)).alias("g1"),
        (F.col("l_discount") * F.lit(10.0)).alias("g2"),
        (F.col("l_extendedprice") / F.lit(100000.0)).alias("g3"))


def with_tracks(records: DataFrame, spark: SparkSession, sf_dir: str,
                fields: Sequence[str]) -> DataFrame:
    """Candidates with their first three objects; NULL for candidates that have none."""
    lists = collect_objects(objects(spark, sf_dir), "id", OBJECT_ORDER, fields,
                            CAPS["tracks"], "tracks")
    return records.join(lists, "id", "left")


def with_collections(records: DataFrame, spark: SparkSession, sf_dir: str,
                     fields: Sequence[str]) -> DataFrame:
    caps = {k: cap for k, cap in CAPS.items() if k != "tracks"}
    lists = collect_collections(objects(spark, sf_dir), "id", OBJECT_ORDER, fields, "kind", caps,
                                ("tracks", CAPS["tracks"]))
    return records.join(lists, "id", "left")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six softmax scores per candidate, with heavy ties."""
    keep = ["id", "label", "is_fake", "pt", "prong", "source", "w_mc", "rnn"]
    terms = [f"exp(cast((id * {7 + 2 * c} + {13 * c}) % 101 as double) / 101D"
             f" + if(label = {c}, 0.8D, 0D)) as e{c}" for c in range(N_CLASSES)]
    total = " + ".join(f"e{c}" for c in range(N_CLASSES))
    return (cand(spark, sf_dir).selectExpr(*keep, *terms)
            .selectExpr("*", f"{total} as total")
            .selectExpr(*keep, *[f"e{c} / total as s{c}" for c in range(N_CLASSES)]))


def score_vector() -> Column:
    return F.array(*SCORE_NAMES)


def network_score() -> Column:
    """Signal score, to six places so that both engines agree on which scores are tied."""
    return F.round(F.lit(1.0) - F.col("s0"), 6)


def baseline_score() -> Column:
    return F.round(F.col("rnn"), 6)


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).withColumn("pred", argmax(score_vector()))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.col("event_type").isin("purchase", "signup").cast("double")
    return (table(spark, sf_dir, "events")
            .groupBy((F.col("user_id") % 5).cast("int").alias("run"),
                     (F.col("event_id") % 40).cast("int").alias("epoch"))
            .agg(F.avg("value").alias("val_loss"), F.avg(good).alias("val_acc")))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    file_no = F.floor(F.col("o_orderkey") / F.lit(500.0)).cast("string")
    return (table(spark, sf_dir, "orders")
            .select(source_name().alias("source"), file_no.alias("_no"), "o_orderdate")
            .select("source", "o_orderdate",
                    F.concat("source", F.lit("_"), "_no", F.lit(".parquet")).alias("file"))
            .groupBy("source", "file")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.min("o_orderdate").alias("created")))


# A tiny fixed network: three object features and two scalars, six classes.
OBJECT_FEATURES = ["g1", "g2", "g3"]
SCALAR_FEATURES = ["x_pt", "x_eta"]


def phi_weights() -> tuple[list[list[float]], list[float]]:
    return ([[((3 * f + 5 * k) % 7 - 3) / 10 for k in range(2)] for f in range(3)],
            [(k + 1) / 10 for k in range(2)])


def head_weights() -> tuple[list[list[float]], list[float]]:
    return ([[((5 * i + 3 * c) % 11 - 5) / 10 for c in range(N_CLASSES)] for i in range(4)],
            [c / 20 for c in range(N_CLASSES)])


def tiny_model() -> DeepSet:
    w1, b1 = phi_weights()
    w2, b2 = head_weights()
    return DeepSet(
        branches=(Branch("tracks", 3, CAPS["tracks"], (Dense(np.array(w1), np.array(b1)),)),
                  Branch("scalars", 2)),
        head=(Dense(np.array(w2), np.array(b2), "softmax"),))


MODEL_FEATURES: Mapping[str, Sequence[str]] = {"tracks": OBJECT_FEATURES,
                                               "scalars": SCALAR_FEATURES}


def with_model_scalars(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"x_pt": F.col("pt") / F.lit(500000.0),
                             "x_eta": F.col("eta") / F.lit(3.0)})

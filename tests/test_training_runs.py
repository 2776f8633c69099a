"""Training by gradient descent, and the jobs that take what it stored."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from setframe.config import Collection, DatasetConfig
from setframe.operators import descent, importance, linear, scoring
from setframe.operators.descent import Descent
from setframe.plans import evaluate, rank, train

FEATURES = ["a", "b"]
CONFIG = DatasetConfig(collections=(Collection("tracks", ("t",), 2), Collection("jets", ("a", "b"))),
                       passthrough=("id",), cuts=None, label="label", weight="weight")


def _rows(spark, n=900):
    """Three classes apart in ``a`` and ``b``; some rows without a class, NULL and NaN features."""
    i = F.col("id")
    c = (i % 3).cast("int")
    noise = ((i * 37 % 101) / 101.0 - 0.5)
    return spark.range(n).select(
        "id", F.when(i % 50 == 49, F.lit(None)).otherwise(c).cast("int").alias("label"),
        (c == 0).alias("is_fake"), F.lit(1.0).alias("weight"),
        F.when(i % 31 == 0, F.lit(float("nan"))).otherwise(c * 2.0 + noise).alias("a"),
        F.when(i % 43 == 0, F.lit(None)).otherwise(F.when(c == 1, 5.0).otherwise(-5.0) + noise).alias("b"),
        F.array(noise, c.cast("double"), F.lit(9.0)).alias("t"),
        F.when(i % 5 == 0, "val").when(i % 5 == 1, "test").otherwise("train").alias("split"))


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("runs"))
    rows = _rows(spark)
    config = DatasetConfig(collections=(Collection("jets", ("a", "b")),), passthrough=("id",), cuts=None,
                           label="label", weight="weight")
    history = train.fit(rows, config, "id", f"{out}/one", Descent(epochs=5, steps=2, rate=0.5))
    return rows, config, out, history


def test_losses_fall_and_the_newest_model_is_the_best(spark, run):
    rows, config, out, history = run
    epochs = history.orderBy("epoch").collect()
    assert [r.epoch for r in epochs] == list(range(5))
    losses = [r.val_loss for r in epochs]
    assert losses == sorted(losses, reverse=True) and epochs[-1].val_accuracy > 0.9
    n_val = rows.where("split = 'val' and label is not null").count()
    assert all(r.val_rows == n_val for r in epochs)
    assert all(sum(c.weight for c in r.confusion) == n_val and len(r.confusion) == 36 for r in epochs)
    model = train.newest(spark, out)
    assert np.allclose(model.weights, epochs[-1].weights) and model.features == ("a", "b")
    scored = evaluate.evaluate(rows.where("split = 'test'"), model, config)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "Exchange" not in plan
    hit = scored.where("label is not null").select(F.avg(
        (F.expr("array_position(scores, array_max(scores)) - 1") == F.col("label")).cast("int"))).first()[0]
    assert hit > 0.9
    ranked = rank.rank(rows.where("split = 'test'"), model, config, "id").collect()
    assert {r.feature for r in ranked} == {"a", "b"} and all(r.loss_delta > 0 for r in ranked)


def test_first_step_is_the_numerical_gradient(spark):
    rows = _rows(spark, 200).withColumn("batch_id", F.lit(0).cast("bigint")).where("label is not null")
    scaled = np.random.default_rng(1).normal(size=(3, 3))
    mean, std = np.array([1.0, -1.0]), np.array([2.0, 3.0])
    found = descent._gradient(rows, FEATURES, "label", "weight", scaled, mean, std)
    data = rows.collect()
    x = np.array([[0.0 if v is None or np.isnan(v) else v for v in (r.a, r.b)] for r in data])
    x = np.hstack([(x - mean) / std, np.ones((len(x), 1))])
    y = np.array([r.label for r in data])

    def loss(w):
        z = x @ w.T
        z -= z.max(axis=1, keepdims=True)
        return float(-(z[np.arange(len(y)), y] - np.log(np.exp(z).sum(axis=1))).sum())

    assert found[-2] == pytest.approx(loss(scaled)) and found[-1] == len(y)
    for at in np.ndindex(scaled.shape):
        step = np.zeros_like(scaled)
        step[at] = 1e-5
        slope = (loss(scaled + step) - loss(scaled - step)) / 2e-5
        assert found[:-2].reshape(scaled.shape)[at] == pytest.approx(slope, rel=1e-4, abs=1e-4)


def test_a_run_goes_on_after_its_last_epoch(spark, run, tmp_path):
    rows, config, _, history = run
    out = str(tmp_path / "run")
    train.fit(rows, config, "id", out, Descent(epochs=2, steps=2, rate=0.5))
    again = train.fit(rows, config, "id", out, Descent(epochs=5, steps=2, rate=0.5))
    pick = lambda h: [(r.epoch, r.val_loss) for r in h.orderBy("epoch").collect()]
    for (e, a), (f, b) in zip(pick(again), pick(history), strict=True):
        assert e == f and a == pytest.approx(b, rel=1e-9)
    # Nothing is left to do: the folder's files stay as they are.
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "run").rglob("*.parquet")}
    train.fit(rows, config, "id", out, Descent(epochs=5, steps=2, rate=0.5))
    assert before == {f: f.stat().st_mtime_ns for f in (tmp_path / "run").rglob("*.parquet")}


def test_patience_ends_a_run(spark, run, tmp_path):
    rows, config, *_ = run
    history = train.fit(rows, config, "id", str(tmp_path / "run"),
                        Descent(epochs=9, steps=1, rate=-0.2, patience=2))
    assert history.count() == 3  # the first epoch stays the best


def test_network_and_generated_code_agree(spark, run):
    rows, config, out, _ = run
    model = linear.load_newest(spark, f"{out}/*/weights/*/part-*.parquet")
    inputs = model.inputs(rows, config, ["id"])
    own = {r.id: r.scores for r in model.score(inputs, ["id"]).collect()}
    wide = linear.LinearModel(model.features, model.weights, model.bias)
    vectors = model.vectors(inputs, ["id"])
    for r in scoring.batch_score(vectors, model.network(), ["id"]).collect():
        assert r.scores == pytest.approx(own[r.id])
    saved, linear.WRITTEN_OUT = linear.WRITTEN_OUT, 0
    try:
        for r in wide.score(inputs, ["id"]).collect():
            assert r.scores == pytest.approx(own[r.id])
    finally:
        linear.WRITTEN_OUT = saved


def test_multinomial_fit_scores_and_ranks_too(spark):
    rows = _rows(spark)
    model, _ = train.train(rows, CONFIG, max_iter=5)
    mine = linear.from_pipeline(model, ["t", "a", "b"])
    pooled = mine.inputs(rows, CONFIG, ["id"])
    theirs = {r.id: list(r["_probability"]) for r in model.transform(pooled).collect()}
    for r in mine.score(pooled, ["id"]).collect():
        assert r.scores == pytest.approx(theirs[r.id], abs=1e-9)
    assert evaluate.evaluate(rows, mine, CONFIG).count() == rows.count()


def test_rows_without_a_class_have_no_part_in_importance(spark, run):
    rows, config, out, _ = run
    model = train.newest(spark, out)
    odd = rows.withColumn("label", F.when(F.col("id") % 77 == 5, 99).otherwise(F.col("label")))
    vectors, network, names = model.ranking(odd, config, ["id"])
    donated = importance.permute_columns(vectors, ["scalars"], "id", suffix=importance.DONOR)
    sums = importance.variant_sums(donated, network, names, "label", "weight")
    n = sums.where("feature = ''").agg(F.sum("n")).first()[0]
    assert n == odd.where("label between 0 and 5").count() < odd.count()
    summary = scoring.loss_and_accuracy(
        model.score(model.inputs(odd, config, ["label"]), ["label"]).withColumn("pred", F.lit(0)),
        F.col("scores"), F.when(F.col("label") < 6, F.col("label")), F.col("pred")).first()
    assert summary.n == n

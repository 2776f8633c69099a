"""ROC curves, AUC, working points. Signal is always the positive class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setframe.operators.ordering import cumulative_sums, percentiles
from setframe.session import broadcast_bounded


def score_counts(df: DataFrame, score: Column, is_signal: Column, weight: Column | None = None,
                 group: Sequence[str] = (), max_groups: int | None = 1) -> DataFrame:
    """Running signal/background weight by descending score, one row per distinct score.

    Columns: ``group..., score`` and, each with ``_before`` and ``_total``: ``pos`` and ``neg``
    (weights), ``n`` (rows), ``n_pos`` (signal rows). Everything about a curve or a working point
    is arithmetic on this table, so the records themselves are scanned and shuffled once.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = df.select(*group, (-score).alias("_down"), is_signal.alias("_sig"), w.alias("_w"))
    counts = cumulative_sums(
        rows, "_down",
        {"pos": F.expr("sum(if(_sig, _w, 0D))"), "neg": F.expr("sum(if(_sig, 0D, _w))"),
         "n": F.expr("count(1)"), "n_pos": F.expr("count_if(_sig)")},
        group, max_groups)
    return counts.withColumn("score", -F.col("_down")).drop("_down")


def roc_curve(counts: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """``(group..., threshold, fpr, tpr)``: the origin, then one point per distinct score.

    The origin carries the top score plus one as its threshold.
    """
    point = F.struct(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("neg_before") + F.col("neg"), F.col("neg_total")).alias("fpr"),
        F.try_divide(F.col("pos_before") + F.col("pos"), F.col("pos_total")).alias("tpr"))
    origin = F.struct((F.col("score") + F.lit(1.0)).alias("threshold"),
                      F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    points = F.when(F.col("n_before") == 0, F.array(origin, point)).otherwise(F.array(point))
    return counts.select(*group, F.inline(points))


def efficiency_rejection(curve: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Signal efficiency against background rejection; points with no background are left out."""
    return curve.where(F.col("fpr") > 0).select(
        *group, F.col("tpr").alias("efficiency"), (F.lit(1.0) / F.col("fpr")).alias("rejection"))


def auc(counts: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Area under the curve: each background weight times the signal above it, ties at half.

    Identical to the trapezoid rule over the points, without pairing neighbouring rows.
    """
    area = F.sum(F.col("neg") * (F.col("pos_before") + F.col("pos") / F.lit(2.0)))
    return counts.groupBy(*group).agg(
        F.try_divide(area, F.max("pos_total") * F.max("neg_total")).alias("auc"),
        F.count(F.lit(1)).alias("n_thresholds"))


def working_points(counts: DataFrame, efficiencies: Sequence[int],
                   group: Sequence[str] = ()) -> DataFrame:
    """``(group..., wp, cut, raw_percentile_cut)`` from the score distribution of signal rows.

    ``cut`` keeps ``wp`` percent of the signal above it (percentile ``100 - wp``);
    ``raw_percentile_cut`` is the percentile ``wp`` itself. Signal rows are counted unweighted.
    """
    wanted = sorted({float(100 - e) for e in efficiencies} | {float(e) for e in efficiencies})
    found = percentiles(counts, "score", "n_pos", wanted, group, descending=True)
    rows = ", ".join(
        f"struct({int(e)} as wp, percentiles[{float(100 - e)!r}D] as cut,"
        f" percentiles[{float(e)!r}D] as raw_percentile_cut)" for e in efficiencies)
    return found.select(*group, F.expr(f"inline(array({rows}))"))


SKETCH_K = 4096


def rank_error(k: int = SKETCH_K) -> float:
    """The sketch's error of a normalised rank, held with 99 percent confidence."""
    return 2.296 / k ** 0.9723


def signal_sketches(df: DataFrame, score: Column, is_signal: Column, by: Sequence[str],
                    k: int = SKETCH_K) -> DataFrame:
    """``(by..., n, sketch)``: a quantile sketch of the signal scores of each part, such as a file or a
    day. Sketches are some tens of kilobytes, can be stored, and merge without the rows."""
    return df.where(is_signal & score.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(score.cast("double"), k).alias("sketch"))


def sketched_working_points(sketches: DataFrame, efficiencies: Sequence[int],
                            group: Sequence[str] = ()) -> DataFrame:
    """``(group..., wp, n, cut)`` from stored sketches: :func:`working_points` to within
    :func:`rank_error` of the wanted share of the signal."""
    merged = sketches.groupBy(*group).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("s"))
    points = [F.struct(F.lit(int(e)).alias("wp"), F.kll_sketch_get_quantile_double(
        "s", F.lit((100 - e) / 100.0)).alias("cut")) for e in efficiencies]
    return merged.where("n > 0").select(*group, "n", F.inline(F.array(*points))).select(
        *group, "wp", "n", "cut")


def _with_cuts(counts: DataFrame, points: DataFrame, n_points: int, group: Sequence[str],
               max_groups: int) -> DataFrame:
    """Each row of the score table with the list of its group's cuts."""
    cuts = points.groupBy(*group).agg(F.collect_list(F.struct("wp", "cut")).alias("_cuts"))
    if group:
        cuts = broadcast_bounded(cuts.withColumnsRenamed({g: f"_c_{g}" for g in group}),
                                 max_groups * n_points)
        condition = F.lit(True)
        for g in group:
            condition = condition & F.col(g).eqNullSafe(F.col(f"_c_{g}"))
        listed = counts.join(cuts, condition)
    else:
        listed = counts.withColumn("_cuts", cuts.scalar())
    return listed


def above_cuts(counts: DataFrame, points: DataFrame, n_points: int, group: Sequence[str] = (),
               max_groups: int = 1) -> DataFrame:
    """Per group and working point: rows and weights above the cut, efficiency, rejection, AUC.

    Rows above a cut are a prefix of the descending score table, so the running sums of the full
    curve are already those of the restricted one; only its totals differ. No record is read again.
    A point with nothing above its cut is a row of zeros, its ratios NULL.
    """
    listed = _with_cuts(counts, points, n_points, group, max_groups)
    above = listed.select("*", F.inline("_cuts")).selectExpr(
        *[f"`{g}`" for g in group], "wp", "cut", "pos_total", "neg_total", "pos_before",
        *[f"if(score > cut, {c}, cast(0 as {t})) as {c}" for c, t in (
            ("n", "bigint"), ("n_pos", "bigint"), ("pos", "double"), ("neg", "double"))])
    return above.groupBy(*group, "wp", "cut").agg(*[F.expr(e) for e in (
        "sum(n) as n_pass", "sum(n_pos) as n_signal", "sum(pos) as w_signal",
        "sum(n - n_pos) as n_background", "sum(neg) as w_background",
        "try_divide(sum(pos), max(pos_total)) as efficiency",
        "try_divide(max(neg_total), sum(neg)) as rejection",
        "try_divide(sum(neg * (pos_before + pos / 2D)), sum(pos) * sum(neg)) as auc")])


def curves_above_cuts(counts: DataFrame, points: DataFrame, n_points: int,
                      group: Sequence[str] = (), max_groups: int = 1) -> DataFrame:
    """Per group and working point, the curve of the rows above the cut: ``(group..., wp, threshold,
    fpr, tpr)``. A prefix of the score table, with the totals of what passes."""
    keys = [*group, "wp"]
    listed = _with_cuts(counts, points, n_points, group, max_groups)
    passing = listed.select("*", F.inline("_cuts")).where("score > cut")
    totals = above_cuts(counts, points, n_points, group, max_groups).select(
        *keys, F.col("w_signal").alias("pos_total"), F.col("w_background").alias("neg_total"))
    restricted = passing.drop("pos_total", "neg_total").join(
        broadcast_bounded(totals, max_groups * n_points), keys)
    return roc_curve(restricted, keys)

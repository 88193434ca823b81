"""Curves and areas over scored, weighted pairs (label, score, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges of values that are dealt to different tasks.
RANGES = 100


def ranged(points: DataFrame, column: str, *by: str) -> DataFrame:
    """points with range: 0 to RANGES - 1, rising with the column, about as many points in each, however the values lie.

    The bounds are approximate quantiles of the points of each group; equal values share a range.
    """
    shares = F.array(*(F.lit(k / RANGES) for k in range(1, RANGES)))
    found = F.array_distinct(F.percentile_approx(column, shares, 10_000)).alias("_bounds")
    bounds = points.groupBy(*by).agg(found) if by else points.agg(found)
    both = points.join(bounds, list(by)) if by else points.crossJoin(F.broadcast(bounds))  # one row
    return both.withColumn("range", F.size(F.filter("_bounds", lambda b: b < F.col(column)))).drop("_bounds")


def summed_below(points: DataFrame, column: str, sums: dict[str, Column], *by: str, falling: bool = False) -> DataFrame:
    """points (with range) and, for each of sums, its sum over all points before (its name) and over all of the group (all_ and its name).

    Before: by rising column, or falling.  Sums run over the ranges first and then inside each, so no task sees all points.
    """
    direction = F.desc if falling else F.asc
    ranges = points.groupBy(*by, "range").agg(*(F.sum(c).alias(name) for name, c in sums.items()))
    order = Window.partitionBy(*by).orderBy(direction("range")).rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows a group
    whole = Window.partitionBy(*by)
    ranges = ranges.select(*by, "range", *(F.coalesce(F.sum(name).over(order), F.lit(0.0)).alias(f"_{name}") for name in sums), *(F.sum(name).over(whole).alias(f"all_{name}") for name in sums))
    inside = Window.partitionBy(*by, "range").orderBy(direction(column)).rowsBetween(Window.unboundedPreceding, -1)
    out = points.join(ranges, [*by, "range"])
    return out.withColumns({name: F.coalesce(F.sum(c).over(inside), F.lit(0.0)) + F.col(f"_{name}") for name, c in sums.items()}).drop(*(f"_{name}" for name in sums))


def cumulated(scored: DataFrame, *by: str) -> DataFrame:
    """A row per distinct score: the weight of either label at that score (p, n), at it or above (tp, fp), and all of it; range."""
    part = lambda label: F.sum(F.when(F.col("label") == label, F.col("weight")).otherwise(0.0))
    points = ranged(scored.groupBy(*by, "score").agg(part(1).alias("p"), part(0).alias("n")), "score", *by)
    sums = summed_below(points, "score", {"tp": F.col("p"), "fp": F.col("n")}, *by, falling=True)
    return sums.select(*by, "score", "p", "n", (F.col("tp") + F.col("p")).alias("tp"), (F.col("fp") + F.col("n")).alias("fp"), F.col("all_tp").alias("all_p"), F.col("all_fp").alias("all_n"), "range")


def roc_points(scored: DataFrame, *by: str) -> DataFrame:
    c = cumulated(scored, *by)
    return c.select(*by, "score", F.try_divide("tp", "all_p").alias("tpr"), F.try_divide("fp", "all_n").alias("fpr"), "range")


def _segments(points: DataFrame, x: str, y: str, start: tuple[float, float], by: tuple[str, ...]) -> DataFrame:
    """by, x0, y0, x1, y1: each point (with its range) with the one of the next higher score, start where there is none.

    A point finds the one before it inside its range of scores, the first of a range takes the last of the range before: no
    task sees all points.
    """
    here = F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    dealt = points.select(*by, "score", here.alias("p"), F.col("range").alias("_range"))
    ends = dealt.groupBy(*by, "_range").agg(F.min_by("p", "score").alias("end"))
    ends = ends.select(*by, "_range", F.lag("end").over(Window.partitionBy(*by).orderBy(F.desc("_range"))).alias("_before"))
    inside = F.lag("p").over(Window.partitionBy(*by, "_range").orderBy(F.desc("score")))
    first = F.struct(F.lit(float(start[0])).alias("x"), F.lit(float(start[1])).alias("y"))
    both = dealt.withColumn("_inside", inside).join(ends, [*by, "_range"]).withColumn("q", F.coalesce("_inside", "_before", first))
    return both.select(*by, F.col("q.x").alias("x0"), F.col("q.y").alias("y0"), F.col("p.x").alias("x1"), F.col("p.y").alias("y1"))


def _area(points: DataFrame, x: str, y: str, start: tuple[float, float], by: tuple[str, ...]) -> DataFrame:
    steps = _segments(points, x, y, start, by).select(*by, ((F.col("x1") - F.col("x0")) * (F.col("y1") + F.col("y0")) / 2).alias("step"))
    return steps.groupBy(*by).agg(F.sum("step").alias("area"))


def roc_auc(scored: DataFrame, *by: str) -> DataFrame:
    """by, roc_auc: the weighted share of (positive, negative) pairs in right order, ties half; null if a label is missing.

    Summed over distinct scores, with the weight above each from the cumulated sums: sums need no order.
    """
    both = cumulated(scored, *by)
    wins = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2))
    return both.groupBy(*by).agg(F.try_divide(wins, F.max("all_p") * F.max("all_n")).alias("roc_auc"))


def pr_points(scored: DataFrame, *by: str) -> DataFrame:
    c = cumulated(scored, *by)
    return c.select(*by, "score", F.try_divide("tp", "all_p").alias("recall"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), "all_n", "range")


def pr_auc(scored: DataFrame, *by: str) -> DataFrame:
    """by, pr_auc: trapezoids between the points of falling scores, from recall 0 and precision 1; null if a label is missing."""
    points = pr_points(scored, *by)
    area = _area(points.drop("all_n"), "recall", "precision", (0.0, 1.0), by)
    some = points.groupBy(*by).agg(F.max("all_n").alias("all_n"))
    out = area.join(some, list(by)) if by else area.crossJoin(some)  # one row each
    return out.select(*by, F.when(F.col("all_n") > 0, F.col("area")).alias("pr_auc"))


def best_threshold(scored: DataFrame) -> DataFrame:
    """One row: the score of the largest sqrt(TPR (1 - FPR)), unweighted, ties to the higher score; its rates and balanced accuracy."""
    points = roc_points(scored.withColumn("weight", F.lit(1.0))).withColumn("g_mean", F.round(F.sqrt(F.col("tpr") * (1 - F.col("fpr"))), 12))
    best = points.agg(F.max(F.struct("g_mean", "score", "tpr", "fpr")).alias("m"))
    return best.select("m.score", "m.g_mean", "m.tpr", "m.fpr", ((F.col("m.tpr") + 1 - F.col("m.fpr")) / 2).alias("balanced_accuracy"))


def interpolated(points: DataFrame, x: str, y: str, grid: int, *by: str, start: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """by, at, value: y on an even grid of x from 0 to 1, straight lines between points from start on; points in the order of falling score."""
    segments = _segments(points, x, y, start, by)
    last = F.floor(F.col("x1") * (grid - 1)).cast("int")
    first = F.when(F.col("x0") == 0, 0).otherwise(F.floor(F.col("x0") * (grid - 1)).cast("int") + 1)
    each = segments.filter("x1 > x0").withColumn("k", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    at = F.col("k") / F.lit(float(grid - 1))
    return each.select(*by, at.alias("at"), (F.col("y0") + (F.col("y1") - F.col("y0")) * (at - F.col("x0")) / (F.col("x1") - F.col("x0"))).alias("value"))


def mean_curve(curves: DataFrame) -> DataFrame:
    return curves.groupBy("at").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def fold_summary(areas: DataFrame, column: str) -> DataFrame:
    """Mean, sample deviation and the 1.96-sigma bounds over folds."""
    return areas.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std")).withColumn("low", F.col("mean") - 1.96 * F.col("std")).withColumn("high", F.least(F.col("mean") + 1.96 * F.col("std"), F.lit(1.0)))

"""Three-way routing, threshold grids, skylines and policy choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIONS = ("auto_keep", "manual_review", "auto_exclude")


def route(p: Column, keep: float | None, exclude: float | None) -> Column:
    """auto_keep up to ``keep``, auto_exclude from ``exclude`` on, both ends closed; anything else, unset thresholds and unknown scores are for review."""
    if keep is None or exclude is None:
        return F.lit("manual_review")
    known = p.isNotNull() & ~F.isnan(p) & p.between(0, 1)
    return F.when(known & (p <= keep), "auto_keep").when(known & (p >= exclude), "auto_exclude").otherwise("manual_review")


def reroute(df: DataFrame, p: str, keep: float, exclude: float, text: str, digest: str) -> DataFrame:
    """New actions from frozen scores; ``intact`` tells whether the text still has its digest."""
    return df.withColumn("action", route(F.col(p), keep, exclude)).withColumn("intact", F.sha2(F.col(text).cast("binary"), 256).eqNullSafe(F.col(digest)))


def joint_stratum(sparse: Column, dense: Column) -> Column:
    """Six exclusive strata of two models' scores, the first that holds (names and thresholds are fixed values)."""
    high, upper = (lambda x: x >= 0.90), (lambda x: x >= 0.50)
    return (
        F.when(high(sparse) & high(dense), "both_p_ge_0_90")
        .when(high(dense), "qwen_only_p_ge_0_90")
        .when(high(sparse), "sparse_only_p_ge_0_90")
        .when(upper(sparse) != upper(dense), "action_disagreement_at_0_50")
        .when(upper(sparse), "both_p_ge_0_50_remainder")
        .otherwise("both_p_lt_0_50")
    )


def action_stratum(left: Column, right: Column) -> Column:
    return F.concat_ws("__", F.concat(F.lit("dense_"), left), F.concat(F.lit("sparse_"), right))


def length_band(n: Column, edges: Sequence[int] = (20, 60, 150, 400)) -> Column:
    """Band number of a length: 0 below the first edge, then one more for each edge reached."""
    out = F.lit(0)
    for k, e in enumerate(edges):
        out = F.when(n >= e, k + 1).otherwise(out)
    return out


def probability_band(p: Column, edges: Sequence[float] = (0.1, 0.3, 0.5, 0.7, 0.9)) -> Column:
    """Band number of a probability; the last band includes 1."""
    out = F.lit(0)
    for k, e in enumerate(edges):
        out = F.when(p >= e, k + 1).otherwise(out)
    return out


def threshold_grid(df: DataFrame, p: str, adverse_keep: Column, adverse_exclude: Column, steps: int = 50) -> DataFrame:
    """For every pair keep < exclude of hundredths-like steps (1 to ``steps`` - 1 over ``steps``): counts of the three actions and adverse events in both tails.

    The scores are read once into a histogram of ``steps`` + 1 cells (those exactly at a step apart from those
    between); running sums over its cells serve all pairs, so the grid never multiplies the rows.
    """
    at = F.floor(F.col(p) * steps + 1e-9).cast("int")
    on = F.abs(F.col(p) * steps - F.round(F.col(p) * steps)) < 1e-9
    cell = F.when(on, F.round(F.col(p) * steps).cast("int") * 2).otherwise(at * 2 + 1)
    cells = df.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(adverse_keep, 1).otherwise(0)).alias("bad_keep"), F.sum(F.when(adverse_exclude, 1).otherwise(0)).alias("bad_exclude"))
    frame = df.sparkSession.range(0, 2 * steps + 1).select(F.col("id").cast("int").alias("cell"))
    full = frame.join(F.broadcast(cells), "cell", "left").na.fill(0)
    up = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    sums = full.select("cell", F.sum("n").over(up).alias("keep_n"), F.sum("bad_keep").over(up).alias("keep_bad"), F.sum("n").over(down).alias("exclude_n"), F.sum("bad_exclude").over(down).alias("exclude_bad"), whole.alias("total"))
    steps_at = sums.where("cell % 2 = 0 and cell between 2 and " + str(2 * steps - 2)).withColumn("step", (F.col("cell") / 2).cast("int"))
    left = steps_at.select(F.col("step").alias("keep_step"), "keep_n", "keep_bad", "total")
    right = steps_at.select(F.col("step").alias("exclude_step"), "exclude_n", "exclude_bad")
    pairs = left.join(F.broadcast(right), F.col("keep_step") < F.col("exclude_step"))
    risk = lambda bad, n: F.when(F.col(n) > 0, F.col(bad) / F.col(n))
    long = lambda c: F.col(c).cast("bigint")
    return pairs.select(
        "keep_step", "exclude_step", long("keep_n").alias("keep_n"), long("exclude_n").alias("exclude_n"), (long("total") - long("keep_n") - long("exclude_n")).alias("manual_n"), long("keep_bad").alias("keep_bad"), long("exclude_bad").alias("exclude_bad"),
        risk("keep_bad", "keep_n").alias("keep_risk"), risk("exclude_bad", "exclude_n").alias("exclude_risk"),
    )


def pareto(points: DataFrame, objectives: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Points that no other beats: no worse in every objective (smaller is better) and better in one. For grids of a few thousand points."""
    other = points.select(*(F.col(c).alias(f"__{c}") for c in objectives)).distinct()
    worse = F.lit(True)
    better = F.lit(False)
    for c in objectives:
        worse, better = worse & (F.col(f"__{c}") <= F.col(c)), better | (F.col(f"__{c}") < F.col(c))
    return points.join(F.broadcast(other), worse & better, "left_anti").select(*key, *objectives)


def best_policy(points: DataFrame, safe: Column, order: Sequence[Column]) -> DataFrame:
    """The first safe point in order."""
    return points.where(safe).orderBy(*order).limit(1)


def nearest_workload(points: DataFrame, rate: str, targets: Sequence[float], key: Sequence[str]) -> DataFrame:
    """For each target the point whose rate is nearest, ties by key."""
    frame = points.sparkSession.createDataFrame([(float(t),) for t in targets], "target double")
    far = points.join(F.broadcast(frame)).withColumn("gap", F.abs(F.col(rate) - F.col("target")))
    order = Window.partitionBy("target").orderBy("gap", *key)
    return far.withColumn("__r", F.row_number().over(order)).where("__r = 1").select("target", *key, rate)

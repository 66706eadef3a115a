"""Metrics: binary and weighted scores, risk and coverage, agreement, bootstrap, acceptance."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d)


def confusion(df: DataFrame, label: str, p: str, threshold: float = 0.5) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall and F1 (0 where nothing is to divide by)."""
    yes, hit = F.col(label) == 1, F.col(p) >= threshold
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    out = df.agg(n(yes & hit).alias("tp"), n(~yes & hit).alias("fp"), n(yes & ~hit).alias("fn"), n(~yes & ~hit).alias("tn"))
    zero = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return out.withColumn("precision", zero(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", zero(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("f1", zero(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def brier_and_log_loss(df: DataFrame, label: str, p: str, weight: Column | None = None, clip: float = 1e-15) -> DataFrame:
    """One row of weighted means of the squared error and the log loss."""
    w = weight if weight is not None else F.lit(1.0)
    q = F.greatest(F.least(F.col(p), F.lit(1 - clip)), F.lit(clip))
    loss = -F.when(F.col(label) == 1, F.ln(q)).otherwise(F.ln(1 - q))
    return df.agg(_ratio(F.sum(w * F.pow(F.col(p) - F.col(label), 2)), F.sum(w)).alias("brier"), _ratio(F.sum(w * loss), F.sum(w)).alias("log_loss"))


def average_precision(df: DataFrame, label: str, p: str, weight: str | None = None) -> DataFrame:
    """Stepwise area under precision and recall, tied scores taken together.

    Scores are pre-aggregated; the running sums go over ranges of the score, counted first, so
    that no single window holds all distinct scores.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    steps = df.groupBy(F.col(p).alias("s")).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0.0)).alias("pos"), F.sum(w).alias("all"))
    steps = steps.withColumn("part", F.floor(F.col("s") * 256))
    parts = steps.groupBy("part").agg(F.sum("pos").alias("ppos"), F.sum("all").alias("pall"))
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("ppos").over(above), F.lit(0.0)).alias("bpos"), F.coalesce(F.sum("pall").over(above), F.lit(0.0)).alias("ball"))
    run = Window.partitionBy("part").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    at = steps.withColumns({"cpos": F.sum("pos").over(run), "call": F.sum("all").over(run)}).join(F.broadcast(parts), "part")
    term = F.col("pos") * (F.col("bpos") + F.col("cpos")) / (F.col("ball") + F.col("call"))
    return at.agg(_ratio(F.sum(term), F.sum("pos")).alias("average_precision"))


def weighted_rates(df: DataFrame, event: Column, base: Column, weight: str) -> DataFrame:
    """Design-weighted ratio, raw ratio and effective sample size of the base."""
    w = F.col(weight)
    on = F.when(base, w)
    return df.agg(
        _ratio(F.sum(F.when(base & event, w)), F.sum(on)).alias("weighted_rate"),
        _ratio(F.sum(F.when(base & event, 1.0)), F.sum(F.when(base, 1.0))).alias("raw_rate"),
        _ratio(F.pow(F.sum(on), 2), F.sum(on * on)).alias("effective_n"),
    )


def risk_coverage(df: DataFrame, label: str, p: str, grid: Sequence[float]) -> DataFrame:
    """For each confidence of the grid: the share of rows at least so sure, and their error rate (null without any).

    One pass: every row counts once, at the highest grid point that it reaches; a running sum over the grid does the rest.
    """
    points = sorted(grid)
    sure = F.greatest(F.col(p), 1 - F.col(p))
    level = F.lit(-1)
    for k, g in enumerate(points):
        level = F.when(sure >= g, k).otherwise(level)
    wrong = (F.col(p) >= 0.5).cast("int") != F.col(label)
    counts = df.groupBy(level.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(wrong.cast("int")).alias("bad"))
    frame = df.sparkSession.createDataFrame([(k, float(g)) for k, g in enumerate(points)] + [(-1, None)], "k int, confidence double")
    filled = frame.join(F.broadcast(counts), "k", "left").na.fill(0, ["n", "bad"])
    up = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = filled.withColumns({"kept": F.sum("n").over(up), "errors": F.sum("bad").over(up), "total": total}).where("k >= 0")
    return out.select("confidence", F.col("kept").cast("bigint").alias("kept"), _ratio(F.col("kept"), F.col("total")).alias("coverage"), _ratio(F.col("errors"), F.col("kept")).alias("risk"))


def nominal_alpha(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Nominal agreement beyond chance of two coders: 1 - observed / expected disagreement (1 if neither disagrees)."""
    observed = pairs.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(a) != F.col(b)).cast("double")).alias("do"))
    pooled = pairs.select(F.explode(F.array(F.col(a), F.col(b))).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    expected = pooled.agg(F.sum("c").alias("m"), F.sum(F.col("c").cast("double") * (F.col("c") - 1)).alias("same"))
    de = 1 - F.col("same") / (F.col("m") * (F.col("m") - 1))
    return observed.crossJoin(F.broadcast(expected)).select(F.col("n").alias("pairs"), F.col("do").alias("observed"), de.alias("expected"), F.when(de > 0, 1 - F.col("do") / de).otherwise(F.lit(1.0)).alias("alpha"))


def component_bootstrap(sums: np.ndarray, seed: int, repetitions: int = 2000, confidence: float = 0.95) -> tuple[float, float] | None:
    """Percentile interval of sum(numerator) / sum(denominator) over resampled components.

    ``sums`` has a row (numerator, denominator) for each component, aggregated in Spark first.
    Resampling n components with replacement is a multinomial draw of their multiplicities, taken in blocks of bounded memory.
    """
    sums = np.asarray(sums, float).reshape(-1, 2)
    if not len(sums) or sums[:, 1].sum() <= 0:
        return None
    rng, n, found = np.random.default_rng(seed), len(sums), []
    for low in range(0, repetitions, 200):
        times = rng.multinomial(n, np.full(n, 1 / n), size=min(200, repetitions - low))
        num, den = (times @ sums).T
        found.append(num[den > 0] / den[den > 0])
    values = np.concatenate(found)
    tail = (1 - confidence) / 2
    return float(np.quantile(values, tail)), float(np.quantile(values, 1 - tail))


def acceptance_gates(baseline: dict[str, float], candidate: dict[str, float], margins: dict[str, float], higher: frozenset[str] = frozenset({"recall", "precision", "f1", "average_precision"})) -> dict[str, bool]:
    """For each margin: whether the candidate is no worse than the baseline by more than it."""
    out = {}
    for name, margin in margins.items():
        delta = candidate[name] - baseline[name]
        out[name] = bool(delta >= -margin if name in higher else delta <= margin)
    return out


def band_errors(df: DataFrame, band: Column, label: str, p: str, length: str) -> DataFrame:
    """Rows, errors, positives and exact median length in each band."""
    wrong = ((F.col(p) >= 0.5).cast("int") != F.col(label)).cast("int")
    return df.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum(wrong).alias("errors"), F.sum(F.col(label).cast("bigint")).alias("positives"), F.percentile(length, 0.5).alias("median_length"))

"""Deterministic sampling, splitting and design weights, ordered by SHA-256 of a seed and an identity.

Top-n per stratum goes through a bounded collection per task before its window, so a stratum that
holds most rows is cut to n rows map-side and never lies in one window whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64


def hash_order(seed: str, *identity: str) -> Column:
    """The draw of a row: SHA-256 of the seed and its identity, joined by colons."""
    return F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in identity]).cast("binary"), 256)


def top_per_stratum(df: DataFrame, strata: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each stratum: first within salted buckets of it, then among their survivors."""
    salt = F.pmod(F.xxhash64(*order), F.lit(BUCKETS))
    first = Window.partitionBy(*strata, "__salt").orderBy(*order)
    few = df.withColumn("__salt", salt).withColumn(rank, F.row_number().over(first)).where(F.col(rank) <= n).drop("__salt")
    return few.withColumn(rank, F.row_number().over(Window.partitionBy(*strata).orderBy(*order))).where(F.col(rank) <= n)


def stratified_sample(df: DataFrame, stratum: str, key: str, seed: str, n: int) -> DataFrame:
    """n rows per stratum by hash order, with inclusion probability and design weight."""
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("stratum_size"))
    drawn = top_per_stratum(df.withColumn("draw", hash_order(seed, key)), [stratum], [F.col("draw"), F.col(key)], n)
    taken = F.least(F.col("stratum_size"), F.lit(n))
    return drawn.join(sizes, stratum).withColumn("inclusion", taken / F.col("stratum_size")).withColumn("weight", F.col("stratum_size") / taken)


def redistributed(population: dict[str, int], targets: dict[str, int]) -> dict[str, int]:
    """Allocations per stratum: small strata are taken whole, and what they lack is spread over the rest in proportion to their room, by largest remainders.

    No share exceeds its stratum's room, so one pass fills all targets. Raises if the strata differ or hold too few.
    """
    if set(population) != set(targets):
        raise ValueError("population and targets name different strata")
    room = {s: max(0, population[s] - t) for s, t in targets.items()}
    lack, total = sum(max(0, t - population[s]) for s, t in targets.items()), sum(room.values())
    if lack > total:
        raise ValueError(f"the strata hold {total} rows to spare, {lack} are lacking")
    whole = {s: lack * r // max(1, total) for s, r in room.items()}
    by_remainder = sorted(targets, key=lambda s: -(lack * room[s] % max(1, total)))  # stable: equal remainders keep the targets' order
    extra = set(by_remainder[: lack - sum(whole.values())])
    return {s: min(t, population[s]) + whole[s] + (s in extra) for s, t in targets.items()}


def global_rank(df: DataFrame, draw: Column, key: str, rank: str = "queue_rank") -> DataFrame:
    """Ranks over the whole table by (draw, key) without one big window: ranges of the draw's first digits are counted, then ranked apart."""
    rows = df.withColumn("__draw", draw).withColumn("__range", F.substring("__draw", 1, 3))
    counts = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__range", before.alias("__before"))  # at most 4,096 rows, whatever the table's size
    inside = F.row_number().over(Window.partitionBy("__range").orderBy("__draw", key))
    return rows.withColumn("__inside", inside).join(F.broadcast(offsets), "__range").withColumn(rank, (F.col("__before") + F.col("__inside")).cast("bigint")).drop("__draw", "__range", "__inside", "__before")


def round_robin(df: DataFrame, group: str, draw: Column, key: str, n: int) -> DataFrame:
    """n rows, one from each group in turn."""
    ranked = top_per_stratum(df.withColumn("draw", draw), [group], [F.col("draw"), F.col(key)], n, "turn")
    return ranked.orderBy("turn", group).limit(n)


def rank_in_group(df: DataFrame, group: str, by: str, ties: Sequence[str], parts: int = 128) -> DataFrame:
    """``df`` with __i, a row's place from 0 in its group by a number and then ties, and __n, the group's rows.

    Each group's numbers are cut into ``parts`` ranges of about as many rows (by approximate quantiles): ranges are counted,
    then ranked apart, so that no group, however hot, is sorted in one task.
    """
    at = F.array_distinct(F.percentile_approx(by, F.array(*[F.lit(k / parts) for k in range(1, parts)]), 20 * parts))
    edges = df.groupBy(group).agg(at.alias("__edges"))  # a row of at most ``parts`` numbers for each group
    keyed = df.join(edges.withColumnRenamed(group, "__g"), F.col(group).eqNullSafe(F.col("__g"))).drop("__g")
    low = F.coalesce(F.size(F.filter("__edges", lambda e: e < F.col(by))), F.lit(0))
    keyed = keyed.withColumn("__part", low).drop("__edges")
    counts = keyed.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__c"))
    whole = Window.partitionBy(group)
    offsets = counts.select(F.col(group).alias("__g"), F.col("__part").alias("__p"), (F.sum("__c").over(whole.orderBy("__part")) - F.col("__c")).alias("__before"), F.sum("__c").over(whole).alias("__n"))
    inside = F.row_number().over(Window.partitionBy(group, "__part").orderBy(by, *ties))
    ranked = keyed.withColumn("__k", inside).join(offsets, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")))
    return ranked.withColumn("__i", F.col("__before") + F.col("__k") - 1).drop("__g", "__p", "__part", "__k", "__before")


def quantile_rows(df: DataFrame, group: str, order: Sequence[str], k: int) -> DataFrame:
    """Earliest, latest and evenly spaced rows of each group (half-even positions); the first column of the order is a number."""
    ranked = rank_in_group(df, group, order[0], order[1:])
    spots = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("__n") - 1) / F.lit(max(1, k - 1))).cast("bigint"))
    return ranked.where((F.col("__n") <= k) | F.array_contains(spots, F.col("__i"))).withColumn("position", F.col("__i").cast("bigint")).drop("__i", "__n")


def temporal_test_tail(df: DataFrame, time: str, key: str, component: str, fraction: float, seed: str) -> DataFrame:
    """The last share of rows by (time, hash) is the test set, grown to whole components; others stay for training."""
    total = df.agg(F.count(F.lit(1)).alias("n"))
    days = df.groupBy(time).agg(F.count(F.lit(1)).alias("__d"))
    later = F.coalesce(F.sum("__d").over(Window.orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = days.withColumn("later", later).crossJoin(F.broadcast(total)).withColumn("want", F.ceil(F.col("n") * fraction)).where("later < want").select(time, "later", "want")
    ranked = df.join(edges, time).withColumn("r", F.row_number().over(Window.partitionBy(time).orderBy(hash_order(seed, key).desc(), key)) + F.col("later"))
    tail = ranked.where("r <= want").select(component).distinct().withColumn("__test", F.lit(True))
    return df.join(tail, component, "left").withColumn("split", F.when(F.col("__test"), "test").otherwise("train")).drop("__test")


def hash_folds(df: DataFrame, component: str, folds: int, seed: str) -> DataFrame:
    """A fold for each component by hash: rows of one component never part."""
    return df.withColumn("fold", F.pmod(F.conv(F.substring(hash_order(seed, component), 1, 8), 16, 10).cast("bigint"), F.lit(folds)).cast("int"))


def grouped_stratified_folds(components: Sequence[tuple[str, int, int]], folds: int) -> dict[str, int]:
    """A fold for each (component, positives, negatives): the largest first, each to the fold that is then evenest."""
    totals = (sum(c[1] for c in components) or 1, sum(c[2] for c in components) or 1)
    load = [[0, 0] for _ in range(folds)]
    out = {}
    for name, pos, neg in sorted(components, key=lambda c: (-(c[1] + c[2]), c[0])):

        def uneven(f: int) -> float:
            after = [[p + (pos if k == f else 0), n + (neg if k == f else 0)] for k, (p, n) in enumerate(load)]
            return sum((x[i] / totals[i] - 1 / folds) ** 2 for x in after for i in (0, 1))

        best = min(range(folds), key=lambda f: (round(uneven(f), 12), f))
        out[name] = best
        load[best][0] += pos
        load[best][1] += neg
    return out


def valid_folds(components: Sequence[tuple[str, int, int]], wanted: int) -> tuple[int, dict[str, int]]:
    """The most folds up to ``wanted`` that have both classes on both sides of each."""
    for k in range(wanted, 1, -1):
        fold = grouped_stratified_folds(components, k)
        sums = [[sum(c[i] for c in components if fold[c[0]] == f) for i in (1, 2)] for f in range(k)]
        whole = [sum(s[i] for s in sums) for i in (0, 1)]
        if all(0 < s[i] < whole[i] for s in sums for i in (0, 1)):
            return k, fold
    raise ValueError("too few groups of both classes for two folds")

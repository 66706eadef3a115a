"""Sampling designs, resampling with shared draws, and the checks around them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.numeric import rate
from quern.operators.sampling import global_rank, hash_order, top_per_stratum


def two_tail_audit(df: DataFrame, action: str, tails: Sequence[str], key: str, audit: str, n: int) -> DataFrame:
    """``n`` rows of each tail by hash, without replacement, as blind tasks: task_id, key, action and a position that mixes the tails.

    A tail with fewer rows gives all; ``tail_size`` tells.
    """
    both = df.where(F.col(action).isin(*tails))
    sizes = both.groupBy(action).agg(F.count(F.lit(1)).alias("tail_size"))
    drawn = top_per_stratum(both.select(key, action).withColumn("draw", hash_order(audit, key)), [action], [F.col("draw"), F.col(key)], n)
    task = F.substring(F.sha2(F.concat_ws("|", F.lit(audit), F.lit("task"), F.col(key).cast("string")).cast("binary"), 256), 1, 24)
    mixed = Window.orderBy(hash_order(f"{audit}|shuffle", key), key)  # of n rows a tail
    return drawn.select(key, action, task.alias("task_id"), F.row_number().over(mixed).alias("position")).join(F.broadcast(sizes), action)


def balanced_take(df: DataFrame, group: str, draw: Column, key: str, n: int) -> DataFrame:
    """n rows, one from each group in turn, by draw; of no group more than n rows are looked at."""
    ranked = top_per_stratum(df.withColumn("__draw", draw), [group], [F.col("__draw"), F.col(key)], n, "__turn")
    return ranked.orderBy("__turn", group).limit(n).drop("__draw", "__turn")


def bucketed_sample(df: DataFrame, stratum: str, wanted: Sequence[tuple[str, int]], group: str, key: str, seed: str, total: int) -> DataFrame:
    """Rows of each wanted stratum, balanced over groups, then the rest of ``total`` from whatever is left; ``bucket`` says which draw a row comes from.

    Raises if there are fewer than ``total`` rows. A shortage of a stratum goes to the last draw.
    """
    taken, left = None, df
    for name, n in [*wanted, ("RANDOM_REMAINDER", None)]:
        held = taken.count() if taken is not None else 0  # never more than total
        pool = left if n is None else left.where(F.col(stratum) == name)
        drawn = balanced_take(pool, group, hash_order(f"{seed}:{name}", key), key, max(0, total - held) if n is None else min(n, total - held)).withColumn("bucket", F.lit(name))
        taken = drawn if taken is None else taken.unionByName(drawn)
        left = df.join(F.broadcast(taken.select(key)), key, "left_anti")
    if taken.count() != total:
        raise ValueError(f"fewer than {total} rows")
    return taken


def length_sample(df: DataFrame, bucket: Column, length: str, key: str, seed: str, per_bucket: int) -> DataFrame:
    """``per_bucket`` rows of each length bucket by hash, and the longest row of all (ties to the least key) if it is not among them; ``targeted`` marks it."""
    rows = df.select(key, length, bucket.alias("bucket"))
    drawn = top_per_stratum(rows.withColumn("draw", hash_order(seed, key)), ["bucket"], [F.col("draw"), F.col(key)], per_bucket).select(key, length, "bucket", F.lit(False).alias("targeted"))
    longest = rows.orderBy(F.desc(length), key).limit(1).withColumn("targeted", F.lit(True))
    return drawn.unionByName(longest.join(drawn.select(key), key, "left_anti").select(key, length, "bucket", "targeted"))


def audit_outside(df: DataFrame, excluded: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """n rows by hash of those whose key is not excluded: a simple random sample, by a bounded sort in each task."""
    left = df.join(excluded.select(key).distinct(), key, "left_anti")
    return left.withColumn("draw", hash_order(seed, key)).orderBy("draw", key).limit(n).drop("draw")


def multiplicities(df: DataFrame, component: str, seed: str, repetitions: int) -> DataFrame:
    """(rep, component, times): how often each resample of as many components as there are draws a component; the same for every metric and model.

    The draw of number i in resample r is a hash of both, so that no state is kept and a lost task draws the same again.
    """
    named = df.select(component).where(F.col(component).isNotNull()).distinct()
    numbered = global_rank(named, hash_order("component", component), component, "number")
    n = named.count()
    draws = df.sparkSession.range(repetitions * n).select(F.floor(F.col("id") / max(1, n)).cast("int").alias("rep"), (F.col("id") % max(1, n)).alias("i"))
    hashed = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col("rep").cast("string"), F.col("i").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    times = draws.select("rep", (F.pmod(hashed, F.lit(max(1, n))) + 1).alias("number")).groupBy("rep", "number").agg(F.count(F.lit(1)).alias("times"))
    return times.join(numbered, "number").select("rep", component, "times")


def resampled_sums(df: DataFrame, component: str, sums: dict[str, Column], times: DataFrame) -> DataFrame:
    """(rep, ...): each sum over every resample; rows are added up by component before they meet the resamples."""
    per = df.groupBy(component).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    return times.join(per, component).groupBy("rep").agg(*[F.sum(F.col(name) * F.col("times")).alias(name) for name in sums])


def bootstrap_ratios(df: DataFrame, component: str, numerator: Column, denominator: Column, times: DataFrame) -> DataFrame:
    """(rep, ratio): a weighted share in every resample, null where nothing is below the line."""
    sums = resampled_sums(df, component, {"n": numerator, "d": denominator}, times)
    return sums.select("rep", F.when(F.col("d") > 0, F.col("n") / F.col("d")).alias("ratio"))


def paired_deltas(df: DataFrame, component: str, truth: str, baseline: str, candidate: str, times: DataFrame, cutoff: float = 0.5, clip: float = 1e-6) -> DataFrame:
    """(rep, log_loss_delta, error_delta): candidate less baseline in the same resamples; one without both classes gives no row."""
    y = F.col(truth)
    p = lambda c: F.least(F.greatest(F.col(c), F.lit(clip)), F.lit(1 - clip))
    loss = lambda c: -(y * F.log(p(c)) + (1 - y) * F.log(1 - p(c)))
    missed = lambda c: ((y == 0) & (F.col(c) >= cutoff)).cast("int")
    sums = resampled_sums(df, component, {"rows": F.lit(1), "ones": y, "loss": loss(candidate) - loss(baseline), "missed": missed(candidate) - missed(baseline)}, times)
    zeros = F.col("rows") - F.col("ones")
    return sums.where((F.col("ones") > 0) & (zeros > 0)).select("rep", (F.col("loss") / F.col("rows")).alias("log_loss_delta"), (F.col("missed") / zeros).alias("error_delta"))


def alpha_resamples(pairs: DataFrame, component: str, left: str, right: str, values: Sequence, times: DataFrame) -> DataFrame:
    """(rep, alpha): nominal agreement of two coders beyond chance in every resample; null where only one value occurs."""
    named = {f"v{k}": (F.col(left) == v).cast("int") + (F.col(right) == v).cast("int") for k, v in enumerate(values)}
    sums = resampled_sums(pairs, component, {"pairs": F.lit(1), "apart": (F.col(left) != F.col(right)).cast("int"), **named}, times)
    both = 2 * F.col("pairs")
    alike = sum((F.col(name) * (F.col(name) - 1) for name in named), F.lit(0))
    expected = 1 - alike / (both * (both - 1))
    return sums.select("rep", F.when((both > 1) & (expected > 0), 1 - (F.col("apart") / F.col("pairs")) / expected).alias("alpha"))


def coverage_threshold(df: DataFrame, p: str, coverage: float, buckets: int = 4096) -> float:
    """The greatest score below the lowest that the share ``coverage`` of rows reaches: rows above it are at least that share, ties never parted.

    Two passes: scores are counted in ``buckets`` ranges of 0 to 1, then the one range that holds the wanted rank is counted by value.
    """
    if not 0 < coverage < 1:
        raise ValueError("coverage is a share between 0 and 1")
    at = F.least(F.floor(F.col(p) * buckets), F.lit(buckets - 1)).cast("int").alias("at")
    counts = {r["at"]: r["count"] for r in df.where(F.col(p).between(0, 1)).select(at).groupBy("at").count().collect()}  # at most as many as buckets
    total = sum(counts.values())
    if not total:
        raise ValueError("no scores")
    wanted, k = math.ceil((total - 1) * (1 - coverage)), -1
    while wanted >= counts.get(k, 0):
        wanted -= counts.get(k, 0)
        k += 1
    inside = df.where(F.col(p).between(0, 1)).where(at == k).groupBy(p).count()
    below = F.sum("count").over(Window.orderBy(p).rowsBetween(Window.unboundedPreceding, 0))
    found = inside.withColumn("below", below).where(F.col("below") > wanted).agg(F.min(p)).first()[0]
    return math.nextafter(found, -math.inf)


def aligned(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows of either side by key: state (same, changed, only_left, only_right) and the names of the columns that differ."""
    a = left.select(F.col(key).alias("__k"), F.struct(*columns).alias("a"))
    b = right.select(F.col(key).alias("__k2"), F.struct(*columns).alias("b"))
    both = a.join(b, F.col("__k") == F.col("__k2"), "full")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns]))
    state = F.when(F.col("a").isNull(), "only_right").when(F.col("b").isNull(), "only_left").when(F.size(changed) > 0, "changed").otherwise("same")
    return both.select(F.coalesce("__k", "__k2").alias(key), state.alias("state"), F.when(state == "changed", changed).otherwise(F.array().cast("array<string>")).alias("changed"))


def guard_breaches(rows: DataFrame, key: str, guards: Sequence[tuple[str, DataFrame, Sequence[str], bool]]) -> DataFrame:
    """(key, guard): rows that break a guard (name, other, columns, wanted): some row of ``other`` with equal columns has to be there, or must not."""
    out = None
    for name, other, columns, wanted in guards:
        broken = rows.join(other.select(*columns).distinct(), list(columns), "left_anti" if wanted else "left_semi").select(key, F.lit(name).alias("guard"))
        out = broken if out is None else out.unionByName(broken)
    return out


def bijection_problems(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, problem): what keeps two key sets from being one-to-one: missing or repeated on either side, or null."""
    count = lambda df, name: df.groupBy(F.col(key).alias(f"__{name}")).agg(F.count(F.lit(1)).alias(name))
    both = count(left, "l").join(count(right, "r"), F.col("__l").eqNullSafe(F.col("__r")), "full")
    k, n, m = F.coalesce("__l", "__r"), F.coalesce("l", F.lit(0)), F.coalesce("r", F.lit(0))
    problem = F.when(k.isNull(), "null_key").when(n == 0, "missing_left").when(m == 0, "missing_right").when(n > 1, "repeated_left").when(m > 1, "repeated_right")
    return both.select(k.alias(key), problem.alias("problem")).where("problem is not null")


def schedule(gaps: dict[str, int], finals: dict[str, int]) -> list[tuple[int, str, int]]:
    """(step, frame, number in the frame): each step goes to the frame whose gap is largest against its final size, the first named on a tie."""
    left, out, used = dict(gaps), [], dict.fromkeys(gaps, 0)
    for step in range(1, sum(gaps.values()) + 1):
        frame = max((f for f in left if left[f]), key=lambda f: (left[f] / finals[f], -list(gaps).index(f)))
        left[frame] -= 1
        used[frame] += 1
        out.append((step, frame, used[frame]))
    return out


def scheduled(queue: DataFrame, frame: str, order: Sequence[Column], gaps: dict[str, int], finals: dict[str, int]) -> DataFrame:
    """The queue's rows that fill the gaps, with their step: the plan has as many rows as there are gaps, each frame's rows are ranked only so far."""
    ranked = top_per_stratum(queue.where(F.col(frame).isin(*gaps)), [frame], list(order), max(gaps.values()), "number")
    plan = queue.sparkSession.createDataFrame(schedule(gaps, finals), f"step int, {frame} string, number int")
    return ranked.join(F.broadcast(plan), [frame, "number"])


def blocked(components: DataFrame, accepted: DataFrame, key: str, component: str = "component") -> DataFrame:
    """``components`` with ``blocked``: whether some other row of the component is accepted already (accepted rows themselves are not listed)."""
    taken = components.join(accepted.select(key).distinct(), key, "left_semi").select(component).distinct().withColumn("__hit", F.lit(True))
    rest = components.join(accepted.select(key).distinct(), key, "left_anti")
    return rest.join(taken, component, "left").withColumn("blocked", F.coalesce("__hit", F.lit(False))).drop("__hit")


def strata_summary(df: DataFrame, bucket: Column, value: str) -> DataFrame:
    """For each bucket and for all (null bucket): rows, sum, least, greatest, mean and median of a whole-number value."""
    rows = df.select(bucket.alias("bucket"), F.col(value).alias("v"))
    out = rows.groupingSets([["bucket"], []], "bucket").agg(
        F.grouping("bucket").alias("whole"), F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.min("v").alias("least"), F.max("v").alias("greatest"), F.avg("v").alias("mean"), F.median("v").alias("median"),
    )
    return out.withColumn("whole", F.col("whole") == 1)


def review_summary(rows: DataFrame, group: str, original: str, reviewed: str, unsure: str = "uncertain") -> DataFrame:
    """Per group: rows, maintained, changed and uncertain ones, and the share of changes among decided ones."""
    decided = F.when(F.col(reviewed) == unsure, "u").when(F.col(reviewed) == F.col(original), "m").otherwise("c")
    count = lambda x: F.sum((decided == x).cast("bigint"))
    out = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), count("m").alias("maintained"), count("c").alias("changed"), count("u").alias("uncertain"))
    return out.withColumn("change_rate", rate(F.col("changed"), F.col("maintained") + F.col("changed")))


def nearest_share(df: DataFrame, group: str, value: str, anchors: dict[str, float], grid: Sequence[float]) -> DataFrame:
    """For each group the threshold of the grid whose share of rows at or above it is nearest to that of the anchors together (ties: the lower one)."""
    above = lambda t: F.sum((F.col(value) >= t).cast("bigint"))
    per = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[above(t).alias(f"g{k}") for k, t in enumerate(grid)], *[above(t).alias(f"a{k}") for k, t in enumerate(anchors.values())])
    hits = sum((F.when(F.col(group) == name, F.col(f"a{k}")).otherwise(0) for k, name in enumerate(anchors)), F.lit(0))
    reference = per.where(F.col(group).isin(*anchors)).agg((F.sum(hits) / F.sum("n")).alias("share"))  # one row
    options = F.array(*[F.struct(F.abs(F.col(f"g{k}") / F.col("n") - F.col("share")).alias("off"), F.lit(t).alias("threshold"), F.col(f"g{k}").alias("above")) for k, t in enumerate(grid)])
    best = per.crossJoin(F.broadcast(reference)).select(group, "n", F.array_min(options).alias("b"))
    return best.select(group, "n", F.col("b.threshold").alias("threshold"), F.col("b.above").alias("above_n"), rate(F.col("b.above"), F.col("n")).alias("above_rate"))


def safest(df: DataFrame, eligible: Column, order: Sequence[Column], fallback: Sequence[Column]) -> DataFrame:
    """The one row that comes first among eligible ones by ``order``, or among all by ``fallback`` if none is eligible."""
    ok = F.coalesce(eligible, F.lit(False))
    first = df.where(ok).orderBy(*order).limit(1).withColumn("eligible", F.lit(True))
    last = df.orderBy(*fallback).limit(1).withColumn("eligible", F.lit(False))
    none = last.join(first.select(F.lit(1).alias("__one")), F.lit(True), "left_anti")
    return first.unionByName(none)


def line_context(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, chars, before, after): each line's length and its neighbours' (null at the ends), within a row, so nothing is shuffled."""
    lengths = F.transform(F.split(text, "\n"), lambda x: F.length(x))
    zipped = F.transform(lengths, lambda x, i: F.struct(x.alias("chars"), F.when(i > 0, F.get(lengths, i - 1)).alias("before"), F.get(lengths, i + 1).alias("after")))
    return df.select(key, F.posexplode(zipped).alias("line_no", "l")).select(key, "line_no", "l.chars", "l.before", "l.after")

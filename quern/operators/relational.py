"""Relational operators: closures, probes, set differences, priority merges, exclusions, as-of versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flag_violations(df: DataFrame, flag: str) -> DataFrame:
    """Rows whose flag is null or neither 0 nor 1; a snapshot is refused while there are any."""
    return df.where(F.col(flag).isNull() | ~F.col(flag).isin(0, 1))


def snapshot_closure(posts: DataFrame, keep: Column, parents: dict[str, tuple[DataFrame, str, str]], children: dict[str, tuple[DataFrame, str, str]], key: str) -> dict[str, DataFrame]:
    """Kept posts, the parents that they name and the children that name them: {name: rows}.

    ``parents``: name -> (rows, the post's column, the parent's key); ``children``: name -> (rows, the child's column, the post's column).
    """
    kept = posts.where(keep)
    out = {"posts": kept}
    for name, (rows, fk, pk) in parents.items():
        out[name] = rows.join(kept.select(F.col(fk).alias(pk)), pk, "left_semi")
    for name, (rows, fk, pk) in children.items():
        out[name] = rows.join(kept.select(F.col(pk).alias(fk)), fk, "left_semi")
    return out


def left_probe(left: DataFrame, right: DataFrame, key: str, compare: str) -> DataFrame:
    """One row: how many rows of ``left`` have no partner, and how many differ from it in ``compare`` (nulls equal nulls)."""
    r = right.select(key, F.col(compare).alias("__other"), F.lit(True).alias("__there"))
    joined = left.select(key, compare).join(r, key, "left")
    return joined.agg(
        F.count(F.when(F.col("__there").isNull(), 1)).alias("missing"),
        F.count(F.when(F.col("__there") & ~F.col(compare).eqNullSafe(F.col("__other")), 1)).alias("mismatched"),
        F.count(F.lit(1)).alias("total"),
    )


def current_leaves(decisions: DataFrame, key: str, supersedes: str) -> DataFrame:
    """Decisions that no other supersedes."""
    return decisions.join(decisions.select(F.col(supersedes).alias(key)).where(F.col(key).isNotNull()), key, "left_anti")


def child_count_mismatches(parents: DataFrame, children: DataFrame, key: str, declared: str) -> DataFrame:
    """Parents whose declared number of children is not the actual one."""
    counts = children.groupBy(key).agg(F.count(F.lit(1)).alias("actual"))
    return parents.select(key, declared).join(counts, key, "left").withColumn("actual", F.coalesce("actual", F.lit(0))).where(F.col(declared) != F.col("actual"))


def priority_merge(base: DataFrame, key: str, sources: Sequence[tuple[str, DataFrame, str]], fallback: Column) -> DataFrame:
    """The first known of the sources' values, else the fallback; ``origin`` names where it came from."""
    out, values, origins = base, [], []
    for k, (name, rows, value) in enumerate(sources):
        out = out.join(rows.select(key, F.col(value).alias(f"__v{k}")), key, "left")
        values.append(F.col(f"__v{k}"))
        origins.append(F.when(F.col(f"__v{k}").isNotNull(), F.lit(name)))
    return out.withColumn("final", F.coalesce(*values, fallback)).withColumn("origin", F.coalesce(*origins, F.lit("model"))).drop(*(f"__v{k}" for k in range(len(sources))))


def merge_exactly_once(records: DataFrame, scored: DataFrame, key: str, digest: str) -> DataFrame:
    """One row with what breaks a one-to-one merge: missing, unexpected, duplicated and mismatching rows."""
    n = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(f"n_{name}"), F.min(digest).alias(f"{name}_digest"))
    both = n(records, "record").join(n(scored, "score"), key, "full_outer")
    return both.agg(
        F.count(F.when(F.col("n_score").isNull(), 1)).alias("missing"),
        F.count(F.when(F.col("n_record").isNull(), 1)).alias("unexpected"),
        F.count(F.when((F.col("n_record") > 1) | (F.col("n_score") > 1), 1)).alias("duplicated"),
        F.count(F.when(F.col("record_digest") != F.col("score_digest"), 1)).alias("mismatched"),
    )


def versioned(current: DataFrame, history: DataFrame, key: str, compared: Sequence[str], version: str) -> DataFrame:
    """Each current row as new, changed or unchanged against the latest of its history, with the version it gets."""
    latest = history.groupBy(key).agg(F.max_by(F.struct(version, *compared), version).alias("__old"))
    joined = current.join(latest, key, "left")
    same = F.lit(True)
    for c in compared:
        same = same & F.col(c).eqNullSafe(F.col(f"__old.{c}"))
    change = F.when(F.col("__old").isNull(), "new").when(same, "unchanged").otherwise("changed")
    number = F.when(F.col("__old").isNull(), 1).when(same, F.col(f"__old.{version}")).otherwise(F.col(f"__old.{version}") + 1)
    return joined.withColumn("input_change", change).withColumn(version, number.cast("bigint")).drop("__old")


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has, counting repeats, with the side."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def union_disjoint(parts: Sequence[tuple[str, DataFrame]], key: str) -> tuple[DataFrame, DataFrame]:
    """All parts with their names, and the keys that more than one row has (to be empty)."""
    whole = None
    for name, rows in parts:
        rows = rows.withColumn("origin", F.lit(name))
        whole = rows if whole is None else whole.unionByName(rows)
    return whole, whole.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def exclude(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the excluded."""
    return df.join(ids.select(key).distinct(), key, "left_anti")


def dangling(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame, key: str) -> DataFrame:
    """How many rows of each table still refer to an excluded key."""
    out = None
    for name, (rows, column) in sorted(tables.items()):
        n = rows.join(ids.select(F.col(key).alias(column)).distinct(), column, "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def eligible(population: DataFrame, reference: DataFrame, component: str) -> DataFrame:
    """Members of components that no reference member belongs to."""
    return population.join(reference.select(component).where(F.col(component).isNotNull()).distinct(), component, "left_anti")


def paired(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Two score sets of one membership side by side."""
    return left.select(key, F.col(value).alias("left_value")).join(right.select(key, F.col(value).alias("right_value")), key)


def nearest_controls(cases: DataFrame, pool: DataFrame, strata: Sequence[str], band: str, length: str, key: str) -> DataFrame:
    """For each case the control of its stratum that is nearest in length; the same band first, ties by key.

    Neighbours come from one ordering of both sides (the last and the next control of each case), so
    no stratum is joined with itself.
    """
    rows = cases.select(*strata, band, length, key, F.lit(1).alias("is_case")).unionByName(pool.select(*strata, band, length, key, F.lit(0).alias("is_case")))

    def found(by: Sequence[str], name: str, df: DataFrame) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(length, "is_case", key)
        df = df.withColumn("__same", F.min(F.when(F.col("is_case") == 0, F.col(key))).over(Window.partitionBy(*by, length)))
        control = F.when(F.col("is_case") == 0, F.struct(F.col(length).alias("l"), F.col("__same").alias("k")))
        before = F.last(control, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
        # the next control is the last one of the reversed order: a frame to the end would be read anew for each row
        reverse = Window.partitionBy(*by).orderBy(F.col(length).desc(), F.col("is_case").desc(), F.col(key).desc())
        behind = F.last(control, ignorenulls=True).over(reverse.rowsBetween(Window.unboundedPreceding, -1))
        df = df.withColumns({"__b": before, "__a": behind})
        far = lambda x: F.abs(F.col(length) - x["l"])
        least = F.least(F.when(F.col("__same").isNotNull(), F.struct(F.lit(0).alias("d"), F.col("__same").alias("k"))), F.when(F.col("__b").isNotNull(), F.struct(far(F.col("__b")).cast("int").alias("d"), F.col("__b.k").alias("k"))), F.when(F.col("__a").isNotNull(), F.struct(far(F.col("__a")).cast("int").alias("d"), F.col("__a.k").alias("k"))))
        return df.withColumn(name, least).drop("__b", "__a", "__same")

    both = found([*strata], "any_band", found([*strata, band], "same_band", rows)).where("is_case = 1")
    pick = F.coalesce("same_band", "any_band")
    return both.select(F.col(key).alias("case_id"), pick["k"].alias("control_id"), pick["d"].alias("length_gap"), F.col("same_band").isNotNull().alias("exact_band"))


def conditional_update(rows: DataFrame, updates: DataFrame, key_hash: str, columns: Sequence[str]) -> DataFrame:
    """Rows whose hash has an update get its values; ``update_state`` says replaced or absent."""
    renamed = updates.select(key_hash, *(F.col(c).alias(f"__new_{c}") for c in columns), F.lit(True).alias("__hit"))
    out = rows.join(renamed, key_hash, "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)))
    return out.withColumn("update_state", F.when(F.col("__hit"), "replaced").otherwise("absent")).drop("__hit", *(f"__new_{c}" for c in columns))

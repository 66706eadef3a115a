"""Integrity and lineage: domain checks, digests, inventories, manifests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A stable reason code and what broke."""

    def __init__(self, code: str, detail: str = "") -> None:
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def require_empty(df: DataFrame, code: str) -> None:
    """Fail with the code if there is any row."""
    if row := df.limit(1).collect():
        raise ContractError(code, str(row[0].asDict()))


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, reasons) of rows that break a rule; a rule that is null counts as broken."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in sorted(rules.items())]))
    return df.select(key, found.alias("reasons")).where(F.size("reasons") > 0)


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with more than one row, and how many."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def table_digest(df: DataFrame) -> DataFrame:
    """(rows, digest): a checksum of all rows that doesn't depend on their order, nulls apart from empty values.

    Each row's SHA-256 over its canonical JSON gives two 60-bit numbers, which are summed: repeats count.
    """
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).cast("binary"), 256)
    part = lambda at: F.conv(F.substring("__row", at, 15), 16, 10).cast("decimal(38,0)")
    sums = df.select(row.alias("__row")).agg(F.count(F.lit(1)).alias("rows"), F.sum(part(1)).alias("a"), F.sum(part(17)).alias("b"))
    return sums.select("rows", F.concat_ws(":", F.coalesce("a", F.lit(0)).cast("string"), F.coalesce("b", F.lit(0)).cast("string")).alias("digest"))


def ordered_digest(df: DataFrame, key: str, value: str) -> DataFrame:
    """One SHA-256 over the ordered digests of key ranges, each over its ordered rows: order counts, and no task gets all rows."""
    rows = df.select(F.col(key).alias("k"), F.col(value).alias("v")).withColumn("part", F.floor(F.col("k") / 4096))
    parts = rows.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("rows"))
    parts = parts.select("part", F.sha2(F.array_join(F.transform("rows", lambda r: F.concat_ws("=", r["k"].cast("string"), r["v"])), "\n").cast("binary"), 256).alias("d"))
    whole = parts.agg(F.array_sort(F.collect_list(F.struct("part", "d"))).alias("all"))
    return whole.select(F.sha2(F.array_join(F.transform("all", lambda p: p["d"]), "\n").cast("binary"), 256).alias("digest"))


def inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def inventory_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files that were added, removed or changed."""
    joined = before.select("path", F.col("sha256").alias("old")).join(after.select("path", F.col("sha256").alias("new")), "path", "full_outer")
    return joined.where(~F.col("old").eqNullSafe(F.col("new"))).select("path", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("change"))


def hash_chain(df: DataFrame, batch: str, order: str, value: Column) -> DataFrame:
    """Per batch, SHA-256 of the previous hash and each record in order; a batch is of bounded size by contract."""
    records = df.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.cast("string").alias("v")))).alias("r"))
    chain = F.aggregate("r", F.lit(""), lambda acc, r: F.sha2(F.concat_ws("|", acc, r["v"]).cast("binary"), 256))
    return records.select(batch, F.size("r").cast("bigint").alias("records"), chain.alias("chain"))


def canonical_sha256(value) -> str:
    """SHA-256 of compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

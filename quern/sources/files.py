"""Sources and sinks with declared schemas: strict CSV, JSON lines, manifests, vector store, segment table."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.lineage import ContractError

BOM = "﻿"

#: Column contracts of the engine's tables.
POSTS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        *(T.StructField(c, T.StringType()) for c in ("platform_key", "platform_post_id", "canonical_url", "title", "content_text", "status", "author_platform_id")),
    ]
)
SEGMENTS = "segment_id string, source_post_id bigint, seg_no int, text string, start int, end int, batch_id string"


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """The eight declared columns of a post table, pruned in the scan."""
    return spark.read.schema(POSTS).parquet(path).select(*POSTS.names)


def read_strict_csv(spark: SparkSession, path: str, schema: T.StructType, ids: Sequence[str] = ()) -> DataFrame:
    """A CSV whose header is exactly the schema's names in order; short, long or badly typed rows fail the read.

    The first line is compared on the driver, through Spark; ids have to be positive.
    """
    first = spark.read.text(path).limit(1).collect()
    header = first[0][0].lstrip(BOM) if first else ""
    if [c.strip('"') for c in header.split(",")] != schema.names:
        raise ContractError("header_mismatch", header)
    frame = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "FAILFAST").option("multiLine", True).option("escape", '"').csv(path)
    for c in ids:
        frame = frame.withColumn(c, F.when(F.col(c) > 0, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} must be positive"))))
    return frame


def write_csv(df: DataFrame, path: str, columns: Sequence[str], most_rows: int = 1_000_000) -> None:
    """One UTF-8 file with a byte order mark, fixed columns and 17-digit floats: for hand-off tasks of counted size.

    A larger table is refused here; write it with ``df.write.csv`` in parts.
    """
    import csv
    import io

    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if df.count() > most_rows:
        raise ContractError("too_many_rows", f"over {most_rows}")
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(columns)
    for row in df.select(*columns).toLocalIterator():
        writer.writerow(["" if row[c] is None else format(row[c], ".17g") if c in floats else row[c] for c in columns])
    write_atomically(path, (BOM + out.getvalue()).encode())


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_atomically(path: str, content: bytes) -> None:
    """Write beside the target and rename over it."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent)
    with os.fdopen(handle, "wb") as out:
        out.write(content)
    os.replace(name, target)


def write_manifest(path: str, value: dict) -> str:
    """Sorted JSON, written atomically; gives its SHA-256."""
    raw = (json.dumps(value, sort_keys=True, ensure_ascii=False, indent=2) + "\n").encode()
    write_atomically(path, raw)
    return hashlib.sha256(raw).hexdigest()


def load_manifest(path: str, expected_sha256: str) -> dict:
    """Parse only what has the expected digest."""
    raw = Path(path).read_bytes()
    if hashlib.sha256(raw).hexdigest() != expected_sha256:
        raise ContractError("digest_mismatch", path)
    return json.loads(raw)


def strict_settings(raw: dict, allowed: dict[str, type]) -> dict:
    """Settings with exactly the allowed keys and types."""
    if set(raw) != set(allowed):
        raise ContractError("key_mismatch", str(sorted(set(raw) ^ set(allowed))))
    wrong = [k for k, kind in allowed.items() if not isinstance(raw[k], kind) or (kind is int and isinstance(raw[k], bool))]
    if wrong:
        raise ContractError("type_mismatch", str(wrong))
    return dict(raw)


def missing_vectors(wanted: DataFrame, store: DataFrame, namespace: str) -> DataFrame:
    """Texts, once per content, that the vector store lacks."""
    have = store.where(F.col("namespace") == namespace).select("sha256")
    return wanted.dropDuplicates(["sha256"]).join(have, "sha256", "left_anti")


def append_vectors(vectors: DataFrame, path: str, dimension: int) -> None:
    """Append checked vectors (namespace, sha256, vector): right size, finite, not all zero."""
    v = F.col("vector")
    good = (F.size(v) == dimension) & F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    vectors.withColumn("vector", F.when(good, v).otherwise(F.raise_error(F.lit("bad_vector")))).write.mode("append").partitionBy("namespace").parquet(path)


def write_segments(parts: DataFrame, path: str) -> None:
    parts.select("segment_id", "source_post_id", "seg_no", "text", "start", "end", "batch_id").write.mode("append").partitionBy("batch_id").parquet(path)


def post_segments(spark: SparkSession, path: str, batch_id: str, post_id: int) -> DataFrame:
    """One post's segments in order: the partition and the id reach the scan."""
    return spark.read.parquet(path).where((F.col("batch_id") == batch_id) & (F.col("source_post_id") == post_id)).orderBy("seg_no")

"""SimHash near-duplicates found with BK-trees.

Each text gets a 64-bit SimHash of its word shingles. Equal fingerprints are collapsed first, so a group of copies of
any size is one tree node. Fingerprints within ``radius`` bits agree on one of ``radius + 1`` bands of bits, and so on
any of that band's bits: as many of them name a shard as make shards of about ``TREE_NODES`` fingerprints. A shard's
BK-tree (children keyed by their distance to the parent, searched along edges within the radius) decides which of them
are linked; the band only says where they meet. A shard of more than ``HOT_NODES`` is dealt anew by its whole band and
the bands of its other bits, which three rows a fingerprint pay for, however hot it is.

A whole corpus's trees would grow with the corpus, so they are not broadcast: rows are dealt to the shard trees. A tree
yields a spanning forest of its links, never all pairs; stars of those forests are contracted to components. Nothing
but counts and checksums reaches the driver.

Defined cases: null, empty and white-space texts have fingerprint zero and are linked like any
other; texts of fewer words than a shingle are one shingle; ties between ids go to the smallest;
rows with a null id are linked but name a component only if no id in it is known; repeated rows
each give a row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.words import ascii_lower, map_batches, texts_of
from quern.operators.graph import connected_components
from quern.session import ready_python, cut, fresh

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
BITS = 64
TREE_NODES = 512  #: of a shard's tree, on average
HOT_NODES = 32 * TREE_NODES
_MASK = (1 << BITS) - 1


def simhash(raw: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """A bit is 1 if over half of the shingles' hashes have it; 0 without words."""
    words = ascii_lower(raw).split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(flat, SEED)
    starts = np.concatenate(([0], ends[:-shingle_words] + 1)).tolist()
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.array([digest(flat[a:b], seed) for a, b in zip(starts, ends[shingle_words - 1 :].tolist())], ">u8")
    ones = np.zeros(BITS, np.int64)
    for low in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[low : low + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


class BKTree:
    """Metric tree over fingerprints; equal ones are stored once."""

    def __init__(self) -> None:
        self.value: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, x: int, radius: int) -> list[int]:
        """Numbers of the nodes at most ``radius`` bits from x."""
        found, stack = [], [0] if self.value else []
        while stack:
            k = stack.pop()
            d = ((self.value[k] ^ x) & _MASK).bit_count()
            if d <= radius:
                found.append(k)
            edges = self.children[k]
            for e in range(d - radius, d + radius + 1):
                if e in edges:
                    stack.append(edges[e])
        return found

    def add(self, x: int) -> int:
        k = 0
        while self.value:
            d = ((self.value[k] ^ x) & _MASK).bit_count()
            if d == 0:
                return k
            if d not in self.children[k]:
                self.children[k][d] = len(self.value)
                break
            k = self.children[k][d]
        self.value.append(x)
        self.children.append({})
        return len(self.value) - 1


class ShardLinks:
    """One shard tree and the components among its nodes."""

    def __init__(self, radius: int) -> None:
        self.tree, self.radius, self.parent = BKTree(), radius, []

    def root(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def node(self, x: int) -> None:
        near = self.tree.within(x, self.radius)
        k = self.tree.add(x)
        if k == len(self.parent):
            self.parent.append(k)
        for other in near:
            self.parent[self.root(other)] = self.root(k)

    def forest(self) -> list[tuple[int, int]]:
        return [(x, self.tree.value[r]) for k, x in enumerate(self.tree.value) if (r := self.root(k)) != k]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, text_key, fp): text_key is a hash of the text that tells rows with one id apart, fp the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp = np.array([simhash(x, shingle_words) for x in texts_of(batch, "text")], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["id", "text_key", "fp"])

        return work

    return map_batches(rows, make, f"id {kind}, text_key bigint, fp bigint")


def _bits(low: int, high: int) -> Column:
    """The bits of fp from ``low`` to below ``high``."""
    return F.shiftrightunsigned(F.shiftleft("fp", BITS - high), BITS - high + low)


def _other_bits(low: int, high: int) -> Column:
    """fp without those bits."""
    above = F.shiftleft(F.shiftrightunsigned("fp", high), low) if high < BITS else F.lit(0).cast("bigint")
    return above.bitwiseOR(_bits(0, low)) if low else above


def _edges(bits: int, parts: int) -> list[tuple[int, int]]:
    return [(bits * k // parts, bits * (k + 1) // parts) for k in range(parts)]


def link_fingerprints(distinct: DataFrame, radius: int = RADIUS, tree_nodes: int = TREE_NODES, hot_nodes: int = HOT_NODES) -> DataFrame:
    """Links (src, dst) that connect all of ``distinct.fp`` within ``radius`` bits of each other."""
    wanted = max(0, math.ceil(math.log2(max(1, distinct.count() / tree_nodes))))
    parts = []
    for k, (low, high) in enumerate(_edges(BITS, radius + 1)):
        rest = _other_bits(low, high)
        inner = [F.xxhash64(F.lit(k), _bits(low, high), F.lit(j), F.shiftrightunsigned(F.shiftleft(rest, BITS - b), BITS - b + a)) for j, (a, b) in enumerate(_edges(BITS - high + low, radius + 1))]
        parts.append(F.struct(F.xxhash64(F.lit(k), _bits(low, min(high, low + wanted)) if wanted else F.lit(0)).alias("shard"), F.array(*inner).alias("inner")))
    rows = distinct.select("fp", F.explode(F.array(*parts)).alias("s")).select("fp", "s.shard", "s.inner")
    hot = rows.groupBy("shard").agg((F.count(F.lit(1)) > hot_nodes).alias("hot")).where("hot")
    rows = rows.join(hot, "shard", "left").select("fp", F.explode(F.when(F.col("hot"), F.col("inner")).otherwise(F.array("shard"))).alias("shard"))
    dealt = rows.repartition(F.col("shard")).sortWithinPartitions("shard", "fp")
    ready_python(distinct.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, ShardLinks(radius)
        for batch in batches:
            links = []
            for fp, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != at:
                    links += shard.forest()
                    at, shard = name, ShardLinks(radius)
                shard.node(fp)
            yield out(links)
        yield out(shard.forest())

    def out(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["src", "dst"])

    return dealt.select("fp", "shard").mapInArrow(run, "src bigint, dst bigint")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS, tree_nodes: int = TREE_NODES
) -> DataFrame:
    """A row for each document: id, text_key, fp, component (smallest id reachable, itself included) and
    keeper (whether this is the group's document to stay: the one with that id)."""
    rows = cut(fingerprints(docs, id_col, text_col, shingle_words))
    first = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "text_key")).alias("first")
    same = cut(rows.groupBy("fp").agg(first))
    return with_keepers(rows, same, link_fingerprints(same.select("fp"), radius, tree_nodes))


def with_keepers(rows: DataFrame, same: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` (id, text_key, fp) with component and keeper; ``same`` has the first row of each fp, ``links`` (src, dst) join fps."""
    groups = connected_components(links)
    named = same.join(groups, same.fp == groups.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    named = cut(named)
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    named = named.join(least, "root").select("fp", "least")
    found = rows.join(named, "fp")
    return found.select(
        "id", "text_key", "fp", F.col("least.id").alias("component"), (F.col("id").eqNullSafe(F.col("least.id")) & (F.col("text_key") == F.col("least.text_key"))).alias("keeper")
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without those of which the group keeps another. A repeated row (same id and text) is the same document."""
    return only_keepers(docs, near_duplicates(docs, id_col, text_col, **options), id_col, text_col)


def only_keepers(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents whose row in ``found`` is a keeper."""
    key = fresh(docs, "text_key")
    kept = found.where("keeper").select(F.col("id").alias("__kept_id"), F.col("text_key").alias("__kept_key")).distinct()
    tagged = docs.withColumn(key, F.xxhash64(text_col))
    return tagged.join(kept, (tagged[key] == kept["__kept_key"]) & tagged[id_col].eqNullSafe(kept["__kept_id"]), "left_semi").select(*docs.columns)

"""Near copies by SimHash, BK-trees and exact shingle similarity: the pipeline's near-duplicate stage.

Two texts are near copies if the Jaccard similarity of their sets of five-word shingles is
``SIMILARITY`` or more. Texts of equal sets are one node, so a group of copies of any size is one.
Each set has a 64-bit SimHash. At a similarity of 0.8 two of them lie about 10 bits apart, with a spread of 3, so
the radius is wide, and no bands of their bits are selective there. So banded MinHash names the shards: 40 keys of
five minima each, of which a pair of similarity 0.8 misses all with a chance of 1.3e-7. In a shard SimHash decides
which nodes are candidates, by a BK-tree as in ``simhash_dedup``. Each candidate pair is then verified on
the texts themselves, so nothing is linked that is not similar.

To keep a dense group from giving all its pairs, nodes are first held against their shard's least node;
after that only nodes outside that node's component stand in the shard's tree, and all nodes of the shard search it.
A shard of more than ``SHARD_NODES`` is dealt to several tasks that each have the whole tree and a part of the searches.

Defined cases: null, empty and white-space texts have no shingles and are copies of each other;
texts of fewer words than a shingle are one shingle; ids as in ``simhash_dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.simhash_dedup import BKTree, only_keepers, with_keepers
from quern.llm.words import ascii_lower, map_batches, texts_of
from quern.operators.graph import connected_components
from quern.session import cut, ready_python

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 5
SEED = 42
RADIUS = 28  #: bits; of pairs of a similarity of 0.8 the smallest sets, of four and five shingles, lie 12 bits apart with a spread of 3.1
SHARD_NODES = 16_384  #: of a shard that one task searches
BROADCAST_ROWS = 1_000_000  #: of a few numbers each
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = np.random.default_rng(SEED + 1).integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingle_set(raw: bytes, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; none without words."""
    words = ascii_lower(raw).split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= shingle_words:
        return np.array([xxhash.xxh64_intdigest(flat, SEED)], np.uint64)
    starts = np.concatenate(([0], ends[:-shingle_words] + 1)).tolist()
    digest, seed = xxhash.xxh64_intdigest, SEED
    return np.unique(np.array([digest(flat[a:b], seed) for a, b in zip(starts, ends[shingle_words - 1 :].tolist())], np.uint64))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key for each band: a hash of its minima; none without shingles."""
    if not len(shingles):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for low in range(0, len(shingles), 512):
        np.minimum(least, (shingles[low : low + 512, None] * _FACTORS + _SHIFTS).min(0), out=least)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def simhash_of(shingles: np.ndarray) -> int:
    """A bit is 1 if over half of the shingles have it; 0 without shingles."""
    ones = np.zeros(64, np.int64)
    for low in range(0, len(shingles), 1 << 15):
        part = shingles[low : low + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILARITY * (len(a) + len(b) - both) - 1e-9


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, fp, n, sim, keys): fp is a hash of the shingle set, n its size, sim its SimHash as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(x) for x in texts_of(batch, "text")]
            fp = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            sim = np.array([simhash_of(s) for s in sets], np.uint64).view(np.int64)
            n, keys = pa.array([len(s) for s in sets], pa.int32()), pa.array([band_keys(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp), n, pa.array(sim), keys], names=["id", "text_key", "fp", "n", "sim", "keys"])

        return work

    return map_batches(rows, make, f"id {kind}, text_key bigint, fp bigint, n int, sim bigint, keys array<bigint>")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (src, dst) whose texts are similar."""
    ready_python(pairs.sparkSession)
    left, right = texts.select(F.col("fp").alias("src"), F.col("text").alias("a")), texts.select(F.col("fp").alias("dst"), F.col("text").alias("b"))
    rows = pairs.join(left, "src").join(right, "dst").select("src", "dst", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None  # rows of one dst mostly follow each other
        for batch in batches:
            good = []
            for a, b in zip(texts_of(batch, "a"), texts_of(batch, "b")):
                if b != last:
                    last, held = b, shingle_set(b)
                good.append(similar(shingle_set(a), held))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["src", "dst"]).filter(pa.array(good, pa.bool_()))

    return rows.mapInArrow(run, "src bigint, dst bigint")


def tree_pairs(rows: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """(src, dst): pairs of ``rows`` (key, fp, n, sim, component, out) of one key and two components, of like sizes and within ``RADIUS`` bits, one of which is out.

    A shard's tree holds the nodes that are out. It is copied to as many parts as the shard has; each node searches it in one of them.
    """
    parts = rows.groupBy("key").agg((F.ceil(F.count(F.lit(1)) / shard_nodes)).cast("int").alias("parts"), F.max("out").alias("any")).where("any").drop("any")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = rows.join(parts, "key").select("*", own.alias("own"))
    dealt = dealt.withColumn("part", F.explode(F.when(F.col("out"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))))
    fields = ["key", "part", "out", "fp", "n", "sim", "component"]
    dealt = dealt.repartition("key", "part").sortWithinPartitions("key", "part", F.desc("out"), "fp").select(*fields, (F.col("part") == F.col("own")).alias("searches"))
    ready_python(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree, held = None, BKTree(), []
        for batch in batches:
            src, dst = [], []
            for key, part, out, fp, n, sim, component, searches in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, part) != at:
                    at, tree, held = (key, part), BKTree(), []
                for k in tree.within(sim, RADIUS) if searches else ():
                    for other, m, of in held[k]:
                        if of != component and min(n, m) >= SIMILARITY * max(n, m) - 1e-9:
                            src.append(other)
                            dst.append(fp)
                if out:  # these come first in their part
                    k = tree.add(sim)
                    if k == len(held):
                        held.append([])
                    held[k].append((fp, n, component))
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return dealt.mapInArrow(run, "src bigint, dst bigint").distinct()


def links(docs: DataFrame, same: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(src, dst): verified links that connect all nodes of ``same`` (fp, n, sim, keys, first) that similar pairs connect."""
    small = lambda df, rows: F.broadcast(df) if rows <= BROADCAST_ROWS else df
    keys = same.select("fp", "n", "sim", F.explode("keys").alias("key"))
    shared = cut(keys.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("fp", "n", "sim")).alias("rep")).where("size > 1").select("key", F.col("rep.fp").alias("rep"), F.col("rep.n").alias("rep_n"), F.col("rep.sim").alias("rep_sim")))
    many = cut(keys.join(small(shared, shared.count()), "key"))
    wanted = same.join(many.select("fp").distinct(), "fp", "left_semi").select("fp", F.col("first.id").alias("__id"), F.col("first.text_key").alias("__key"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    texts = cut(texts.join(wanted, (F.col("text_key") == F.col("__key")) & F.col("id").eqNullSafe(F.col("__id"))).select("fp", "text").dropDuplicates(["fp"]))
    alike = lambda a, b: F.least(a, b) >= SIMILARITY * F.greatest(a, b) - 1e-9
    near = F.bit_count(F.col("sim").bitwiseXOR(F.col("rep_sim"))) <= RADIUS
    stars = many.where((F.col("fp") != F.col("rep")) & alike(F.col("n"), F.col("rep_n")) & near).select(F.col("fp").alias("src"), F.col("rep").alias("dst")).distinct()
    stars = cut(_verified(stars, texts))
    at = cut(connected_components(stars))
    of = at.withColumnRenamed("node", "fp")
    ends = many.select("key", "fp", "n", "sim", "rep").join(of, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ends = ends.join(at.select(F.col("node").alias("rep"), F.col("component").alias("rep_component")), "rep", "left").withColumn("out", F.col("component") != F.coalesce("rep_component", "rep"))
    ends = cut(ends.select("key", "fp", "n", "sim", "component", "out"))
    return stars.unionByName(_verified(tree_pairs(ends), texts))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, text_key, fp, component and keeper, as of ``simhash_dedup.near_duplicates``."""
    rows = cut(sketches(docs, id_col, text_col))
    first = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "text_key")).alias("first")
    same = cut(rows.groupBy("fp").agg(first, F.first("n").alias("n"), F.first("sim").alias("sim"), F.first("keys").alias("keys")))
    return with_keepers(rows, same.select("fp", "first"), links(docs, same, id_col, text_col))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those of which the group keeps another."""
    return only_keepers(docs, near_copies(docs, id_col, text_col), id_col, text_col)

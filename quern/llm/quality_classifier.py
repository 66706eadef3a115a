"""Quality classifier: histogram gradient-boosted trees over document statistics, in numpy.

Statistics of a text alone are its inputs. Training bins each statistic by quantiles and grows
trees level by level from histograms of gradients; the trees are flattened into arrays (feature,
threshold, leaf value, heap order), so that a batch of documents walks all of them with a few
vectorised steps. Training takes a documented, bounded sample of labelled rows to the driver;
scoring reads every text once, map-side.

Defined cases: a null or empty text has statistics of zero and is scored by them like any other;
without a labelled row every score is 0.5, with labels of one kind all scores lean to it; a label
other than 0 or 1 is ignored; rows that repeat an id share its labels; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.quality_rules import repeated_words
from quern.llm.words import few_by_hash, map_batches, texts_of

SAMPLE_ROWS = 12_000  #: labelled rows for training at most, those of least hash of their id
TREES = 80
DEPTH = 4
BINS = 64
RATE = 0.15
LEAF_WEIGHT = 3.0
RIDGE = 1.0
_UPPER, _LOWER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
FEATURES = (
    "words", "mean_word", "long_word_share", "short_word_share", "upper_share", "digit_share", "symbol_share", "bar_share", "bang_share", "punctuation_share", "non_ascii_share",
    "lines", "mean_line", "short_line_share", "duplicate_line_share", "unended_line_share", "distinct_word_share", "top_word_share", "stutter_share", "repeated_word_share", "byte_entropy",
    "capital_word_share", "symbol_word_share", "longest_word",
)


def features(raw: bytes) -> list[float]:
    """Statistics of one text, in the order of FEATURES."""
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(raw)
    at = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    among = lambda chars: int(at[list(chars)].sum())
    lengths = np.array([len(w) for w in words])
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x.strip() for x in raw.split(b"\n") if x.strip()]
    letters = max(1, among(_UPPER) + among(_LOWER))
    p = at[at > 0] / size
    last = b"".join([w[-1:] for w in words])
    return [
        n, lengths.mean(), (lengths > 12).mean(), (lengths < 3).mean(), among(_UPPER) / letters, among(_DIGIT) / size, among(b"#*$%&<>|") / size, at[0x7C] / n, at[0x21] / n, among(b".,;:?") / n, at[128:].sum() / size,
        len(lines), n / len(lines), sum(len(x) < 30 for x in lines) / len(lines), 1 - len(set(lines)) / len(lines), sum(x[-1] not in b".!?:;\"')" for x in lines) / len(lines),
        len(counts) / n, max(counts.values()) / n, sum(map(bytes.__eq__, words, words[1:])) / n, repeated_words(words) / n, float(-(p * np.log2(p)).sum()),
        sum(map(bytes.isupper, words)) / n, (n - len(last.translate(None, b"#*$%&|<>"))) / n, lengths.max(),
    ]


@dataclass(frozen=True)
class Forest:
    """Trees in heap order: node k's children are 2k + 1 and 2k + 2; a dead end sends all rows left."""

    feature: np.ndarray  #: (trees, inner nodes)
    threshold: np.ndarray  #: as feature; a row with a value up to it goes left
    value: np.ndarray  #: (trees, leaves)
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.feature):
            return np.full(len(x), self.start)
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        node, depth = np.zeros((len(x), len(self.feature)), np.int64), int(np.log2(self.value.shape[1]))
        for _ in range(depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        return self.start + self.value[trees, node - (2**depth - 1)].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Boost logistic loss. The order of rows doesn't matter."""
    inner, leaves = 2**depth - 1, 2**depth
    if not len(y):
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), 0.0)
    prior = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(prior / (1 - prior)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    margin = np.full(len(y), start)
    all_features, all_thresholds, all_values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold, cutoff = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, BINS)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            slot = node - first
            best = np.full(width, 1e-6)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                at = slot * BINS + binned[:, f]
                gs, hs = (np.bincount(at, v, width * BINS).reshape(width, BINS).cumsum(1) for v in (g, h))
                gl, hl, ga, ha = gs[:, : len(e)], hs[:, : len(e)], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + RIDGE) + (ga - gl) ** 2 / (ha - hl + RIDGE) - ga**2 / (ha + RIDGE)
                gain[(hl < LEAF_WEIGHT) | (ha - hl < LEAF_WEIGHT)] = 0
                k = gain.argmax(1)
                won = np.flatnonzero(gain[np.arange(width), k] > best)
                best[won] = gain[won, k[won]]
                feature[first + won], cutoff[first + won], threshold[first + won] = f, k[won], e[k[won]]
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cutoff[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + RIDGE)
        margin += value[leaf]
        all_features.append(feature)
        all_thresholds.append(threshold)
        all_values.append(value)
    return Forest(np.array(all_features), np.array(all_thresholds), np.array(all_values), start)


def _feature_rows(rows: DataFrame, kept: str, names: list[str]) -> DataFrame:
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = [features(t) for t in texts_of(batch, "text")]
            return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(x, pa.list_(pa.float64()))], names=[*names, "x"])

        return work

    return map_batches(rows, make, f"{kept}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", learn=None, sample_rows: int = SAMPLE_ROWS) -> Forest:
    """Fit on the labelled documents of at most ``sample_rows`` ids (where ``learn`` holds): those of least hash.

    The ids are few by that bound, so they are broadcast to the scan and only their texts are measured.
    """
    named = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    named = named.where(learn) if learn is not None else named
    ids = named.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col)).alias("y")).withColumn("h", F.xxhash64("id"))
    chosen = few_by_hash(ids, "h", ids.count(), sample_rows).orderBy("h", "id").limit(sample_rows).select("id", "y")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("y", "text")
    got = _feature_rows(rows.select(F.col("y").cast("int").alias("y"), "text"), "y int", ["y"]).limit(2 * sample_rows).toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, np.array(got.column("y").to_pylist(), float))


def score(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) for every row: the chance of label 1, and 1 from one half on."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            p = forest.score(np.array([features(t) for t in texts_of(batch, "text")]))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["id", "score", "predicted"])

        return work

    return map_batches(rows, make, f"id {kind}, score double, predicted int")

"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items.

Items and documents are lower-cased (A-Z) and cut into words of ASCII letters, digits and
non-ASCII characters. Every run of ``window`` consecutive item words is a pattern (a shorter
item is one pattern); the automaton runs over word numbers, so a document is scanned once and
each hit maps back to the offsets of its words in the original text. Documents are never
shuffled. An automaton takes about 75 times the memory of its items' text, so items are broadcast in slices of
at most ``max_items_mb`` (about 450 MB of automaton in each Python worker, which builds it once and keeps it for
its next tasks). A larger benchmark is scanned slice after slice, each cut from the one before by a checkpoint.

Defined cases: a null or empty text has no words and no hits; an item whose text or id is null,
or that has no words, has no patterns; equal item ids count once; an empty benchmark leaves all
documents clean; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.words import alnum_spans, alnum_words, code_points, map_batches, texts_of
from quern.session import cut, fresh

WINDOW = 10
MAX_ITEMS_MB = 6
_SPANS = "array<struct<start:bigint,end:bigint>>"


class ItemAutomaton:
    """Word-level automaton over the windows of (item id, text) pairs."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.number: dict[bytes, int] = {}
        patterns: dict[tuple[int, ...], set[str]] = {}
        for item, raw in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in alnum_words(raw)]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                patterns.setdefault(tuple(ids[k : k + window]), set()).add(item)
        self.shortest = min(map(len, patterns), default=0)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for ids, owners in patterns.items():
            self.automaton.add_word(ids, (len(ids), tuple(owners)))
        if patterns:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """Which words lie in an occurrence (None: none does), and the items that occur."""
        if not self.shortest or len(words) < self.shortest:
            return None, set()
        get = self.number.get
        ids = [get(w, 0) for w in words]
        foreign = np.flatnonzero(np.array(ids) == 0)
        edges = np.concatenate(([-1], foreign, [len(ids)]))
        edges = [(a + 1, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()) if b - a - 1 >= self.shortest]
        hit, owners = None, set()
        for low, high in edges:
            for end, (length, items) in self.automaton.iter(tuple(ids[low:high])):
                if hit is None:
                    hit = np.zeros(len(ids), bool)
                hit[low + end + 1 - length : low + end + 1] = True
                owners.update(items)
        return hit, owners


_BUILT: dict[tuple[str, int], ItemAutomaton] = {}  #: of this worker: the last automaton and the items that it is of


def _automaton(name: str, items, window: int) -> ItemAutomaton:
    if (name, window) not in _BUILT:
        _BUILT.clear()
        _BUILT[name, window] = ItemAutomaton(items.value, window)
    return _BUILT[name, window]


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _slices(benchmark: DataFrame, id_col: str, text_col: str, max_bytes: int):
    """The benchmark's items in pieces of bounded size, never all at once when large."""
    items, size = [], 0
    for item, text in benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).toLocalIterator():
        raw = text.encode()
        if items and size + len(raw) > max_bytes:
            yield items
            items, size = [], 0
        items.append((item, raw))
        size += len(raw)
    yield items


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_items_mb: int = MAX_ITEMS_MB,
) -> DataFrame:
    """All columns of ``docs`` and, as a struct in a column ``contamination``: n_words, n_hit (words
    inside any occurring window), items (ids as strings, sorted) and spans (code points of the
    original text, end exclusive). A column of that name in ``docs`` is replaced."""
    docs = docs.drop("contamination")
    broadcast = docs.sparkSession.sparkContext.broadcast
    slices = _slices(benchmark, item_id_col, item_text_col, max_items_mb << 20)
    first, after = next(slices), next(slices, None)
    if after is None:
        return _scan(docs, broadcast(first), text_col, window, None)
    found = _scan(docs, broadcast(first), text_col, window, None)
    while after is not None:  # a benchmark beyond the bound: slice after slice, each cut from the one before
        found = _scan(cut(found), broadcast(after), text_col, window, "contamination")
        after = next(slices, None)
    return found


def _scan(docs: DataFrame, items, text_col: str, window: int, earlier: str | None) -> DataFrame:
    if earlier:
        old = fresh(docs, "earlier")
        docs = docs.withColumnRenamed(earlier, old)
    kept = [f for f in docs.schema.fields if not earlier or f.name != old]
    kind = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:" + _SPANS + ">"
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept) + f", `contamination` {kind}"

    name = uuid.uuid4().hex

    def make():
        automaton = _automaton(name, items, window)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            before = batch.column(batch.schema.get_field_index(old)).to_pylist() if earlier else [None] * batch.num_rows
            rows = []
            for raw, was in zip(texts_of(batch, text_col), before):
                words = alnum_words(raw)
                hit, owners = automaton.scan(words)
                spans = []
                if was and was["n_hit"]:
                    hit = np.zeros(len(words), bool) if hit is None else hit
                    owners |= set(was["items"])
                if hit is not None:
                    at = np.array(alnum_spans(raw))
                    if was and was["n_hit"]:
                        starts = code_points(raw, at[:, 0])
                        for x in was["spans"]:
                            hit |= (starts >= x["start"]) & (starts < x["end"])
                    first, last = _runs(hit)
                    low, high = code_points(raw, at[first, 0]).tolist(), code_points(raw, at[last - 1, 1]).tolist()
                    spans = [{"start": a, "end": b} for a, b in zip(low, high)]
                rows.append({"n_words": len(words), "n_hit": 0 if hit is None else int(hit.sum()), "items": sorted(owners), "spans": spans})
            out = pa.array(rows, pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            return pa.RecordBatch.from_arrays([*columns, out], names=[*(f.name for f in kept), "contamination"])

        return work

    return map_batches(docs, make, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without any hit, with their own columns: a contaminated document goes whole,
    so that neither a passage nor what stood around it can be learnt."""
    judged = contamination(docs.select(*docs.columns), benchmark, id_col, text_col, **options)
    if "contamination" in docs.columns:
        tag = fresh(docs, "contamination")
        judged = contamination(docs.withColumnRenamed("contamination", tag), benchmark, id_col, text_col, **options)
        return judged.where("contamination.n_hit = 0").drop("contamination").withColumnRenamed(tag, "contamination").select(*docs.columns)
    return judged.where("contamination.n_hit = 0").select(*docs.columns)

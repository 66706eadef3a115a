"""BPE encoding and decoding: speculate and verify.

Greedy longest match proposes tokens for each new word; a proposal is right exactly when every
token can arise from its own bytes and no merge crosses any boundary between two neighbours.
Boundaries are tested for all distinct adjacent pairs at once with numpy; only words with a
failing pair go through exact merging. Encoded words are remembered per task in a table of
bounded size. The vocabulary file is read on the driver and broadcast (a few MB, checked).

A merge crosses the boundary of left token L and right token R when some piece l on L's right
edge and some piece r on R's left edge exist at the same time and (l, r) is a merge that comes
before either piece is consumed inside its own token; at equal rank the leftmost goes first.

Defined cases: a null or empty text has no tokens and decodes to the empty text; the strings of
special tokens become their ids; texts of any length are encoded whole; repeated rows each give
a row; extra columns pass through ``encode``.
"""

from __future__ import annotations

import functools
import heapq
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quern.llm.words import map_batches, texts_of

#: How the vocabulary's pre-tokeniser cuts text into words (a fixed value of the format).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
MAX_VOCABULARY_MB = 64
CACHE_WORDS = 500_000  #: a task's table of encoded words, about 250 bytes each


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The format's printable stand-in of each byte: itself if visible, else the next from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder for one byte-level vocabulary file."""

    def __init__(self, raw: bytes, cache_words: int = CACHE_WORDS) -> None:
        spec, stand_in = json.loads(raw), _byte_of()
        as_bytes = lambda s: bytes(stand_in[c] for c in s)
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.vocab = {as_bytes(s): i for s, i in model["vocab"].items() if s not in self.special}
        self.size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * self.size
        for b, i in self.vocab.items():
            self.bytes_of[i] = b
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.reach: dict[bytes, int] = {}
        for b in self.vocab:
            if len(b) > 1:
                self.reach[b[:2]] = max(len(b), self.reach.get(b[:2], 1))
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        parts, made = np.full((self.size, 2), -1), np.full(self.size, -1)
        for k, m in enumerate(model["merges"]):
            a, b = (as_bytes(x) for x in (m.split(" ") if isinstance(m, str) else m))
            i, j, t = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank[i, j] = (k, t)
            if made[t] < 0:
                parts[t], made[t] = (i, j), k
        keys = np.array([i * self.size + j for i, j in self.rank], np.int64)
        order = np.argsort(keys)
        self.merge_keys, self.merge_ranks = keys[order], np.array([k for k, _ in self.rank.values()], np.int64)[order]
        self.right, self.left = self._edge(parts, made, 1), self._edge(parts, made, 0)
        whole = made < 0
        inner = np.flatnonzero(~whole)
        whole[inner] = self.apart(parts[inner, 0], parts[inner, 1], made[inner])
        for t in inner[np.argsort(made[inner])]:
            whole[t] &= whole[parts[t, 0]] and whole[parts[t, 1]]
        self.reachable = whole
        self.pairs: dict[int, bool] = {}
        self.cache: dict[str, np.ndarray] = {}
        self.cache_words = cache_words
        self.exact = 0  #: words that needed exact merging, for reports

    @staticmethod
    def _edge(parts: np.ndarray, made: np.ndarray, side: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Level by level, the piece on each token's edge and the rank at which it is consumed there."""
        piece, until = np.arange(len(parts)), np.full(len(parts), np.iinfo(np.int64).max)
        levels = [(piece, until)]
        while (deeper := (piece >= 0) & (parts[piece, side] >= 0)).any():
            until = np.where(deeper, made[piece], -1)
            piece = np.where(deeper, parts[piece, side], -1)
            levels.append((piece, until))
        return levels

    def apart(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge crosses between tokens a and b (only merges of a rank under ``below``, if given)."""
        good = np.ones(len(a), bool)
        for lp, lu in self.right:
            for rp, ru in self.left:
                at = np.flatnonzero(good & (lp[a] >= 0) & (rp[b] >= 0))
                if not len(at):
                    break
                key = lp[a[at]] * np.int64(self.size) + rp[b[at]]
                k = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
                rank = self.merge_ranks[k]
                crosses = (self.merge_keys[k] == key) & (rank < lu[a[at]]) & (rank <= ru[b[at]])
                if below is not None:
                    crosses &= rank < below[at]
                good[at[crosses]] = False
        return good

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the lowest rank, leftmost first."""
        ids = [self.vocab[word[k : k + 1]] for k in range(len(word))]
        if len(ids) > 200:
            return self._merge_long(ids)
        rank, none = self.rank.get, (len(self.rank), -1)
        ranks = [rank(p, none) for p in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) is not none:
            k = ranks.index(least)
            ids[k : k + 2] = least[1:]
            del ranks[k]
            if k:
                ranks[k - 1] = rank((ids[k - 1], ids[k]), none)
            if k < len(ranks):
                ranks[k] = rank((ids[k], ids[k + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a queue, for words whose length squared would hurt."""
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        queue = [(*self.rank[p], k, *p) for k in range(len(ids) - 1) if (p := (ids[k], ids[k + 1])) in self.rank]
        heapq.heapify(queue)
        while queue:
            _, made, k, a, b = heapq.heappop(queue)
            n = after[k]
            if ids[k] != a or n < 0 or ids[n] != b:
                continue
            ids[k], ids[n], after[k] = made, -1, after[n]
            if after[n] >= 0:
                before[after[n]] = k
            for low, high in ((before[k], k), (k, after[k])):
                if low >= 0 and high >= 0 and (p := (ids[low], ids[high])) in self.rank:
                    heapq.heappush(queue, (*self.rank[p], low, *p))
        return [i for i in ids if i >= 0]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match, from the longest token with these two first bytes downwards."""
        vocab, reach, out, at, n = self.vocab.get, self.reach.get, [], 0, len(word)
        while at < n:
            end = min(n, at + reach(word[at : at + 2], 1))
            while (t := vocab(word[at:end])) is None:
                end -= 1
            out.append(t)
            at = end
        return out

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Tokens of each word: proposals that pass, exact merging for the rest."""
        guesses = [self.propose(w) for w in words]
        flat = np.fromiter(chain.from_iterable(guesses), np.int64)
        owner = np.repeat(np.arange(len(words)), [len(g) for g in guesses])
        bad = np.zeros(len(words), bool)
        bad[owner[~self.reachable[flat]]] = True
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pair, back = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
        known = np.array([self.pairs.get(p, -1) for p in pair.tolist()], np.int8)
        new = np.flatnonzero(known < 0)
        if len(new):
            known[new] = self.apart(pair[new] // self.size, pair[new] % self.size)
            if len(self.pairs) + len(new) > 4 * self.cache_words:
                self.pairs.clear()
            self.pairs.update(zip(pair[new].tolist(), known[new].tolist()))
        bad[owner[inside[known[back] == 0]]] = True
        self.exact += int(bad.sum())
        return [np.array(self.merge(w) if b else g, np.int32) for w, g, b in zip(words, guesses, bad.tolist())]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        split = [self._words(t) for t in texts]
        fresh = {w for words in split for w in words if w not in self.cache}
        if fresh:
            if len(self.cache) + len(fresh) > self.cache_words:
                self.cache = {s: np.array([i], np.int32) for s, i in self.special.items()}
                fresh = {w for words in split for w in words if w not in self.cache}
            new = list(fresh)
            self.cache.update(zip(new, self.encode_words([w.encode() for w in new])))
        get, none = self.cache.__getitem__, np.zeros(0, np.int32)
        return [np.concatenate([*map(get, words)]) if words else none for words in split]

    def _words(self, text: str) -> list[str]:
        if self.split_special and any(s in text for s in self.special):
            for s, i in self.special.items():
                self.cache.setdefault(s, np.array([i], np.int32))
            return [w for part in self.split_special.split(text) for w in ([part] if part in self.special else WORDS.findall(part))]
        return WORDS.findall(text)

    def decode(self, ids: list[int]) -> str:
        """The text of token ids; bytes that are not UTF-8 become U+FFFD. An id outside the vocabulary raises."""
        table = self.bytes_of
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def _codec(raw: bytes) -> Codec:
    return Codec(raw)


def _load(df: DataFrame, path: str | None):
    from pathlib import Path

    raw = Path(path or default_vocabulary()).read_bytes()
    if len(raw) > MAX_VOCABULARY_MB << 20:
        raise ValueError(f"a vocabulary of {len(raw)} bytes is too large to broadcast")
    return df.sparkSession.sparkContext.broadcast(raw)


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))


def _groups(raw: list[bytes], most: int = 4 << 20):
    """Row ranges of a few MB of text each."""
    low = size = 0
    for k, x in enumerate(raw):
        if size and size + len(x) > most:
            yield low, k
            low, size = k, 0
        size += len(x)
    yield low, len(raw)


def _mapped(df: DataFrame, path: str | None, text_col: str | None, ids_col: str, decoded_col: str | None) -> DataFrame:
    raw = _load(df, path)
    new = [c for c in (ids_col if text_col else None, decoded_col) if c]
    kept = [f for f in df.schema.fields if f.name not in new]
    kinds = {ids_col: "array<int>", decoded_col: "string"}
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept] + [f"`{c}` {kinds[c]}" for c in new])

    def make():
        codec = _codec(raw.value)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            if text_col:
                texts, ids = texts_of(batch, text_col), []
                for low, high in _groups(texts):
                    ids += codec.encode_batch([t.decode() for t in texts[low:high]])
            else:
                ids = [x or () for x in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()]
            made = {ids_col: _lists(ids)} if text_col else {}
            if decoded_col:
                made[decoded_col] = pa.array([codec.decode(x.tolist() if text_col else x) for x in ids], pa.string())
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept] + [made[c] for c in new]
            return pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in kept), *new])

        return work

    return map_batches(df, make, schema)


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "input_ids", vocabulary: str | None = None) -> DataFrame:
    """``df`` with the token ids of each text; a column named as ``ids_col`` is replaced."""
    return _mapped(df, vocabulary, text_col, ids_col, None)


def decode(df: DataFrame, ids_col: str = "input_ids", decoded_col: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """``df`` with the text of each list of ids (null: the empty text)."""
    return _mapped(df, vocabulary, None, ids_col, decoded_col)


def round_trip(df: DataFrame, text_col: str = "text", ids_col: str = "input_ids", decoded_col: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """``encode`` and ``decode`` in one pass over the texts."""
    return _mapped(df, vocabulary, text_col, ids_col, decoded_col)

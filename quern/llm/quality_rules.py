"""Quality rules as weak supervision.

Every rule votes good or bad on a document, or abstains. Documents are reduced to their pattern
of votes, of which there are at most 3 ** rules; counting patterns over the whole corpus is one
small aggregation, and expectation-maximisation over those counts (on the driver, of a size
that no corpus can raise) estimates how often each rule is right. The posterior probability of
good quality then replaces all-must-pass filtering. Texts are read twice and never shuffled.

Defined cases: a null or empty text has no words, fails the base rules and is rejected; texts of
any length are read whole; an empty table trains on nothing and gives no rows; repeated rows each
give a row and each count; other columns are ignored, and a column named ``quality`` is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.words import map_batches, texts_of
from quern.session import fresh

MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
LEAST_LINES = 5  #: for the share of unended lines to say anything
#: Rule, and the share from which it calls a document bad; below that it abstains.
DEFECTS = (
    ("symbols_per_word", 0.10),
    ("upper_share", 0.35),
    ("duplicate_line_share", 0.30),
    ("repeated_word_share", 0.25),
    ("top_word_share", 0.30),
    ("unended_line_share", 0.80),
    ("shouted_word_share", 0.10),
    ("odd_word_length", 1.0),
    ("shortness", 1.0),
    ("stutter_share", 0.30),
)
#: What the one rule that calls documents good, "prose", allows at most of each share.
PROSE = (0.05, 0.15, 0.10, 0.10, 0.15, 0.50, 0.03, 0.5, 0.5, 0.10)
N_RULES = len(DEFECTS) + 1
ROUNDS = 200


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words in windows of ``window`` words that occur twice or more in the text, first included.

    Windows are compared exactly: ranks of windows of 1, 2, 4, ... words give those of twice as many.
    """
    if len(words) <= window:
        return 0
    number: dict[bytes, int] = {}
    rank, width = np.array([number.setdefault(w, len(number)) for w in words], np.int64), 1
    if len(number) == len(words):
        return 0
    while width < window:
        step = min(width, window - width)
        pair = rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:]
        values, rank, counts = np.unique(pair, return_inverse=True, return_counts=True)
        width += step
        if len(values) == len(pair):
            return 0
    starts = np.flatnonzero(counts[rank] > 1)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def statistics(raw: bytes) -> dict:
    """The base statistics, and those that the rules look at."""
    words = raw.split()
    n = len(words)
    points = len(raw.decode()) - (len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r")))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    duplicates = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    out = {"n_words": n, "word_chars": points, "n_symbols": symbols, "n_dup_lines": duplicates, "n_repeat_words": repeats, "base_failed": failed}
    if not n:
        return out | {"values": tuple(float(name == "shortness") for name, _ in DEFECTS)}
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(raw) - len(raw.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    shouted = raw.count(b"!!")
    ended = sum(x.rstrip()[-1:] in b".!?:;\"')" for x in lines)
    mean = points / n
    return out | {
        "values": (
            symbols / n,
            upper / max(1, upper + lower),
            duplicates / len(lines),
            repeats / n,
            max(counts.values()) / n if n >= MIN_WORDS else 0.0,
            1 - ended / len(lines) if len(lines) >= LEAST_LINES else 0.0,
            shouted / n,
            0.0 if 3 <= mean <= 10 else 1.0 if mean < 2 or mean > 15 else 0.5,
            1.0 if n < MIN_WORDS else 0.5 if n < 2 * MIN_WORDS else 0.0,
            sum(map(bytes.__eq__, words, words[1:])) / n,
        )
    }


def votes(values: tuple[float, ...]) -> tuple[int, ...]:
    """1 good, -1 bad, 0 abstains; the last vote is that of "prose"."""
    defects = tuple(-1 if x >= bad else 0 for x, (_, bad) in zip(values, DEFECTS))
    return (*defects, int(all(x <= most for x, most in zip(values, PROSE))))


def pattern(vote: tuple[int, ...]) -> int:
    return sum((v + 1) * 3**k for k, v in enumerate(vote))


def unpacked(patterns: np.ndarray) -> np.ndarray:
    return np.stack([patterns // 3**k % 3 - 1 for k in range(N_RULES)], axis=1)


@dataclass(frozen=True)
class VoteModel:
    """How often each rule is right when it votes; the classes count alike before any vote."""

    accuracy: tuple[float, ...]

    def posterior(self, vote: np.ndarray) -> np.ndarray:
        weight = np.log(np.array(self.accuracy) / (1 - np.array(self.accuracy)))
        return 1 / (1 + np.exp(-(vote @ weight)))


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> VoteModel:
    """Expectation-maximisation over counted vote patterns, from rules that are right at first four times in five.

    A hundredth of all votes is added to each rule as votes of that first accuracy, so that a
    rule which hardly ever votes keeps it. Accuracies stay between 0.55 and 0.995.
    """
    vote, n = unpacked(patterns), counts.sum()
    model = VoteModel((0.8,) * N_RULES)
    if not n:
        return model
    weight, belief = counts / n, 0.01
    for _ in range(rounds):
        p = model.posterior(vote)
        right = (weight * p) @ (vote > 0) + (weight * (1 - p)) @ (vote < 0)
        fitted = np.clip((right + 0.8 * belief) / (weight @ (vote != 0) + belief), 0.55, 0.995)
        if np.abs(fitted - model.accuracy).max() < 1e-9:
            break
        model = VoteModel(tuple(fitted.tolist()))
    return model


_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def vote_patterns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(pattern, count) over all documents."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [pattern(votes(statistics(x)["values"])) for x in texts_of(batch, "text")]
            values, counts = np.unique(np.array(found, np.int64), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], names=["pattern", "n"])

        return work

    return map_batches(docs.select(F.col(text_col).alias("text")), make, "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text_col: str = "text") -> VoteModel:
    """The vote model of a whole corpus; at most 3 ** rules counts come to the driver."""
    rows = vote_patterns(docs, text_col).orderBy("pattern").collect()
    return fit_votes(np.array([r["pattern"] for r in rows], np.int64), np.array([r["n"] for r in rows], float))


def judge(docs: DataFrame, text_col: str = "text", model: VoteModel | None = None, least: float = 0.5) -> DataFrame:
    """All columns and a struct ``quality``: the base statistics, base_failed, votes, posterior and kept."""
    model = model or train(docs, text_col)
    fields = [f for f in docs.schema.fields if f.name != "quality"]
    kind = "struct<" + ",".join(f"{c}:bigint" for c in _STATS) + ",base_failed:boolean,votes:array<int>,posterior:double,kept:boolean>"
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields] + [f"`quality` {kind}"])
    shape = pa.struct([*((c, pa.int64()) for c in _STATS), ("base_failed", pa.bool_()), ("votes", pa.list_(pa.int32())), ("posterior", pa.float64()), ("kept", pa.bool_())])

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [statistics(x) for x in texts_of(batch, text_col)]
            vote = [votes(x.pop("values")) for x in found]
            sure = model.posterior(np.array(vote)).tolist()
            rows = [x | {"votes": v, "posterior": p, "kept": not x["base_failed"] and p >= least} for x, v, p in zip(found, vote, sure)]
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in fields]
            return pa.RecordBatch.from_arrays([*columns, pa.array(rows, shape)], names=[*(f.name for f in fields), "quality"])

        return work

    return map_batches(docs.select(*(f.name for f in fields)) if len(fields) == len(docs.columns) else docs, make, schema)


def keep_good(docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents that the rules keep, with their own columns (a column named ``quality`` among them stays)."""
    own = fresh(docs, "quality")
    named = docs.withColumnRenamed("quality", own) if "quality" in docs.columns else docs
    good = judge(named, text_col, least=least).where("quality.kept").drop("quality")
    return (good.withColumnRenamed(own, "quality") if own in good.columns else good).select(*docs.columns)

"""Language identification with a byte convolutional network, trained here with numpy.

A text is cut into windows of a fixed number of bytes, all of it. Filters of several widths run
over each window; as the input is one byte at a time, a filter's response is a sum of table
entries, and pairs of bytes are looked up together. Each filter's largest response over the
window goes through a softmax layer, and the windows' log-probabilities are averaged over the
text. Training takes a documented, bounded sample of labelled rows to the driver.

Defined cases: a text that is null or has no letter is ``und`` with score 0; a corpus without a
labelled row makes every text ``und``; ties go to the label that sorts first; repeated rows each
give a row; other columns, clashing names included, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.words import few_by_hash, map_batches, texts_of

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16  #: of each width
SAMPLE_ROWS = 2000  #: labelled rows for training at most, the least by hash of their id
SAMPLE_BYTES = 4096  #: of each of them, cut at random whole windows
EPOCHS = 5  #: at least, and at least so many steps of 64 windows:
STEPS = 800
CLASSES = 48  #: bytes are first mapped to so many classes
UNKNOWN = "und"
_HAS_LETTER = r"\p{L}"


def byte_classes() -> np.ndarray:
    """a-z without case, blank, digits, other ASCII, and the rest by its lower bits."""
    table = np.zeros(256, np.int64)
    for b in range(256):
        c = chr(b).lower()
        table[b] = 1 + ord(c) - 97 if "a" <= c <= "z" and b < 128 else 27 if b in (32, 9, 10, 11, 12, 13) else 28 if 48 <= b < 58 else 29 if b < 128 else 30 + b % 17 if b < 192 else 47
    return table


_TABLE = byte_classes()
PAD = 0


def windows_of(raw: bytes, window: int = WINDOW) -> np.ndarray:
    """Every byte's class, in rows of ``window``; the last row is padded."""
    codes = _TABLE[np.frombuffer(raw, np.uint8)]
    out = np.full((max(1, -(-len(codes) // window)), window), PAD)
    out.ravel()[: len(codes)] = codes
    return out


@dataclass(frozen=True)
class ByteNet:
    labels: tuple[str, ...]
    taps: tuple[np.ndarray, ...]  #: for each width: (width, CLASSES, FILTERS)
    bias: np.ndarray
    weight: np.ndarray
    shift: np.ndarray

    def responses(self, codes: np.ndarray, places: bool = False):
        """Largest response of every filter in every window, and where it is."""
        best, where = [], []
        pair = codes[:, :-1] * CLASSES + codes[:, 1:]
        for taps in self.taps:
            width, span = len(taps), codes.shape[1] - len(taps) + 1
            doubled = lambda k: (taps[k][:, None, :] + taps[k + 1][None, :, :]).reshape(CLASSES * CLASSES, -1)
            total = doubled(0)[pair[:, :span]]
            for k in range(2, width - 1, 2):
                total += doubled(k)[pair[:, k : k + span]]
            if width % 2:
                total += taps[width - 1][codes[:, width - 1 : width - 1 + span]]
            if places:
                at = total.argmax(1)
                where.append(at)
                best.append(np.take_along_axis(total, at[:, None, :], 1)[:, 0])
            else:
                best.append(total.max(1))
        pooled = np.concatenate(best, 1) + self.bias
        return (pooled, where) if places else pooled

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        z = np.maximum(self.responses(codes), 0) @ self.weight + self.shift
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def predict(self, raws: list[bytes], block: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Label number and probability of every text, over all its windows in batches."""
        total, n = np.zeros((len(raws), len(self.labels))), np.zeros(len(raws))
        held, owners, size = [], [], 0

        def flush() -> None:
            codes, owner = np.concatenate(held), np.concatenate(owners)
            for low in range(0, len(codes), block):
                np.add.at(total, owner[low : low + block], self.log_probabilities(codes[low : low + block]))
            np.add.at(n, owner, 1)

        for k, raw in enumerate(raws):
            held.append(windows_of(raw))
            owners.append(np.full(len(held[-1]), k))
            size += len(held[-1])
            if size >= 8 * block:
                flush()
                held, owners, size = [], [], 0
        if held:
            flush()
        mean = total / np.maximum(n, 1)[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        top = p.argmax(1)
        return top, p[np.arange(len(p)), top]


def fit(raws: list[bytes], labels: list[str], epochs: int = EPOCHS, seed: int = 7) -> ByteNet | None:
    """Mini-batch Adam on single windows; None without a row."""
    names = tuple(sorted(set(labels)))
    if not names:
        return None
    rng, number = np.random.default_rng(seed), {x: k for k, x in enumerate(names)}
    codes, target = [], []
    for raw, label in zip(raws, labels):
        if raw:
            codes.append(windows_of(raw))
            target.append(np.full(len(codes[-1]), number[label]))
    codes, target = (np.concatenate(codes), np.concatenate(target)) if codes else (np.full((1, WINDOW), PAD), np.zeros(1, np.int64))
    share = np.bincount(target, minlength=len(names)) / len(target)
    cost = 1 / np.maximum(share, 1e-3) ** 0.5
    n_out = FILTERS * len(WIDTHS)
    state = {f"t{k}": rng.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for k, w in enumerate(WIDTHS)}
    state |= {"bias": np.zeros(n_out, np.float32), "weight": rng.normal(0, n_out**-0.5, (n_out, len(names))).astype(np.float32), "shift": np.zeros(len(names), np.float32)}
    first, second, step = {k: np.zeros_like(v) for k, v in state.items()}, {k: np.zeros_like(v) for k, v in state.items()}, 0
    net = lambda: ByteNet(names, tuple(state[f"t{k}"] for k in range(len(WIDTHS))), state["bias"], state["weight"], state["shift"])
    for _ in range(max(epochs, -(-STEPS * 64 // len(codes)))):
        order = rng.permutation(len(codes))
        for low in range(0, len(order), 64):
            rows = order[low : low + 64]
            x, y, model = codes[rows], target[rows], net()
            pooled, where = model.responses(x, places=True)
            active = np.maximum(pooled, 0)
            z = active @ model.weight + model.shift
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= (cost[y] / len(y))[:, None]
            back = (p @ model.weight.T) * (pooled > 0)
            grad = {"weight": active.T @ p, "shift": p.sum(0), "bias": back.sum(0)}
            for k, at in enumerate(where):
                g, own = np.zeros_like(state[f"t{k}"]), back[:, k * FILTERS : (k + 1) * FILTERS]
                for tap in range(WIDTHS[k]):
                    np.add.at(g[tap], (np.take_along_axis(x, at + tap, 1), np.arange(FILTERS)[None, :]), own)
                grad[f"t{k}"] = g
            step += 1
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                state[k] = (state[k] - 0.004 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", learn=None, sample_rows: int = SAMPLE_ROWS) -> ByteNet | None:
    """Fit on at most ``sample_rows`` rows with a label (and where ``learn`` holds): those of least hash of their id.

    Of a sampled text a random whole window in each sixteenth of it is used, at most ``SAMPLE_BYTES`` in all.
    """
    part = WINDOW
    pieces = SAMPLE_BYTES // part
    source = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    source = source.where(learn) if learn is not None else source
    encoded = F.encode(text_col, "UTF-8")
    step = F.greatest(F.lit(part), F.floor(F.length(encoded) / pieces))
    cut = lambda k: F.substring(encoded, (F.lit(1) + step * k + F.pmod(F.xxhash64(F.col(id_col), F.lit(k)), F.greatest(F.lit(1), step - part + 1))).cast("int"), F.lit(part))
    chosen = source.select(F.xxhash64(id_col).alias("h"), F.col(id_col).alias("id"), F.concat(*(cut(k) for k in range(pieces))).alias("raw"), F.col(label_col).alias("label"))
    rows = few_by_hash(chosen, "h", source.count(), sample_rows).orderBy("h", "id", "raw").limit(sample_rows).collect()
    return fit([bytes(r["raw"]) for r in rows], [r["label"] for r in rows])


def identify(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row, from the whole of its text alone."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(_HAS_LETTER), F.lit(False)).alias("known"))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            known = np.array(batch.column(2).to_pylist(), bool) & (net is not None)
            label, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            if known.any():
                raws = texts_of(batch, "text")
                top, p = net.predict([raws[k] for k in np.flatnonzero(known)])
                label[known], score[known] = [net.labels[k] for k in top], p
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(label.tolist(), pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

        return work

    return map_batches(rows, make, f"id {kind}, lang_pred string, score double")

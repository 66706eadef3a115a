"""Tokenisation shared by the corpus operators, over UTF-8 bytes.

Working on bytes keeps lower-casing to A-Z and splitting to ASCII white space or ASCII
non-alphanumerics exactly as the operators define them, whatever else a text contains.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import ready_python

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: A-Z to a-z, and every ASCII character that is neither letter nor digit to a blank.
_ALNUM = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).translate(_LOWER)
_ALNUM_RUN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def alnum_words(raw: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and all non-ASCII characters, A-Z lower-cased."""
    return raw.translate(_ALNUM).split()


def alnum_spans(raw: bytes) -> list[tuple[int, int]]:
    """Byte offsets in ``raw`` of each of ``alnum_words(raw)``, in order."""
    return [m.span() for m in _ALNUM_RUN.finditer(raw)]


def code_points(raw: bytes, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets to code-point offsets."""
    starts = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return starts[offsets]


def ascii_lower(raw: bytes) -> bytes:
    return raw.translate(_LOWER)


def few_by_hash(df: DataFrame, hashed: str, rows: int, most: int) -> DataFrame:
    """Rows whose hash column is small enough that about twice ``most`` of all ``rows`` are left: what tasks then
    send for a sample of the least hashes doesn't grow with their number."""
    share = min(1.0, (2 * most + 200) / max(1, rows))
    return df if share >= 1 else df.where(F.col(hashed) < int(share * 2**64) - 2**63)


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The texts of a batch as UTF-8 bytes; null is the empty text."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function built once per task by ``make``; batches are kept small."""
    ready_python(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            if batch.num_rows:
                work = work or make()
                yield work(batch)

    return df.mapInArrow(run, schema)

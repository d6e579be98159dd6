"""Word characters of whole columns of texts, told apart in Arrow's buffers as Spark's regular
expressions do."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from supportlake.functions.rules import WORD

CODES = 0x110000


@lru_cache(maxsize=8)
def _letters(spark: SparkSession, kind: str) -> bytes:
    code = F.lpad(F.hex("id"), 8, "0")
    found = (
        spark.range(CODES).filter(~F.col("id").between(0xD800, 0xDFFF))
        .filter(F.decode(F.unhex(code), "UTF-32").rlike(f"[{kind}]"))
        .toPandas()["id"]
    )
    marks = np.zeros(CODES, bool)
    marks[found.to_numpy()] = True
    return np.packbits(marks).tobytes()


def word_letters(spark: SparkSession, but: str = "") -> bytes:
    """A bit per code point: whether Spark's regular expressions find it in WORD, and not in
    `but`. Asked once a session."""
    return _letters(spark, f"{WORD}&&[^{but}]" if but else WORD)


@lru_cache(maxsize=8)
def _marks(letters: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(letters, np.uint8)).astype(bool)


def only_letters(texts: pa.Array, letters: bytes) -> pa.Array:
    """Every byte of another character turned into a blank. Texts are valid UTF-8 and not null."""
    marks, n = _marks(letters), len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1]
    if texts.buffers()[2] is None:
        return texts
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    kept = np.arange(256, dtype=np.uint8)
    kept[:128][~marks[:128]] = 32
    data = kept[data]
    for size, low, high in ((2, 0xC0, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0xF8)):
        at = np.flatnonzero((data >= low) & (data < high))
        if len(at):
            code = (data[at] & (0x7F >> size)).astype(np.int32)
            for i in range(1, size):
                code = code << 6 | (data[at + i] & 0x3F)
            other = at[~marks[code]]
            for i in range(size):
                data[other + i] = 32
    return pa.StringArray.from_buffers(n, pa.py_buffer(ends - ends[0]), pa.py_buffer(data))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Rows in slices of at most so many bytes of `column`, texts or lists of four-byte numbers, or of
    one row."""
    for batch in batches:
        sizes = batch.column(column)
        if pa.types.is_string(sizes.type):
            sizes = pc.binary_length(sizes)
        else:
            sizes = pc.multiply(pc.list_value_length(sizes), 4)
        ends, at = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while at < batch.num_rows:
            full = (ends[at - 1] if at else 0) + most
            to = max(at + 1, int(np.searchsorted(ends, full, side="right")))
            yield batch.slice(at, to - at)
            at = to

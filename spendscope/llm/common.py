"""What several operators share: the shared folder, stored tables, Arrow batches cut by bytes, words as arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendscope.sources.scratch import shared_folder

__all__ = ["shared_folder"]

#: Bytes of text that a task works on at once; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """The rows as a table in the shared folder: later jobs read it, lost executors cost nothing."""
    path = shared_folder(df.sparkSession, what)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, under fixed names, so that no other column can clash."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def sampled(df: DataFrame, n: int, *key: str) -> DataFrame:
    """About n rows, the same on every run: those whose key's hash is below n / count; 2 n at most, should keys repeat."""
    total = df.count()
    if total <= n:
        return df
    return df.filter(F.shiftrightunsigned(F.xxhash64(F.lit(11), *key), 24) < int(n / total * (1 << 40))).limit(2 * n)


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of text."""
    lengths = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
    group = np.maximum(np.cumsum(lengths) - 1, 0) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(lengths)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


#: Rows of a batch of whole texts on its way to Python: JVM, pipe and Python each hold batches, for every task of an executor.
BATCH_ROWS = 1_000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run within hand rows to Python by BATCH_ROWS at most; the session's own bound holds if it is smaller, and again afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def given_back() -> None:
    """What a task has freed goes back to the system: its Python process serves the next stages, beside the JVM, and would keep it."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if trim:
        trim(0)


def mapped(df: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str, column: str = "text") -> DataFrame:
    """mapInArrow, piece by piece; `work` returns the columns of `schema`."""
    import re

    names = [x.split()[0] for x in re.split(r",\s*(?![^<]*>)", schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, column):
                out = work(piece)
                if len(out[names[0]]):
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (out[n] for n in names)], names)
        given_back()

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows (a null is empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: A random odd base and a random value per byte: a polynomial hash modulo 2^64, mixed at the end.
_BASE = 0xD6E8FEB86659FD93
_BYTE = np.random.default_rng(20240131).integers(1, 2**63, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
BYTE_LOWER = _BYTE[_LOWER]
#: Values that a running sum of hashes spans, so that the powers stay small however long a text is.
_SPAN = 1 << 20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i in 0..n-1 at least."""
    if len(_POWERS[0]) < n:
        size, inverse = 1 << max(16, (n - 1).bit_length()), pow(_BASE, -1, 1 << 64)
        for k, base in enumerate((_BASE, inverse)):
            out = np.full(size, base & (2**64 - 1), np.uint64)
            out[0] = 1
            np.multiply.accumulate(out, out=out)
            _POWERS[k] = out
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """Polynomial hashes of values[starts:ends] (of table[values], if given) in rising order, from running sums over _SPAN values."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + _SPAN, "right")))
        span = values[a : int(ends[j - 1])]
        up, down = powers(len(span) + 1)
        total = np.zeros(len(span) + 1, np.uint64)
        np.cumsum((span if table is None else table[span]) * up[: len(span)], out=total[1:])
        out[i:j] = mix((total[ends[i:j] - a] - total[starts[i:j] - a]) * down[starts[i:j] - a])
        i = j
    return out


class Words:
    """Words of many texts: byte spans, owners and 64-bit hashes, without a Python object per word."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = False, punctuation: np.ndarray | None = None):
        self.raw, self.offsets = raw, offsets
        gap = _SPACE[raw] if punctuation is None else punctuation[raw]
        inside = ~gap
        first = inside.copy()
        first[1:] &= gap[:-1]
        inner = offsets[1:-1]
        inner = inner[inner < len(raw)]
        first[inner] = inside[inner]
        last = inside.copy()
        last[:-1] &= gap[1:]
        edge = offsets[1:-1] - 1
        edge = edge[edge >= 0]
        last[edge] = inside[edge]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: Words of row i are bounds[i]:bounds[i + 1].
        self.bounds = np.searchsorted(self.starts, offsets)
        self.owner = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))
        self.hashes = rolling(raw, self.starts, self.ends, BYTE_LOWER if lower else _BYTE)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all n-word windows inside one text, and their hashes."""
        at = np.flatnonzero(self.owner[n - 1 :] == self.owner[: max(0, len(self.owner) - n + 1)]) if len(self.owner) >= n else np.zeros(0, np.int64)
        return at, rolling(self.hashes, at, at + n)


def covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of `size` positions lie in a span of n that begins at one of `at`."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, np.minimum(at + n, size), -1)
    return np.cumsum(steps[:-1]) > 0


def repeated(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes occur twice or more under the same owner."""
    key = hashes ^ mix((owner.astype(np.uint64) + np.uint64(1)) * _ODD)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def later_copies(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes equal an earlier one of the same owner."""
    key = hashes ^ mix((owner.astype(np.uint64) + np.uint64(1)) * _ODD)
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(key), bool)
    out[order[1:][key[order][1:] == key[order][:-1]]] = True
    return out


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]

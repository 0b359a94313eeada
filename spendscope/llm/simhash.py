"""Near duplicates by SimHash: fingerprints of word shingles, bit-sliced comparison inside blocks, components.

Fingerprints within `radius` bits agree on all but `radius` of `radius + 2`
bit ranges, so each distinct fingerprint is dealt out once per choice of two
agreeing ranges (ten choices of about 26 bits for radius 3). A block is
compared vertically: plane b holds bit b of all its rows, 64 rows to a word,
and the differing bits of many pairs are counted at once by carry-save adders
that saturate above the radius; words whose pairs are all beyond it are
abandoned. Blocks above BLOCK_ROWS rows are cut into chunks and every two
chunks meet in a task of their own, so no group goes whole to one task and no
pair is skipped.

Defined cases: a null text counts as empty; no word gives fingerprint zero,
which links like any other; rows that repeat a doc_id are one document; a row
without doc_id links others but never names a component (its component_id is
null only if no row of the component has an id); columns other than id and
text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendscope.llm.common import documents, given_back, mapped, stored
from spendscope.llm.components import components

#: Rows of a chunk; it sets how work is cut, not what is compared.
BLOCK_ROWS = 1024
_SEED = 42
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_EVERY = 8  # planes between two looks for words to abandon


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Majority of the bits of XXH64 over the word shingles of lower-cased (A-Z) UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = iter([b" ".join(words)])
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if shingle > 1 else iter(words)
    bits = np.unpackbits(np.frombuffer(b"".join(map(xxhash.xxh64_digest, grams, repeat(_SEED))), np.uint8)).reshape(-1, 64)
    n, whole = len(bits), len(bits) // 255
    ones = bits[whole * 255 :].sum(0, dtype=np.uint8).astype(np.int64)
    if whole:  # sums of 255 bits fit in a byte
        ones += bits[: whole * 255].reshape(whole, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint as the 64 bits of a long."""

    def work(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").fill_null("").cast(pa.large_binary()).to_pylist()
        return {"id": batch.column("id"), "fp": np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)}

    return mapped(documents(docs, id_col, text_col), work, "id long, fp long")


def _ranges(radius: int) -> list[int]:
    """Masks of radius + 2 bit ranges."""
    cuts = [64 * i // (radius + 2) for i in range(radius + 3)]
    return [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:])]


def block_keys(fp: Column, radius: int) -> Column:
    """One struct (band, bits) for every two ranges that may agree."""
    masks = [x | y for x, y in combinations(_ranges(radius), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*(F.struct(F.lit(i).alias("band"), fp.bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(signed)))


class _Counter:
    """Carry-save counters of differing bits: ones, twos, ... and a flag above the radius."""

    def __init__(self, shape: tuple[int, ...], radius: int):
        self.radius = radius
        self.digits = [np.zeros(shape, np.uint64) for _ in range((radius + 1).bit_length())]
        self.beyond = np.zeros(shape, np.uint64)

    def add(self, bits: np.ndarray) -> None:
        carry = bits
        for k, digit in enumerate(self.digits):
            self.digits[k] = digit ^ carry
            carry = digit & carry
        over = carry
        hit = np.full_like(over, _FULL)
        for k, digit in enumerate(self.digits):  # exactly radius + 1
            hit &= digit if (self.radius + 1) >> k & 1 else ~digit
        self.beyond |= over | hit

    def keep(self, rows: np.ndarray) -> None:
        self.digits = [x[rows] for x in self.digits]
        self.beyond = self.beyond[rows]


def planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): plane b holds bit b of every row, row r at bit r % 64 of word r // 64."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def near(queries: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """(queries, words) bits: which rows of fps lie within the radius of each query."""
    rows, words = planes(fps), -(-len(fps) // 64)
    valid = np.full(words, _FULL)
    if len(fps) % 64:
        valid[-1] = (np.uint64(1) << np.uint64(len(fps) % 64)) - np.uint64(1)
    q, w = np.divmod(np.arange(len(queries) * words), words)
    out = np.zeros((len(queries), words), np.uint64)
    counter = _Counter((len(q),), radius)
    counter.beyond |= ~valid[w]
    for b in range(64):
        flip = np.where(queries >> np.uint64(b) & np.uint64(1), _FULL, np.uint64(0))
        counter.add(rows[b][w] ^ flip[q])
        if b % _EVERY == _EVERY - 1:
            alive = np.flatnonzero(counter.beyond != _FULL)
            if 2 * len(alive) < len(q) or b == 63:
                q, w = q[alive], w[alive]
                counter.keep(alive)
    out[q, w] = ~counter.beyond
    return out


def _stars(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one block as stars around the first row of each local component."""
    n = len(fps)
    words = -(-n // 64)
    step = max(1, (1 << 20) // max(1, words))
    bits = np.concatenate([near(fps[i : i + step], fps, radius) for i in range(0, n, step)])
    root, free = np.full(n, -1), np.ones(n, bool)
    for first in range(n):
        if not free[first]:
            continue
        wave = np.array([first])
        while len(wave):
            free[wave] = False
            root[wave] = first
            seen = np.bitwise_or.reduce(bits[wave], axis=0)
            wave = np.flatnonzero(np.unpackbits(seen.view(np.uint8), bitorder="little")[:n].astype(bool) & free)
    at = np.flatnonzero(root != np.arange(n))
    return fps[at], fps[root[at]]


def _shifted(fps: np.ndarray, size: np.ndarray, place: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside many small blocks at once: rows against the rows k places on, 64 pairs to a word."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(1, int(size.max(initial=1))):
        left = np.flatnonzero(place + k < size)
        if not len(left):
            break
        x, y = planes(fps[left]), planes(fps[left + k])
        words = np.arange(x.shape[1])
        counter = _Counter((len(words),), radius)
        for b in range(64):
            counter.add(x[b][words] ^ y[b][words])
            if b % _EVERY == _EVERY - 1:
                alive = np.flatnonzero(counter.beyond != _FULL)
                words = words[alive]
                counter.keep(alive)
        inside = np.zeros((x.shape[1],), np.uint64)
        inside[words] = ~counter.beyond
        hit = np.flatnonzero(np.unpackbits(inside.view(np.uint8), bitorder="little")[: len(left)])
        out.append((fps[left[hit]], fps[left[hit] + k]))
    if not out:
        return fps[:0], fps[:0]
    return tuple(np.concatenate(x) for x in zip(*out))


_SMALL = 32  # rows of a block up to which many blocks are compared together


def compare(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole blocks; rows of a block stand together."""
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    count = np.diff(np.r_[start, len(keys)])
    size = np.repeat(count, count)
    place = np.arange(len(keys)) - np.repeat(start, count)
    small = size <= _SMALL
    found = [_shifted(fps[small], size[small], place[small], radius)]
    found += [_stars(fps[s : s + c], radius) for s, c in zip(start, count) if c > _SMALL]
    return tuple(np.concatenate(x) for x in zip(*found))


def _compared(rows: DataFrame, radius: int) -> DataFrame:
    """Rows (block, fp), sorted by block inside each partition -> (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_k, rest_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in _with_end(batches):
            if batch is not None:
                rest_k = np.concatenate([rest_k, batch.column("block").to_numpy()])
                rest_f = np.concatenate([rest_f, batch.column("fp").to_numpy().view(np.uint64)])
                cut = int(np.searchsorted(rest_k, rest_k[-1])) if len(rest_k) else 0
            else:
                cut = len(rest_k)
            if cut:
                a, b = compare(rest_k[:cut], rest_f[:cut], radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
                rest_k, rest_f = rest_k[cut:], rest_f[cut:]
        given_back()

    return rows.mapInArrow(run, "a long, b long")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """(fp) without repeats -> (a, b): links that join exactly the fingerprints within the radius, transitively."""
    dealt = distinct.select("fp", F.explode(block_keys(F.col("fp"), radius)).alias("k")).select("fp", "k.band", "k.bits")
    sizes = dealt.groupBy("band", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    chunks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), chunks).cast("int")
    rows = dealt.join(sizes, ["band", "bits"]).select("fp", "band", "bits", chunks.alias("chunks"), own.alias("own"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    block = F.xxhash64("band", "bits", F.least("own", "other"), F.greatest("own", "other"))
    rows = rows.select(block.alias("block"), "fp").repartition("block").sortWithinPartitions("block")
    return _compared(rows, radius).distinct()


def near_duplicates(
    docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per input row: (doc_id, fp, component_id)."""
    prints = stored(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    least = prints.groupBy("fp").agg(F.min("id").alias("first"))
    twice = prints.filter("id is not null").groupBy("id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi")
    same_id = prints.join(twice, "id").select(F.col("fp").alias("a"), F.col("lo").alias("b")).filter("a <> b")
    roots = stored(components(links(least.select("fp"), radius).union(same_id)), "roots")
    named = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "root")
    groups = named.filter("root is not null").groupBy("root").agg(F.min("first").alias("least"))
    named = named.join(groups, "root", "left").select("fp", F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"))
    return prints.join(named, "fp", "left").select(F.col("id").alias("doc_id"), "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """The documents without all but the smallest doc_id of each component; repeated rows of a doc_id become one.

    Rows without doc_id cannot be told apart by id and stay.
    """
    found = stored(near_duplicates(docs, shingle, radius), "components")
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    twice = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    left = docs.join(gone, "doc_id", "left_anti")
    if twice.isEmpty():  # the texts need not move once more
        return left.select(*(F.col(f"`{c}`") for c in docs.columns))
    single = left.join(twice, "doc_id", "left_anti")
    repeated = left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return single.unionByName(repeated).select(*(F.col(f"`{c}`") for c in docs.columns))

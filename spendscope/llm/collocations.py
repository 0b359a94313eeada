"""Phrase collocations by direct-address tiling.

Words get ids by falling frequency, so pairs of neighbours fill a matrix whose
corner is crowded and whose rest is nearly empty. The matrix is cut into tiles
of TILE x TILE ids. In each piece of text, a tile with many pairs is counted by
one dense bincount at the address (left id, right id); the pairs of all others
are sorted and counted as coordinates. Spark sums the counts up by pair.

Pairs found `least` times or more are ranked by frequency again and become the
ids of the next level: two such pairs that overlap in a word are a phrase of three
words, and so on up to `longest`. A level reads the ids that the texts were
turned into once, not the texts; ids that are no longer frequent end a run, so the
runs shrink from level to level.

Ids 0..ADDRESSED-1 are held by every task (a sorted array of that many hashes).
Frequent units beyond them are counted as well: a bitmap of fixed size tells
which hashes may be theirs, they are named by 62 bits of their hash and their pairs
are coordinates. Equality of words inside a task is equality of 64-bit hashes;
words and phrases themselves are joined by text.

Phrases never cross a language, as ids are given by language and word. Scores are
decimals of 38 digits, cut down by whole division.

Defined cases: null and empty texts have no words; a null language is `und`;
repeated rows count each; texts are read whole, cut only between texts; words longer than any
limit of a tokenizer are words; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendscope.llm.common import Words, mix, pieces, stored, utf8
from spendscope.llm.decontamination import BITMAP_BITS, _bitmap

#: Units whose ids address tiles; the hashes of so many go to every task.
ADDRESSED = 1 << 18
TILE = 1 << 10
#: Pairs in a tile from which it is counted densely.
DENSE = TILE * TILE // 16
#: Dense tiles counted in one go, 8 bytes an address.
_AT_ONCE = 8
_PIECE = 4 << 20
#: Parts into which a language's phrases are dealt for the first round of its list.
SALTS = 64
_NONE = -1
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_GAP = _BREAK.copy()
_GAP[[9, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _language_hashes(column: pa.Array) -> np.ndarray:
    coded = column.dictionary_encode()
    known = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()]
    return np.array(known, np.uint64)[coded.indices.to_numpy(zero_copy_only=False)] if len(column) else np.zeros(0, np.uint64)


def _units(batch: pa.RecordBatch) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of the texts, a hash of language and word of each, and whether it follows the one before in the same piece."""
    raw, offsets = utf8(batch.column("text"))
    words = Words(raw, offsets, lower=True, punctuation=_GAP)
    keys = mix(words.hashes ^ mix(_language_hashes(batch.column("lang"))[words.owner]))
    upto = np.cumsum(_BREAK[raw])[words.starts] if len(raw) else np.zeros(0, np.int64)
    follows = np.zeros(len(keys), bool)
    follows[1:] = (upto[1:] == upto[:-1]) & (words.owner[1:] == words.owner[:-1])
    return words, keys, follows


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("text <> ''")


def _over(rows: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", _PIECE):
                yield from work(piece)

    return rows.mapInArrow(run, schema)


def words_of(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, key, n): how often each language has each word; the row without a phrase has the sum."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words, keys, _ = _units(batch)
        key, first, n = np.unique(keys, return_index=True, return_counts=True)
        size = words.ends[first] - words.starts[first]
        ends = np.cumsum(size)
        at = np.repeat(words.starts[first] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        offsets = np.r_[0, ends].astype(np.int32)
        text = pa.StringArray.from_buffers(len(key), pa.py_buffer(offsets), pa.py_buffer(_LOWER[words.raw[at]]))
        yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(words.owner[first])), text, pa.array(key.view(np.int64)), pa.array(n)], ["lang", "phrase", "key", "n"])
        sums = np.diff(words.bounds)
        empty = pa.nulls(len(batch), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("lang"), empty, pa.array(np.zeros(len(batch), np.int64)), pa.array(sums)], ["lang", "phrase", "key", "n"])

    counted = _over(_texts(docs, text_col, lang_col), work, "lang string, phrase string, key long, n long")
    return counted.groupBy("lang", "phrase").agg(F.max("key").alias("key"), F.sum("n").alias("n"))


@dataclass
class Ranks:
    """Ids of frequent units by their hash, for the tasks."""

    keys: np.ndarray  # sorted
    ids: np.ndarray
    bits: np.ndarray | None  # of the hashes of units that are not addressed

    def of(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), _NONE, np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            out[hit] = self.ids[at[hit]]
        if self.bits is not None:
            bit = (keys >> np.uint64(40)).astype(np.int64) % BITMAP_BITS
            tail = (out == _NONE) & ((self.bits[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1).astype(bool)
            out[tail] = -(keys[tail] >> np.uint64(2)).astype(np.int64) - 2
        return out


def ranked(units: DataFrame, addressed: int = ADDRESSED) -> tuple[DataFrame, Ranks]:
    """Units (key, n, ...) with their `id`: the `addressed` most frequent by rank, others by hash; and what the tasks need."""
    spark = units.sparkSession
    top = units.orderBy(F.desc("n"), "key").limit(addressed).select("key").toArrow().column("key").to_numpy()
    place = np.argsort(top.view(np.uint64), kind="stable")
    given = spark.createDataFrame(pa.table({"key": top, "rank": np.arange(len(top))})) if len(top) else spark.createDataFrame([], "key long, rank long")
    named = units.join(given, "key", "left")
    named = named.withColumn("id", F.coalesce("rank", -F.shiftrightunsigned("key", 2) - 2)).drop("rank")
    named = stored(named, "units")
    rest = named.filter("id < 0").select(F.col("key").alias("seed"))
    bits = None if len(top) < addressed or rest.isEmpty() else _bitmap(rest)
    return named, Ranks(top.view(np.uint64)[place], place.astype(np.int64), bits)


def _without_gaps(ids: np.ndarray) -> np.ndarray:
    """Runs of frequent units, with one mark between two of them."""
    keep = ids != _NONE
    keep[1:] |= ids[:-1] != _NONE
    return ids[keep]


def _squeezed(ids: np.ndarray) -> bytes:
    narrow = len(ids) == 0 or (ids.min() >= -1)
    return bytes([4 if narrow else 8]) + zstandard.ZstdCompressor(level=1).compress((ids.astype(np.int32) if narrow else ids).tobytes())


def _opened(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data[1:])
    return np.frombuffer(raw, np.int32 if data[0] == 4 else np.int64).astype(np.int64)


def encoded(docs: DataFrame, ranks: Ranks, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(ids): the frequent words of each piece of the corpus as ids, compressed, with marks where a phrase cannot go on."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        _, keys, follows = _units(batch)
        ids = shared.value.of(keys)
        breaks = np.flatnonzero(~follows)
        ids = np.insert(ids, breaks, _NONE)
        yield pa.RecordBatch.from_arrays([pa.array([_squeezed(_without_gaps(ids))], pa.binary())], ["ids"])

    return stored(_over(_texts(docs, text_col, lang_col), work, "ids binary"), "ids")


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(mix(left.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) ^ right.view(np.uint64))


def joined(ids: np.ndarray, ranks: Ranks) -> np.ndarray:
    """Ids of the next level's units, each of two neighbours of this one."""
    left, right = ids[:-1], ids[1:]
    out = np.full(len(left), _NONE, np.int64)
    both = np.flatnonzero((left != _NONE) & (right != _NONE))
    out[both] = ranks.of(pair_keys(left[both], right[both]))
    return _without_gaps(out)


def pair_counts(ids: np.ndarray, tile: int = TILE, dense: int = DENSE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, n) of all neighbours: crowded tiles by address, the others as sorted coordinates."""
    both = (ids[:-1] != _NONE) & (ids[1:] != _NONE)
    left, right = ids[:-1][both], ids[1:][both]
    addressed = (left >= 0) & (right >= 0)
    found = []
    a, b = left[addressed], right[addressed]
    if len(a):
        side = int(max(a.max(), b.max())) // tile + 1
        tiles = a // tile * side + b // tile
        names, place, sizes = np.unique(tiles, return_inverse=True, return_counts=True) if side > 4096 else _small_unique(tiles, side * side)
        crowded = np.flatnonzero(sizes >= dense)
        slot = np.full(len(names), -1)
        slot[crowded] = np.arange(len(crowded))
        slots = slot[place]
        for begin in range(0, len(crowded), _AT_ONCE):
            own = (slots >= begin) & (slots < begin + _AT_ONCE)
            address = ((slots[own] - begin) * tile + a[own] % tile) * tile + b[own] % tile
            n = np.bincount(address)
            hit = np.flatnonzero(n)
            name = names[crowded[begin + hit // (tile * tile)]]
            found.append((name // side * tile + hit // tile % tile, name % side * tile + hit % tile, n[hit]))
        sparse = slots < 0
        code, n = np.unique(a[sparse] << np.int64(32) | b[sparse], return_counts=True)
        found.append((code >> np.int64(32), code & np.int64(0xFFFFFFFF), n))
    if not addressed.all():
        a, b = left[~addressed], right[~addressed]
        _, first, n = np.unique(pair_keys(a, b), return_index=True, return_counts=True)
        found.append((a[first], b[first], n))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def _small_unique(tiles: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.bincount(tiles, minlength=n)
    return np.arange(n), tiles, sizes


def pairs(ids: DataFrame, levels: list[Ranks], tile: int = TILE, dense: int = DENSE) -> DataFrame:
    """(left, right, n) of the units of the last of `levels`, which lead there from words."""
    shared = ids.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("ids"):
                units = reduce(joined, shared.value, _opened(data.as_py()))
                left, right, n = pair_counts(units, tile, dense)
                for i in range(0, len(n), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 18)]) for x in (left, right, n)], ["left", "right", "n"])

    return ids.mapInArrow(run, "left long, right long, n long").groupBy("left", "right").agg(F.sum("n").alias("n"))


def _keyed(found: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = pair_keys(batch.column("left").to_numpy(), batch.column("right").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key.view(np.int64))], [*batch.schema.names, "key"])

    return found.mapInArrow(run, "left long, right long, n long, key long")


@dataclass
class Phrases:
    """Frequent phrases by their number of words: levels[0] are words (lang, phrase, id, n), others have the ids of both overlapping halves."""

    levels: list[DataFrame]
    sums: DataFrame  # (lang, total)


def frequent(
    docs: DataFrame, least: int = 100, longest: int = 5, addressed: int = ADDRESSED, tile: int = TILE, dense: int = DENSE, text_col: str = "text", lang_col: str = "lang",
) -> Phrases:
    """All phrases of up to `longest` words that occur `least` times or more in their language."""
    counted = stored(words_of(docs, text_col, lang_col).filter(F.col("phrase").isNull() | (F.col("n") >= least)), "words")
    words, ranks = ranked(counted.filter("phrase is not null").select("lang", "phrase", "key", "n"), addressed)
    ids, levels, steps = encoded(docs, ranks, text_col, lang_col), [words], []
    for _ in range(2, longest + 1):
        found = stored(_keyed(pairs(ids, steps, tile, dense).filter(F.col("n") >= least)), "pairs")
        below = levels[-1]
        left = below.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("begin"))
        right = below.select(F.col("id").alias("right"), F.substring_index("phrase", " ", -1).alias("end"))
        named = found.join(left, "left").join(right, "right").select("lang", F.concat_ws(" ", "begin", "end").alias("phrase"), "key", "n", "left", "right")
        units, ranks = ranked(named, addressed)
        levels.append(units)
        steps.append(ranks)
    return Phrases(levels, counted.filter("phrase is null").select("lang", F.col("n").alias("total")))


def lowest_cuts(candidates: DataFrame, parts: DataFrame, sums: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the lowest-scoring cut of each candidate; ties to the first."""
    cuts = candidates.withColumn("words", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("one"), F.array_join(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")), " ").alias("two"))
    for part, name in (("one", "l"), ("two", "r")):
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(part), F.col("n").alias(name)), ["lang", part])
    cuts = cuts.join(sums, "lang")
    big = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = cuts.withColumn("above", big("a") * big("total") * F.lit(1000).cast("decimal(4,0)")).withColumn("below", big("l") * big("r"))
    cuts = cuts.withColumn("score", F.expr("above div below"))
    return cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("total").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut")).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(
    docs: DataFrame, least: int = 100, longest: int = 5, first: int = 2000, addressed: int = ADDRESSED, tile: int = TILE, dense: int = DENSE, text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `first` phrases that are not always part of a longer one."""
    found = frequent(docs, least, longest, addressed, tile, dense, text_col, lang_col)
    open_ = []
    for k in range(1, longest):
        units = found.levels[k].select("id", "lang", "phrase", F.col("n").alias("a"))
        if k + 1 < longest:  # a phrase inside a longer one is inside one that is longer by a word
            longer = found.levels[k + 1]
            inside = longer.select(F.col("left").alias("id"), "n").unionByName(longer.select(F.col("right").alias("id"), "n")).groupBy("id").agg(F.max("n").alias("inside"))
            units = units.join(inside, "id", "left").filter("inside is null or inside < a")
        open_.append(units.select("lang", "phrase", "a"))
    parts = reduce(DataFrame.unionByName, (x.select("lang", "phrase", "n") for x in found.levels[: longest - 1]))
    scored = stored(lowest_cuts(reduce(DataFrame.unionByName, open_), parts, found.sums), "scored")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*best)
    some = scored.withColumn("place", F.row_number().over(salted)).filter(F.col("place") <= first).drop("place")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*best))
    return some.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

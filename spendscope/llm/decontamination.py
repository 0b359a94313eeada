"""Benchmark decontamination by greedy string tiling.

1. Every k-word window of an item is a seed (an item of fewer words is one
   seed, as a whole). A bitmap of fixed size holds the seeds' hashes; one pass
   over the documents keeps those with a hit, and which seeds they hit.
2. Hits join seeds. Seeds of an item that are so common in the documents and so
   few that they alone cannot reach the asked coverage start no candidate; the
   others name (document, item) pairs.
3. Each pair is tiled: running Karp-Rabin hashes of falling length find the
   longest matches among unmarked words, which are marked without overlap, so
   passages count in any order. A pair counts if the marked words cover at
   least `coverage` of the item.

Words are runs of letters, digits and bytes above ASCII, lower-cased. Equality
of words is equality of 64-bit hashes. Defined cases: null and empty texts and
items without a word match nothing; repeated rows are found row by row and
reported once per (doc_id, item_id) with their best coverage; a null doc_id or
item_id is kept as such; very long texts are read whole; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.llm.common import Words, covered, documents, given_back, mapped, pieces, rolling, stored, utf8

#: Bits of the seed bitmap, whatever the number of seeds.
BITMAP_BITS = 1 << 24
_PAGE = 1024
_GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _words(column: pa.Array) -> Words:
    return Words(*utf8(pc.utf8_lower(column)), lower=False, punctuation=_GAP)


def _bit(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) % BITMAP_BITS


def keyed(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_key, item_id, item_text), one row per distinct item: the only table that holds item texts."""
    rows = documents(items, id_col, text_col).select(F.xxhash64("id", "text").alias("item_key"), F.col("id").alias("item_id"), F.col("text").alias("item_text"))
    return rows.dropDuplicates(["item_key"])


def seeds(items: DataFrame, k: int = 5) -> DataFrame:
    """(item_key, n_words, length, seed, times): hashes of the windows of each item of `keyed` and how often it has them."""

    def work(batch: pa.RecordBatch) -> dict:
        words = _words(batch.column("text"))
        n_words = np.diff(words.bounds)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n in range(1, k + 1):
            at, hashes = words.windows(n)
            row = words.owner[at]
            keep = np.ones(len(at), bool) if n == k else n_words[row] == n
            found.append((row[keep], np.full(int(keep.sum()), n), hashes[keep]))
        row, length, hashes = (np.concatenate(x) for x in zip(*found))
        return {"item_key": batch.column("item_key").take(pa.array(row)), "n_words": n_words[row], "length": length.astype(np.int32), "seed": hashes.view(np.int64)}

    rows = mapped(items.select("item_key", F.col("item_text").alias("text")), work, "item_key long, n_words long, length int, seed long")
    return rows.groupBy("item_key", "n_words", "length", "seed").agg(F.count("*").alias("times"))


def _bitmap(found: DataFrame) -> np.ndarray:
    """Set bits as one byte array; pages are built by the executors, the driver gets BITMAP_BITS / 8 bytes at most."""
    # the seed's upper 24 bits, as _bit takes them
    bit = F.shiftrightunsigned("seed", 40) % BITMAP_BITS
    pages = found.select(bit.alias("bit")).groupBy((F.col("bit") / _PAGE).cast("int").alias("page")).agg(
        F.collect_set((F.col("bit") % _PAGE).cast("int")).alias("bits"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for bits in batch.column("bits").to_pylist():
                flags = np.zeros(_PAGE, bool)
                flags[bits] = True
                out.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("page"), pa.array(out, pa.binary())], ["page", "bytes"])

    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    for page, data in pages.mapInArrow(pack, "page int, bytes binary").toLocalIterator():
        out[page * _PAGE // 8 : (page + 1) * _PAGE // 8] = np.frombuffer(data, np.uint8)
    return out


def seeded(docs: DataFrame, bitmap: np.ndarray, lengths: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, hits): the documents that have a window in the bitmap, and those windows' hashes."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def work(batch: pa.RecordBatch) -> dict:
        bits, words = shared.value, _words(batch.column("text"))
        rows, found = [], []
        for n in lengths:
            at, hashes = words.windows(n)
            bit = _bit(hashes)
            hit = np.flatnonzero(bits[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1)
            rows.append(words.owner[at[hit]])
            found.append(hashes[hit])
        row, hashes = np.concatenate(rows), np.concatenate(found)
        order = np.lexsort((hashes, row))
        row, hashes = row[order], hashes[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
        row, hashes = row[new], hashes[new]
        own, start = np.unique(row, return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[start, len(row)], pa.int32()), pa.array(hashes.view(np.int64)))
        take = pa.array(own)
        return {"id": batch.column("id").take(take), "text": batch.column("text").take(take), "hits": lists}

    return mapped(documents(docs, id_col, text_col), work, "id long, text string, hits array<long>")


def _runs(free: np.ndarray) -> int:
    """Length of the longest run of True."""
    edge = np.diff(np.r_[False, free, False].astype(np.int8))
    return int(max(np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1), default=0))


def _windows(values: np.ndarray, free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of n unmarked values, and their Karp-Rabin hashes."""
    if len(values) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    blocked = np.r_[0, np.cumsum(~free)]
    at = np.flatnonzero(blocked[n:] == blocked[:-n])
    return at, rolling(values, at, at + n)


def _longest_shared(item: np.ndarray, free_a: np.ndarray, text: np.ndarray, free_b: np.ndarray, least: int, most: int) -> int:
    """The greatest length up to `most` at which both have an equal window of unmarked words, 0 if below `least`.

    Whoever shares a window shares its shorter ones, so the length is found by halving.
    """
    found = 0
    while least <= most:
        size = (least + most + 1) // 2 if found else least
        if np.isin(_windows(item, free_a, size)[1], _windows(text, free_b, size)[1]).any():
            found, least = size, size + 1
        elif found:
            most = size - 1
        else:
            return 0
    return found


def tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two arrays of word hashes: (start in item, start in text, length), longest first."""
    out: list[tuple[int, int, int]] = []
    a, ah = _windows(item, np.ones(len(item), bool), least)
    b, bh = _windows(text, np.ones(len(text), bool), least)
    # only words inside a shared seed can take part
    free_a = covered(a[np.isin(ah, bh)], least, len(item))
    free_b = covered(b[np.isin(bh, ah)], least, len(text))
    size = _longest_shared(item, free_a, text, free_b, least, min(_runs(free_a), _runs(free_b)))
    while size >= least:
        a, ah = _windows(item, free_a, size)
        b, bh = _windows(text, free_b, size)
        hit_a, hit_b = np.isin(ah, bh), np.isin(bh, ah)
        places: dict[int, list[int]] = {}
        for p, h in zip(b[hit_b].tolist(), bh[hit_b].tolist()):
            places.setdefault(h, []).append(p)
        for stack in places.values():
            stack.reverse()
        for p, h in zip(a[hit_a].tolist(), ah[hit_a].tolist()):
            if not (free_a[p] and free_a[p + size - 1]) or not free_a[p : p + size].all():
                continue
            stack = places[h]
            while stack and not free_b[stack[-1] : stack[-1] + size].all():
                stack.pop()
            if stack:
                q = stack.pop()
                free_a[p : p + size] = False
                free_b[q : q + size] = False
                out.append((p, q, size))
        size = _longest_shared(item, free_a, text, free_b, least, min(size - 1, _runs(free_a), _runs(free_b)))
    return out


_TILES = "item_id long, id long, key long, n_words long, n_covered long, tiles array<struct<item_start:long,doc_start:long,n:long>>"


def _tiled(pairs: DataFrame, k: int) -> DataFrame:
    def work(batch: pa.RecordBatch) -> dict:
        one, two = _words(batch.column("item_text")), _words(batch.column("text"))
        spans, marked = [], []
        for i in range(len(batch)):
            item = one.hashes[one.bounds[i] : one.bounds[i + 1]]
            found = tiles(item, two.hashes[two.bounds[i] : two.bounds[i + 1]], max(1, min(k, len(item))))
            marked.append(sum(n for _, _, n in found))
            spans.append([{"item_start": p, "doc_start": q, "n": n} for p, q, n in found])
        kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("item_start", "doc_start", "n")]))
        return {
            "item_id": batch.column("item_id"), "id": batch.column("id"), "key": batch.column("key"), "n_words": batch.column("n_words"),
            "n_covered": np.array(marked, np.int64), "tiles": pa.array(spans, kind),
        }

    names = ["item_id", "id", "key", "n_words", "n_covered", "tiles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                out = work(piece)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (out[n] for n in names)], names)
        given_back()

    return pairs.mapInArrow(run, _TILES)


def contaminated(
    docs: DataFrame, items: DataFrame, k: int = 5, coverage: float = 0.5, doc_cols: tuple[str, str] = ("doc_id", "text"),
    item_cols: tuple[str, str] = ("item_id", "text"),
) -> DataFrame:
    """(doc_id, key, item_id, n_words, n_covered, coverage, tiles), one row per document row and item at or above the coverage.

    `key` tells rows of one doc_id apart: xxhash64 of id and text.
    """
    texts = stored(keyed(items, *item_cols), "items")
    known = stored(seeds(texts, k), "seeds")
    lengths = sorted(r[0] for r in known.select("length").distinct().collect())  # k values at most
    hit = seeded(docs, _bitmap(known), lengths or [k], *doc_cols).withColumn("key", F.xxhash64("id", "text"))
    hit = stored(hit, "seeded")
    hits = hit.select("key", F.explode("hits").alias("seed"))
    common = hits.groupBy("seed").agg(F.count("*").alias("n_docs"))
    ranked = known.join(common, "seed")
    reach = F.expr("sum(times * length) over (partition by item_key order by n_docs desc, seed rows between unbounded preceding and current row)")
    starting = ranked.select("*", reach.alias("reach")).filter(F.col("reach") >= F.lit(coverage) * F.col("n_words")).select("seed", "item_key")
    pairs = stored(hits.join(starting, "seed").select("key", "item_key").distinct(), "pairs")
    sizes = known.groupBy("item_key").agg(F.max("n_words").alias("n_words"))
    wanted = pairs.join(hit.select("key", "id", "text").dropDuplicates(["key"]), "key").join(texts.join(sizes, "item_key"), "item_key")
    found = _tiled(wanted.select("item_id", "item_text", "n_words", "id", "key", "text"), k)
    share = F.col("n_covered") / F.col("n_words")
    return found.select(F.col("id").alias("doc_id"), "key", "item_id", "n_words", "n_covered", share.alias("coverage"), "tiles").filter(
        F.col("coverage") >= coverage)


def decontaminated(docs: DataFrame, items: DataFrame, k: int = 5, coverage: float = 0.5) -> DataFrame:
    """The documents that no item is found in, row by row, with all their columns."""
    bad = stored(contaminated(docs, items, k, coverage).select(F.col("key").alias("__key"), F.col("doc_id").alias("__id")).distinct(), "contaminated")
    same = (F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string")) == bad["__key"]) & docs["doc_id"].cast("long").eqNullSafe(bad["__id"])
    return docs.join(bad, same, "left_anti")

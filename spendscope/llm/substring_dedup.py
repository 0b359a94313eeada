"""Substring dedup by prefix-partitioned suffix trees over words.

A suffix begins at every word that `least` words of a document follow from.
Suffixes are split by a prefix of variable length: those with the same first
word form a cell, and cells with too many suffixes for memory are split by the
first two words, then three, and so on. The counts cover all documents; every
task then knows from the list of heavy cells to which group a suffix belongs. A
group holds about GROUP / 2 suffixes, whatever the size of the corpus.

Texts are dealt into chunks of some megabytes that are stored once. A text that is
whole the same as one of a smaller doc_id goes as a whole, by its 128-bit digest, and
brings no suffixes: the other has them all. Equal suffixes of a chunk are told
apart no further than to `least` words and sent as one, with the smallest
doc_id, so a passage in a third of all documents is sent once a chunk. Content is
sent to the groups in two rounds, the second only for suffixes that can have an equal:

1. 32 hash bits of the first `least` words, sorted: suffixes whose bits no other
   chunk has are leaves that hang off shallow nodes. Their share of the traffic
   ends here.
2. The first `least` words of the others, a symbol of 16 hash bits each, and the bits
   of the first round. A group's subtree is built as the sorted order of its
   suffixes with the lengths of common prefixes of neighbours; its internal nodes of
   depth `least` and more are the repeats, and the smallest doc_id below a node is
   the one that keeps it. What a suffix costs does not hang on the number of groups.

Each round's answers, a bit per suffix, are written as one file a chunk below the
shared folder, so no text is shuffled. The chunk marks the words of all windows
that a smaller doc_id also has; neighbouring marked windows are one repeat,
however long.

Words are runs of anything but ASCII white space. Suffixes of one chunk are equal if 64
hash bits of their first `least` words are, those of different chunks if all symbols are: 16
bits a word and 32 more over all of them (240 bits for 13 words, 48 where one word differs). Defined cases: null and empty texts have no
words and lose none; texts of fewer than `least` words lose none; rows that
repeat a doc_id are judged each, and are not smaller than one another; a row
without doc_id keeps all its words and takes none from others; very long texts are
read whole, each then being a chunk of its own; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.llm.common import Words, covered, documents, mix, per_row, pieces, shared_folder, stored, utf8
from spendscope.llm.warc import file_system

#: Suffixes that a group may hold; a cell of more than a quarter of it is split by a longer prefix.
GROUP = 1 << 22
#: Most heavy cells of a length of prefix; groups grow with the corpus beyond that.
MOST_HEAVY = 1 << 20
CELL_BITS = 16
CHUNK_BYTES = 10 << 20
_WORDS_AT_ONCE = 2 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


# -- chunks -------------------------------------------------------------------


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, ids, texts): the documents dealt into chunks of about `size` bytes of text, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, bytes_held = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table.column(c).combine_chunks()) for c in ("id", "text")]
            return pa.RecordBatch.from_arrays([pa.array([f"{part:07d}-{number:05d}"]), *lists], ["chunk", "ids", "texts"])

        for batch in batches:
            for piece in pieces(batch, "text", _WORDS_AT_ONCE):
                new = piece.column("text").nbytes
                if held and bytes_held + new > size:
                    yield out()
                    number, held, bytes_held = number + 1, [], 0
                held.append(piece)
                bytes_held += new
        if held:
            yield out()

    return stored(documents(docs, id_col, text_col).mapInArrow(run, "chunk string, ids array<long>, texts array<string>"), "chunks", "zstd")


class Chunk:
    """Words and distinct suffixes of a chunk's documents; the same for the same rows, whenever it is made."""

    def __init__(self, ids: pa.Array, texts: pa.Array, least: int, copies: np.ndarray):
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        self.raw, offsets = utf8(texts)
        group = np.maximum(offsets[1:] - 1, 0) // _WORDS_AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        parts = [(a, offsets[a], Words(self.raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in zip(cuts, cuts[1:])]
        self.starts = np.concatenate([w.starts + at for _, at, w in parts])
        self.ends = np.concatenate([w.ends + at for _, at, w in parts])
        self.owner = np.concatenate([w.owner + a for a, _, w in parts])
        self.hashes = np.concatenate([w.hashes for _, _, w in parts])
        self.bounds = np.searchsorted(self.owner, np.arange(len(self.ids) + 1))
        whole = Words.__new__(Words)
        whole.owner, whole.hashes = self.owner, self.hashes
        at, hashes = whole.windows(least)
        keep = ~(self.null | copies)[self.owner[at]]
        self.at, hashes = at[keep], hashes[keep]
        order = np.argsort(hashes, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = hashes[order][1:] != hashes[order][:-1]
        first = np.flatnonzero(new)
        #: Of every window the number of its suffix; of every suffix its first window, smallest doc_id and hash.
        self.suffix = np.empty(len(order), np.int64)
        self.suffix[order] = np.cumsum(new) - 1
        self.head = self.at[order[first]]
        self.least_id = np.minimum.reduceat(self.ids[self.owner[self.at[order]]], first) if len(first) else np.zeros(0, np.int64)
        self.hash = hashes[order[first]]

    def prefix(self, suffixes: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the first n words of suffixes."""
        out = self.hashes[self.head[suffixes]].copy()
        for k in range(1, n):
            out = mix(out * _ODD + self.hashes[self.head[suffixes] + k])
        return out

    def kept_texts(self, keep: np.ndarray) -> pa.Array:
        """Kept words of each document joined by one space."""
        s, size, owner = self.starts[keep], (self.ends - self.starts)[keep], self.owner[keep]
        space = np.zeros(len(s), np.int64)
        space[1:] = owner[1:] == owner[:-1]
        ends = np.cumsum(size + space)
        out = np.full(ends[-1] if len(ends) else 0, 32, np.uint8)
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(ends - size, size) + inner] = self.raw[np.repeat(s, size) + inner]
        offsets = np.r_[0, ends][np.searchsorted(owner, np.arange(len(self.ids) + 1))]
        return pa.LargeStringArray.from_buffers(len(self.ids), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out))


def _rows(chunks: DataFrame, work: Callable[[str, pa.Array, pa.Array], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, ids, texts = batch.columns
            for i in range(len(batch)):
                yield from work(names[i].as_py(), ids[i].values, texts[i].values)

    return chunks.mapInArrow(run, schema)


def _each(chunks: DataFrame, least: int, folder: str, work: Callable[[str, Chunk], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Over the suffixes of every chunk; `folder` knows its copies, which are left out."""

    def one(name: str, ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        keep = pa.array(~_copies(folder, name, ids, texts))
        ids, texts = ids.filter(keep), texts.filter(keep)
        if len(ids):
            yield from work(name, Chunk(ids, texts, least, np.zeros(len(ids), bool)))

    return _rows(chunks, one, schema)


# -- whole copies -------------------------------------------------------------


def _digests(ids: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct texts of a chunk by digest: (digest, smallest doc_id), and which one each row has (-1 without doc_id)."""
    texts = texts.fill_null("").cast(pa.large_binary())
    digest = np.array([hashlib.blake2b(x.as_buffer(), digest_size=16).digest() for x in texts], "S16") if len(texts) else np.zeros(0, "S16")
    digest = digest.view([("a", "<u8"), ("b", "<u8")])
    known = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False))
    names, place = np.unique(digest[known], return_inverse=True)
    low = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(low, place, ids.fill_null(0).to_numpy(zero_copy_only=False)[known])
    own = np.full(len(ids), -1)
    own[known] = place
    return names, low, own


def _by_digest(names: np.ndarray, parts: int) -> dict[int, np.ndarray]:
    return dict(_by_group((names["b"] % np.uint64(parts)).astype(np.int64)))


def _whole_copies(chunks: DataFrame, folder: str, parts: int) -> None:
    """A bit per distinct text of a chunk: whether a smaller doc_id of another chunk has it."""

    def work(name: str, ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        names, low, _ = _digests(ids, texts)
        by = _by_digest(names, parts)
        yield _blobs(name, list(by), [names[own].tobytes() + low[own].tobytes() for own in by.values()])

    def answer(blobs: list[bytes]) -> list[np.ndarray]:
        sizes = [len(b) // 24 for b in blobs]
        names = np.concatenate([np.frombuffer(b, [("a", "<u8"), ("b", "<u8")], n) for b, n in zip(blobs, sizes)])
        low = np.concatenate([np.frombuffer(b, np.int64, n, 16 * n) for b, n in zip(blobs, sizes)])
        known, place = np.unique(names, return_inverse=True)
        lowest = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(lowest, place, low)
        return np.split(lowest[place] < low, np.cumsum(sizes)[:-1])

    _answered(_rows(chunks, work, _BLOBS), answer, folder)


def _copies(folder: str, name: str, ids: pa.Array, texts: pa.Array) -> np.ndarray:
    """Rows whose whole text a smaller doc_id has; the folder's name ends in the number of parts."""
    names, low, own = _digests(ids, texts)
    if not len(names):
        return np.zeros(len(ids), bool)
    elsewhere = _answers(folder, name, _by_digest(names, int(folder.rpartition("-")[2])), len(names))
    place = np.maximum(own, 0)
    return (own >= 0) & (elsewhere[place] | (ids.fill_null(0).to_numpy(zero_copy_only=False) > low[place]))


# -- prefixes -----------------------------------------------------------------


@dataclass
class Split:
    """Heavy cells by length of prefix, and the number of groups."""

    heavy: list[np.ndarray] = field(default_factory=list)
    groups: int = 1
    total: int = 0

    def open_cells(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes whose prefixes are all in heavy cells, and the cells of their next longer prefix."""
        rest = np.arange(len(chunk.head))
        for k, heavy in enumerate(self.heavy, 1):
            rest = rest[np.isin(_cell(chunk.prefix(rest, k)), heavy)]
        return rest, _cell(chunk.prefix(rest, len(self.heavy) + 1))

    def of(self, chunk: Chunk) -> np.ndarray:
        """The group of each suffix."""
        out, rest = np.zeros(len(chunk.head), np.int64), np.arange(len(chunk.head))
        for k in range(1, len(self.heavy) + 2):
            cells = _cell(chunk.prefix(rest, k))
            out[rest] = (mix(cells.astype(np.uint64) * _ODD + np.uint64(k)) % np.uint64(self.groups)).astype(np.int64)
            if k <= len(self.heavy):
                rest = rest[np.isin(cells, self.heavy[k - 1])]
        return out


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def split(chunks: DataFrame, least: int, copies: str, group: int = GROUP) -> Split:
    """Prefixes of variable length for groups of `group` suffixes at most."""
    out, spark = Split(), chunks.sparkSession
    while len(out.heavy) < least - 1:
        shared = spark.sparkContext.broadcast(out)

        def work(name: str, chunk: Chunk) -> Iterator[pa.RecordBatch]:
            cells, n = np.unique(shared.value.open_cells(chunk)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n)], ["cell", "n"])

        counted = stored(_each(chunks, least, copies, work, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), "cells")
        if not out.heavy:
            out.total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            group = max(group, 4 * out.total // MOST_HEAVY)
            out.groups = max(2 * out.total // group + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        heavy = counted.filter(F.col("n") > group // 4).select("cell").toArrow().column("cell").to_numpy()
        if not len(heavy):
            break
        out = Split([*out.heavy, np.sort(heavy)], out.groups, out.total)
    return out


# -- rounds -------------------------------------------------------------------


def _by_group(groups: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Suffixes of each group, in the order of their hashes."""
    order = np.argsort(groups, kind="stable")
    cuts = np.flatnonzero(np.diff(groups[order], prepend=-1)).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        yield int(groups[order[a]]), order[a:b]


def _planes(values: np.ndarray) -> bytes:
    """Rising numbers as differences, byte by byte, so that bytes alike lie together."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(len(values), steps.itemsize).T).tobytes()


def _values(data: bytes, kind: type = np.uint32) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(kind().itemsize, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


_PRESS = struct.Struct("<III")
#: Symbols of a suffix besides its words: the hash bits of the first round once more.
_TAG = 2


def _bytes_apart(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def _bytes_joined(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind().itemsize, -1).T).view(kind).ravel()


def _content(chunk: Chunk, symbols: np.ndarray, suffixes: np.ndarray, least: int) -> bytes:
    """Smallest doc_ids, hash bits and the symbols of the first words of suffixes."""
    slots = symbols[chunk.head[suffixes][None, :] + np.arange(least)[:, None]]
    press = zstandard.ZstdCompressor(level=1)
    low = press.compress(_bytes_apart(chunk.least_id[suffixes]))
    tags = _planes((chunk.hash[suffixes] >> np.uint64(32)).astype(np.uint32))
    return _PRESS.pack(len(suffixes), len(low), len(tags)) + low + tags + press.compress(_bytes_apart(slots.ravel()))


def _decoded(data: bytes, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest doc_ids, and symbols as (least + _TAG, suffixes)."""
    n, a, b = _PRESS.unpack_from(data)
    at, read = _PRESS.size, zstandard.ZstdDecompressor()
    low = _bytes_joined(read.decompress(data[at : at + a]), np.int64)
    tags = _values(data[at + a : at + a + b]).view(np.uint16).reshape(n, _TAG).T
    words = _bytes_joined(read.decompress(data[at + a + b :]), np.uint16).reshape(least, n)
    return low, np.concatenate([words, tags])


def subtree(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes as columns of ranked words, the first word in the first row -> (order, common): their sorted order, and how many words each shares with the one before."""
    depth, n = columns.shape
    bits = max(1, int(columns.max()).bit_length()) if n else 1
    keys, per_key = [], 64 // bits
    for i in range(0, depth, per_key):
        key = np.zeros(n, np.uint64)
        for row in columns[i : i + per_key]:
            key = key << np.uint64(bits) | row.astype(np.uint64)
        keys.append(key)
    order = np.lexsort(keys[::-1])
    common, equal = np.zeros(n, np.int64), np.ones(max(n - 1, 0), bool)
    for row in columns:
        equal &= row[order[1:]] == row[order[:-1]]
        common[1:] += equal
    return order, common


def deep_nodes(common: np.ndarray, least: int) -> np.ndarray:
    """First leaf of each run below one internal node of depth `least` or more (or of a leaf by itself)."""
    return np.flatnonzero(common < least) if len(common) else np.zeros(0, np.int64)


def _answered(rows: DataFrame, answer: Callable[[list[bytes]], list[np.ndarray]], folder: str) -> None:
    """Per group, answers to the chunks' data, one array of bits each; written as one file a chunk."""

    def group(table: pa.Table) -> pa.Table:
        bits = [np.packbits(x).tobytes() for x in answer(table.column("data").to_pylist())]
        return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "bits": pa.array(bits, pa.binary())})

    def keep(table: pa.Table) -> pa.Table:
        fs, root = file_system(folder)
        name, part = table.column("chunk")[0].as_py(), f"{root}/.part-{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as sink, pa.ipc.new_file(sink, table.schema) as out:
            out.write_table(table)
        fs.move(part, f"{root}/{name}")
        return pa.table({"n": pa.array([len(table)])})

    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    bits = rows.groupBy("part").applyInArrow(group, "chunk string, part long, bits binary")
    bits.groupBy("chunk").applyInArrow(keep, "n long").agg(F.sum("n")).collect()


def _answers(folder: str, chunk: str, sizes: dict[int, np.ndarray], n: int) -> np.ndarray:
    """The bits of a chunk's file, put at the suffixes that asked."""
    fs, root = file_system(folder)
    out = np.zeros(n, bool)
    if sizes:
        with fs.open_input_file(f"{root}/{chunk}") as f:
            table = pa.ipc.open_file(f).read_all()
        for part, bits in zip(table.column("part").to_pylist(), table.column("bits").to_pylist()):
            own = sizes[part]
            out[own] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).astype(bool)
    return out


def _shared_elsewhere(blobs: list[bytes]) -> list[np.ndarray]:
    """Which hash bits another chunk has as well."""
    values = [_values(b) for b in blobs]
    every = np.concatenate(values)
    order = np.argsort(every, kind="stable")
    same = every[order][1:] == every[order][:-1]
    again = np.zeros(len(every), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return np.split(again, np.cumsum([len(v) for v in values])[:-1])


def _smaller_elsewhere(least: int) -> Callable[[list[bytes]], list[np.ndarray]]:
    """Which suffixes lie below a deep node with a smaller doc_id than theirs."""

    def answer(blobs: list[bytes]) -> list[np.ndarray]:
        parts = [_decoded(b, least) for b in blobs]
        low = np.concatenate([x for x, _ in parts])
        order, common = subtree(np.concatenate([x for _, x in parts], axis=1))
        nodes = deep_nodes(common, least + _TAG)
        lowest = np.repeat(np.minimum.reduceat(low[order], nodes), np.diff(np.r_[nodes, len(order)]))
        out = np.zeros(len(low), bool)
        out[order] = lowest < low[order]
        return np.split(out, np.cumsum([len(x) for x, _ in parts])[:-1])

    return answer


def deduplicated(
    docs: DataFrame, least: int = 13, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """(doc_id, n_words, n_removed, text, removed), one row per document row.

    `text` has the kept words joined by one space; `removed` the removed runs as (start, n) in words.
    """
    spark = docs.sparkSession
    chunks = chunked(docs, id_col, text_col, chunk_bytes)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    copies, asked, told = f"{shared_folder(spark, 'whole-copies')}-{parts}", shared_folder(spark, "suffix-bits"), shared_folder(spark, "suffix-repeats")
    _whole_copies(chunks, copies, parts)
    shared = spark.sparkContext.broadcast(split(chunks, least, copies, group))

    def first(name: str, chunk: Chunk) -> Iterator[pa.RecordBatch]:
        by = dict(_by_group(shared.value.of(chunk)))
        yield _blobs(name, list(by), [_planes((chunk.hash[own] >> np.uint64(32)).astype(np.uint32)) for own in by.values()])

    def survivors(name: str, chunk: Chunk) -> dict[int, np.ndarray]:
        by = dict(_by_group(shared.value.of(chunk)))
        some = _answers(asked, name, by, len(chunk.head))
        return {part: own[some[own]] for part, own in by.items() if some[own].any()}

    def second(name: str, chunk: Chunk) -> Iterator[pa.RecordBatch]:
        by = survivors(name, chunk)
        symbols = (chunk.hashes >> np.uint64(16)).astype(np.uint16)
        yield _blobs(name, list(by), [_content(chunk, symbols, own, least) for own in by.values()])

    def last(name: str, ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        whole = _copies(copies, name, ids, texts)
        chunk = Chunk(ids, texts, least, whole)
        gone = _answers(told, name, survivors(name, chunk), len(chunk.head))
        over = gone[chunk.suffix] | (chunk.ids[chunk.owner[chunk.at]] > chunk.least_id[chunk.suffix])
        n_words = np.diff(chunk.bounds)
        removed = covered(chunk.at[over], least, len(chunk.hashes)) | (whole & (n_words >= least))[chunk.owner]
        edge = np.ones(len(removed), bool)
        edge[1:] = (removed[1:] != removed[:-1]) | (chunk.owner[1:] != chunk.owner[:-1])
        run = np.flatnonzero(edge)
        size = np.diff(np.r_[run, len(removed)])
        run, size = run[removed[run]], size[removed[run]]
        spans = pa.StructArray.from_arrays([pa.array(run - chunk.bounds[chunk.owner[run]]), pa.array(size)], ["start", "n"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(chunk.owner[run], np.arange(len(chunk.ids) + 1)).astype(np.int32)), spans)
        yield pa.RecordBatch.from_arrays(
            [pa.array(chunk.ids, mask=chunk.null), pa.array(n_words), pa.array(per_row(removed.astype(np.int64), chunk.bounds)), chunk.kept_texts(~removed).cast(pa.string()), lists],
            ["doc_id", "n_words", "n_removed", "text", "removed"])

    _answered(_each(chunks, least, copies, first, _BLOBS), _shared_elsewhere, asked)
    _answered(_each(chunks, least, copies, second, _BLOBS), _smaller_elsewhere(least), told)
    return _rows(chunks, last, "doc_id long, n_words long, n_removed long, text string, removed array<struct<start:long,n:long>>")


_BLOBS = "part long, chunk string, data binary"


def _blobs(chunk: str, parts: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(parts, pa.int64()), pa.array([chunk] * len(parts), pa.string()), pa.array(data, pa.binary())], ["part", "chunk", "data"])

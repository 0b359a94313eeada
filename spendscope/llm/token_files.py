"""Token ids as binary files with a shared zstandard dictionary.

One range shuffle orders the documents by id. Each task then tokenizes its
range, compresses every document's ids for itself and writes shards of about
SHARD_BYTES; the driver only learns each shard's counts. Files are written under a
name of their own and renamed when whole, so a repeated task leaves nothing behind.

Shard: magic, version, id width, dictionary hash, counts; the compressed documents;
the index (doc_id, offset of the bytes, number of ids); a footer that finds
the index. One document is read by its index entry alone. Beside the shards
lies `dictionary.zstd`, made of serialized id arrays of a bounded sample of
documents (SAMPLE_DOCS texts, of each SAMPLE_SLICES slices of SAMPLE_CHARS characters
spread over it); its hash must match. It is trained; where a sample is too small or too
uniform for the trainer, its ids are the dictionary as they are.

White space never matters to the tokenizer's word pattern, nor case, and a comma
or full stop after a letter is a word of its own, so texts are cut there and every
distinct word goes through the tokenizers library once per worker (a memory of
CACHE_WORDS words; beyond it, it starts anew). Words are told apart by 64-bit hashes, and
ids of a text are gathered from the memory as one array. Tokenizers without a mark for
the end of words, and texts with signs of special tokens, are only cut at white space.

Defined cases: null and empty texts hold the end id only; rows that repeat a
doc_id follow each other, ordered by text hash; a row without doc_id comes
first; very long texts are one document like others; an empty table gives no
shard; other columns are not read.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.llm.common import BYTE_LOWER, Words, documents, given_back, pieces, rolling, sampled, shared_folder, small_batches, utf8

#: Documents that the dictionary is made of at most, and what is read of each.
SAMPLE_DOCS, SAMPLE_SLICES, SAMPLE_CHARS = 2_000, 4, 5_000
DICTIONARY_BYTES = 64 << 10
SHARD_BYTES = 128 << 20
CACHE_WORDS = 600_000
MAGIC = b"IDSHARD1"
_HEAD = struct.Struct("<8sHH32sQQ")  # magic, version, bytes per id, dictionary hash, documents, ids
_FOOT = struct.Struct("<QQ8s")  # index offset, index bytes, magic
_INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "<i8"), ("offset", "<u8"), ("n_ids", "<u8")])
_SIGN = np.zeros(256, bool)
_SIGN[[ord(","), ord(".")]] = True
_AFTER = np.zeros(256, bool)
_AFTER[[10, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[65:91] = True
_TOKENIZERS: dict[str, object] = {}


def _cut(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words at white space, a sign between a letter and a blank being one of its own: (starts, ends, hashes, bounds of texts)."""
    words = Words(raw, offsets, lower=True)
    starts, ends = words.starts, words.ends
    last = ends - 1
    # the blank after must be of the same text
    inside = ends < offsets[1:][words.owner] if len(ends) else np.zeros(0, bool)
    sign = np.flatnonzero((ends - starts > 1) & inside & _SIGN[raw[last]] & _LETTER[raw[np.maximum(last - 1, 0)]] & _AFTER[raw[np.minimum(ends, max(len(raw) - 1, 0))]])
    if not len(sign):
        return starts, ends, words.hashes, words.bounds
    cut_starts = np.insert(starts, sign + 1, ends[sign] - 1)
    shorter = ends.copy()
    shorter[sign] -= 1
    cut_ends = np.insert(shorter, sign + 1, ends[sign])
    hashes = np.insert(words.hashes, sign + 1, 0)
    # the words before a sign, and the signs, get hashes of their own
    at = sign + np.arange(len(sign))
    table = BYTE_LOWER
    hashes[at] = rolling(raw, cut_starts[at], cut_ends[at], table)
    hashes[at + 1] = rolling(raw, cut_starts[at + 1], cut_ends[at + 1], table)
    return cut_starts, cut_ends, hashes, np.searchsorted(cut_starts, offsets)


class Encoder:
    """ids of texts, word by word through the library."""

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library, self.end = Tokenizer.from_file(path), end_id
        suffix = json.loads(self.library.to_str())["model"].get("end_of_word_suffix")
        #: Ids that end a word, if the vocabulary marks them.
        self.ends = np.zeros(self.library.get_vocab_size(with_added_tokens=True), bool)
        self.ends[[i for w, i in self.library.get_vocab().items() if suffix and w.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        """Place 0 of the memory is the end id."""
        self.place: dict[bytes, int] = {}
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pool, self.begin, self.count = np.array([self.end], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64)

    def ids_of(self, words: list[bytes]) -> list[np.ndarray]:
        """Plain words, which the library cannot split, go many to a text; others each for itself."""
        texts, out = [w.decode() for w in words], [None] * len(words)
        plain = [self.ends.any() and t.isalpha() and t == t.lower() for t in texts]
        together, alone = [i for i, p in enumerate(plain) if p], [i for i, p in enumerate(plain) if not p]
        groups = [together[i : i + 512] for i in range(0, len(together), 512)]
        for group, one in zip(groups, self.library.encode_batch_fast([" ".join(texts[i] for i in g) for g in groups], add_special_tokens=False)):
            ids = np.array(one.ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(group) or not len(ids) or cuts[-1] != len(ids):
                alone += group
                continue
            for i, part in zip(group, np.split(ids, cuts[:-1])):
                out[i] = part
        for i, one in zip(alone, self.library.encode_batch_fast([texts[i] for i in alone], add_special_tokens=False)):
            out[i] = np.array(one.ids, np.uint32)
        return out

    def learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """New words by their rising hashes."""
        found = self.ids_of(words)
        count = np.array([len(x) for x in found], np.int64)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slots = np.insert(self.keys, at, keys), np.insert(self.slots, at, len(self.count) + np.arange(len(words)))
        self.begin = np.r_[self.begin, len(self.pool) + np.cumsum(count) - count]
        self.count = np.r_[self.count, count]
        self.pool = np.concatenate([self.pool, *found])

    def arrays(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, the end id after each, and where each text's ids begin and end."""
        if not self.ends.any():
            return self._whole([raw[a:b].tobytes().split() for a, b in zip(offsets.tolist(), offsets[1:].tolist())])
        starts, ends, hashes, bounds = _cut(raw, offsets)
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        places = np.full(len(keys), -1)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            places = np.where(self.keys[at] == keys, self.slots[at], -1)
        new = np.flatnonzero(places < 0)
        if len(new) and len(self.keys) + len(new) > CACHE_WORDS:
            self.forget()
            places, new = np.full(len(keys), -1), np.arange(len(keys))
        if len(new):
            data = raw.tobytes().lower()
            known = len(self.count)
            self.learn(keys[new], [data[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            places[new] = known + np.arange(len(new))
        order = np.insert(places[inverse], bounds[1:], 0)
        return self._gathered(order, bounds + np.arange(len(bounds)))

    def _whole(self, split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Words as they are, by their bytes."""
        new = list(set().union(*split).difference(self.place))
        if new and len(self.place) + len(new) > CACHE_WORDS:
            self.forget()
            new = list(set().union(*split))
        if new:
            found = self.ids_of(new)
            count = np.array([len(x) for x in found], np.int64)
            self.place.update(zip(new, range(len(self.count), len(self.count) + len(new))))
            self.begin = np.r_[self.begin, len(self.pool) + np.cumsum(count) - count]
            self.count, self.pool = np.r_[self.count, count], np.concatenate([self.pool, *found])
        order = [p for words in split for p in (*map(self.place.__getitem__, words), 0)]
        return self._gathered(np.array(order, np.int64), np.cumsum([0, *(len(w) + 1 for w in split)]))

    def _gathered(self, places: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = self.count[places]
        upto = np.r_[0, np.cumsum(count)]
        at = np.repeat(self.begin[places] - upto[:-1], count) + np.arange(upto[-1])
        return self.pool[at], upto[bounds]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text with the end id. Texts with signs of special tokens go apart."""
        special = [i for i, t in enumerate(texts) if b"<|" in t]
        out: list[np.ndarray | None] = [None] * len(texts)
        if special and self.ends.any():
            for i in special:
                words = self.ids_of(texts[i].split())
                out[i] = np.concatenate([*words, np.array([self.end], np.uint32)])
        plain = [i for i, x in enumerate(out) if x is None]
        raw = np.frombuffer(b"".join(texts[i] for i in plain), np.uint8)
        ids, bounds = self.arrays(raw, np.cumsum([0, *(len(texts[i]) for i in plain)]))
        for i, part in zip(plain, np.split(ids, bounds[1:-1])):
            out[i] = part
        return out


def encoder(path: str, end_id: int) -> Encoder:
    if (path, end_id) not in _TOKENIZERS:
        _TOKENIZERS[path, end_id] = Encoder(path, end_id)
    return _TOKENIZERS[path, end_id]


def width_of(path: str, end_id: int) -> int:
    """Bytes per stored id: two if all ids fit."""
    most = max(encoder(path, end_id).library.get_vocab_size(with_added_tokens=True) - 1, end_id)
    return 2 if most < 1 << 16 else 4


def narrow(ids: np.ndarray, width: int) -> bytes:
    return ids.astype("<u2" if width == 2 else "<u4").tobytes()


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """A dictionary from SAMPLE_DOCS documents at most (those first by hash)."""
    rows = sampled(documents(docs, id_col, text_col), SAMPLE_DOCS, "id", "text").select(F.coalesce("text", F.lit("")).alias("t"))
    length, whole = F.length("t"), SAMPLE_SLICES * SAMPLE_CHARS
    # slices at even distances; a text that they would cover is taken whole
    slices = [F.substr("t", F.floor((length - SAMPLE_CHARS) * F.lit(k) / (SAMPLE_SLICES - 1)).cast("int") + 1, F.lit(SAMPLE_CHARS)) for k in range(SAMPLE_SLICES)]
    told = rows.select(F.when(length <= whole, F.array("t")).otherwise(F.array(*slices)).alias("slices")).toArrow().column("slices").to_pylist()
    width = width_of(tokenizer, end_id)
    texts, work, ids = [t.encode() for x in told for t in x], encoder(tokenizer, end_id), []
    for i in range(0, len(texts), 200):
        ids += [narrow(x, width) for x in work.encode(texts[i : i + 200])]
    return dictionary_of(ids)


def dictionary_of(samples: list[bytes]) -> bytes:
    """Trained for an eighth of the samples' bytes and DICTIONARY_BYTES at most; else the samples' last bytes as they are; empty without any."""
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    if size >= 256:
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:  # too few samples, or too alike
            pass
    raw = b"".join(samples)[-DICTIONARY_BYTES:]
    return raw and raw.rjust(8, raw[:1])  # the library wants eight bytes at least


def _file_system(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def _hash(data: bytes) -> bytes:
    import hashlib

    return hashlib.sha256(data).digest()


class ShardWriter:
    """One shard, streamed to a file of its own name until it is whole."""

    def __init__(self, folder: str, name: str, dictionary: bytes, width: int):
        self.fs, self.root = _file_system(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.name, self.part = name, f"{self.root}/.part-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.part)
        held = _dictionary(dictionary)
        self.press = zstandard.ZstdCompressor(level=3, dict_data=held) if held else zstandard.ZstdCompressor(level=3)
        self.head, self.width = _HEAD.pack(MAGIC, 1, width, _hash(dictionary), 0, 0), width
        self.out.write(self.head)
        self.index: list[np.ndarray] = []
        self.at, self.n_docs, self.n_ids = len(self.head), 0, 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> None:
        """Documents with their ids, one after the other; text i has ids[bounds[i]:bounds[i + 1]]."""
        data, cuts, press = memoryview(narrow(ids, self.width)), (bounds * self.width).tolist(), self.press.compress
        frames = [press(data[a:b]) for a, b in zip(cuts, cuts[1:])]
        index = np.zeros(len(frames), _INDEX)
        index["doc_id"] = doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
        index["has_id"] = doc_ids.is_valid().to_numpy(zero_copy_only=False)
        sizes = np.array([len(x) for x in frames], np.int64)
        index["offset"], index["n_ids"] = self.at + np.cumsum(sizes) - sizes, np.diff(bounds)
        self.index.append(index)
        self.out.write(b"".join(frames))
        self.at, self.n_docs, self.n_ids = self.at + int(sizes.sum()), self.n_docs + len(frames), self.n_ids + int(bounds[-1] - bounds[0])

    def close(self) -> tuple[str, int, int]:
        begin = self.at
        for part in self.index:
            self.out.write(part.tobytes())
            self.at += part.nbytes
        self.out.write(_FOOT.pack(begin, self.at - begin, MAGIC))
        self.out.close()
        self.fs.move(self.part, f"{self.root}/{self.name}")
        return self.name, self.n_docs, self.n_ids


class ShardReader:
    """Documents of one shard, all in order or one by its number."""

    def __init__(self, folder: str, name: str):
        self.fs, root = _file_system(folder)
        with self.fs.open_input_stream(f"{root}/dictionary.zstd") as f:
            dictionary = f.read()
        self.file = self.fs.open_input_file(f"{root}/{name}")
        magic, _, self.width, digest, _, _ = _HEAD.unpack(self.file.read_at(_HEAD.size, 0))
        at, size, last = _FOOT.unpack(self.file.read_at(_FOOT.size, self.file.size() - _FOOT.size))
        if magic != MAGIC or last != MAGIC:
            raise ValueError(f"{name} is not a whole shard")
        if digest != _hash(dictionary):
            raise ValueError(f"{name} was written with another dictionary")
        self.index = np.frombuffer(self.file.read_at(size, at), _INDEX)
        self.ends = np.r_[self.index["offset"][1:], at].astype(np.int64) if len(self.index) else np.zeros(0, np.int64)
        held = _dictionary(dictionary)
        self.open = zstandard.ZstdDecompressor(dict_data=held) if held else zstandard.ZstdDecompressor()

    def document(self, number: int) -> np.ndarray:
        begin = int(self.index["offset"][number])
        data = self.open.decompress(self.file.read_at(int(self.ends[number]) - begin, begin))
        return np.frombuffer(data, "<u2" if self.width == 2 else "<u4").astype("<u4")


def write(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Write shards of about `shard_bytes` below `folder` in ascending doc_id order; returns (number, name, n_docs, start, n_tokens) per shard."""
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer, end_id, id_col, text_col)
    fs, root = _file_system(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dictionary.zstd") as f:
        f.write(dictionary)
    width = width_of(tokenizer, end_id)
    rows = documents(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, work, part, done = None, encoder(tokenizer, end_id), TaskContext.get().partitionId(), 0

        def told() -> pa.RecordBatch:
            name, n_docs, n_tokens = shard.close()
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([name]), pa.array([n_docs]), pa.array([n_tokens])], ["number", "name", "n_docs", "n_tokens"])

        for batch in batches:
            for piece in pieces(batch):
                if not len(piece):
                    continue
                shard = shard or ShardWriter(folder, f"shard-{part:06d}-{done:05d}.ids", dictionary, width)
                raw, offsets = utf8(piece.column("text"))
                if b"<|" in raw.tobytes() and work.ends.any():
                    ids = work.encode(piece.column("text").fill_null("").cast(pa.large_binary()).to_pylist())
                    shard.add(piece.column("id"), np.concatenate(ids), np.cumsum([0, *map(len, ids)]))
                else:
                    shard.add(piece.column("id"), *work.arrays(raw, offsets))
                if shard.at >= shard_bytes:
                    yield told()
                    shard, done = None, done + 1
        if shard:
            yield told()
        given_back()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, F.col("id").asc_nulls_first(), "h").sortWithinPartitions(F.col("id").asc_nulls_first(), "h").select("id", "text")
    with small_batches(spark):
        shards = sorted(placed.mapInArrow(run, "number long, name string, n_docs long, n_tokens long").collect(), key=lambda r: r.name)
    start, table = 0, []
    for r in shards:
        table.append((r.number, r.name, r.n_docs, start, r.n_tokens))
        start += r.n_tokens
    return spark.createDataFrame(table, "number long, name string, n_docs long, start long, n_tokens long")


def read(shards: DataFrame, folder: str, arrays: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), and `ids` if asked for, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist()):
                shard = ShardReader(folder, name)
                counts = shard.index["n_ids"].astype(np.int64)
                starts = start + np.cumsum(counts) - counts
                for i in range(0, len(counts), 2000):
                    part = slice(i, min(i + 2000, len(counts)))
                    ids = [shard.document(k) for k in range(part.start, part.stop)]
                    if any(len(x) != n for x, n in zip(ids, counts[part])):
                        raise ValueError(f"{name}: a document's ids are not those of its index")
                    own = pa.array(shard.index["doc_id"][part], mask=shard.index["has_id"][part] == 0)
                    out = [own, pa.array(starts[part]), pa.array(counts[part]), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if arrays:
                        out.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(out, names)
        given_back()

    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * arrays
    n = max(1, shards.count())
    return shards.select("name", "start", "number").repartition(n).mapInArrow(run, kinds)


def encoded(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written to the shared folder and read back."""
    folder = shared_folder(docs.sparkSession, "token-ids")
    return read(write(docs, folder, tokenizer, end_id, id_col, text_col), folder)

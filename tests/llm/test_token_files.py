import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from spendscope.llm import token_files as t
from spendscope.llm.common import shared_folder
from spendscope.llm.queries import END_ID, tokenizer_path

ODD = ["It's the DOG's, x.y. A.. b", "<|ENDOFTEXT|> <|endoftext|>, b,", "éx İb 12, a,, b., (c). don't, we're.", "ΣΑΣ, ﬁx   y z", "", " ", "a" * 5000, "1,2,3."]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def test_words_give_the_ids_of_whole_texts(library):
    work = t.Encoder(tokenizer_path(), END_ID)
    for text, data in zip(ODD, work.encode([x.encode() for x in ODD])):
        assert data.tolist() == [*library.encode(text, add_special_tokens=False).ids, END_ID]


def test_random_texts_give_the_ids_of_the_library(library):
    rng = np.random.default_rng(4)
    signs = list("abcXYZéß ,.  \n\t'\"-!?09<|>İς") + [" the", "ing ", "\u2028", "\U0001f600", " a.", "b, "]
    texts = ["".join(rng.choice(signs, int(rng.integers(0, 60)))) for _ in range(3000)]
    work = t.Encoder(tokenizer_path(), END_ID)
    for text, ids in zip(texts, work.encode([x.encode() for x in texts])):
        assert ids.tolist() == [*library.encode(text, add_special_tokens=False).ids, END_ID], text


def test_full_cache_starts_anew(monkeypatch, library):
    monkeypatch.setattr(t, "CACHE_WORDS", 3)
    work = t.Encoder(tokenizer_path(), END_ID)
    for text in ("one two three four five", "six one", "two six seven eight"):
        assert work.encode([text.encode()])[0].tolist() == [*library.encode(text, add_special_tokens=False).ids, END_ID]


def test_files_hold_every_document(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(t.encoded(docs, tokenizer_path(), END_ID).collect())
    at = 0
    for row, doc in zip(got, sorted(docs.collect(), key=lambda r: r.doc_id), strict=True):
        ids = np.array([*library.encode(doc.text or "", add_special_tokens=False).ids, END_ID], "<u4")
        assert tuple(row) == (doc.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_single_documents_and_dictionary_hash(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    folder = shared_folder(spark, "ids")
    shards = t.write(docs, folder, tokenizer_path(), END_ID).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    fs, root = t._file_system(folder)
    with fs.open_input_stream(f"{root}/dictionary.zstd") as f:
        assert f.read()
    reader = t.ShardReader(folder, shards[-1].name)
    for n in (3, 0, len(reader.index) - 1):
        text = texts[int(reader.index["doc_id"][n])]
        assert reader.document(n).tolist() == [*library.encode(text, add_special_tokens=False).ids, END_ID]
    with fs.open_output_stream(f"{root}/dictionary.zstd") as f:
        f.write(b"")
    with pytest.raises(ValueError, match="another dictionary"):
        t.ShardReader(folder, shards[0].name)


@pytest.mark.parametrize("n", [1, 10, 5000])
def test_every_corpus_has_a_dictionary(spark, n):
    docs = spark.range(n).selectExpr("id as doc_id", "concat('text number ', id, ' of many others') as text")
    folder = shared_folder(spark, "ids")
    shards = t.write(docs, folder, tokenizer_path(), END_ID)
    fs, root = t._file_system(folder)
    with fs.open_input_stream(f"{root}/dictionary.zstd") as f:
        assert len(f.read()) >= 8
    rows = t.read(shards, folder).collect()
    assert len(rows) == n and {r.doc_id for r in rows} == set(range(n))


def test_dictionaries_of_odd_samples():
    assert t.dictionary_of([]) == b"" and t.dictionary_of([b""]) == b""
    for samples in ([b"ab"], [b"x" * 9000], [bytes(range(256))] * 3):
        assert len(t.dictionary_of(samples)) >= 8


def test_long_texts_give_slices_from_all_over(spark, make, monkeypatch):
    monkeypatch.setattr(t, "SAMPLE_CHARS", 40)
    text = " ".join(f"w{i:04d}" for i in range(2000))
    seen = []
    monkeypatch.setattr(t, "dictionary_of", lambda samples: seen.extend(samples) or b"")
    t.train_dictionary(make([(1, text, "", "", 0), (2, "short", "", "", 0)]), tokenizer_path(), END_ID)
    assert len(seen) == t.SAMPLE_SLICES + 1


def test_small_shards_hold_the_same_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = []
    for size in (1 << 14, 1 << 40):
        folder = shared_folder(spark, "ids")
        shards = t.write(docs, folder, tokenizer_path(), END_ID, shard_bytes=size)
        found.append((sorted(map(tuple, t.read(shards, folder).collect())), shards.count()))
    assert found[0][0] == found[1][0] and found[0][1] > 2 * found[1][1]


def test_messy_rows(spark, messy, empty):
    got = t.encoded(messy, tokenizer_path(), END_ID).collect()
    assert len(got) == 12 and sorted(r.n_tokens for r in got)[:4] == [1, 1, 1, 1]
    order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in order] == [None, None, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9]
    assert [r.start for r in order] == np.r_[0, np.cumsum([r.n_tokens for r in order])][:-1].tolist()
    assert t.encoded(empty, tokenizer_path(), END_ID).count() == 0


def test_batches_of_texts_are_small_and_the_bound_comes_back(spark, monkeypatch):
    """Whole texts reach Python by BATCH_ROWS at most; the session's own number holds again afterwards, also after an error."""
    from spendscope.llm import common

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with common.small_batches(spark):
        rows = spark.range(0, 5000, 1, 1).mapInArrow(lambda batches: batches, "id long")
        sizes = spark.range(0, 5000, 1, 1).mapInArrow(lambda batches: (b.slice(0, 1).set_column(0, "id", __import__("pyarrow").array([len(b)])) for b in batches), "id long").collect()
        assert rows.count() == 5000 and max(r.id for r in sizes) <= common.BATCH_ROWS
    assert spark.conf.get(key) == before
    with pytest.raises(ValueError), common.small_batches(spark):
        raise ValueError
    assert spark.conf.get(key) == before

import zlib

import duckdb
import numpy as np
import pytest
from test_decontamination import tiling_by_hand, words
from test_simhash import by_hand, groups
from tokenizers import Tokenizer

import corpus_pipeline
from harness import check
from spendscope.llm import langid
from spendscope.llm.queries import QUERIES, SQL, tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "token_ids"]


def test_pipeline_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    said = {r.doc_id: r for r in langid.identified(docs, model).collect()}
    left = [r for r in docs.collect() if said[r.doc_id].lang_pred != "und" and said[r.doc_id].score >= 0.5]
    fp = {r.doc_id: by_hand(r.text) for r in left}
    root = groups(fp.values(), 3)
    first = {}
    for i in sorted(fp):
        first.setdefault(root[fp[i]], i)
    left = [r for r in left if first[root[fp[r.doc_id]]] == r.doc_id]
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def clean(text):
        text = words(text)
        seen = {tuple(text[i : i + 5]) for i in range(len(text) - 4)}
        for item in items:
            hit = sum(tuple(item[i : i + 5]) in seen for i in range(len(item) - 4))
            if hit and 2 * 5 * hit >= len(item):
                at = [i for i in range(len(text) - 4) if tuple(text[i : i + 5]) in {tuple(item[k : k + 5]) for k in range(len(item) - 4)}]
                if 2 * sum(x[0] for x in tiling_by_hand(item, text[at[0] : at[-1] + 5], 5)) >= len(item):
                    return False
        return True

    left = {r.doc_id: r for r in left if clean(r.text)}
    got = corpus_pipeline.run(spark, SF).collect()
    library = Tokenizer.from_file(tokenizer_path())
    copies, size, at = {}, {}, 0
    for r in sorted(got, key=lambda r: r.start):
        ids = np.array([*library.encode(left[r.doc_id].text, add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert set(copies) <= set(left) and max(copies.values()) <= 3
    for r in left.values():
        size[r.source] = size.get(r.source, 0) + len(r.text.split())
    assert abs(sum(copies[i] * len(left[i].text.split()) for i in copies) - sum(size.values())) <= 0.05 * sum(size.values())


def test_messy_documents_through_all_stages(spark, messy, empty):
    for docs in (messy, empty):
        rows = docs
        for name, stage in corpus_pipeline.STAGES:
            rows = corpus_pipeline.stored(stage(spark, rows, SF), name)
            if name != "token_ids":
                assert rows.columns == docs.columns
        assert rows.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert rows.count() == 0


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    result = db.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert check.rows_of(df.columns, [tuple(r) for r in df.collect()]) == check.rows_of(columns, result.fetchall())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_query_returns_a_row_per_document_or_page(spark, name):
    n = spark.read.parquet(f"{SF}/{'pages' if name in ('op1_url_filter', 'op4_html_extraction') else 'documents'}.parquet").count()
    assert QUERIES[name](spark, SF).count() == n or name == "op9_decontamination"

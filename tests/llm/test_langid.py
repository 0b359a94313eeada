import zlib

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from spendscope.llm import langid


def test_counts_equal_by_hand():
    texts = pa.array(["abc ABC", None, "", "éè", "a"])
    counts = langid.counted(*langid._code_points(texts))
    assert counts.sum(1).tolist() == [7 + 6 + 5, 0, 0, 2 + 1, 1]
    alone = [langid.counted(*langid._code_points(texts.slice(i, 1)))[0] for i in range(5)]
    assert (np.array(alone) == counts).all()


def test_sparse_scores_equal_the_product():
    r = np.random.default_rng(1)
    model = langid.Model(["a", "b"], r.normal(size=(langid.BUCKETS, 2)), np.array([0.1, -0.2]))
    counts = (r.random((5, langid.BUCKETS)) < 0.001) * r.integers(1, 5, (5, langid.BUCKETS))
    assert np.allclose(model.scores(counts), counts @ model.log_p + model.prior)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.held_out(F.col("doc_id"))
    model = langid.train(docs.filter(~out))
    assert model.labels == ["de", "en", "es", "fr"]
    got = {r.doc_id: r.lang_pred for r in langid.identified(docs, model).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 100 and sum(got[r.doc_id] == r.lang for r in held) >= 0.98 * len(held)


def test_training_sums_all_rows(spark, make):
    rows = [(i, "abc", "x", "", 0) for i in range(20)] + [(99, "zzz", "y", "", 0)]
    one, two = langid.train(make(rows)), langid.train(make(rows).repartition(5))
    assert one.labels == two.labels and np.allclose(one.log_p, two.log_p) and np.allclose(np.exp(one.prior), [20 / 21, 1 / 21])


def test_messy_rows(messy, empty):
    model = langid.train(messy)
    got = langid.identified(messy, model).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (3, 4, 5, 8)} == {("und", 0.0)}
    left = langid.accepted(messy, model)
    assert left.columns == messy.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 2, 6, 7, 9]
    none = langid.train(empty)
    assert none.labels == [] and {r.lang_pred for r in langid.identified(messy, none).collect()} == {"und"}
    assert langid.identified(empty, model).count() == 0

import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spendscope.llm import toxicity as t
from spendscope.llm.langid import held_out


def kernel_by_hand(a, b):
    """Sum over common subsequences of weight^span, in letter classes between marks."""
    def bag(unit):
        s = [t._BEGIN, *(int(c) for c in t._CLASS[np.frombuffer(unit, np.uint8)] if c), t._END]
        out = {}
        for ix in combinations(range(len(s)), t.LETTERS):
            if ix[-1] - ix[0] < t.SPAN:
                key = tuple(s[i] for i in ix)
                out[key] = out.get(key, 0) + t.DECAY ** (ix[-1] - ix[0] + 1)
        return out

    x, y = bag(a), bag(b)
    return sum(v * y[k] for k, v in x.items() if k in y)


def test_kernel_equals_by_hand():
    units = [b"idiot", b"id*iot", b"stupidity", "é".encode() + b"tat", b"a", b"123", b"xx"]
    unit, code, value, sizes = t.profiles(units)
    dense = np.zeros((len(units), t._CODES))
    dense[unit, code] = value
    norm = t.lengths_norm(sizes)
    for i, a in enumerate(units):
        for j, b in enumerate(units):
            if sizes[i] and sizes[j]:
                assert dense[i] @ dense[j] * norm[i] * norm[j] == pytest.approx(kernel_by_hand(a, b))


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id"), "doc_id")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = t.train(docs.filter(~held_out(F.col("doc_id"), 3, 1)), labels)
    return model, docs, labels


def sample_of(trained):
    _, docs, labels = trained
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [(r.doc_id, r.text, truth[r.doc_id]) for r in docs.collect() if r.text]
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    known = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    return {y: [t for _, t, l in known if l == y] for y in (0, 1)}, {y: [t for _, t, l in held if l == y] for y in (0, 1)}


def rates(model, held):
    """Shares of held-out toxic and harmless texts that are marked."""
    out = []
    for y in (1, 0):
        units = t.Units(pa.array(held[y]))
        _, first, inverse = np.unique(units.keys, return_index=True, return_inverse=True)
        score = model.probability(t.best(units.owner, t._margins(model, units, first)[inverse], len(held[y])))
        out.append(float((score >= 0.7).mean()))
    return out


def test_held_out_accuracy(trained):
    model, docs, labels = trained
    truth = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    got = {r.doc_id: r.predicted for r in t.scored(docs.filter(held_out(F.col("doc_id"), 3, 1)), model).collect()}
    bad = [i for i in truth if truth[i]]
    good = [i for i in truth if not truth[i]]
    assert sum(got[i] for i in bad) >= 0.83 * len(bad)
    assert sum(got[i] for i in good) <= 0.03 * len(good)


def test_copies_teach_nothing_more(trained):
    known, held = sample_of(trained)
    rng = np.random.default_rng(3)
    plain = t.fit(known[1] + known[0], [1] * len(known[1]) + [0] * len(known[0]))
    for bad, good in ((known[1] * 3, known[0]), (known[1] * 10, known[0] * 2)):
        model = t.fit(bad + good, [1] * len(bad) + [0] * len(good))
        assert (model.table == plain.table).all() and (model.slope, model.offset) == (plain.slope, plain.offset)
    bad, good = (list(rng.choice(known[y], 3000)) for y in (1, 0))
    caught, flagged = rates(t.fit(bad + good, [1] * 3000 + [0] * 3000), held)
    assert caught >= 0.83 and flagged <= 0.04, (caught, flagged)


def test_few_harmless_texts_flag_none(trained):
    known, held = sample_of(trained)
    model = t.fit(known[1] + known[0][: len(known[1])], [1] * len(known[1]) + [0] * len(known[1]))
    caught, flagged = rates(model, held)
    assert caught >= 0.6 and flagged <= 0.03, (caught, flagged)


def test_near_copies_vote_together():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join(rng.choice(words, 80)) for _ in range(30)]
    near = [x + f" more{i} words{i}" for i in range(4) for x in texts[:3]]
    units = t.Units(pa.array(texts + near))
    keys, place = np.unique(units.keys, return_inverse=True)
    pairs = np.unique(units.owner * len(keys) + place)
    voter = t._voters(pairs // len(keys), keys[pairs % len(keys)], len(texts + near))
    assert voter[:30].tolist() == list(range(30)) and voter[30:].tolist() == [0, 1, 2] * 4


def test_curve_of_separable_margins_stays_finite():
    top = np.r_[np.full((50, 3), 2.0), np.full((50, 3), -0.5)]
    slope, offset = t._logistic(top, np.r_[np.ones(50), np.zeros(50)].astype(int))
    assert max(*slope, abs(offset)) < 20


def test_gaps_and_insertions(trained, make):
    model, _, _ = trained
    clean = "they walked home in the rain and said nothing of it "
    rows = [clean, clean + "idiot stupid worthless", clean + "id*iot stu.pid worth-less", clean + "i d i o t and s t u p i d and t r a s h", clean + "idi0t stup1d w0rthless", clean + "id iot stu pid and wor thless"]
    got = {r.doc_id: r.score for r in t.scored(make([(i, x, "", "", 0) for i, x in enumerate(rows)]), model).collect()}
    assert got[0] < 0.5 and all(got[i] >= 0.7 for i in range(1, 6)), got


def test_memory_of_units_changes_nothing(trained, make, monkeypatch):
    model, _, _ = trained
    rows = [(i, f"idiot and {w} stupid number{i}", "", "", 0) for i, w in enumerate(["trash", "peace", "scum"] * 10)]
    want = {r.doc_id: r.score for r in t.scored(make(rows), model).collect()}
    monkeypatch.setattr(t, "_KNOWN_UNITS", 2)
    assert {r.doc_id: r.score for r in t.scored(make(rows), model).collect()} == want


def test_messy_rows(spark, trained, messy, empty):
    model, _, _ = trained
    got = t.scored(messy, model).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert len({r.score for r in got if r.doc_id in (3, 4, 5)}) == 1
    assert t.scored(empty, model).count() == 0


@pytest.mark.parametrize("labels", [[], [0, 0], [1, 1], [None, 0]])
def test_labels_of_one_kind(spark, make, labels):
    docs = make([(i, f"text number {i} here", "", "", 0) for i in range(4)])
    known = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "doc_id long, toxic int")
    got = {round(r.score, 6) for r in t.scored(docs, t.train(docs, known)).collect()}
    assert got == ({1.0} if labels == [1, 1] else {0.0})

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from spendscope.llm import mixing


def targets_by_hand(sizes, weights, most=3.0):
    """Shares, the excess over the caps handed on until none is above."""
    total, fixed = sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        if not free:
            return [fixed[i] for i in range(len(sizes))]
        level = (total - sum(fixed.values())) / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * level > most * sizes[i]]
        if not over:
            return [fixed.get(i, weights[i] * level) for i in range(len(sizes))]
        fixed.update({i: most * sizes[i] for i in over})


def tilted(sources):
    """One constraint per source, by a key that a null source has too."""
    keyed = sources.withColumn("sid", mixing._sid(mixing.F.col("source")))
    return mixing.tilts(keyed, {"sid": keyed.select("sid", "target")}, "source_size")[0]


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1000, 5, 70, 900, 2], [0, 10, 20], [5], [7, 7, 7, 7, 7, 7, 7, 7], [1, 1, 1, 100000]])
def test_targets(spark, sizes):
    names = [f"s{i}" for i in range(len(sizes) - 1)] + [None]
    df = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")
    got = {r.source: r for r in tilted(mixing.targets(mixing.weights(df))).collect()}
    weights = [i % 3 + 1 for i in range(len(sizes))]
    for name, size, want in zip(names, sizes, targets_by_hand(sizes, weights)):
        assert got[name].target == pytest.approx(want, abs=1e-9)
        if size:
            assert size * 2.718281828459045 ** got[name].tilt == pytest.approx(want, rel=1e-9)


def test_small_targets_converge(spark):
    df = spark.createDataFrame([("a", 10**15, 1.0), ("b", 1, 3.0)], "source string, source_size long, target double")
    assert [round(r.tilt, 6) for r in tilted(df).orderBy("source").collect()] == [-34.538776, 1.098612]


def test_mix(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mixed(docs).collect()
    again = mixing.mixed(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    sizes = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    taken, target = {}, {}
    for r in rows:
        assert r.size == sizes[r.doc_id] and r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in target)
    copies = {}
    for r in mixing.repeated(docs).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert copies == {r.doc_id: r.copies for r in rows if r.copies}


def test_no_python_on_the_main_path(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (mixing.mixed(docs), mixing.repeated(docs)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_messy_rows(messy, empty):
    rows = mixing.mixed(messy).collect()
    assert len(rows) == 12 and all(r.taken <= 3 * r.size for r in rows)
    assert {r.size for r in rows if r.doc_id == 3} == {0}
    assert len({r.copies for r in rows if r.doc_id == 2}) == 1
    assert mixing.mixed(empty).count() == 0 and mixing.repeated(empty).count() == 0
    assert mixing.repeated(messy).columns == messy.columns


def test_words_of_other_white_space(make):
    rows = mixing.mixed(make([(1, "a b c\x1cd\te\x0bf", "", "s", 0)])).collect()
    assert rows[0].size == 4


def test_long_text_at_the_border(spark, make):
    """1,000 texts of ten words and one of 5,000 that lies where the need ends; the rest of the need is behind the window."""
    place = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16) / 2**48
    long_of = {s: next(i for i in range(10**6, 2 * 10**6) if abs(place(i) - at) < 1e-3) for s, at in (("a", 0.6), ("b", 0.3))}
    rows = [(1000 * k + i, "w " * 10, "en", s, 20) for k, s in enumerate("ab") for i in range(1000)]
    rows += [(i, "w " * 5000, "en", s, 10000) for s, i in long_of.items()]
    # rows that repeat an id lie in one place and are taken or left together
    again = [i for i in range(1000, 2000) if place(i) > 0.35][:20]
    rows += [(i, "w " * 10, "en", "b", 20) for i in again]
    docs = make(rows)
    source = {i: s for i, _, _, s, _ in rows}
    got, taken, target = mixing.mixed(docs).collect(), {"a": 0, "b": 0}, {}
    for r in got:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(0 <= target[s] - taken[s] <= mixing.MISS * target[s] for s in "ab"), (taken, target)
    copies = {(r.doc_id, r.copies) for r in got}
    assert len(copies) == len(source)
    n = Counter(i for i, *_ in rows)
    assert Counter(r.doc_id for r in mixing.repeated(docs).collect()) == Counter({i: c * n[i] for i, c in copies if c})


NAMES = ["sid", "base", "low", "high", "chosen", "part", "copies", "copy", "more", "place", "size", "need", "behind", "source_size", "target", "tilt", "rate", "words", "one", "two"]


def test_columns_with_internal_names_stay_as_they_are(spark):
    extra = [f"{p}{n}" for p in ("", "__", "__mix_", "__MIX__") for n in NAMES if not (p == "" and n in ("size",))]
    rows = [(i, f"w{i} " * (i % 5 + 1), "ab"[i % 2], *[i * 100 + k for k in range(len(extra))]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` long" for c in extra))
    got = mixing.repeated(docs)
    assert got.columns == docs.columns
    plain = Counter(r.doc_id for r in mixing.repeated(docs.select("doc_id", "text", "source")).collect())
    assert Counter(r.doc_id for r in got.collect()) == plain and sum(plain.values()) > 0
    want = {r[0]: tuple(r) for r in rows}
    assert all(tuple(r) == want[r.doc_id] for r in got.collect())


def test_dual_of_overlapping_constraints_equals_a_solver(spark):
    """Sources and languages at once, against proportional fitting in numpy."""
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 60, (5, 3)) * (rng.random((5, 3)) > 0.2)
    want = sizes * np.exp(rng.normal(0, 1, (5, 1)) + rng.normal(0, 1, (1, 3)))
    by_source, by_lang = want.sum(1), want.sum(0)
    fitted = sizes.astype(float)
    for _ in range(20000):
        fitted *= np.divide(by_source, fitted.sum(1), where=fitted.sum(1) > 0, out=np.ones(5))[:, None]
        fitted *= np.divide(by_lang, fitted.sum(0), where=fitted.sum(0) > 0, out=np.ones(3))[None, :]
    cells = spark.createDataFrame([(i, j, int(sizes[i, j])) for i in range(5) for j in range(3)], "source long, lang long, size long")
    goals = {d: spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], f"{d} long, target double") for d, v in (("source", by_source), ("lang", by_lang))}
    got, miss = mixing.tilts(cells, goals)
    assert miss == 0.0 and "Python" not in got._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        if r["size"]:
            assert r["size"] * np.exp(r.tilt) == pytest.approx(fitted[r.source, r.lang], rel=1e-5)


def test_dual_of_one_dimension_is_the_ratio(spark):
    rows = [("a", 100, 300.0), ("b", 1000, 7.0), ("c", 5, 5.0), ("d", 0, 0.0), (None, 10, 10.0)]
    cells = spark.createDataFrame(rows, "source string, size long, target double")
    got, miss = mixing.tilts(cells, {"source": cells.select("source", "target")})
    assert miss == 0.0
    found = {r.source: np.exp(r.tilt) for r in got.collect()}
    assert found["a"] == pytest.approx(3, rel=1e-14) and found["b"] == pytest.approx(0.007, rel=1e-13) and found["c"] == found["d"] == 1.0


def test_constraints_that_contradict_each_other_end(spark):
    cells = spark.createDataFrame([("a", "x", 10), ("b", "y", 10)], "source string, lang string, size long")
    goals = {"source": spark.createDataFrame([("a", 10.0), ("b", 10.0)], "source string, target double"), "lang": spark.createDataFrame([("x", 30.0), ("y", 10.0)], "lang string, target double")}
    _, miss = mixing.tilts(cells, goals)
    assert miss > 0.1


def test_ranks_and_running_sums_over_ranges(spark):
    rows = [(f"s{i:03d}", (i * 37) % 101) for i in range(300)]
    df = spark.createDataFrame(rows, "source string, v long").repartition(5)
    got = mixing._running(df, [mixing.F.col("v"), mixing.F.col("source")], {"rank": mixing.F.lit(1), "upto": mixing.F.col("v")}).collect()
    ordered = sorted(got, key=lambda r: (r.v, r.source))
    assert [r["rank"] for r in ordered] == list(range(1, 301)) and [r.upto for r in ordered] == np.cumsum([r.v for r in ordered]).tolist()

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendscope.llm import filter_audit as a


def by_hand(rows, labels):
    """Every document through every order, one filter after the other."""
    import re

    rows = [(i, t or "", s or "") for i, t, s in rows]

    def fails(i, t):
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = i is not None and any(j is not None and j < i and u == t for j, u, _ in rows)
        return {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                "D": re.search(r"[#$%&*|]", t) is not None, "E": copy}

    docs = [(s, fails(i, t), labels.get(i, (0, 0))) for i, t, s in rows]
    out = {}
    for part in {s for s, _, _ in docs}:
        own = [(f, y) for s, f, y in docs if s == part]
        gone = {c: 0 for c in "ABCDE"}
        for order in permutations("ABCDE"):
            left = own
            for step, c in enumerate(order, 1):
                hit = [(f, y) for f, y in left if f[c]]
                earlier = [f for f, _ in own if f[c] and any(f[x] for x in order[: step - 1])]
                left = [(f, y) for f, y in left if not f[c]]
                out[part, "".join(order), step] = [len(left), len(hit), len(earlier), sum(f[c] and sum(f.values()) == 1 for f, _ in own),
                                                   sum(y[0] == 1 for _, y in hit), sum(y[1] == 1 for _, y in hit)]
                gone[c] += len(hit)
        for order in permutations("ABCDE"):
            for step, c in enumerate(order, 1):
                out[part, "".join(order), step].append(gone[c])
    return out


def run(spark, docs, labels):
    known = spark.createDataFrame([(i, q, t) for i, (q, t) in labels.items()], "doc_id long, quality int, toxic int")
    rows = a.audited(a.kinds(a.failures(docs), known)).collect()
    out = {(r.part, r.filter_order, r.step): list(r[3:]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_equals_by_hand(spark, make):
    rng = np.random.default_rng(5)
    long = [" ".join(f"w{x}" for x in rng.integers(0, 900, 250)), " ".join(f"w{x}" for x in rng.integers(0, 60, 250)), "AB " * 210, "x# " + "word " * 220, "short", "", None]
    rows = [(int(i), long[rng.integers(7)], "", ["a", "b", "", None][rng.integers(4)], 0) for i in rng.permutation(80)]
    labels = {i: (int(rng.integers(2)), int(rng.integers(2))) for i in range(0, 80, 2)}
    assert run(spark, make(rows), labels) == by_hand([(r[0], r[1], r[3]) for r in rows], labels)


def test_messy_rows(spark, messy, empty):
    rows = [(r.doc_id, r.text, r.source) for r in messy.collect()]
    assert run(spark, messy, {2: (1, 1), 9: (0, 1)}) == by_hand(rows, {2: (1, 1), 9: (0, 1)})
    assert run(spark, empty, {1: (0, 0)}) == {}


def test_labels_with_nulls_and_repeats(spark, make):
    known = spark.createDataFrame([(1, 0, None), (1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = a.kinds(a.failures(make([(1, "x", "", "s", 0), (None, "x", "", "s", 0)])), known).collect()
    assert sorted((r.good, r.toxic, r.n) for r in rows) == [(0, 0, 1), (1, 0, 1)]


@pytest.mark.parametrize("n", [1, 3, 5])
def test_steps_equal_first_failing_filter(n):
    orders, steps = a.removal_steps(n)
    for m in range(1 << n):
        for o, order in enumerate(orders):
            assert steps[m, o] == min([i for i, f in enumerate(order) if m >> f & 1], default=n)


def test_hot_text_and_many_parts(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text"), (F.col("id") % 500).cast("string").alias("source"))
    known = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = a.audited(a.kinds(a.failures(docs), known))
    assert got.count() == 500 * 600
    assert got.filter("filter_order = 'EABCD' and step = 1").agg(F.sum("removed")).first()[0] == 999

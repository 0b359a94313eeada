import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from spendscope.llm import collocations as c


def by_hand(rows, least, longest, first):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    f[lang][tuple(ws[i : i + k])] += 1
    out = []
    for lang, own in f.items():
        some = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in some.items():
            longer = any(b >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in some.items())
            if not longer:
                score, _, l, r = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def corpus(n=300, seed=3):
    rng = np.random.default_rng(seed)
    vocabulary = [f"{w}{i}" for i in range(40) for w in ("a", "É", "Mot", "\U0001f600x")]
    passages = [" ".join(rng.choice(vocabulary, 7)) for _ in range(3)]
    rows = []
    for _ in range(n):
        ws = [vocabulary[int(x)] for x in np.minimum(rng.zipf(1.5, rng.integers(0, 60)) - 1, len(vocabulary) - 1)]
        ws.insert(len(ws) // 2, passages[rng.integers(3)])
        text = "".join(w + rng.choice([" ", "  ", "\t", ". ", ", ", "\n", "?!"], p=[0.7, 0.05, 0.05, 0.1, 0.05, 0.03, 0.02]) for w in ws)
        rows.append((text, [None, "en", "de"][int(rng.integers(3))]))
    return rows


@pytest.mark.parametrize("sizes", [{}, {"addressed": 7, "tile": 2, "dense": 3}, {"addressed": 0}, {"tile": 8, "dense": 1}, {"addressed": 50, "tile": 16, "dense": 10**9}])
def test_equals_by_hand(make, sizes):
    rows = corpus() + [(None, "en"), ("", None), (" .,; ", "en"), ("same same same same same same same same", "en")]
    docs = make([(i, t, lang, "s", 0) for i, (t, lang) in enumerate(rows)])
    got = c.collocations(docs, least=8, longest=5, first=25, **sizes)
    assert sorted(map(tuple, got.collect())) == by_hand(rows, 8, 5, 25)


def test_dense_and_sparse_tiles_agree():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.3, 20_000), 5000) - 2
    want = Counter((a, b) for a, b in zip(ids.tolist(), ids[1:].tolist()) if a != -1 and b != -1)
    for tile, dense in ((4, 1), (64, 10), (1024, 10**9)):
        left, right, n = c.pair_counts(ids, tile, dense)
        assert dict(zip(zip(left.tolist(), right.tolist()), n.tolist())) == want


def test_scores_beyond_64_bits(spark):
    a, l, r, n = 7 * 10**12 + 1, 9 * 10**12 + 7, 8 * 10**12 + 3, 10**14 + 9
    one = spark.createDataFrame([("x", "p q", a)], "lang string, phrase string, a long")
    parts = spark.createDataFrame([("x", "p", l), ("x", "q", r)], "lang string, phrase string, n long")
    got = c.lowest_cuts(one, parts, spark.createDataFrame([("x", n)], "lang string, total long")).first()
    assert got.score == 1000 * a * n // (l * r) and (got.l, got.r, got.n) == (l, r, n)


def test_lowest_cut_and_its_ties(spark):
    one = spark.createDataFrame([("x", "p q r", 10)], "lang string, phrase string, a long")
    parts = spark.createDataFrame([("x", p, n) for p, n in (("p", 30), ("q r", 20), ("p q", 20), ("r", 30))], "lang string, phrase string, n long")
    got = c.lowest_cuts(one, parts, spark.createDataFrame([("x", 600)], "lang string, total long")).first()
    assert (got.l, got.r, got.score) == (30, 20, 10000)


def test_messy_rows(messy, empty):
    got = c.collocations(messy, least=3)
    rows = [(r.text, r.lang) for r in messy.collect()]
    assert sorted(map(tuple, got.collect())) == by_hand(rows, 3, 5, 2000)
    assert c.collocations(empty).count() == 0


def test_words_of_one_language_stay_apart(make):
    rows = [("good day", lang) for lang in ("en", "de") for _ in range(5)]
    docs = make([(i, t, lang, "s", 0) for i, (t, lang) in enumerate(rows)])
    assert c.collocations(docs, least=6).count() == 0
    assert sorted(r.lang for r in c.collocations(docs, least=5).collect()) == ["de", "en"]

import random
import re

import numpy as np
import pytest

from spendscope.llm import decontamination as d


def words(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())


def tiling_by_hand(a, b, least):
    """Greedy string tiling on lists: the longest common run of unmarked words, again and again."""
    used_a, used_b, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        used_a.update(range(i, i + n))
        used_b.update(range(j, j + n))
        out.append(best)


@pytest.mark.parametrize("seed", range(6))
def test_tiles_cover_as_by_hand(seed):
    r = random.Random(seed)
    item = [r.randint(0, 12) for _ in range(40)]
    parts = [item[i : i + 9] for i in range(0, 40, 9)]
    r.shuffle(parts)
    text = [r.randint(0, 12) for _ in range(20)] + [w for p in parts for w in [*p, 99]]
    got = d.tiles(np.array(item, np.uint64), np.array(text, np.uint64), 3)
    want = tiling_by_hand(item, text, 3)
    assert sorted(n for _, _, n in got) == sorted(n for n, _, _ in want)
    assert all(item[p : p + n] == text[q : q + n] for p, q, n in got)
    marks = [set(range(p, p + n)) for p, _, n in got]
    assert sum(map(len, marks)) == len(set().union(*marks))


ITEM = "The quick brown fox jumps over the lazy dog. Then it sleeps for nine long hours in the warm sun, happily."
REORDERED = "Well: then it sleeps for nine LONG hours in the warm sun happily and more. Before, the quick brown fox jumps over the lazy dog!"


def bench(spark):
    return spark.createDataFrame([(10, ITEM), (11, "only three words"), (12, None), (13, ""), (14, "?!"), (None, "nobody knows this item by any number at all")], "item_id long, text string")


def test_contaminated(spark, make):
    filler = "some other words that come between and mean nothing here. " * 30
    docs = make([
        (1, filler + ITEM + filler, "", "", 0), (2, REORDERED, "", "", 0), (3, "The quick brown fox jumps far away from here and it never sleeps", "", "", 0),
        (4, "so ONLY three, words!", "", "", 0), (5, None, "", "", 0), (6, "", "", "", 0), (7, filler * 40 + ITEM, "", "", 0), (1, filler + ITEM + filler, "", "", 0),
        (None, "x Nobody knows this item by any number at all y", "", "", 0)])
    got = {(r.doc_id, r.item_id): (r.n_covered, r.n_words) for r in d.contaminated(docs, bench(spark)).collect()}
    n = len(words(ITEM))
    assert got == {(1, 10): (n, n), (2, 10): (n, n), (7, 10): (n, n), (4, 11): (3, 3), (None, None): (9, 9)}
    left = d.decontaminated(docs, bench(spark))
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [3, 5, 6]


def test_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.n_covered for r in d.contaminated(docs, items).collect()}
    want = {}
    benchmark = [(r.item_id, words(r.text)) for r in items.collect()]
    for r in docs.collect():
        text = words(r.text)
        five = {tuple(text[i : i + 5]) for i in range(len(text) - 4)}
        for item_id, item in benchmark:
            near = [i for i in range(len(text)) if any(tuple(text[j : j + 5]) in {tuple(item[k : k + 5]) for k in range(len(item) - 4)} for j in range(max(0, i - 4), i + 1))] if any(tuple(item[k : k + 5]) in five for k in range(len(item) - 4)) else []
            if near:
                part = text[near[0] : near[-1] + 1]
                n = sum(x[0] for x in tiling_by_hand(item, part, 5)) if len(part) < 400 else None
                if n is not None and 2 * n >= len(item):
                    want[r.doc_id, item_id] = n
    assert want and got == want


def test_common_seeds_start_no_candidate_alone(spark, make):
    head = "it is well known to all of us that "
    items = spark.createDataFrame([(i, head + " ".join(f"w{i}x{k}" for k in range(30))) for i in range(20)], "item_id long, text string")
    docs = make([(i, head + f"document {i} says nothing else of interest", "", "", 0) for i in range(50)])
    assert d.contaminated(docs, items).count() == 0


def test_messy_rows(spark, messy, empty):
    assert d.contaminated(messy, bench(spark)).count() == 0
    assert d.decontaminated(messy, bench(spark)).count() == 12
    assert d.contaminated(empty, bench(spark)).count() == 0 and d.decontaminated(empty, bench(spark)).count() == 0
    assert d.decontaminated(messy, bench(spark).limit(0)).count() == 12


@pytest.mark.parametrize("seed", range(8))
def test_longest_shared_window_is_found_by_halving(seed):
    r = np.random.default_rng(seed)
    item, text = r.integers(0, 4, 30).astype(np.uint64), r.integers(0, 4, 40).astype(np.uint64)
    free_a, free_b = r.random(30) > 0.1, r.random(40) > 0.1

    def shared(n):
        windows = lambda v, free: {tuple(v[i : i + n]) for i in range(len(v) - n + 1) if free[i : i + n].all()}
        return bool(windows(item, free_a) & windows(text, free_b))

    want = max([n for n in range(2, 31) if shared(n)], default=0)
    assert d._longest_shared(item, free_a, text, free_b, 2, 30) == want


def test_item_of_two_hundred_thousand_words(spark, make):
    words = [f"w{i}" for i in range(200_000)]
    long = " ".join(words)
    items = spark.createDataFrame([(1, long), (2, "quite another short item of some eight words")], "item_id long, text string")
    half = " ".join(words[110_000:] + ["x"] * 30 + words[:20_000])
    docs = make([(1, long, "", "", 0), (2, half, "", "", 0), (3, " ".join(words[:90_000]), "", "", 0), (4, "none of it", "", "", 0)])
    got = {(r.doc_id, r.item_id): (r.n_words, r.n_covered, len(r.tiles)) for r in d.contaminated(docs, items).collect()}
    assert got == {(1, 1): (200_000, 200_000, 1), (2, 1): (200_000, 110_000, 2)}
    assert "item_text" not in d.seeds(d.keyed(items)).columns

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spendscope.llm import components, simhash


def by_hand(text, n=3):
    words = [w for w in (text or "").translate({i: i + 32 for i in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, radius):
    """Smallest member per member, by comparing all pairs."""
    nodes = sorted(set(fps))
    root = {f: f for f in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in nodes}


def clustered(n, seed=1):
    r = random.Random(seed)
    centers = [r.getrandbits(64) for _ in range(6)]
    out = []
    for _ in range(n):
        f = r.choice(centers) if r.random() < 0.8 else r.getrandbits(64)
        for _ in range(r.randint(0, 4)):
            f ^= 1 << r.randrange(64)
        out.append(f)
    return sorted(set(out))


@pytest.mark.parametrize("text", [None, "", "a", "A b", "one two three four", "x y z İ Q \x1c w", "a b c " * 300])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == by_hand(text)


def test_signed_fingerprint_column(spark, make):
    got = simhash.fingerprints(make([(1, "one two three four", "", "", 0), (2, None, "", "", 0)])).collect()
    assert {r.id: r.fp % (1 << 64) for r in got} == {1: by_hand("one two three four"), 2: 0}


@pytest.mark.parametrize("radius", [0, 1, 3, 6])
def test_bitwise_counters_equal_popcounts(radius):
    fps = np.array(clustered(150), np.uint64)
    bits = simhash.near(fps, fps, radius)
    got = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")[:, : len(fps)].astype(bool)
    assert (got == (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius)).all()


@pytest.mark.parametrize("rows", [5, 32, 1024])
def test_links_equal_all_pairs(spark, monkeypatch, rows):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", rows)
    fps = clustered(300)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    links = simhash.links(df, 3)
    got = {r.a % (1 << 64): r.b % (1 << 64) for r in links.collect()}
    assert all((a ^ b).bit_count() <= 64 for a, b in got.items())
    roots = {r.node % (1 << 64): r.root % (1 << 64) for r in components.components(links).collect()}
    want = groups(fps, 3)
    sets = lambda m: sorted(tuple(sorted(f for f in fps if m.get(f, f) == k)) for k in {m.get(f, f) for f in fps})
    assert sets(roots) == sets(want)


def test_long_chain_is_one_component(spark):
    df = spark.range(300).selectExpr("id as a", "id + 1 as b")
    assert {(r.node, r.root) for r in components.components(df).collect()} == {(i, 0) for i in range(301)}


def test_messy_rows(messy):
    got = simhash.near_duplicates(messy).collect()
    assert len(got) == 12
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add(r.component_id)
    # equal texts, repeated rows and the row without id share a component; texts without a word link with each other
    assert by_id == {1: {1}, 2: {1}, 3: {3}, 4: {3}, 5: {3}, 6: {6}, 9: {6}, 7: {7}, 8: {8}, None: {1, 3}}


def test_one_of_each(messy, empty):
    got = simhash.one_of_each(messy)
    assert got.columns == messy.columns
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == [1, 3, 6, 7, 8]
    assert simhash.one_of_each(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


def test_repeated_id_with_other_text_is_one_document(make):
    rows = make([(5, "alpha beta gamma delta", "", "", 0), (5, "quite another text than that", "", "", 0), (7, "quite another text than that", "", "", 0)])
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(rows).collect()} == {(5, 5), (7, 5)}
    assert simhash.one_of_each(rows).count() == 1


def test_hexadecimal(spark):
    df = spark.createDataFrame([(0,), (-1,), (255,)], "fp long").select(simhash.hexadecimal(F.col("fp")))
    assert [r[0] for r in df.collect()] == ["0" * 16, "f" * 16, "0" * 14 + "ff"]


def test_links_with_null_ends_and_loops_are_none(spark):
    from spendscope.llm.components import components

    links = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (None, 3), (4, None), (5, 5), (None, None)], "a long, b long")
    assert sorted(map(tuple, components(links).collect())) == [(1, 1), (2, 1), (3, 1)]
    assert components(links.limit(0)).count() == 0

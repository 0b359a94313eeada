import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spendscope.llm import substring_dedup as s


def by_hand(rows, least):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    lowest = {}
    for i, ws in docs:
        if i is not None:
            for p in range(len(ws) - least + 1):
                key = tuple(ws[p : p + least])
                lowest[key] = min(lowest.get(key, i), i)
    out = []
    for i, ws in docs:
        gone = set()
        if i is not None:
            for p in range(len(ws) - least + 1):
                if lowest[tuple(ws[p : p + least])] < i:
                    gone |= set(range(p, p + least))
        out.append((i is None, i or 0, len(ws), len(gone), " ".join(w for p, w in enumerate(ws) if p not in gone)))
    return sorted(out)


def found(docs, **options):
    rows = s.deduplicated(docs, **options).collect()
    for r in rows:
        assert sum(x.n for x in r.removed) == r.n_removed and all(x.n >= options["least"] for x in r.removed)
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.text) for r in rows)


def corpus(n=120, seed=2):
    rng = np.random.default_rng(seed)
    vocabulary = [f"{w}{i}" for i in range(6) for w in ("a", "É", "\U0001f600")]
    passages = [" ".join(rng.choice(vocabulary, int(rng.integers(4, 30)))) for _ in range(8)]
    rows = []
    for i in rng.permutation(n).tolist():
        parts = [" ".join(rng.choice(vocabulary, int(rng.integers(0, 12)))) for _ in range(4)]
        parts.insert(2, passages[rng.integers(8)])
        rows.append((i if i % 11 else None, rng.choice([" ", "\n", "\t \r"]).join(parts)))
    return rows + [(3, rows[0][1]), (3, rows[0][1]), (500, rows[5][1]), (None, rows[5][1]), (501, None), (502, ""), (503, passages[0])]


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 1}, {"chunk_bytes": 3000, "group": 8}, {"chunk_bytes": 900, "group": 1}])
def test_equals_by_hand(make, sizes):
    rows = corpus()
    docs = make([(i, t, "en", "s", 0) for i, t in rows]).repartition(3)
    want = by_hand(rows, 5)
    assert sum(r[3] for r in want) > 500
    assert found(docs, least=5, **sizes) == want


def test_prefixes_grow_where_suffixes_are_many(spark, make):
    rows = [(i, "the same words begin here " + f"x{i} y{i} z{i}") for i in range(200)]
    chunks = s.chunked(make([(i, t, "en", "s", 0) for i, t in rows]), size=100)
    folder = f"{s.shared_folder(spark, 'copies')}-3"
    s._whole_copies(chunks, folder, 3)
    split = s.split(chunks, 5, folder, 64)
    assert len(split.heavy) == 4 and 600 < split.total <= 800 and all(len(h) for h in split.heavy)
    assert s.split(chunks, 5, folder, 10**6).heavy == []


def test_hot_passage_in_a_third_of_the_documents(spark, make):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"own{i} a{i} " + (passage if i % 3 == 0 else "") + f" end{i}") for i in range(900)]
    got = found(make([(i, t, "en", "s", 0) for i, t in rows]).repartition(4), least=13, chunk_bytes=5000)
    assert [r[3] for r in got] == [40 if i % 3 == 0 and i else 0 for i in range(900)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=5, max_size=5), min_size=1, max_size=40), st.integers(1, 5))
def test_subtree_order_and_depths(rows, least):
    columns = np.array(rows).T
    order, common = s.subtree(columns)
    leaves = [rows[i] for i in order]
    assert leaves == sorted(rows)
    for i in range(1, len(leaves)):
        assert common[i] == next((k for k in range(5) if leaves[i][k] != leaves[i - 1][k]), 5)
    nodes = s.deep_nodes(common, least)
    assert len(nodes) == len({tuple(r[:least]) for r in rows})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_hash_bits_round_trip(values):
    values = np.sort(np.array(values, np.uint32))
    assert s._values(s._planes(values)).tolist() == values.tolist()


def test_messy_rows(messy, empty):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    assert found(messy, least=4) == by_hand(rows, 4)
    assert found(messy, least=13) == by_hand(rows, 13)
    assert s.deduplicated(empty).count() == 0

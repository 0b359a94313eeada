import random
import re

import pyarrow as pa
import pytest

from spendscope.llm import repetition


def by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": 0, "dup_line_chars": 0}
    seen = set()
    for line in text.split("\n"):
        own = re.findall(r"[^\x20\x09-\x0D]+", line)
        if own and line in seen:
            out["n_dup_lines"] += 1
            out["dup_line_chars"] += sum(map(len, own))
        seen.add(line)
    for n in {repetition.BASE_WINDOW, *repetition.MOST_REPEATED}:
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        marked = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + n)}
        out[f"chars_{n}"] = sum(len(words[j]) for j in marked)
        if n == repetition.BASE_WINDOW:
            out["n_repeat_words"] = len(marked)
    return out


def texts():
    r = random.Random(4)
    out = [None, "", " ", "\n\n", "a", "a b\na b\n a b\n\na b", "é é é", "x\x1cy z\x0b w", "# * $%&|<>", "same line here\n" * 12, "a b c d e f g h " * 3, "tail\n", "\ufeffü\u2003ü 😀"]
    for _ in range(25):
        lines = [" ".join(r.choice("ab cd ef gh é".split()) for _ in range(r.randint(0, 14))) for _ in range(r.randint(1, 9))]
        out.append(r.choice(["\n", "\n\n", "\r\n"]).join(r.choice(lines) for _ in range(12)))
    return out


def test_measures_equal_by_hand():
    rows = texts()
    got = repetition.measures(pa.array(rows, pa.string()))
    for i, text in enumerate(rows):
        want = by_hand(text)
        assert {k: int(v[i]) for k, v in got.items()} == want, repr(text)


def test_slices_of_a_batch():
    rows = pa.array(texts(), pa.string())
    whole, part = repetition.measures(rows), repetition.measures(rows.slice(5, 9))
    assert all((whole[k][5:14] == part[k]).all() for k in whole)


def test_verdicts(make):
    plain = " ".join(f"word{i}" for i in range(300))
    rows = make([(1, plain, "", "", 0), (2, plain + " " + plain, "", "", 0), (3, "too short", "", "", 0), (4, plain + "\n" + "\n".join(["the same line"] * 120), "", "", 0), (5, None, "", "", 0)])
    got = {r.doc_id: (r.base_failed, r.kept) for r in repetition.judged(rows).collect()}
    assert got == {1: (False, True), 2: (True, False), 3: (True, False), 4: (True, False), 5: (True, False)}


def test_five_word_repeats_are_the_methods_own(make):
    # five words repeat, eight never do
    text = " ".join(f"alpha beta gamma delta epsilon w{i} x{i}" for i in range(60))
    row = repetition.judged(make([(1, text, "", "", 0)])).first()
    assert row.n_repeat_words == 0 and not row.base_failed and not row.kept and row.share_5 > 0.45


def test_messy_rows(messy, empty):
    got = repetition.judged(messy).collect()
    assert len(got) == 12 and all(r.base_failed and not r.kept for r in got)
    assert repetition.judged(empty).count() == 0
    assert {r.n_words for r in got if r.doc_id == 6} == {40_000}


@pytest.mark.parametrize("size", [1, 100])
def test_cuts_between_pieces_change_nothing(monkeypatch, size):
    from spendscope.llm import common

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts()))), pa.array(texts(), pa.string())], ["id", "text"])
    cut = list(common.pieces(batch, most=size))
    assert sum(len(p) for p in cut) == len(batch) and [i for p in cut for i in p.column("id").to_pylist()] == list(range(len(batch)))

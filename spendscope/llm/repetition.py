"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths in numpy.

For each length, every window of n words is hashed from one running sum over
the text's words; windows found twice or more are marked, and the characters of
all words under a mark are counted, first occurrence included. Lines are hashed
the same way. A text fails if the share of its word characters under repeated
n-grams exceeds the threshold of that length, or if lines that equal an earlier one
hold too many of its word characters or are too many of its lines.

Defined cases: a null or empty text has counts of 0 and shares of 0 (the base
rule rejects it for its length); a text shorter than n words has no window of n;
whole texts are read, however long; rows stand for themselves; other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spendscope.llm.common import Words, covered, documents, later_copies, mapped, per_row, repeated, utf8

#: Share of a text's word characters that repeated n-grams may cover, first occurrence included, by n. Set on labelled
#: texts (README): about twice the published shares, which leave the first occurrence out, and up to 2.5 times where
#: texts labelled as good would go.
MOST_REPEATED = {5: 0.30, 6: 0.28, 7: 0.32, 8: 0.27, 9: 0.275, 10: 0.25}
#: Share of the word characters in lines that equal an earlier line, and share of such lines among those with a word.
MOST_DUPLICATE_LINES, MOST_DUPLICATE_LINE_COUNT = 0.15, 0.50
SHORTEST, BASE_WINDOW, BASE_PERCENT = 20, 8, 30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LINE_END = np.zeros(256, bool)
_LINE_END[10] = True


def measures(column: pa.Array, count_lines: bool = False) -> dict[str, np.ndarray]:
    """Counts and shares of every text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars, chars_<n>; n_lines if asked for."""
    raw, offsets = utf8(column)
    words = Words(raw, offsets)
    heads = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    chars = heads[words.ends] - heads[words.starts]
    upto = np.r_[0, np.cumsum(chars)]
    out = {
        "n_words": np.diff(words.bounds), "word_chars": per_row(chars, words.bounds),
        "n_symbols": per_row(_SYMBOL[raw].astype(np.int64), offsets),
    }
    lines = Words(raw, offsets, punctuation=_LINE_END)
    first, last = np.searchsorted(words.starts, lines.starts), np.searchsorted(words.starts, lines.ends)
    again = later_copies(lines.owner, lines.hashes) & (last > first)
    out["n_dup_lines"] = per_row(again.astype(np.int64), lines.bounds)
    if count_lines:
        out["n_lines"] = per_row((last > first).astype(np.int64), lines.bounds)
    out["dup_line_chars"] = per_row(np.where(again, upto[last] - upto[first], 0), lines.bounds)
    for n in sorted({BASE_WINDOW, *MOST_REPEATED}):
        at, hashes = words.windows(n)
        under = covered(at[repeated(words.owner[at], hashes)], n, len(chars))
        out[f"chars_{n}"] = per_row(np.where(under, chars, 0), words.bounds)
        if n == BASE_WINDOW:
            out["n_repeat_words"] = per_row(under.astype(np.int64), words.bounds)
    return out


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts, base_failed, kept, share_lines, share_<n>), one row per document row."""
    shares = [f"share_{n}" for n in MOST_REPEATED]

    def work(batch: pa.RecordBatch) -> dict:
        m = measures(batch.column("text"), count_lines=True)
        most = np.maximum(m["word_chars"], 1)
        share = {f"share_{n}": m[f"chars_{n}"] / most for n in MOST_REPEATED} | {"share_lines": m["dup_line_chars"] / most}
        base = (m["n_words"] < SHORTEST) | (100 * m["n_repeat_words"] > BASE_PERCENT * m["n_words"])
        over = (share["share_lines"] > MOST_DUPLICATE_LINES) | (m["n_dup_lines"] > MOST_DUPLICATE_LINE_COUNT * m["n_lines"])
        for n, limit in MOST_REPEATED.items():
            over |= share[f"share_{n}"] > limit
        return m | share | {"doc_id": batch.column("id"), "base_failed": base, "kept": ~base & ~over}

    kinds = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, share_lines double"
    return mapped(documents(docs, id_col, text_col), work, kinds + "".join(f", {s} double" for s in shares))

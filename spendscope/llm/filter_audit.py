"""Which filter removes what, in every order: min-plus removal ranks.

A document's failures are a row of the mask matrix (0 where it fails a filter,
infinite elsewhere), an order of the filters is a row of the position matrix
(the inverse permutation: at which step each filter is applied). Their min-plus
product is the step at which each order removes each kind of document. Scatter
counts weighted by the number of documents of each kind give what every step
removes, keeps and finds already removed.

Documents are counted by part, failure mask and labels before any order is
looked at, so the orders cost the same however many documents there are: a part
has at most 4 * 2^filters kinds. Equal texts meet by their 128-bit digest; the
smallest doc_id of a digest is an aggregate, joined back by digest and doc_id,
so that a text which a third of the documents share is never gathered.

Defined cases: a null text is an empty one, and equal to other empty ones; an
empty text holds no words, so fails A alone of the first four; a null part
counts as the empty string; rows that repeat a doc_id count each, and are not copies of one
another; a row without doc_id is no copy and makes none, and has no label; several labels of
one doc_id count as 1 where any is; texts are read whole; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.llm.common import Words, mapped, mix, per_row, stored, utf8

FILTERS = "ABCDE"
SHORTEST, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
_CAPITAL = np.zeros(256, np.int64)
_CAPITAL[65:91] = 1
_MARK = np.zeros(256, np.int64)
_MARK[[ord(c) for c in "#$%&*|"]] = 1
#: Parts whose tables are made at once.
_PARTS = 200
_COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failing(column: pa.Array) -> np.ndarray:
    """Bits of the filters A to D that each text fails."""
    raw, offsets = utf8(column)
    words = Words(raw, offsets)
    n_words = np.diff(words.bounds)
    own = words.hashes ^ mix((words.owner.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    distinct = np.bincount(words.owner[np.unique(own, return_index=True)[1]], minlength=len(n_words))
    points = per_row(((raw & 0xC0) != 0x80).astype(np.int64), offsets)
    return (
        (n_words < SHORTEST) * 1
        + (100 * distinct < LEAST_DISTINCT * n_words) * 2
        + (100 * per_row(_CAPITAL[raw], offsets) > MOST_CAPITALS * points) * 4
        + (per_row(_MARK[raw], offsets) > 0) * 8
    )


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask, digest) per document row: failures of A to D, and 16 bytes that tell texts apart."""

    def work(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").fill_null("").cast(pa.large_binary())
        digests = [hashlib.blake2b(x.as_buffer(), digest_size=16).digest() for x in texts]
        return {"id": batch.column("id"), "part": batch.column("part"), "mask": failing(batch.column("text")).astype(np.int32), "digest": pa.array(digests, pa.binary())}

    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        F.col(f"`{text_col}`").cast("string").alias("text"))
    return mapped(rows, work, "id long, part string, mask int, digest binary")


def kinds(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, good, toxic, n): documents of each kind, the mask now with the bit of E, the copies."""
    known = labels.groupBy(F.col(f"`{id_col}`").cast("long").alias("id")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    both = rows.join(known, "id", "left").select("id", "digest", "part", "mask", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))
    both = stored(both.groupBy(*both.columns).agg(F.count("*").alias("n")), "failures")
    least = both.filter("id is not null").groupBy("digest").agg(F.min("id").alias("id"))
    first = both.join(least, ["digest", "id"], "left_semi").unionByName(both.filter("id is null"))
    by, more = ["part", "mask", "good", "toxic"], 1 << FILTERS.index("E")
    signed = both.select(*by, "n", F.lit(0).cast("long").alias("firsts")).unionByName(first.select(*by, F.lit(0).cast("long").alias("n"), F.col("n").alias("firsts")))
    summed = signed.groupBy(*by).agg((F.sum("n") - F.sum("firsts")).alias("copies"), F.sum("firsts").alias("firsts"))
    split = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("firsts").alias("n")), F.struct((F.col("mask") + more).alias("mask"), F.col("copies").alias("n"))))
    return summed.select("part", "good", "toxic", split.alias("x")).select("part", "x.mask", "good", "toxic", "x.n").filter("n > 0")


def removal_steps(n_filters: int) -> tuple[np.ndarray, np.ndarray]:
    """(orders, their filters by step) and (masks, orders): the step from 0 at which a document of that mask goes; n_filters if never."""
    orders = np.array(list(permutations(range(n_filters))))
    masks = np.arange(1 << n_filters)[:, None] >> np.arange(n_filters) & 1
    far = np.where(masks == 1, 0, n_filters)
    return orders, np.min(far[:, None, :] + np.argsort(orders, axis=1)[None, :, :], axis=2).clip(max=n_filters)


def tables(weights: np.ndarray, n_filters: int) -> dict[str, np.ndarray]:
    """weights (parts, labels, masks), labels being good + 2 * toxic -> every count as (parts, orders, steps)."""
    orders, steps = removal_steps(n_filters)
    n = n_filters
    at = steps.T[:, None, :] == np.arange(n)[None, :, None]  # order, step, mask
    fails = (np.arange(1 << n)[None, :] >> np.arange(n)[:, None] & 1).astype(bool)  # filter, mask
    again = fails[orders] & (steps.T[:, None, :] < np.arange(n)[None, :, None])
    count = lambda w, of: (w @ of.reshape(-1, 1 << n).T.astype(np.int64)).reshape(len(w), *of.shape[:-1])
    every = weights.sum(1)
    removed = count(every, at)
    alone = every[:, 1 << np.arange(n)]
    shapley = np.stack([np.where(orders == f, removed, 0).sum((1, 2)) for f in range(n)], 1)
    return {
        "kept": every.sum(1)[:, None, None] - np.cumsum(removed, 2), "removed": removed, "redundant": count(every, again),
        "unique_fails": alone[:, orders], "good_lost": count(weights[:, 1::2].sum(1), at), "toxic_lost": count(weights[:, 2:].sum(1), at),
        "shapley": shapley[:, orders],
    }


def audited(counted: DataFrame, letters: str = FILTERS) -> DataFrame:
    """(part, mask, good, toxic, n) -> (part, filter_order, step, counts), a row for every part, order and step."""
    n = len(letters)
    orders, _ = removal_steps(n)
    names = ["".join(letters[f] for f in o) for o in orders]
    per_part = len(orders) * n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, len(whole), _PARTS):
                batch = whole.slice(begin, _PARTS)
                weights = np.zeros((len(batch), 4, 1 << n), np.int64)
                for i, part_kinds in enumerate(batch.column("kinds").to_pylist()):
                    for k in part_kinds:
                        weights[i, k["good"] + 2 * k["toxic"], k["mask"]] += k["n"]
                out = tables(weights, n)
                part = batch.column("part").take(pa.array(np.repeat(np.arange(len(batch)), per_part)))
                order = pa.array(np.repeat(np.array(names), n).tolist() * len(batch), pa.string())
                step = pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(batch) * len(orders)))
                columns = [pa.array(np.ascontiguousarray(np.broadcast_to(out[c], (len(batch), len(orders), n))).ravel()) for c in _COUNTS]
                yield pa.RecordBatch.from_arrays([part, order, step, *columns], ["part", "filter_order", "step", *_COUNTS])

    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("kinds"))
    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS))

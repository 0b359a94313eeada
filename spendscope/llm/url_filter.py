"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

Features of a URL: lengths of its parts, depth, labels, digit ratio and longest
digit run, character entropy, parameter counts, hyphens, escapes, vowel share,
and how often labelled URLs with the same suffix (last one, two and three labels
of the host) are bad. Suffixes are counted exactly over all labelled URLs, and
their rates are joined to the distinct hosts of the pages, so no task holds a
table of them; the trees are fitted on about SAMPLE_ROWS URLs of each label,
those first by hash. URLs are dealt into two halves by hash, and one of the
sample gets the rates of the other half, else the only URL of a host would
tell its own label and the trees would learn nothing about unseen hosts.

Rules are a short list given as a parameter; a rule `host/path` fits its host
and all subdomains if the path starts with the rule's; the longest wins.

Defined cases: a null URL, or one without `://`, has an empty host and path and
is judged by its features like others; equal URLs get equal verdicts; URLs
without label teach nothing; without labels of both kinds the method allows
all; URLs of any length are read whole; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendscope.llm import boosting
from spendscope.llm.common import mapped, per_row, sampled, stored, utf8

SAMPLE_ROWS = 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as the rules see them."""
    has = F.instr(url, "://") > 0
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), r"^[^?#]*", 0)
    return F.when(has, F.translate(host, _UPPER, _LOWER)).otherwise(""), F.when(has, path).otherwise("")


def ruled(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, start = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(name)).otherwise(verdict)
    return rule, verdict


def _suffixes(host: Column) -> Column:
    """(k, suffix): the last one, two and three labels."""
    return F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.substring_index(host, ".", -k).alias("suffix")) for k in (1, 2, 3))))


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_DIGIT, _VOWEL, _LETTER = _mask("0123456789"), _mask("aeiouAEIOU"), _mask(_UPPER + _LOWER)


def _entropy(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits per character of each row."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    counts = np.bincount(np.repeat(np.arange(n), size) * 256 + raw, minlength=n * 256).reshape(n, 256)
    p = counts / np.maximum(size, 1)[:, None]
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(1)


def _longest_run(hit: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n, out = len(offsets) - 1, np.zeros(len(offsets) - 1, np.int64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    new = np.ones(len(hit), bool)
    new[1:] = (hit[1:] != hit[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.r_[first, len(hit)])
    np.maximum.at(out, owner[first[hit[first]]], length[hit[first]])
    return out


def features(url: pa.Array, host: pa.Array, path: pa.Array, suffixes: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """(rows, features); the last three are the rates that `suffixes` (rows, 3) points to."""
    columns = []
    for name, part in (("url", url), ("host", host), ("path", path)):
        raw, offsets = utf8(part)
        size = np.diff(offsets)
        count = lambda mask: per_row(mask[raw].astype(np.int64), offsets)  # noqa: E731, B023
        columns += [size, count(_DIGIT) / np.maximum(size, 1), _entropy(raw, offsets), count(_mask("-_")), _longest_run(_DIGIT[raw], offsets)]
        if name == "url":
            columns += [count(_mask("?")), count(_mask("&=")), count(_mask("%")), count(_mask("#")), count(_mask(_UPPER)) / np.maximum(size, 1)]
        if name == "host":
            columns += [count(_mask(".")), count(_mask(":@")), count(_VOWEL) / np.maximum(count(_LETTER), 1)]
        if name == "path":
            columns += [count(_mask("/")), count(_mask(".")), size / np.maximum(count(_mask("/")), 1)]
    columns += [rates[suffixes[:, k]] for k in range(3)]
    return np.stack([np.asarray(c, float) for c in columns], 1)


@dataclass
class Model:
    trees: boosting.Trees
    counts: DataFrame  # (k, suffix, bad0, n0, bad1, n1), one row per suffix, by half
    overall: float


def _rated(rows: DataFrame, counts: DataFrame, overall: float, own: str | None = None) -> DataFrame:
    """Rows with a host -> with r1, r2, r3: the rates of its suffixes, of both halves or of that which `own` is not."""
    hosts = rows.select("host").distinct().select("host", _suffixes(F.col("host")).alias("s")).select("host", "s.k", "s.suffix")
    found = hosts.join(counts, ["k", "suffix"], "left")
    names = ("bad0", "n0", "bad1", "n1")
    wide = found.groupBy("host").agg(*(F.coalesce(F.max(F.when(F.col("k") == k, F.col(c))), F.lit(0)).alias(f"{c}_{k}") for k in (1, 2, 3) for c in names))

    def rate(k: int) -> Column:
        bad0, n0, bad1, n1 = (F.col(f"{c}_{k}") for c in names)
        if own is None:
            bad, n = bad0 + bad1, n0 + n1
        else:
            bad, n = F.when(F.col(own) == 0, bad1).otherwise(bad0), F.when(F.col(own) == 0, n1).otherwise(n0)
        return ((bad + F.lit(4 * overall)) / (n + 4)).alias(f"r{k}")

    # a stored table is broadcast or split at a hot host; an aggregate's output would keep all rows of a host in one task
    return rows.join(stored(wide, "host-counts"), "host", "left").select(*rows.columns, *(rate(k) for k in (1, 2, 3)))


def _features(url: pa.Array, host: pa.Array, path: pa.Array, rates: np.ndarray) -> np.ndarray:
    return features(url, host, path, np.arange(rates.size).reshape(rates.shape), rates.ravel())


def _prepared(df: DataFrame, url_col: str, *more: Column) -> DataFrame:
    url = F.col(f"`{url_col}`").cast("string")
    host, path = parts(F.coalesce(url, F.lit("")))
    return df.select(url.alias("text"), host.alias("host"), path.alias("path"), *more)


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label") -> Model:
    """A model of labelled URLs (label 1: block)."""
    rows = _prepared(labelled, url_col, F.col(f"`{label_col}`").cast("int").alias("y")).filter("y in (0, 1) and text is not null")
    rows = rows.withColumn("half", F.pmod(F.xxhash64(F.lit(7), "text"), F.lit(2)).cast("int"))
    by_half = [f(F.when(F.col("half") == h, v)).alias(f"{c}{h}") for h in (0, 1) for c, f, v in (("bad", F.sum, F.col("y").cast("long")), ("n", F.count, F.lit(1)))]
    hosts = rows.groupBy("host").agg(*by_half).select("*", _suffixes(F.col("host")).alias("s"))
    counts = stored(hosts.groupBy("s.k", "s.suffix").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("bad0", "n0", "bad1", "n1"))), "suffixes")
    total = counts.filter("k = 1").agg(F.sum(F.col("bad0") + F.col("bad1")).alias("bad"), F.sum(F.col("n0") + F.col("n1")).alias("n")).first()
    overall = (total.bad or 0) / max(total.n or 0, 1)
    sample = []
    for label in (0, 1):
        # stored, so that a limit among its rows is the same wherever they are read
        chosen = stored(sampled(rows.filter(F.col("y") == label), SAMPLE_ROWS, "text"), "sample")
        sample += sorted(_rated(chosen, counts, overall, "half").collect(), key=lambda r: r.text)
    if not sample:
        return Model(boosting.fit(np.zeros((0, 1)), np.zeros(0)), counts, overall)
    x = _features(*(pa.array([r[c] for r in sample], pa.string()) for c in ("text", "host", "path")), np.array([[r.r1, r.r2, r.r3] for r in sample]))
    y = np.array([r.y for r in sample])
    if y.all():
        y, x = y[:0], x[:0]
    return Model(boosting.fit(x, y), counts, overall)


def filtered(pages: DataFrame, model: Model, rules: list[tuple[str, str]], threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score), one row per page."""
    shared = pages.sparkSession.sparkContext.broadcast(model.trees)

    def work(batch: pa.RecordBatch) -> dict:
        names = ("page_id", "host", "path")
        rates = np.stack([batch.column(f"r{k}").to_numpy() for k in (1, 2, 3)], 1)
        x = _features(*(batch.column(c) for c in ("text", "host", "path")), rates)
        return {n: batch.column(n) for n in names} | {"score": 1 / (1 + np.exp(-shared.value.logits(x)))}

    rows = _prepared(pages, url_col, F.col(f"`{id_col}`").cast("long").alias("page_id"))
    found = mapped(_rated(rows, model.counts, model.overall), work, "page_id long, host string, path string, score double")
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    return found.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") > threshold, "block").otherwise("allow")).alias("verdict"), "score")

"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of 1 to 3 characters over the labelled rows in hashed
buckets: each task adds up its own rows, Spark sums the tasks' counts, and the
driver gets one matrix of BUCKETS x languages, whatever the input. It is
broadcast; scoring counts a batch's n-grams, keeps the non-zero cells and adds
up their log probabilities in numpy.

Defined cases: a text that is null or has no letter is `und` with score 0 and
teaches nothing; rows without a label teach nothing; equal scores go to the
first language by name; without any labelled row all texts are `und`;
whole texts are read, however long; repeated rows count as often as they come;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendscope.llm.common import given_back, pieces, small_batches, utf8

BUCKETS = 1 << 14
_ORDERS = (1, 2, 3)
_SMOOTH = 0.5
UNKNOWN = "und"
#: Labels that a model may have unless told otherwise; more are an error, as a column of broken labels would fill the
#: driver with a matrix of BUCKETS numbers a label. A larger `most_labels` admits them, with that memory.
MOST_LABELS = 1_000


@dataclass
class Model:
    labels: list[str]
    log_p: np.ndarray  # (BUCKETS, labels)
    prior: np.ndarray

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """(rows, BUCKETS) counts -> (rows, labels) log likelihoods plus prior, over the non-zero cells."""
        row, bucket = np.nonzero(counts)
        out = np.zeros((len(counts), len(self.labels)))
        weighted = self.log_p[bucket] * counts[row, bucket][:, None]
        edge = np.searchsorted(row, np.arange(len(counts) + 1))
        total = np.r_[np.zeros((1, len(self.labels))), np.cumsum(weighted, axis=0)]
        out += total[edge[1:]] - total[edge[:-1]]
        return out + self.prior


def _code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all rows, and the rows' offsets."""
    raw, offsets = utf8(pc.utf8_lower(column))
    text = raw.tobytes().decode("utf-8")
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    heads = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    return points, heads[offsets]


def lettered(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    return np.asarray(pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False))


def grams(points: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of the n-grams of every order; all that is no letter counts as a space."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    values = points.astype(np.uint32) * np.uint32(2654435761)
    values[points < 65] = 7
    code = np.zeros(len(points), np.uint32)
    for n in _ORDERS:
        end = len(points) - n + 1
        if end <= 0:
            return
        code = (code[:end] * np.uint32(0x01000193)) ^ (values[n - 1 :] + np.uint32(n))
        code = code ^ (code >> np.uint32(15))
        code = code * np.uint32(0x2C1B3C6D)
        inside = owner[:end] == owner[n - 1 :]
        yield owner[:end][inside], (code[inside] >> np.uint32(18)).astype(np.int64)


def counted(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, BUCKETS) counts."""
    rows = len(offsets) - 1
    out = np.zeros(rows * BUCKETS, np.int64)
    for owner, bucket in grams(points, offsets):
        out += np.bincount(owner * BUCKETS + bucket, minlength=rows * BUCKETS)
    return out.reshape(rows, BUCKETS)


def train(docs: DataFrame, text_col: str = "text", label_col: str = "lang", most_labels: int = MOST_LABELS) -> Model:
    """A model from all labelled rows of `docs`."""
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{label_col}`").cast("string").alias("label"))
    rows = rows.filter("text is not null and label is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = batch.column("label").to_pylist()
            for label in sorted(set(labels)):
                one = batch.filter(pc.equal(batch.column("label"), label))
                total = sums.setdefault(label, np.zeros(BUCKETS + 1, np.int64))
                total[BUCKETS] += int(lettered(one.column("text")).sum())
                for piece in pieces(one):
                    for _, bucket in grams(*_code_points(piece.column("text"))):
                        total[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
        for label, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at), pa.array(total[at])], ["label", "bucket", "n"])
        given_back()

    summed = rows.mapInArrow(run, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    table = summed.groupBy("label").agg(F.collect_list(F.struct("bucket", "n")).alias("cells")).limit(most_labels + 1)
    labels, counts = [], []
    with small_batches(docs.sparkSession):
        learned = sorted((r.label, r.cells) for r in table.toLocalIterator())
    for label, cells in learned:
        column = np.zeros(BUCKETS + 1)
        column[[c.bucket for c in cells]] = [c.n for c in cells]
        if column[BUCKETS] and label != UNKNOWN:
            labels.append(label)
            counts.append(column)
    if len(labels) > most_labels:
        raise ValueError(f"more than {most_labels} labels")
    if not labels:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    cells = np.array(counts).T
    words = cells[:BUCKETS] + _SMOOTH
    return Model(labels, np.log(words / words.sum(0)), np.log(cells[BUCKETS] / cells[BUCKETS].sum()))


def predictor(model: Model, docs: DataFrame):
    """A column function text -> struct(lang, score); score is the posterior probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    def score(column: pa.Array) -> pa.Array:
        model = shared.value
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        letters = lettered(column)
        lang, best = np.full(len(column), UNKNOWN, object), np.zeros(len(column))
        batch = pa.RecordBatch.from_arrays([column], ["text"])
        at = 0
        for piece in pieces(batch, most=1 << 18):
            for part in range(0, len(piece), 64):
                texts = piece.slice(part, 64).column("text")
                rows = np.arange(at, at + len(texts))
                at += len(texts)
                if not model.labels:
                    continue
                logs = model.scores(counted(*_code_points(texts)))
                odds = np.exp(logs - logs.max(1, keepdims=True))
                pick = logs.argmax(1)
                good = letters[rows]
                lang[rows[good]] = np.array(model.labels, object)[pick[good]]
                best[rows[good]] = (odds.max(1) / odds.sum(1))[good]
        given_back()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(best)], fields=list(kind))

    from pyspark.sql.functions import arrow_udf

    return arrow_udf(score, "struct<lang:string,score:double>")


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score), one row per document row."""
    predict = predictor(model, docs)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), predict(F.col(f"`{text_col}`").cast("string")).alias("p"))
    return rows.select("doc_id", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents whose text has a known language with at least this probability, with all their columns."""
    p = predictor(model, docs)(docs["text"].cast("string"))
    return docs.filter((p["lang"] != UNKNOWN) & (p["score"] >= least))

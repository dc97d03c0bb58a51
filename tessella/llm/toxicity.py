"""Operator 2, toxicity: a linear classifier by non-negative positive-unlabelled learning.

A document is the set of its words, hashed into a fixed number of features. Confirmed toxic
documents are the positives; text without regard to its label is the unlabelled side, of which the
class prior's share is toxic too. With logistic loss l, the risk of a score f is

    prior * mean_P l(f) + max(0, mean_U l(-f) - prior * mean_P l(-f))

where the second term is what negatives would add; when it falls below zero the gradient step goes
the other way, which keeps a flexible model from driving it negative. The prior is the share of
toxic rows among the labelled training rows.

All documents that aren't held out are the unlabelled side. Words get a weight where their share of
the positives differs clearly from their share of the unlabelled, by counts over all of them. With
those words alone, documents of equal sets become one row with its counts; each step sums the risk's
gradient over that table by numpy in the tasks, in whole numbers, so that sums don't depend on order.
What reaches the driver is a few numbers for each weighed word, at most ``FEATURES`` of them.

The fit uses at most about ``max_labelled`` labelled rows, chosen by a hash of their ids beyond that
(the documented bound).

Defined results: a null or empty text has the bias alone and is scored; a very long text is read
whole; null labels are no labels, repeated ones count once; rows that share an id are scored one by
one; without a positive every score is the prior (0 without labels); an empty table gives an empty
result. Further columns, however named, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import CACHE_ENTRIES, discard, held_out, settle
from tessella.llm.quality_model import MAX_LABELLED, some

FEATURES = 1 << 20
#: Documents that must hold a word before it gets a weight, by how many standard errors its share of the
#: positives must differ from its share of the unlabelled, and by what factor. Without the last, more and more
#: common words would pass as the corpus grows, each with next to no weight.
MIN_DOCS, MIN_ERRORS, MIN_RATIO = 5, 4.0, 3.0
STEPS, RATE, DECAY = 40, 0.3, 2e-4
#: Tasks of a pass, at most, and numbers of a piece in which a task gives back its sums.
TASKS, PIECE = 512, 1024
#: Steps to one in which a document's part of a gradient is summed.
FIXED = 1 << 24
CUT = 0.5
WORD = re.compile(r"[^\W\d_]+")


class Features(dict):
    """A word's feature."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) % FEATURES
        return value

    def of(self, text: str | None) -> np.ndarray:
        words = set(WORD.findall((text or "").lower()))
        return np.unique(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int32)))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values, and the row of each."""
    lengths = np.diff(np.asarray(column.offsets))
    return np.asarray(column.flatten()), np.repeat(np.arange(len(column)), lengths)


def featured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the features of each document, ascending."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            x = _lists([features.of(t) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), x], names=["doc_id", "x"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, x array<int>")


def counted(training: DataFrame) -> DataFrame:
    """(feature, n_p, n_u): how many positive and how many of all rows of (x, toxic) hold a feature; ``FEATURES`` is in every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, FEATURES + 1), np.int64)
        for batch in batches:
            values, row = _flat(batch.column("x"))
            toxic = np.asarray(batch.column("toxic"))
            total[0] += np.bincount(values[toxic[row]], minlength=FEATURES + 1)
            total[1] += np.bincount(values, minlength=FEATURES + 1)
            total[:, FEATURES] += int(toxic.sum()), len(toxic)
        found = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[0][found]), pa.array(total[1][found])], names=["feature", "n_p", "n_u"])

    parts = training.select("x", "toxic").mapInArrow(run, "feature int, n_p long, n_u long")
    return parts.groupBy("feature").agg(F.sum("n_p").alias("n_p"), F.sum("n_u").alias("n_u"))


def weighed(counts: DataFrame, n_p: int, n_u: int) -> np.ndarray:
    """The features whose share of the positives clearly differs from that of all rows, ascending."""
    share = (F.col("n_p") + F.col("n_u")) / (n_p + n_u)
    error = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / n_p + 1 / n_u))
    of_p, of_u = F.col("n_p") / n_p, F.col("n_u") / n_u
    clear = (F.abs(of_p - of_u) >= MIN_ERRORS * error) & (F.greatest(of_p, of_u) >= MIN_RATIO * F.least(of_p, of_u))
    rows = counts.where((F.col("feature") < FEATURES) & (F.col("n_u") >= MIN_DOCS) & clear).select("feature").toArrow()
    return np.sort(np.asarray(rows.column("feature")))


def patterns(training: DataFrame, used: np.ndarray) -> DataFrame:
    """(x, n_p, n_u): the sets of weighed words, as places in ``used``, that rows of (x, toxic) hold, and how many rows do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(FEATURES, -1, np.int32)
        place[used] = np.arange(len(used))
        for batch in batches:
            values, row = _flat(batch.column("x"))
            at = place[values]
            n = np.bincount(row[at >= 0], minlength=batch.num_rows)
            x = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(at[at >= 0]))
            yield pa.RecordBatch.from_arrays([x, batch.column("toxic")], names=["x", "toxic"])

    reduced = training.select("x", "toxic").mapInArrow(run, "x array<int>, toxic boolean")
    return reduced.groupBy("x").agg(F.count_if("toxic").alias("n_p"), F.count("*").alias("n_u"))


def risk_parts(values: np.ndarray, row: np.ndarray, n_p: np.ndarray, n_u: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums over rows, in steps of 1 / ``FIXED``: of chance and of n_p, by word and over all, and of l(-f).

    Three rows: chance over positives, count of positives, chance over unlabelled; a column for each word,
    then one over all rows, then one of the losses l(-f) of positives, 0 and unlabelled.
    """
    m = len(weights) - 1
    f = np.bincount(row, weights[values], minlength=len(n_p)) + weights[-1]
    chance, loss = (np.rint(x * FIXED) for x in (1 / (1 + np.exp(-np.clip(f, -35, 35))), np.logaddexp(0, f)))
    out = np.zeros((3, m + 2))
    for i, of_row in enumerate((n_p * chance, n_p * float(FIXED), n_u * chance)):
        out[i, :m] = np.bincount(values, of_row[row], minlength=m)
        out[i, m] = of_row.sum()
    out[:, m + 1] = (n_p * loss).sum(), 0, (n_u * loss).sum()
    return out.astype(np.int64)


def gradient(parts: np.ndarray, n_p: int, n_u: int, prior: float) -> np.ndarray:
    """The direction to step against: of the risk, or of minus the negatives' part where that is below zero."""
    chance_p, count_p, chance_u = parts[:, :-1] / FIXED
    loss_p, _, loss_u = parts[:, -1] / FIXED
    of_positives, of_negatives = prior * (chance_p - count_p) / n_p, chance_u / n_u - prior * chance_p / n_p
    return of_positives + of_negatives if loss_u / n_u >= prior * loss_p / n_p else -of_negatives


def train(table: DataFrame, m: int, n_p: int, n_u: int, prior: float) -> np.ndarray:
    """Weights of m words and the bias, from ``patterns``; each step is one pass over the table."""
    weights = np.zeros(m + 1)
    weights[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, STEPS + 1):

        def run(batches: Iterator[pa.RecordBatch], weights=weights.copy()) -> Iterator[pa.RecordBatch]:
            total = np.zeros((3, m + 2), np.int64)
            for batch in batches:
                total += risk_parts(*_flat(batch.column("x")), np.asarray(batch.column("n_p")), np.asarray(batch.column("n_u")), weights)
            pieces = [total.ravel()[i : i + PIECE] for i in range(0, total.size, PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pieces), dtype=np.int32)), pa.array(pieces, pa.list_(pa.int64()))], names=["piece", "v"])

        def add(pieces: pa.Table) -> pa.Table:
            v = np.sum([np.asarray(x.values) for x in pieces.column("v")], axis=0)
            return pa.table({"piece": pieces.column("piece")[:1], "v": pa.array([v], pa.list_(pa.int64()))})

        sums = table.mapInArrow(run, "piece int, v array<long>").groupBy("piece").applyInArrow(add, "piece int, v array<long>").toArrow()
        parts = np.concatenate([np.asarray(x.values) for x in sums.sort_by("piece").column("v")]).reshape(3, m + 2).astype(float)
        g = gradient(parts, n_p, n_u, prior)
        g[:-1] += DECAY * weights[:-1]
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g**2
        weights -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights


def fit(features: DataFrame, labels: DataFrame, label_col: str, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray, float]:
    """The weighed features, their weights and bias, and the prior; no weights without a positive."""
    known = labels.where(~held_out()).where(F.col(label_col).isin(0, 1)).select("doc_id", F.col(label_col).cast("int").alias("y"))
    known = some(known.distinct(), max_labelled)
    rows, toxic = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    prior = min(0.99, toxic / rows) if rows else 0.0
    nothing = np.zeros(0, np.int32), np.zeros(0), prior
    if not toxic:
        return nothing
    positive = known.where("y = 1").select("doc_id", F.lit(True).alias("toxic"))
    training = features.where(~held_out()).join(F.broadcast(positive), "doc_id", "left").select("x", F.coalesce("toxic", F.lit(False)).alias("toxic"))
    counts = settle(counted(training))
    total = counts.where(F.col("feature") == FEATURES).select("n_p", "n_u").first()
    if not total or not total.n_p:
        return nothing
    used = weighed(counts, *total)
    table = settle(patterns(training, used))
    weights = train(table.coalesce(TASKS), len(used), *total, prior)
    discard(counts, table)
    return used, weights, prior


def scored(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", cut: float = CUT, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) per document."""
    features = settle(featured(docs, id_col, text_col))
    used, weights, prior = fit(features, labels, label_col, max_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(FEATURES)
        w[used] = weights[:-1]
        for batch in batches:
            values, row = _flat(batch.column("x"))
            f = np.bincount(row, w[values], minlength=batch.num_rows) + (weights[-1] if len(weights) else 0)
            score = 1 / (1 + np.exp(-np.clip(f, -35, 35))) if len(weights) else np.full(batch.num_rows, prior)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    out = features.mapInArrow(run, f"doc_id {features.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

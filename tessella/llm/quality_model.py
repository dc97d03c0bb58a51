"""Operator 1, quality classifier: regularised quadratic discriminant analysis.

A document becomes a vector of transformed statistics (logs of counts, logits of shares), rounded to
multiples of 1 / ``FIXED``. Per class the mean and covariance come from sums over the labelled training
rows, made by the executors in whole numbers, so that they don't depend on the order of rows. The
covariance shrinks towards the pooled one and towards a multiple of the identity. A score is the
posterior from the difference of two Gaussian log densities, whose Mahalanobis distances use the
inverse Cholesky factors, made once on the driver and kept by every task.

The fit uses at most about ``max_labelled`` labelled rows, chosen by a hash of their ids beyond that (the
documented bound); scores cover every document, each in whole however long.

Defined results: a null text counts as empty and is scored like one; a null label is no label; rows
that share an id are scored one by one, and a label counts for each of them; repeated labels count once; without two rows of each
class every score is the prior (0.5 without any label); an empty table gives an empty result. Further
columns, however named, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import WordHashes, held_out, settle, windows

POOL, RIDGE = 0.05, 0.01
CUT = 0.3
EPS = 1e-3
N_FEATURES = 16
#: Steps to one in which statistics are kept.
FIXED = 1 << 14
#: Labelled rows that a fit broadcasts: 16 bytes each.
MAX_LABELLED = 1_000_000


def _logit(x: float) -> float:
    return float(np.log((x + EPS) / (1 - x + EPS)))


def statistics(text: str, hashes: WordHashes) -> list[float]:
    """The transformed statistics of a text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digits = int(by[65:91].sum()), int(by[97:123].sum()), int(by[48:58].sum())
    stops, other = int(by[[44, 46]].sum()), int(by[33:48].sum() + by[58:65].sum() + by[91:97].sum() + by[123:127].sum())
    share = by[by > 0] / size
    if n:
        h = hashes.of(words)
        seen = np.unique(h, return_counts=True)[1]
        lengths = np.fromiter(map(len, words), np.int64, n)
        two = windows(h, 2)
        repeat, top, pairs = 1 - len(seen) / n, int(seen.max()) / n, 1 - len(np.unique(two)) / max(1, len(two))
        mean, spread = float(lengths.mean()), float(lengths.std())
    else:
        repeat = top = pairs = mean = spread = 0.0
    return [
        float(np.log1p(n)), float(np.log1p(mean)), float(np.log1p(spread)), _logit(repeat), _logit(top), _logit(pairs),
        _logit(upper / size), _logit(lower / size), _logit(digits / size), _logit(stops / size), _logit((other - stops) / size),
        _logit(int(by[32]) / size), _logit(int(by[10]) / size), _logit(int(by[128:].sum()) / size),
        float(-(share * np.log2(share)).sum()), _logit(int(by[124]) / size),
    ]


def featured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics in steps of 1 / ``FIXED``."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            x = np.array([statistics(t or "", hashes) for t in batch.column("text").to_pylist()]).reshape(-1, N_FEATURES)
            steps = pa.array(np.rint(x * FIXED).astype(np.int32).ravel())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES), steps)], names=["doc_id", "x"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, x array<int>")


def _steps(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, N_FEATURES).astype(np.int64)


class Discriminant:
    """Two Gaussians from per-class sums: how many rows, of x, of x times x."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]], pool: float = POOL, ridge: float = RIDGE):
        n = {c: sums[c][0] if c in sums else 0.0 for c in (0, 1)}
        self.prior = (n[1] + 1) / (n[0] + n[1] + 2)
        self.ready = min(n.values()) >= 2
        if not self.ready:
            return
        mean = {c: sums[c][1] / n[c] for c in (0, 1)}
        cov = {c: sums[c][2] / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)}
        pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
        over = np.outer(self.scale, self.scale)
        self.mean, self.factor, self.constant = {}, {}, {}
        for c in (0, 1):
            s = ((1 - pool) * cov[c] + pool * pooled) / over
            s = (1 - ridge) * s + ridge * np.trace(s) / len(s) * np.eye(len(s))
            lower = np.linalg.cholesky(s + 1e-9 * np.eye(len(s)))
            self.mean[c], self.factor[c] = mean[c] / self.scale, np.linalg.inv(lower)
            self.constant[c] = -np.log(np.diag(lower)).sum() + np.log(n[c] / (n[0] + n[1]))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), self.prior)
        density = {c: self.constant[c] - 0.5 * (((x / self.scale - self.mean[c]) @ self.factor[c].T) ** 2).sum(1) for c in (0, 1)}
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -35, 35)))


def some(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` of the rows by a hash of the id, or all where there are fewer."""
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64(F.lit("some"), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * most / n))


def fit(features: DataFrame, labels: DataFrame, label_col: str, max_labelled: int = MAX_LABELLED) -> Discriminant:
    """Learns from the rows of ``labels`` (doc_id, ``label_col``) that aren't held out."""
    known = labels.where(~held_out()).where(F.col(label_col).isin(0, 1)).select("doc_id", F.col(label_col).cast("int").alias("y"))
    known = some(known.distinct(), max_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + N_FEATURES + N_FEATURES**2), np.int64)
        for batch in batches:
            y, x = np.asarray(batch.column("y")), _steps(batch.column("x"))
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.r_[len(own), own.sum(0), (own.T @ own).ravel()]
        at = np.arange(total.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], len(at)), pa.int32()), pa.array(np.tile(at, 2), pa.int32()), pa.array(total.ravel())], names=["y", "at", "v"])

    parts = features.join(F.broadcast(known), "doc_id").select("y", "x").mapInArrow(run, "y int, at int, v long")
    sums = np.zeros((2, 1 + N_FEATURES + N_FEATURES**2))
    for y, at, v in parts.groupBy("y", "at").agg(F.sum(F.col("v").cast("decimal(20,0)"))).collect():
        sums[y, at] = float(v) / FIXED ** (0 if at == 0 else 1 if at <= N_FEATURES else 2)
    return Discriminant({c: (s[0], s[1 : 1 + N_FEATURES], s[1 + N_FEATURES :].reshape(N_FEATURES, N_FEATURES)) for c, s in enumerate(sums)})


def scored(docs: DataFrame, labels: DataFrame, label_col: str = "quality", cut: float = CUT, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) per document."""
    features = settle(featured(docs))
    model = fit(features, labels, label_col, max_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(_steps(batch.column("x")) / FIXED))], names=["doc_id", "score"])

    out = features.mapInArrow(run, f"doc_id {features.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

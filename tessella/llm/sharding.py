"""Operator 4, sharding by histogram sort, to shards of near-equal bytes.

Rows are ordered by (hash of the text, hash of the id): equal texts lie side by side. For every
wanted boundary the driver holds an interval of keys that surrounds it. Each round sends a few
probes per open interval to all partitions of a narrow table (key, size), which count the exact
bytes and rows below each; the intervals shrink until a probe is within tolerance of its boundary.
The driver holds so many keys for each boundary between shards, whatever the size of the corpus.
Then the documents are exchanged once, each straight to its place.

Shards are dealt further, by a hash of the row, into parts of bounded size, so that no task holds a
shard and equal texts spread: a row's slot is the number of rows in its shard's earlier parts, counted
in the narrow table, plus its rank in its part. A boundary falls between two texts where tolerance
allows and inside a group of equal texts only where it must.

Defined results: a null text has 0 bytes; a null id is one more id; rows equal in text and id are not
told apart and stay in one part, a very long text is one row of its part; an empty table gives an
empty result; further columns pass through, and where one is named as a new column, underscores go
before the new one's name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import discard, settle, unused

SHARDS = 24
#: Bytes a row counts beside those of its text.
ROW_BYTES = 8
#: How far a shard's end may lie from its place, as a share of a shard.
TOLERANCE = 0.0005
PART_BYTES = 32 << 20
PROBES = 16
END = 1 << 128


def _packed(keys: list[int]) -> np.ndarray:
    return np.frombuffer(b"".join(k.to_bytes(16, "big") for k in keys), "S16")


def _keys(h: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Pairs of signed numbers as 16 bytes that sort alike."""
    flip = np.uint64(1 << 63)
    both = np.stack([h.astype(np.int64).view(np.uint64) ^ flip, t.astype(np.int64).view(np.uint64) ^ flip], 1)
    return np.ascontiguousarray(both.astype(">u8")).view("S16").ravel()


def histogram(keys: DataFrame, probes: list[int]) -> list[tuple[int, int]]:
    """Exact (bytes, rows) below each of the sorted probes. ``keys``: h, t, size."""
    packed = _packed(probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(packed) + 1), np.int64)
        for batch in batches:
            h, t, size = (np.asarray(c) for c in batch.columns)
            at = np.searchsorted(packed, _keys(h, t), "right")
            np.add.at(total[0], at, size)
            total[1] += np.bincount(at, minlength=len(packed) + 1)
        some = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[0][some]), pa.array(total[1][some])], names=["bin", "bytes", "rows"])

    counted = np.zeros((2, len(probes) + 1), np.int64)
    for b, size, rows in keys.mapInArrow(run, "bin int, bytes long, rows long").groupBy("bin").agg(F.sum("bytes"), F.sum("rows")).collect():
        counted[:, b] = size, rows
    below = np.cumsum(counted, 1)
    return [(int(below[0, i]), int(below[1, i])) for i in range(len(probes))]


def splitters(keys: DataFrame, targets: list[tuple[float, float]], total: tuple[int, int]) -> list[tuple[int, int, int]]:
    """(key, bytes below, rows below) for each (place in bytes, tolerance)."""
    low = [(0, 0, 0)] * len(targets)
    high = [(END - 1, *total)] * len(targets)
    found: dict[int, tuple[int, int, int]] = {}
    while len(found) < len(targets):
        probes: set[int] = set()
        for i in range(len(targets)):
            if i in found:
                continue
            a, b = low[i][0], high[i][0]
            if b - a <= 1 or high[i][2] - low[i][2] <= 1:
                found[i] = min(low[i], high[i], key=lambda x: abs(x[1] - targets[i][0]))
                continue
            inner = {a + (b - a) * j // (PROBES + 1) for j in range(1, PROBES + 1)}
            between_texts = {p >> 64 << 64 for p in inner}
            probes |= {p for p in (between_texts if len(between_texts - {a}) > 1 else inner) if a < p < b} or {(a + b) // 2}
        ordered = sorted(probes)
        if not ordered:
            continue
        at = [(k, *c) for k, c in zip(ordered, histogram(keys, ordered), strict=True)]
        places = np.array([x[1] for x in at])
        for i, (place, tolerance) in enumerate(targets):
            if i in found:
                continue
            j = int(np.searchsorted(places, place, "right"))
            if j:
                low[i] = max(low[i], at[j - 1], key=lambda x: x[0])
            if j < len(at):
                high[i] = min(high[i], at[j], key=lambda x: x[0])
            near = min(low[i], high[i], key=lambda x: abs(x[1] - place))
            if abs(near[1] - place) <= tolerance:
                found[i] = near
    return [found[i] for i in range(len(targets))]


def _shard_of(cuts: list[int], h: Column, t: Column) -> Column:
    """How many of the cuts lie at or below the key (h, t)."""
    halves = [((k >> 64) - (1 << 63), (k & (1 << 64) - 1) - (1 << 63)) for k in cuts]
    return sum((((h > a) | ((h == a) & (t >= b))).cast("int") for a, b in halves), F.lit(0))


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` with ``size``, ``shard`` and ``slot`` as last columns."""
    size_of = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + ROW_BYTES
    size, shard_no, slot, h, t, part, first = unused(docs.columns, "size", "shard", "slot", "h", "t", "part", "first")
    keyed = docs.withColumns({h: F.xxhash64(text_col), t: F.xxhash64(F.col(id_col).isNull(), F.col(id_col)), size: size_of})
    keys = settle(keyed.select(F.col(h).alias("h"), F.col(t).alias("t"), F.col(size).alias("size")))
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    targets = [(total * i / shards, total / shards * TOLERANCE) for i in range(1, shards)]
    cuts = sorted(k for k, _, _ in splitters(keys, targets, (total, rows))) if rows else []
    each = max(1, math.ceil(total / shards / part_bytes))

    def place(h: Column, t: Column) -> tuple[Column, Column]:
        return _shard_of(cuts, h, t), F.pmod(F.xxhash64(h, t), F.lit(each)).cast("int")

    shard_at, part_at = place(F.col("h"), F.col("t"))
    counts = keys.groupBy(shard_at.alias(shard_no), part_at.alias(part)).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(shard_no).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = settle(counts.select(shard_no, part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(first)))
    discard(keys)
    shard_at, part_at = place(F.col(h), F.col(t))
    rank = F.row_number().over(Window.partitionBy(shard_no, part).orderBy(h, t))
    # the join is on the window's keys, so documents are exchanged once
    ranked = keyed.withColumns({shard_no: shard_at, part: part_at}).withColumn(slot, rank).join(bases, [shard_no, part])
    return ranked.select(*docs.columns, size, shard_no, (F.col(first) + F.col(slot) - 1).alias(slot))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return out.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

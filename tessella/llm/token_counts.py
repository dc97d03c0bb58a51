"""Operator 6, token counts by offset-mapped attribution.

A whole document is encoded once with a public byte-level vocabulary. Each token's span of bytes
follows from its length in the vocabulary; the spans are interval-joined to the document's sections
(its lines, each with the line feed that ends it). A token that crosses a boundary goes to the
section that holds most of its bytes, the earlier one of equals.

Defined results: a null or empty text has one empty section (0) without tokens; a very long text is
encoded whole; a null id is an id; rows that share an id, or are equal in all, each give their sections;
an empty table gives an empty result; further columns, however named, are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"


def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def sections(raw: bytes) -> np.ndarray:
    """Where the lines of a text end, in bytes; the last ends with the text."""
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(raw) else np.r_[ends, len(raw)]


def attribute(lengths: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross one of its boundaries."""
    stop = np.cumsum(lengths)
    start = stop - lengths
    first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left")
    owner = first.copy()
    for i in np.flatnonzero(first < last):
        edges = np.r_[start[i], ends[first[i] : last[i]], stop[i]]
        owner[i] = first[i] + int(np.diff(edges).argmax())
    return np.bincount(owner, minlength=len(ends)), np.bincount(owner[first < last], minlength=len(ends))


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, section, start, stop, n_tokens, n_crossing): places are bytes of the UTF-8 text."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, width = encoding(public_tokenizers.path(vocabulary))
        for batch in batches:
            out, row = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ends = sections((text or "").encode())
                n, crossing = attribute(width[encoder.encode_ordinary(text or "")], ends)
                out.append(np.stack([np.arange(len(ends)), np.r_[0, ends[:-1]], ends, n, crossing]))
                row.append(np.full(len(ends), i))
            if out:
                section, *rest = np.concatenate(out, 1)
                arrays = [batch.column("doc_id").take(pa.array(np.concatenate(row))), pa.array(section.astype(np.int32)), *map(pa.array, rest)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "section", "start", "stop", "n_tokens", "n_crossing"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, section int, start long, stop long, n_tokens long, n_crossing long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))

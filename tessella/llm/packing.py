"""Operator 3, best-fit packing by the linear grouping scheme.

Documents become token ids, those over the capacity are cut into pieces of it. Pieces are dealt by
hash into buckets of bounded size and each bucket is packed on its own, so the work spreads and no
task grows with the corpus; a bucket wastes at most a fraction of one sequence at its end.

In a bucket, large pieces are sorted and cut into groups of equal cardinality, each length rounded
up to its group's largest. With so few sizes, column generation finds configurations (how many of
each size share a sequence) that use the fewest sequences in the linear relaxation; its whole part
is taken. Actual pieces replace the rounded ones, and what is left, large and small, goes by best
fit in descending length into the gaps, then into new sequences.

Defined results: a null or empty text is the end id alone (length 1); a very long text is encoded
whole and cut; rows that share an id, or are equal in all, are packed one by one; ties in length are
broken by the order of (id, piece); an empty table gives an empty result. Further columns of documents
are left out (``with_ids`` adds the ids themselves); those of ``parts`` pass through, and where one is
named as a new column, underscores go before the new one's name.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import CACHE_ENTRIES, settle, unused

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 1
BUCKET_PIECES = 16_384
GROUPS = 96
#: Where there are more sizes than groups, groups' lengths are rounded up further to multiples of this,
#: which keeps the pricing of configurations small.
UNIT = 16
#: How far from the best relaxed solution column generation may stop.
GAP = 5e-4
#: Lengths over capacity / LARGE count as large.
LARGE = 8


class Words(dict):
    """Token ids, as bytes of 32-bit numbers, of a stretch of text without spaces or line feeds.

    The vocabulary drops white space and never merges across it, so a text's ids are those of its
    stretches in turn. A stretch is cut by the vocabulary's own pattern into parts, and each part goes
    through its merges once while it stays in the cache. Stretches that need more than lower-casing
    (other normal forms, special tokens, control characters) take the tokeniser's full way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.merges = self.full.model
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.parts: dict[str, bytes] = {}
        self[""] = b""
        # the byte-level alphabet: printable Latin-1 stands for itself, other bytes for code points from 256
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = (b for b in range(256) if b not in set(shown))
        self.alphabet = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}

    def part(self, text: str) -> bytes:
        found = self.parts.get(text)
        if found is None:
            if len(self.parts) >= CACHE_ENTRIES:
                self.parts.clear()
            shown = text if text.isascii() else text.encode().decode("latin-1").translate(self.alphabet)
            found = self.parts[text] = array("I", [t.id for t in self.merges.tokenize(shown)]).tobytes()
        return found

    def __missing__(self, stretch: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
            self[""] = b""
        plain = stretch.isascii()
        if "<|" in stretch or not (stretch.isprintable() and (plain or unicodedata.is_normalized("NFC", stretch))):
            value = array("I", self.full.encode(stretch, add_special_tokens=False).ids).tobytes()
        else:
            low = stretch.lower() if plain or "Σ" not in stretch else "".join(map(str.lower, stretch))
            if low.isalpha():
                value = self.part(low)
            elif low[-1] in ",." and low[:-1].isalpha():
                value = self.part(low[:-1]) + self.part(low[-1])
            else:
                value = b"".join(map(self.part, self.cut(low)))
        self[stretch] = value
        return value

    def ids(self, text: str) -> bytes:
        for space in "\n\t\r":
            text = text.replace(space, " ")
        return b"".join(map(self.__getitem__, text.split(" ")))


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): ids are little-endian unsigned 32-bit numbers."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = Words(public_tokenizers.path(vocabulary)), END_ID.to_bytes(4, "little")
        for batch in batches:
            out = []
            for row, text in enumerate(batch.column("text").to_pylist()):
                ids = words.ids(text or "") + end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((row, n, at // 4, len(part) // 4, zlib.crc32(part), part))
            if out:
                row, n, at, length, crc, part = zip(*out, strict=True)
                arrays = [batch.column("doc_id").take(pa.array(row)), pa.array(n, pa.int32()), *(pa.array(x, pa.int64()) for x in (at, length, crc))]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(part, pa.binary())] * with_ids, names=names)

    return source.mapInArrow(run, schema)


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(how often, how many of each size): the whole part of the best fractional solution.

    Gilmore and Gomory's column generation: the basis starts with one size per sequence; each round
    prices a new configuration by dynamic programming over the room used.
    """
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.linalg.inv(basis)
    x = inverse @ counts
    room = np.arange(capacity + 1)
    fits = room[None, :] - sizes[:, None]
    at = np.maximum(fits, 0)
    for _ in range(6 * m):
        worth = np.ones(m) @ inverse
        value, chosen = np.zeros(capacity + 1), []
        for _ in range(int(capacity // sizes.min())):
            tried = np.where(fits >= 0, value[at] + worth[:, None], -1.0)
            best = tried.argmax(0)
            top = tried[best, room]
            pick = np.where(top > value + 1e-12, best, -1)
            chosen.append(pick)
            value = np.maximum(value, top)
        if value[capacity] <= 1 + GAP:  # then no solution is better by more than this share
            break
        column, left = np.zeros(m), capacity
        for pick in reversed(chosen):
            if (i := int(pick[left])) >= 0:
                column[i] += 1
                left -= int(sizes[i])
        step = inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        inverse = np.linalg.inv(basis)
        x = np.maximum(inverse @ counts, 0)
    return [(int(n + 1e-9), basis[:, j].astype(int)) for j, n in enumerate(x) if n >= 1 - 1e-9]


class Gaps:
    """Sequences by the room they have left."""

    def __init__(self, capacity: int):
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.some = 0  # bit r: a sequence has r left

    def add(self, sequence: int, room: int) -> None:
        self.by_room[room].append(sequence)
        self.some |= 1 << room

    def best(self, length: int) -> tuple[int, int] | None:
        """The sequence with the least room that ``length`` fits in, and that room."""
        over = self.some >> length
        if not over:
            return None
        room = length + (over & -over).bit_length() - 1
        sequence = self.by_room[room].pop()
        if not self.by_room[room]:
            self.some ^= 1 << room
        return sequence, room


class Waiting:
    """Large pieces that have no place yet, by length."""

    def __init__(self, lengths: np.ndarray, pieces: list[int]):
        self.by_length: dict[int, list[int]] = {}
        for i in reversed(pieces):
            self.by_length.setdefault(int(lengths[i]), []).append(i)
        self.some = sum(1 << n for n in self.by_length)  # bit n: a piece of length n waits

    def longest(self, most: int, least: int = 0) -> tuple[int, int] | None:
        """A piece of the greatest length from ``least`` to ``most``, and that length."""
        length = (self.some & (1 << most + 1) - 1).bit_length() - 1
        if length < max(1, least):
            return None
        piece = self.by_length[length].pop()
        if not self.by_length[length]:
            self.some ^= 1 << length
        return piece, length


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of each piece."""
    order = np.argsort(-lengths, kind="stable")
    n_large = int((lengths > capacity // LARGE).sum())
    sequence, filled = np.full(len(lengths), -1, np.int64), []
    large = order[:n_large].tolist()
    waiting = Waiting(lengths, large)
    if n_large:
        few = len(waiting.by_length) <= groups
        unit = 1 if few else UNIT
        cuts = np.flatnonzero(np.diff(lengths[large], prepend=-1)).tolist() if few else sorted({n_large * i // groups for i in range(groups)})
        ranges: dict[int, list[int]] = {}  # a group's rounded length: its least length, its number
        for a, b in zip(cuts, [*cuts[1:], n_large], strict=True):
            top = min(capacity, -(-int(lengths[order[a]]) // unit) * unit)
            n = ranges.get(top, (0, 0))[1]
            ranges[top] = [int(lengths[order[b - 1]]), n + b - a]
        sizes = np.array(list(ranges))  # descending
        for often, config in configurations(-(-sizes // unit), np.array([n for _, n in ranges.values()], float), capacity // unit):
            slots = [i for i, n in enumerate(config) for _ in range(n)]
            for _ in range(often):
                room, took = capacity, []
                for at, i in enumerate(slots):
                    # the last slot takes whatever fills the sequence best
                    most = room if at == len(slots) - 1 else int(sizes[i])
                    if found := waiting.longest(min(most, room), ranges[int(sizes[i])][0]):
                        took.append(found[0])
                        room -= found[1]
                if took:
                    sequence[took] = len(filled)
                    filled.append(capacity - room)
    gaps = Gaps(capacity)
    for s, used in enumerate(filled):
        gaps.add(s, capacity - used)
    for i in [i for i in large if sequence[i] < 0] + order[n_large:].tolist():
        length = int(lengths[i])
        s, room = gaps.best(length) or (len(filled), capacity)
        if s == len(filled):
            filled.append(0)
        sequence[i] = s
        gaps.add(s, room - length)
    offset, used = np.zeros(len(lengths), np.int64), np.zeros(len(filled), np.int64)
    for i in order.tolist():
        offset[i] = used[sequence[i]]
        used[sequence[i]] += lengths[i]
    return sequence, offset


def pack(parts: DataFrame, capacity: int = CAPACITY, bucket_pieces: int = BUCKET_PIECES) -> DataFrame:
    """``parts`` (doc_id, piece, length and more) with ``sequence_id`` and ``offset`` as last columns.

    A bucket numbers its sequences from its own multiple of 2**32. Pieces are dealt by their place in
    the written table, so that equal rows spread like any others.
    """
    parts = settle(parts)
    buckets = max(1, math.ceil(parts.count() / bucket_pieces))
    bucket, sequence_id, offset_col = unused(parts.columns, "bucket", "sequence_id", "offset")
    dealt = parts.withColumn(bucket, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece"], kind="stable", ignore_index=True)
        sequence, offset = pack_lengths(frame["length"].to_numpy(), capacity)
        return frame.assign(**{sequence_id: frame[bucket] * 2**32 + sequence, offset_col: offset}).drop(columns=bucket)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields) + f", `{sequence_id}` long, `{offset_col}` long"
    return dealt.groupBy(bucket).applyInPandas(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))

"""Operator 7, benchmark decontamination by pigeonhole edit matching.

Texts and test items are lower-cased and reduced to letters and digits with one space between
words. An item of n characters may occur with up to k = n // ``ERROR_EVERY`` edits. Cut into k + 1
pieces, one piece of any such occurrence is untouched; an Aho-Corasick automaton over the pieces of
all items finds each exact hit in one pass over a text. The stretch around the hits of an item is
verified by Myers' bit-parallel distance. The items are the query set: they are read in blocks of
bounded size, and each block is held against every document.

Every occurrence is a match: where the distance falls within the budget and leaves it again, the
least distance (the first of equals) tells the match's end. Places are characters of the text itself.

Items under ``MIN_CHARS`` reduced characters are matched without edits and as whole words; being common
speech as often as leaks, they are reported by ``matches`` but are no reason for ``clean`` to drop a
document. ``unsearchable`` gives back the items without a letter or digit, the only ones not searched.

Defined results: a null or empty text matches nothing, a null item neither; very long texts are searched
whole; equal items each give a row; rows that share an id are matched one by one; empty tables give no
matches, and ``clean`` all documents; further columns are ignored by ``matches`` and kept by ``clean``.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import row_key, unused

ERROR_EVERY = 16
#: Reduced characters below which an item is matched exactly, and is no evidence for ``clean``.
MIN_CHARS = 24
#: Characters of test items whose automaton a task holds at once.
BLOCK_CHARS = 2_000_000
WORD = re.compile(r"[^\W_]+")
NAMES = ["doc_id", "item_id", "distance", "start", "stop", "item_chars"]


def reduced(text: str | None) -> str:
    return " ".join(WORD.findall((text or "").lower()))


def places(text: str) -> list[int]:
    """Where in ``text`` each character of its reduced form comes from; a space comes from the word's end."""
    low, origin = text.lower(), None
    if len(low) != len(text):
        origin = [i for i, c in enumerate(text) for _ in c.lower()]
    out: list[int] = []
    for m in WORD.finditer(low):
        if out:
            out.append(out[-1] + 1)
        out += range(m.start(), m.end()) if origin is None else origin[m.start() : m.end()]
    return out


class Pattern:
    """Myers' bit vectors of one item."""

    def __init__(self, text: str):
        self.n = len(text)
        self.ones, self.high = (1 << self.n) - 1, 1 << (self.n - 1)
        self.of: dict[str, int] = defaultdict(int)
        for i, c in enumerate(text):
            self.of[c] |= 1 << i

    def scores(self, text: str, anchored: bool = False) -> Iterator[int]:
        """After each character of ``text`` the least distance of the pattern to a stretch that ends there;
        ``anchored``: to the whole of what was read."""
        up, down, score, get = self.ones, 0, self.n, self.of.get
        for c in text:
            eq = get(c, 0)
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            more = (down | ~(xh | up)) & self.ones
            less = up & xh
            if more & self.high:
                score += 1
            elif less & self.high:
                score -= 1
            more = (more << 1 | anchored) & self.ones
            less = (less << 1) & self.ones
            up = (less | ~(xv | more)) & self.ones
            down = more & xv
            yield score


class Matcher:
    """Finds near occurrences of reduced items in reduced texts."""

    def __init__(self, items: list[str], error_every: int = ERROR_EVERY, min_chars: int = MIN_CHARS):
        self.items = items
        self.forward = [Pattern(x) for x in items]
        self.backward = [Pattern(x[::-1]) for x in items]
        self.exact = [len(x) < min_chars for x in items]
        self.budget = [0 if e else len(x) // error_every for x, e in zip(items, self.exact, strict=True)]
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (item, k) in enumerate(zip(items, self.budget, strict=True)):
            cuts = [len(item) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces[item[a:b]].append((i, b))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, where)
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, stop) of each occurrence, in places of the reduced text."""
        starts: dict[int, set[int]] = defaultdict(set)
        for end, where in self.automaton.iter(text):
            for i, offset in where:
                starts[i].add(end + 1 - offset)
        out = []
        for i in sorted(starts):
            k, n = self.budget[i], len(self.items[i])
            if self.exact[i]:
                whole = (s for s in sorted(starts[i]) if (s == 0 or text[s - 1] == " ") and text[s + n : s + n + 1] in ("", " "))
                out += [(i, 0, s, s + n) for s in whole]
                continue
            stretches: list[list[int]] = []
            for s in sorted(starts[i]):
                low, high = max(0, s - k), min(len(text), s + n + k)
                if stretches and low < stretches[-1][1]:
                    stretches[-1][1] = high
                else:
                    stretches.append([low, high])
            for low, high in stretches:
                for distance, at in minima(self.forward[i].scores(text[low:high]), k):
                    stop = low + at + 1
                    back = text[max(low, stop - n - k) : stop][::-1]
                    length = next(j for j, score in enumerate(self.backward[i].scores(back, True), 1) if score == distance)
                    out.append((i, distance, stop - length, stop))
        return out


def minima(scores: Iterator[int], most: int) -> Iterator[tuple[int, int]]:
    """(score, place) of the first least score of each run of scores within ``most``."""
    best: tuple[int, int] | None = None
    for at, score in enumerate(scores):
        if score <= most:
            best = min(best or (score, at), (score, at))
        elif best:
            yield best
            best = None
    if best:
        yield best


def unsearchable(items: DataFrame, item_text_col: str = "text") -> DataFrame:
    """The items that hold no letter or digit, all columns as they were."""
    return items.where(~F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).rlike(r"[\p{L}\p{N}]"))


def matches(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    error_every: int = ERROR_EVERY,
    min_chars: int = MIN_CHARS,
) -> DataFrame:
    """(doc_id, item_id, distance, start, stop, item_chars): places in the text, and the item's reduced length."""
    items = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).cast("string").alias("item_text"))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    kinds = [x.dataType.simpleString() for x in (source.schema["doc_id"], items.schema["item_id"])]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, distance long, start long, stop long, item_chars long"
    blocks = max(1, math.ceil((items.agg(F.sum(F.char_length("item_text"))).first()[0] or 0) / BLOCK_CHARS))
    out = None
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks)) == b).toArrow()
        texts = [reduced(t) for t in block.column("item_text").to_pylist()]
        ids = block.column("item_id").combine_chunks().filter(pa.array(map(bool, texts), pa.bool_()))
        held = [t for t in texts if t]

        def run(batches: Iterator[pa.RecordBatch], held=held, ids=ids) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(held, error_every, min_chars) if held else None
            for batch in batches if matcher else ():
                rows, found = [], []
                for row, text in enumerate(batch.column("text").to_pylist()):
                    if hits := matcher.find(reduced(text)):
                        at = places(text)
                        rows += [row] * len(hits)
                        found += [(i, distance, at[start], at[stop - 1] + 1, len(held[i])) for i, distance, start, stop in hits]
                if found:
                    item, *rest = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), ids.take(pa.array(item)), *[pa.array(x, pa.int64()) for x in rest]], names=NAMES)

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, **how) -> DataFrame:
    """The documents that hold no item of ``min_chars`` reduced characters or more; all columns as they were."""
    key = unused(docs.columns, "key")[0]
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    leaks = matches(keyed, items, key, text_col, min_chars=min_chars, **how).where(F.col("item_chars") >= min_chars)
    return keyed.join(leaks.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

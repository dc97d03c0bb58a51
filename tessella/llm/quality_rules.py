"""Operator 8, quality rules: tokeniser fertility beside plain base rules.

Every word of a text is encoded by a public SentencePiece vocabulary. Four figures follow:
tokens per word, characters per token, the share of byte-fallback tokens, and the entropy of a
text's token distribution. A text is rejected when a figure leaves the band of its language, or of
its script where the language is unknown or too rare to have a band.

All figures depend on a text's length (a mean over few tokens varies more, the entropy of many is
higher), so bands hold per language and length class: two classes to each doubling of the token
count. A band is the median plus or minus ``WIDTH`` robust standard deviations over all texts of the class
that pass the base rules, each distinct text counted once, so it follows the corpus and not a constant
nor the number of copies. A robust standard deviation is the median distance from the median, so junk must be
half of a class to move it far; and in a class, a source with more texts than the median source weighs as
that one, so a hot source does not set the band. A class too
rare for a band takes that of itself and its neighbours, then that of its language at all lengths; only a
language without any band takes its script's. Texts under ``MIN_TOKENS`` tokens are too short to judge and keep the base
verdict.

Defined results: a null text counts as none (0 words, base_failed); an empty text likewise; a very long
text is encoded whole; a null language uses the script's band; a null or absent source counts as one
source; repeated rows are judged alike; an empty table gives an empty result; further columns are ignored
by ``verdicts`` and passed on untouched by ``passing``. Verdicts depend on the rows alone, not on how they
are dealt to tasks: bands come from whole counts of rounded figures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import CACHE_ENTRIES, WordHashes, discard, row_key, settle, unused, windows

VOCABULARY = "piece_bpe_32k.model"
WINDOW = 8
MIN_WORDS = 20
MIN_TOKENS = 20
#: Least number of documents that makes a language's own band.
MIN_GROUP = 30
#: Half width of a band in robust standard deviations, and the least half width by figure.
WIDTH = 6.0
LEAST = {"tokens_per_word": 0.02, "chars_per_token": 0.02, "byte_share": 0.02, "entropy": 0.02}
#: Median distance from the median of a normal distribution, in standard deviations.
MAD = 0.6745
#: Median and median distance are taken over figures rounded to this step, so they are exact and repeatable.
STEP = 1 / 1024
#: Weight of a text in a source that is not too large.
ONE = 1 << 30
#: A text's band is that of the first of these groups that has one; the number is how many length classes
#: to either side count as the text's own, None all of them.
GROUPS = (("lang", 0), ("lang", 1), ("lang", None), ("script", 0), ("script", None))
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, tokens_per_word double, chars_per_token double, byte_share double, entropy double, script string"


class Pieces(dict):
    """A word's token ids as bytes of 32-bit numbers."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = np.array(self.model.encode(word.decode()), np.uint32).tobytes()
        return value


def script_of(text: str) -> str:
    """Script of most of a text's distinct letters: latin, cyrillic, greek, cjk, arabic, or other."""
    counts: dict[str, int] = {}
    for c in set(text):
        if c.isalpha():
            o = ord(c)
            s = "latin" if o < 0x250 or 0x1E00 <= o < 0x1F00 else "greek" if o < 0x400 else "cyrillic" if o < 0x530 else "arabic" if 0x600 <= o < 0x780 else "cjk" if 0x2E80 <= o < 0xD7B0 else "other"
            counts[s] = counts.get(s, 0) + 1
    return max(sorted(counts), key=counts.get) if counts else "other"


def base_counts(text: str, hashes: WordHashes) -> tuple[list[bytes], tuple[int, int, int, int, int]]:
    """The words of a text and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeated = 0
    if len(words) > WINDOW:
        w = windows(hashes.of(words), WINDOW)
        _, at, n = np.unique(w, return_inverse=True, return_counts=True)
        if len(n) < len(w):
            starts = np.flatnonzero(n[at] > 1)
            step = np.zeros(len(words) + 1, np.int64)
            np.add.at(step, starts, 1)
            np.add.at(step, starts + WINDOW, -1)
            repeated = int((np.cumsum(step) > 0).sum())
    return words, (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated)


def fertility(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang"), vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per document: the columns ``keep``, the base counts and the three figures."""
    source = docs.select(*[F.col(c) for c in keep], F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]) + f", {FIELDS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, hashes = Pieces(public_tokenizers.path(vocabulary)), WordHashes()
        for batch in batches:
            rows = []
            for text in batch.column(len(keep)).to_pylist():
                text = text or ""
                words, base = base_counts(text, hashes)
                ids = np.frombuffer(b"".join(map(pieces.__getitem__, words)), np.uint32)
                n = len(ids)
                if n:
                    counts = np.bincount(ids, minlength=len(pieces.is_byte))
                    used = counts[counts > 0]
                    share = used / n
                    figures = (n, n / base[0], base[1] / n, int(counts[pieces.is_byte].sum()) / n, float(-(share * np.log2(share)).sum()))
                else:
                    figures = (0, None, None, None, None)
                rows.append((*base, *figures, script_of(text)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 11
            kinds = [pa.int64()] * 6 + [pa.float64()] * 4 + [pa.string()]
            arrays = [batch.column(i) for i in range(len(keep))] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *(x.split()[0] for x in FIELDS.split(", "))])

    return source.mapInArrow(run, schema)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def length_class():
    return F.floor(2 * F.log2(F.col("n_tokens").cast("double")))


def histogram(figures: DataFrame, kind: str) -> DataFrame:
    """(``kind``, length_class, source, figure, step, n): distinct texts by rounded figure; ``kind`` is lang or script."""
    usable = figures.where(~base_failed() & (F.col("n_tokens") >= MIN_TOKENS) & F.col(kind).isNotNull())
    # equal texts have equal figures and weigh as one
    texts = usable.groupBy(kind, "length_class", "text_hash").agg(F.min("source").alias("source"), *[F.min(c).alias(c) for c in LEAST])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("figure"), F.round(F.col(c) / STEP).cast("long").alias("step")) for c in LEAST]))
    return texts.select(kind, "length_class", "source", each.alias("x")).groupBy(kind, "length_class", "source", "x.figure", "x.step").agg(F.count("*").alias("n"))


def bands(counts: DataFrame, kind: str, reach: int | None, group: str, width: float = WIDTH) -> DataFrame:
    """The low and high end of each figure's band from a ``histogram``, per ``kind`` and, unless ``reach`` is None, length class.

    The ends' names begin with ``group``.
    """
    keys = [kind] if reach is None else [kind, "length_class"]
    if reach:
        counts = counts.withColumn("length_class", F.explode(F.sequence(F.col("length_class") - reach, F.col("length_class") + reach)))
    counts = counts.groupBy(*keys, "source", "figure", "step").agg(F.sum("n").alias("n"))
    sources = counts.where(F.col("figure") == next(iter(LEAST))).groupBy(*keys, "source").agg(F.sum("n").alias("of_source"))
    groups = sources.groupBy(*keys).agg(F.sum("of_source").alias("n_texts"), F.greatest(F.median("of_source"), MIN_GROUP / F.count("*")).alias("most")).where(F.col("n_texts") >= MIN_GROUP)
    weight = F.round(F.col("n") * F.least(F.lit(1.0), F.col("most") / F.col("of_source")) * ONE).cast("long")
    steps = counts.join(sources, [*keys, "source"]).join(groups, keys).groupBy(*keys, "figure", "step").agg(F.sum(weight).alias("w"))
    whole = Window.partitionBy(*keys, "figure")
    for value, by in (("middle", F.col("step")), ("spread", F.abs(F.col("step") - F.col("middle")))):
        below = F.sum("w").over(whole.orderBy(by))
        steps = steps.withColumn("below", below).withColumn(value, F.min(F.when(F.col("below") >= F.sum("w").over(whole) - F.col("below"), by)).over(whole))
    ends = []
    for c, least in LEAST.items():
        middle, spread = (F.max(F.when(F.col("figure") == c, F.col(x))) * STEP for x in ("middle", "spread"))
        half = F.greatest(F.lit(least), width * spread / MAD)
        ends += [(middle - half).alias(f"{group}_{c}_low"), (middle + half).alias(f"{group}_{c}_high")]
    return steps.groupBy(*keys).agg(*ends)


def _source(docs: DataFrame, source_col: str):
    return F.col(source_col).cast("string") if source_col in docs.columns else F.lit(None).cast("string")


def verdicts(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: id, base counts, figures, ``base_failed`` and ``kept``."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.coalesce(_source(docs, source_col), F.lit("")).alias("source"), row_key(text_col).alias("text_hash"))
    figures = settle(fertility(source, keep=("doc_id", "lang", "source", "text_hash"))).withColumn("length_class", length_class())
    counts = {kind: settle(histogram(figures, kind)) for kind in ("lang", "script")}
    out = figures
    for i, (kind, reach) in enumerate(GROUPS):
        # written, so that Spark knows a band table's size: it broadcasts a small one, and beside a large one
        # splits the rows of a language that holds most of them
        found = settle(bands(counts[kind], kind, reach, f"band{i}"))
        out = out.join(found, [kind] if reach is None else [kind, "length_class"], "left")
    discard(*counts.values())
    inside = F.lit(True)
    for c in LEAST:
        low, high = (F.coalesce(*[f"band{i}_{c}_{end}" for i in range(len(GROUPS))]) for end in ("low", "high"))
        inside = inside & F.coalesce(F.col(c).between(low, high), F.lit(True))
    kept = ~F.col("base_failed") & ((F.col("n_tokens") < MIN_TOKENS) | inside)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.withColumn("base_failed", base_failed()).select(*names, "base_failed", kept.alias("kept"), "n_tokens", *LEAST, "lang", "script")


def passing(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents that keep their place, all columns as they were.

    Rows meet their verdict by a hash of id, language and text, so rows that share an id are told apart.
    """
    key = unused(docs.columns, "key")[0]
    keyed = docs.withColumn(key, row_key(id_col, lang_col, text_col))
    judged = verdicts(keyed.select(F.col(key), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), _source(docs, source_col).alias("source")), key)
    rejected = judged.where(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(rejected, key, "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))

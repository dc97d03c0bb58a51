"""A corpus pipeline of five operators; each stage's result is written and read again by the next.

Quality rules drop documents; line dedup takes boilerplate lines out of texts (and drops a document
of which that leaves no word); of near duplicates one document stays; documents that hold a
benchmark item go; best-fit packing returns the token pieces with their places in sequences.

Defined results: a null or empty text goes in the first stage, as it has under 20 words; a very long text
passes whole; rows that share an id are judged one by one, and of rows equal in id and text one stays; a
null id comes after all others in its group of near duplicates; a null language or source is one of its
own; an empty table gives an empty result. Further columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, line_dedup, ngram_join, packing, quality_rules
from tessella.llm.common import settle


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.passing(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs)
    changed = F.col(out.columns[-1]) > 0
    out = out.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # five-word shingles at a similarity of 0.8, the library's rule for near duplicates
    return ngram_join.representatives(docs, size=5, num=80)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram join", ngram_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: Tokenisers and edit distances have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

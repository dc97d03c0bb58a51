"""Operator 10, line dedup by distinct-site spread. Built-in functions only.

Every line with a word is hashed. One aggregation per hash merges a HyperLogLog sketch of the sites
(column ``source``) that show the line. A line far above its threshold is boilerplate, one far below is
not; those whose estimate lies within the sketch's error of the threshold get an exact count of distinct
sites. Lines under ``SHORT_CHARS`` characters (menus, headings, but also "Yes.") must be shown by twice as
many sites. Of a boilerplate line the first occurrence, by id and then position, stays; every other one
is removed.

The text is cut twice: for the sketches, and for the places of the lines that may be boilerplate, from
which exact counts and first occurrences come.

Defined results: a null text stays null with no lines; an empty text has one empty line, which like
every line without a word stays; a very long text or line is one like any other; a null site counts as
a site of its own; rows equal in id, site and text are one document and get the same result; ids may be
null (they order first); an empty table gives an empty result; further columns pass through, and where
one is named as a new column, underscores go before the new one's name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import row_key, settle, unused

MIN_SITES = 3
SHORT_CHARS = 16
LG_K = 10
WORD = r"[^\x20\x09-\x0D]"


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_sites: int, short_chars: int) -> DataFrame:
    """(id, key, site, pos, h1, h2, need): lines with a word and how many sites make each boilerplate."""
    site = F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit("null"))
    cut = docs.select(F.col(id_col).alias("id"), row_key(id_col, site_col, text_col).alias("key"), site.alias("site"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line"))
    need = F.when(F.char_length("line") < short_chars, 2 * min_sites).otherwise(min_sites)
    return cut.where(F.col("line").rlike(WORD)).select("id", "key", "site", "pos", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), need.alias("need"))


def candidates(lines: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """(h1, h2, need, sure): lines whose sketch says that enough sites may show them; ``sure`` without a count."""
    error = 3 * 1.04 / 2 ** (lg_k / 2)
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), F.count("*").alias("n"), F.min("need").alias("need")).where(F.col("n") >= F.col("need"))
    estimated = spread.select("h1", "h2", "need", F.hll_sketch_estimate("sketch").alias("estimate"))
    return estimated.where(F.col("estimate") > F.col("need") * (1 - error) - 1).select("h1", "h2", "need", (F.col("estimate") > F.col("need") * (1 + error) + 1).alias("sure"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, short_chars: int = SHORT_CHARS) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, and ``n_lines`` and ``n_removed`` as last columns."""
    lines = _lines(docs, id_col, text_col, site_col, min_sites, short_chars)
    maybe = settle(candidates(lines))
    places = settle(lines.drop("need").join(maybe, ["h1", "h2"]).select("h1", "h2", "need", "sure", "site", F.struct("id", "key", "pos").alias("at")))
    exact = places.where("NOT sure").groupBy("h1", "h2").agg(F.count_distinct("site").alias("sites"), F.min("need").alias("need")).where("sites >= need").select("h1", "h2")
    found = maybe.where("sure").select("h1", "h2").unionByName(exact)
    # written, so that the joins below have exchanges of their own and a very common line's rows can be split
    first = settle(places.groupBy("h1", "h2").agg(F.min("at").alias("first")).join(found, ["h1", "h2"], "left_semi"))
    key, drop, n_lines, n_removed = unused(docs.columns, "key", "drop", "n_lines", "n_removed")
    drops = places.join(first, ["h1", "h2"]).where(F.col("at") != F.col("first")).select(F.col("at.key").alias(key), F.col("at.pos").alias("pos"))
    drops = drops.groupBy(key).agg(F.collect_set("pos").alias(drop))
    parts = F.split(F.col(text_col), "\n", -1)
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(F.col(drop), i)), "\n")
    joined = docs.withColumn(key, row_key(id_col, site_col, text_col)).join(drops, key, "left")
    counted = joined.withColumn(n_lines, F.when(F.col(text_col).isNull(), 0).otherwise(F.size(parts)).cast("long")).withColumn(n_removed, F.coalesce(F.size(drop), F.lit(0)).cast("long"))
    return counted.withColumn(text_col, F.when(F.col(drop).isNull(), F.col(text_col)).otherwise(kept)).select(*docs.columns, n_lines, n_removed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_lines", "n_removed", "text")


SQL = f"""
WITH pieces AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, source, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM pieces
), spread AS (
  SELECT line, min((doc_id, pos)) AS first FROM lines WHERE regexp_matches(line, '{WORD}')
  GROUP BY line HAVING count(DISTINCT source) >= CASE WHEN length(line) < {SHORT_CHARS} THEN {2 * MIN_SITES} ELSE {MIN_SITES} END
), marked AS (
  SELECT l.doc_id, l.pos, l.line, s.line IS NOT NULL AND (l.doc_id, l.pos) != s.first AS gone
  FROM lines l LEFT JOIN spread s ON l.line = s.line
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
FROM marked GROUP BY doc_id
"""

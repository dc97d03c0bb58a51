"""The pipeline stage by stage against a brute-force version of each decision."""

import os

import duckdb
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tessella.llm import decontaminate, line_dedup, packing, quality_rules  # noqa: E402
from tessella.llm.common import settle  # noqa: E402
from tests.llm.test_operators import components_by_force, counts_by_force, prose  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = [f for _, f in corpus_pipeline.STAGES]

    kept = stages[0](spark, docs, SF).cache()
    assert kept.columns == columns
    verdict = {r.doc_id: r.kept for r in quality_rules.verdicts(docs).collect()}
    for r in docs.collect():
        n, *_, again = counts_by_force(r.text)
        assert not verdict[r.doc_id] or not (n < 20 or 100 * again > 30 * n)
    assert {r.doc_id for r in kept.collect()} == {i for i, k in verdict.items() if k}

    lines = stages[1](spark, kept, SF).cache()
    con = duckdb.connect()
    con.register("documents", kept.select("doc_id", "text", "source").toPandas())
    expected = {d: t for d, _, gone, t in con.execute(line_dedup.SQL).fetchall() if not gone or t.split()}
    assert lines.columns == columns and {r.doc_id: r.text for r in lines.collect()} == expected
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    single = stages[2](spark, lines, SF).cache()
    classes = components_by_force([(r.doc_id, r.text) for r in lines.collect()], 5, 80, 100)
    assert single.columns == columns and {r.doc_id for r in single.collect()} == {d for d, n, c in classes if c in (d, None)}

    clean = stages[3](spark, single, SF).cache()
    items = [decontaminate.reduced(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r.doc_id for r in clean.collect()}
    assert clean.columns == columns
    for r in single.collect():
        if any(x in decontaminate.reduced(r.text) for x in items):
            assert r.doc_id not in left
    found = {r.doc_id for r in decontaminate.matches(single, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert left == {r.doc_id for r in single.collect()} - found

    packed = stages[4](spark, clean, SF)
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in packed.collect()} == {(r.doc_id, r.piece, r.ids_crc32) for r in packing.pieces(clean).collect()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, packed.select("doc_id", "piece", "ids_crc32").collect()))


def test_edge_cases(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, key int, n_removed int, row int"
    line, item = "The same line of some length that several sites show.", spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    words = [prose(i, 60) for i in range(6)]
    rows = [
        (1, words[0]), (1, words[0]), (1, words[1]), (None, words[2]), (None, words[2]), (None, None), (2, None), (3, ""), (4, words[3] + "\n" + line), (5, words[4] + "\n" + line),
        (6, line + "\n" + prose(77, 40)), (7, f"{words[5]}\n{item}\n{prose(9, 30)}"), (8, (prose(10, 90) + "\n") * 1), (9, " ".join(prose(100 + i, 500) for i in range(40))),
    ]
    docs = spark.createDataFrame([(i, t, ["en", None][n % 2], [f"s{n}", None][n == 3], 0, 1, 2, 3) for n, (i, t) in enumerate(rows)], schema)
    for table, expected in ((docs, {1, None, 4, 5, 6, 8, 9}), (docs.where("false"), set())):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            table = settle(stage(spark, table, SF))
            assert table.columns == docs.columns
        left = [(r.doc_id, r.text) for r in table.collect()]
        assert {i for i, _ in left} == expected and len(left) == len(set(left))
        assert all(r["key"] == 1 and r["n_removed"] == 2 and r["row"] == 3 for r in table.collect())
        if left:
            assert sum(line in t for _, t in left) == 1 and sum(i == 1 for i, _ in left) == 2 and sum(i is None for i, _ in left) == 1
        packed = corpus_pipeline.STAGES[-1][1](spark, table, SF).collect()
        assert {r.doc_id for r in packed} == expected and all(r.offset + r.length <= 4096 for r in packed)

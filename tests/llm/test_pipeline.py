"""The whole pipeline on the smallest tables, each stage against a plain version of its rule on its own input."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from test_decontamination import brute as hits
from test_linededup import brute as without_lines
from test_neardup import brute as groups

DIRECTORY = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DIRECTORY.exists(), reason="given tables are not here")


def test_stages(spark, tmp_path):
    read = lambda name: spark.read.parquet(f"{DIRECTORY}/{name}.parquet")
    docs, texts = read("documents"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = texts
        stage(spark, docs, str(DIRECTORY)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
            texts = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert len(texts) == docs.count()
            assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
        if name == "toxicity":
            toxic = {r["doc_id"] for r in read("labels").where("toxic = 1").collect()}
            assert len(toxic & set(texts)) < len(toxic) and len(texts) > 150
        elif name == "line dedup":
            assert texts == without_lines(sorted(before.items()))
        elif name == "near-duplicates":
            wanted = groups(sorted(before.items()), 5, 80)
            assert texts == {i: before[i] for i, (_, c) in wanted.items() if c == i}
        elif name == "decontamination":
            items = [tuple(r) for r in read("benchmark").select("item_id", "text").collect()]
            assert texts == {i: t for i, t in before.items() if not hits(t, items)[-1]}
        elif name == "packing":
            assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == set(before)
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "packing"


def test_odd_rows_and_empty_tables_go_through(docs, spark, tmp_path):
    for name, rows, schema in (("labels", [(1, 1, 1), (2, 1, 0), (3, 1, 0), (4, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int"), ("benchmark", [(1, None), (None, "a b")], "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    full = docs([(1, None), (2, ""), (None, None), (3, "x y z"), (3, "x y z"), (4, "long text " * 5000)]).withColumn("node", F.lit(1))
    for table, pieces in ((full, 6), (full.limit(0), 0)):
        step = table
        for _, stage in corpus_pipeline.STAGES:
            step = stage(spark, step, str(tmp_path))
        assert step.where("piece = 0").count() in (pieces, pieces - 1)


def test_queries_and_their_statements(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in DIRECTORY.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    ours = set(entry.queries()) - set(entry.BASE)
    assert sorted(n.split("_")[0] for n in ours) == sorted(["pipeline", *(f"op{i}" for i in range(1, 14))])
    for name in ours & set(entry.oracle_sql()):
        df = entry.queries()[name](spark, str(DIRECTORY))
        result = con.execute(entry.oracle_sql()[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == sorted(df.columns)
        plain = lambda row: tuple(round(v, 9) if isinstance(v, float) else v for v in row)
        found = sorted((plain(r[c] for c in names) for r in df.collect()), key=str)
        assert found == sorted(map(plain, result.fetchall()), key=str)

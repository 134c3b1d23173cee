"""The pipeline's stages on a small table, and queries with SQL against DuckDB."""

import duckdb
import pytest

import corpus_pipeline
from partflow.llm import queries


def test_stages_follow_each_other(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        stage(spark, docs, data).write.parquet(path)
        docs = spark.read.parquet(path)
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert sizes[0] >= sizes[1] >= sizes[2] > 0 and sizes[3] >= 0.9 * sizes[2]
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
    assert corpus_pipeline.run(spark, data).count() == sizes[-1]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, data, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    frame = queries.QUERIES[name](spark, data)
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    order = [names.index(c) for c in frame.columns]
    assert sorted(map(str, map(tuple, frame.collect()))) == sorted(str(tuple(row[i] for i in order)) for row in found.fetchall())

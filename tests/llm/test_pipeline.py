import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from pactspark.llm import common, queries  # noqa: E402


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, seen, kept = docs.columns, [docs.count()], {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs.count())
        kept[k] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert seen[0] >= seen[1] == seen[2] >= seen[3] >= seen[4] == seen[5] > 0
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [k for k, q in labels.items() if q == 1]
    bad = [k for k, q in labels.items() if q == 0]
    assert np.mean([k in kept[0] for k in good]) > 0.95 and np.mean([k in kept[0] for k in bad]) < 0.3
    ran = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in ran} == kept[4] and all(r.round_trip for r in ran)


def test_stages_of_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).collect() == []


def test_stages_of_messy_rows(spark, sf, messy, tmp_path):
    """Nulls, ties, repeated rows and columns with names that operators use themselves: all columns keep their values."""
    docs = messy.withColumn("topic", F.lit("mine")).withColumn("removed_lines", F.lit("r")).withColumn("score", F.col("doc_id")).withColumn("copies", F.lit(None).cast("string"))
    rows = {tuple(r) for r in docs.drop("text", "n_chars").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k == len(corpus_pipeline.STAGES) - 1:
            assert all(r.round_trip for r in out.collect())
            break
        assert out.columns == docs.columns and {tuple(r) for r in out.drop("text", "n_chars").collect()} <= rows, name
        out.write.parquet(str(tmp_path / str(k)))
        if name != "quality classifier":  # few of the odd rows are good
            docs = spark.read.parquet(str(tmp_path / str(k)))


def test_intermediate_tables_are_deleted(spark, documents):
    import os

    with common.temporary(spark):
        kept = common.save(documents.limit(3), "x")
        files = [f.removeprefix("file://").removeprefix("file:") for f in kept.inputFiles()]
        assert kept.count() == 3 and all(map(os.path.exists, files))
    assert not any(map(os.path.exists, files))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_the_twin(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found, wanted = queries.queries()[name](spark, sf).toArrow(), con.execute(queries.oracle_sql()[name]).to_arrow_table()
    names = sorted(found.column_names)
    assert names == sorted(wanted.column_names)
    rows = [sorted(tuple(map(str, r)) for r in zip(*(t.column(c).to_pylist() for c in names))) for t in (found, wanted)]
    assert rows[0] == rows[1]


def test_registered():
    names = list(queries.queries())
    assert sorted({n.split("_")[0] for n in names if n.startswith("op")}) == sorted(f"op{k}" for k in range(1, 11)) and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names)

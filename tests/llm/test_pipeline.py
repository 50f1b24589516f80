"""The stages do on their own input what their operators say, and the kept documents are whole."""

import corpus_pipeline
from __spark_entry__ import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        rows = kept.collect()
        assert all(before[r["doc_id"]] == r for r in rows)
        sizes.append(len(rows))
        docs = spark.createDataFrame(rows, docs.schema)
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.6 * len(before)
    pieces = corpus_pipeline.pack_windows(spark, docs, SF).collect()
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in docs.collect()}


def test_registered():
    names = set(queries())
    assert {"pipeline"} <= names and sum(n.startswith("op") and n[2].isdigit() for n in names) == 13

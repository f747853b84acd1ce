"""The pipeline's stages on small tables, each against what its operator says."""

import pandas as pd

import corpus_pipeline


def test_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = pd.read_parquet(f"{folder}/labels.parquet").set_index("doc_id")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        rows = out.toPandas()
        assert set(rows.doc_id) <= set(docs.toPandas().doc_id) and len(rows)
        kept[name], docs = set(rows.doc_id), spark.createDataFrame(rows, docs.schema)
    clean = set(labels[(labels.toxic == 0) & (labels.quality == 1)].index)
    assert len(clean & kept["quality"]) > 0.9 * len(clean)
    texts = docs.toPandas().text
    assert texts.is_unique
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).toPandas()
    assert set(pieces.doc_id) == kept["near_duplicates"]
    assert pieces.groupby("sequence_id").length.sum().iloc[:-1].eq(2048).all()

"""The corpus pipeline: toxicity, quality, near-duplicates, packing.

Each stage works on all rows its predecessor kept. All but the last return the columns of documents; the last returns the
packed pieces. ``run`` writes each stage's rows as Parquet in the shared folder, reads them again for the next, and deletes
them when the next has written its own.

In every stage null texts count as empty, very long texts are read whole, repeated rows are judged alike, an empty table stays
empty and columns beyond those of documents stay as they are, whatever their names.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlark.llm.common import crc_fold, fresh, remove, shared_dir, table
from paperlark.llm.minhash import Params, near_duplicates
from paperlark.llm.packing import pack
from paperlark.llm.qda import fit_quality, score_quality
from paperlark.llm.toxicity import fit_toxicity, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose toxicity is under 0.5; learns from the labelled ones that are not held out.

    Where these are all alike, or none, nothing tells documents apart and all are kept. Null and empty texts are scored as any.
    """
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").where(crc_fold("doc_id") != 0))
    if not model.weights.any():
        return docs
    score = fresh(docs, "score")
    return score_toxicity(docs, model, score_col=score).where(F.col(score) < 0.5).drop(score)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose quality is 0.3 or more; learns from the labelled ones that are not held out.

    Without labels of both classes all are kept. Null and empty texts are scored as any.
    """
    model = fit_quality(docs, table(spark, sf_dir, "labels").where(crc_fold("doc_id") != 0))
    score = fresh(docs, "score")
    return score_quality(docs, model, score_col=score).where(F.col(score) >= 0.3).drop(score)


#: Links from a similarity of 0.8 on; 61 bands of 6 miss one with chance (1 - 0.8^6)^61 < 1e-8.
NEAR = Params(percent=80, bands=61)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each near-duplicate component (runs of five words, similarity 0.8 or more) the document with the smallest id.

    Rows with one id are kept or not together, whatever their texts. Texts without words, null ones and rows without an id
    are linked with nothing and kept.
    """
    gone = near_duplicates(docs, params=NEAR).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens; null and empty texts have their end token only, repeated rows one piece or more each."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), length=2048)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicate), ("packing", packing)]

#: No SQL: a trained classifier and a tokenizer are not expressible. The tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:
                remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs

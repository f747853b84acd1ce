"""Documents that keep coming, imported whole: receipts, their named items and every document's outcome, batch by batch.

What must be remembered for ever, which key was saved under which id, is Spark's own state: a batch reads its documents and the
state of its keys and nothing of what was saved before. Parsing is part of the stream's plan; only the key, the document's number
and the parsed receipt as one JSON string pass through the stateful function. Receipts, items and outcomes are written under the
batch's number, the outcomes last: a batch counts once these are there, and one that runs again after a failure writes the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paperlark.operators import flows
from paperlark.operators.receipts import parse_receipts

OUTCOMES = "seq long, outcome string, saved_id long, warned boolean, error string"
_JUDGED = "seq long, outcome string, saved_id long, warned boolean, error string, said string"
_STORED = "unique_key string, id long"


def _judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The documents of one key: the first one ever is saved, the others are its duplicates. Keyless documents have groups of their own."""
    rows = pd.concat(list(frames), ignore_index=True)  # of one key in one batch
    stored = rows[rows["stored"]]
    saved_id = state.get[0] if state.exists else int(stored["id"].min()) if len(stored) else None
    docs = rows[~rows["stored"]].sort_values("seq", kind="stable").reset_index(drop=True)
    keyed = len(rows) > 0 and bool(rows["keyed"].iloc[0])
    first = pd.Series(False, index=docs.index)
    if saved_id is None and len(docs):
        saved_id = int(docs["id"].iloc[0])
        first.iloc[0] = True
    if keyed and not state.exists and saved_id is not None:
        state.update((saved_id,))
    if len(docs):
        yield pd.DataFrame({"seq": docs["seq"], "outcome": first.map({True: "saved", False: "duplicate"}), "saved_id": saved_id, "warned": first & docs["warned"], "error": None, "said": docs["said"].where(first, None)})


def judged_documents(docs: DataFrame, *, import_id: str, stored: DataFrame | None = None) -> DataFrame:
    """A stream of docs(seq, rows) -> seq, outcome, saved_id, warned, error, and what a saved receipt says, as JSON.

    stored(unique_key, id): a stream of the receipts saved before this import; they count from the batch on that they come in.
    """
    readable = parse_receipts(docs.where("rows is not null").select(F.col("seq").cast("long").alias("seq"), "rows"))
    fine = (F.size("items") > 0) | F.col("total").isNotNull()
    said = F.to_json(F.struct(*readable.columns))
    own = readable.where(fine).select(
        F.coalesce("unique_key", F.concat(F.lit("\0"), F.col("seq").cast("string"))).alias("key"), F.col("unique_key").isNotNull().alias("keyed"), "seq", flows.new_id(import_id).alias("id"),
        (F.size("warnings") > 0).alias("warned"), said.alias("said"), F.lit(False).alias("stored"),
    )
    if stored is not None:
        known = stored.where("unique_key is not null").select(F.col("unique_key").alias("key"), F.lit(True).alias("keyed"), F.lit(-1).cast("long").alias("seq"), F.col("id").cast("long").alias("id"), F.lit(False).alias("warned"), F.lit(None).cast("string").alias("said"), F.lit(True).alias("stored"))
        own = own.unionByName(known)
    judged = own.groupBy("key").applyInPandasWithState(_judge, _JUDGED, "id long", "append", GroupStateTimeout.NoTimeout)
    none = [F.lit(None).cast("long").alias("saved_id"), F.lit(False).alias("warned")]
    odd = readable.where(~fine).select("seq", F.lit("failed").alias("outcome"), *none, flows.refusal().alias("error"), F.lit(None).cast("string").alias("said"))
    unread = docs.where("rows is null").select(F.col("seq").cast("long").alias("seq"), F.lit("failed").alias("outcome"), *none, F.lit(flows.UNREADABLE).alias("error"), F.lit(None).cast("string").alias("said"))
    return judged.unionByName(odd).unionByName(unread)


def _said_schema(spark: SparkSession) -> str:
    return parse_receipts(spark.createDataFrame([], "seq long, rows array<string>")).schema


def save_batch(batch: DataFrame, number: int, folder: str, mappings: DataFrame, catalog: DataFrame, aliases: DataFrame, *, now: int = 0) -> None:
    """Write a batch of judged documents under its number; again, it replaces itself."""
    spark, at = batch.sparkSession, f"batch={number}"
    batch = batch.persist()
    try:
        saved = batch.where("outcome = 'saved'").select(F.col("saved_id").alias("id"), F.from_json("said", _said_schema(spark)).alias("r")).select("id", "r.*")
        receipts = saved.select("id", *flows.receipt_columns(), F.array_join("rows", "\n").alias("ocr_text"), F.lit(now).cast("long").alias("created_at"))
        receipts.write.mode("overwrite").parquet(f"{folder}/receipts/{at}")
        # the batch's documents are held already, so that nothing more is kept for the naming of their items
        flows.items_of_parsed(saved, mappings, catalog, aliases, keep=lambda df: df).write.mode("overwrite").parquet(f"{folder}/items/{at}")
        batch.drop("said").write.mode("overwrite").parquet(f"{folder}/outcomes/{at}")
    finally:
        batch.unpersist()


def import_stream(docs: DataFrame, folder: str, checkpoint: str, mappings: DataFrame, catalog: DataFrame, aliases: DataFrame, *, import_id: str, stored: DataFrame | None = None, now: int = 0) -> StreamingQuery:
    """Import what a stream of docs(seq, rows) brings; ``saved`` reads the tables. The answer is the running query."""
    judged = judged_documents(docs, import_id=import_id, stored=stored)
    write = lambda batch, number: save_batch(batch, number, folder, mappings, catalog, aliases, now=now)
    return judged.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def saved(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table 'receipts', 'items' or 'outcomes' of an import, of the batches that are wholly written."""
    whole = spark.read.parquet(f"{folder}/outcomes").select("batch").distinct()
    rows = spark.read.parquet(f"{folder}/{name}")
    return rows.join(F.broadcast(whole), "batch", "left_semi").drop("batch")  # a number for each batch


def stored_keys(spark: SparkSession, path: str) -> DataFrame:
    """The receipts saved before (Parquet with unique_key and id), as a stream that comes in one batch."""
    return spark.readStream.schema(_STORED).parquet(path)

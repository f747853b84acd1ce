"""Receipts that keep coming: running counts, suppression of repeats, and saving batch by batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlark.operators.ingest import split_new
from paperlark.sources.shared import checkpoint_dir


def watch_folder(spark: SparkSession, path: str, schema: str, files_at_once: int = 64) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).option("recursiveFileLookup", True).parquet(path)


def running_counts(stream: DataFrame, column: str = "outcome") -> DataFrame:
    """Counts so far of each value; the state is one row for each value."""
    return stream.groupBy(column).agg(F.count("*").alias("n"))


def first_seen(stream: DataFrame, key: str = "unique_key") -> DataFrame:
    """The first row of each key ever; rows without a key all pass.

    State grows with the number of keys, as the meaning asks: a watermark would let old keys in again.
    """
    keyed = stream.where(F.col(key).isNotNull()).dropDuplicates([key])
    return keyed.unionByName(stream.where(F.col(key).isNull()))


def save_batches(stream: DataFrame, folder: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame], *, rows_col: str = "rows", buckets: int = 256):
    """Parse each batch and save what is new, under the batch's own number, so that a batch that runs again after a failure
    replaces itself. Saved keys are kept apart, in ``buckets`` folders by their hash: a batch reads only the buckets that
    its own keys fall into. Documents with null rows are not parsed; their number and that of each outcome, one row of
    counters for each batch, go to the folder's ``outcomes``."""

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("unique_key"), F.lit(buckets)).cast("int")
        readable = F.col(rows_col).isNotNull() if rows_col in batch.columns else F.lit(True)
        batch = batch.persist()
        parsed = parse(batch.where(readable)).persist()
        try:
            own = [r.b for r in parsed.where("unique_key is not null").select(bucket.alias("b")).distinct().collect()]  # buckets at most
            stored = spark.createDataFrame([], "unique_key string, batch long, bucket int")
            if _exists(spark, f"{folder}/keys"):
                stored = spark.read.schema("unique_key string, batch long, bucket int").parquet(f"{folder}/keys").where(F.col("bucket").isin(own))
            judged = split_new(parsed, stored.where(F.col("batch") != number).select("unique_key")).persist()
            saved = judged.where("outcome = 'saved'").drop("outcome")
            saved.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
            keys = saved.where("unique_key is not null").select("unique_key", bucket.alias("bucket"), F.lit(number).cast("long").alias("batch"))
            keys.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{folder}/keys")
            counted = judged.groupBy("outcome").agg(F.count("*").alias("n")).union(batch.where(~readable).groupBy(F.lit("failed")).agg(F.count("*")))
            counted.write.mode("overwrite").parquet(f"{folder}/outcomes/batch={number}")
            judged.unpersist()
        finally:
            parsed.unpersist(), batch.unpersist()

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def drain_counts(counts: DataFrame) -> DataFrame:
    """Run a stream of running counts over all that is there now; its few rows come as a table in memory."""
    spark, name = counts.sparkSession, f"counts_{uuid.uuid4().hex}"
    counts.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint_dir(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def drain(stream: DataFrame) -> DataFrame:
    """Run a stream that only appends over all that is there now, into Parquet in the shared folder."""
    folder = checkpoint_dir(stream.sparkSession)
    stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")

"""What the operators share: the folder that all executors see, fresh column names, whole texts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset a local master, as in tests, gets a temporary one, and a
    cluster an error: its machines share no temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not (found := spark.sparkContext.getCheckpointDir()):
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="paperlark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; its files survive lost executors."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new local path in the shared folder for files that workers memory-map; the folder must be a mounted one."""
    root = shared_dir(spark)
    scheme, _, rest = root.partition(":")
    if rest and scheme not in ("file",):
        raise ValueError(f"memory-mapped files need a shared folder that is mounted on every worker, not {root}")
    root = "/" + rest.lstrip("/") if rest else root
    path = os.path.join(root, f"{name}-{uuid.uuid4().hex}")
    return path


#: Rows of an Arrow batch at most: texts are long, and a worker and its executor hold some batches at a time.
BATCH_ROWS = 1000


def bounded(df: DataFrame) -> DataFrame:
    """df; its session then sends no more rows in an Arrow batch than BATCH_ROWS, and runs all kinds of Python functions in
    one pool of workers (Spark keeps a second one, with its memory, for functions with shortened tracebacks)."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    conf.set("spark.sql.execution.pyspark.udf.simplifiedTraceback.enabled", "false")
    return df


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def whole(text: str | Column) -> Column:
    """The whole text, the empty one for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def crc_fold(doc_id: str, folds: int = 5) -> Column:
    """crc32 of the id's decimal text, modulo folds; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds, F.lit(0))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], texts: int = 1, *, rows: int = 400, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts (a column's number) of each hold no more bytes than size, unless it is one text alone."""
    for batch in batches:
        ends = pc.cumulative_sum(pc.cast(pc.fill_null(pc.binary_length(batch.column(texts)), 0), "int64")).to_pylist()
        first, base = 0, 0
        for i in range(1, batch.num_rows + 1):
            if i == batch.num_rows or i - first >= rows or ends[i] - base > size:
                yield batch.slice(first, i - first)
                first, base = i, ends[i - 1]

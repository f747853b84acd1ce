"""Several tables that change as one: each version is a folder of its own, and one small file names the version that counts.

A writer writes all tables of a new version and then switches the pointer by one rename. Until then readers see the old version
whole, also when the writer fails between two tables; a version may be computed from the one that it replaces. The version before
the current one stays for readers that are under way; older ones and those of failed writers are deleted with the next switch.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, folder: str) -> dict | None:
    """What the pointer says: version, before (the version it replaced), and number; None where nothing was written yet."""
    try:
        stream = _files(spark, folder).open(_path(spark, f"{folder}/{POINTER}"))
    except Py4JJavaError as error:
        if "FileNotFoundException" in str(error.java_exception):
            return None
        raise
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _switch(spark: SparkSession, folder: str, told: dict) -> None:
    files, own = _files(spark, folder), f"{folder}/.{POINTER}-{uuid.uuid4().hex}"
    out = files.create(_path(spark, own))
    out.write(bytearray(json.dumps(told).encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    rename = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = hadoop.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(_path(spark, own)), files.makeQualified(_path(spark, f"{folder}/{POINTER}")), options)


def write_snapshot(folder: str, tables: dict[str, DataFrame], number: int = 0) -> None:
    """Replace all tables of the folder by these, at once. number is kept with the version, as a batch's own."""
    spark = next(iter(tables.values())).sparkSession
    old, version = current(spark, folder), f"version-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{version}/{name}")
    _switch(spark, folder, {"version": version, "before": old and old["version"], "number": number})
    files, live = _files(spark, folder), {version, old and old["version"]}
    for status in files.listStatus(_path(spark, folder)):
        if (name := status.getPath().getName()).startswith("version-") and name not in live:
            files.delete(status.getPath(), True)


def read_snapshot(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the current version."""
    told = current(spark, folder)
    if told is None:
        raise FileNotFoundError(f"{folder} has no {POINTER}")
    return spark.read.parquet(f"{folder}/{told['version']}/{name}")

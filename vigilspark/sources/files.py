"""Ledger files: reading, writing, and not replacing a good one by a bad run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class TooFewRows(ValueError):
    """A new ledger is too small to replace the old one."""


def read_ledger_csv(spark: SparkSession, path: str, schema: T.StructType | str, encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header, read with a fixed schema; a byte order mark before the first header is no part of it."""
    return spark.read.option("header", True).option("enforceSchema", True).option("encoding", encoding).option("multiLine", True).schema(schema).csv(path)


def read_ledger_json(spark: SparkSession, path: str, schema: T.StructType | str, records: str) -> DataFrame:
    """Rows of the array ``records`` of JSON documents."""
    return spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode(records).alias("_r")).select("_r.*")


def write_ledger(df: DataFrame, path: str, fmt: str = "parquet", keys: list[str] | None = None, partition_by: list[str] | None = None) -> None:
    """Write a ledger, rows sorted by ``keys`` over all files."""
    if keys:
        df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def guarded_overwrite(new: DataFrame, path: str, min_rows: int) -> int:
    """Write ``new`` beside ``path`` and check it before it replaces what is there: at least ``min_rows`` rows,
    or TooFewRows and the old ledger stays.  Returns the rows written.

    The old ledger is moved aside (``.old``) before the new one takes its place, and only then deleted, so a
    crash leaves one of them whole."""
    beside = f"{path}.next"
    new.write.mode("overwrite").parquet(beside)
    spark = new.sparkSession
    rows = spark.read.parquet(beside).count()
    jvm = spark.sparkContext._jvm
    source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (beside, path))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if rows < min_rows:
        fs.delete(source, True)
        raise TooFewRows(f"{rows} rows, fewer than {min_rows}; {path} stays as it is")
    old = jvm.org.apache.hadoop.fs.Path(f"{path}.old")
    if fs.exists(target):
        fs.delete(old, True)
        fs.rename(target, old)
    fs.rename(source, target)
    fs.delete(old, True)
    return rows

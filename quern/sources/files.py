"""Readers and writers: Parquet, CSV, JSON documents, row ids, digests, idempotent and cleaned outputs."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.plans.experiment import FEATURES, FLAGS

#: The raw experiment file: features as doubles, flags as small integers.
RAW_SCHEMA = T.StructType([T.StructField(n, T.DoubleType()) for n in FEATURES] + [T.StructField(n, T.ByteType()) for n in FLAGS])
ROWS_PER_GROUP_BYTES = 16 << 20


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below ``spark.checkpoint.dir``; a temporary folder only where a local session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='quern-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/quern/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all that this application has written as scratch; call it once its results have been read or saved."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch(spark, "x")).getParent()
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its rows, and their order in files, stay as they are."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_count(spark: SparkSession, path: str) -> DataFrame:
    """(rows) of a Parquet table, from its footers: no column is read."""
    return spark.read.parquet(path).select().agg(F.count(F.lit(1)).alias("rows"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = RAW_SCHEMA, partitions: int | None = None) -> DataFrame:
    """A CSV file with a header, gzipped or not; a gzipped file can't be split, so ``partitions`` deals its rows out.

    With ``schema=None``, as for result tables, the types are inferred.
    """
    reader = spark.read.option("header", True)
    rows = reader.schema(schema).option("enforceSchema", False).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return rows.repartition(partitions) if partitions else rows


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """Columns and predicate reach the scan."""
    rows = spark.read.parquet(path)
    if where:
        rows = rows.where(where)
    return rows.select(*columns) if columns else rows


def with_row_ids(spark: SparkSession, path: str, name: str = "source_row_id") -> DataFrame:
    """Dense physical row numbers over one or many Parquet files, in order of file names.

    Counts per file come from the footers; only they are ordered in one place.
    """
    from pyspark.sql import Window

    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(offsets, "_file").withColumn(name, F.col("_row") + F.col("_before")).drop("_file", "_row", "_before")


def write_parquet(df: DataFrame, path: str, *, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    out = df.write.mode(mode).option("compression", "zstd").option("parquet.block.size", ROWS_PER_GROUP_BYTES)
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def write_csv(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """A small result table as one CSV file with a header."""
    df.coalesce(1).write.mode(mode).option("header", True).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def create_if_absent(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, made only if it isn't there (complete) yet."""
    if not exists(spark, f"{path}/_SUCCESS"):
        write_parquet(make(), path)
    return spark.read.parquet(path)


def remove_generated(spark: SparkSession, folder: str, suffixes: tuple[str, ...]) -> list[str]:
    """Deletes the files of one folder, not below it, that have one of these suffixes; returns their names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    if fs.exists(p):
        for s in fs.listStatus(p):
            name = s.getPath().getName()
            if s.isFile() and name.endswith(suffixes):
                fs.delete(s.getPath(), False)
                gone.append(name)
    return sorted(gone)


def file_sha256(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file of any size, read as a stream."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def table_sha256(spark: SparkSession, path: str) -> str:
    """SHA-256 over the digests of all files of a table, in any order; a task reads a file (up to 2 GB) at a time, and only digests come to the driver."""
    found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("digest")).collect()
    return hashlib.sha256("".join(sorted(r.digest for r in found)).encode()).hexdigest()


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect()))


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    text = json.dumps(value, indent=2, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def describe(df: DataFrame) -> DataFrame:
    """The schema as rows of (column_name, column_type, is_nullable)."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column_name string, column_type string, is_nullable boolean")

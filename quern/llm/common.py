"""Shared helpers of the text operators: tables, the shared scratch folder, written stages."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one is set only where a local session names none (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='quern-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def small_batches(df: DataFrame, rows: int = 512) -> DataFrame:
    """``df``, to be handed to Python in batches of at most ``rows`` rows: whole texts may be long.

    The limit is a setting of the session, read when a job runs; it is lowered, never raised.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(name, "10000"))
    if now > rows or now <= 0:
        df.sparkSession.conf.set(name, str(rows))
    return df


def with_text(docs: DataFrame, keep: list[str], text_col: str):
    """(rows for Python, fields of ``keep``, function from a batch to its texts); a text that is kept isn't sent twice.

    ``text_col`` may be a field, as in ``d.text``, at any depth of a kept struct ``d``.
    """
    outer, _, inner = text_col.partition(".")
    if outer in keep:
        rows, at = docs.select(*keep), keep.index(outer)
        read = lambda b: reduce(pa.StructArray.field, inner.split(".") if inner else [], b.column(at))
    else:
        rows = docs.select(*keep, F.col(text_col).alias("text_for_python"))
        read = lambda b: b.column(len(keep))
    return small_batches(rows), rows.schema.fields[: len(keep)], read


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the application's own part of the shared folder (see ``clear_scratch``)."""
    return f"{shared_dir(spark)}/quern/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all that this application has written as scratch; call it once its results have been read or saved."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quern/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str, **options) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends here, and lost executors cost no recomputation; ``options`` are the writer's."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: keys that are broadcast as hot, at most; any other key has at most a 10,000th of all rows
HOT_KEYS = 10_000


def hot_keys(found: DataFrame, key: str, *, least: int = 256) -> DataFrame | None:
    """The keys of ``found`` (a written table of one row a key, n its number of rows elsewhere) with over ``least`` rows and over a ``HOT_KEYS``-th of all; None if there are none."""
    total = found.agg(F.sum("n")).first()[0] or 0
    hot = found.where(F.col("n") > max(least, total // HOT_KEYS)).select(key)
    return None if hot.isEmpty() else hot


def lookup_join(rows: DataFrame, found: DataFrame, key: str, *, hot: DataFrame | None, share: int = 64) -> DataFrame:
    """``rows`` joined with ``found`` (one row a key); rows of ``hot`` keys are dealt to ``share`` tasks each.

    ``hot`` (see ``hot_keys``) has at most ``HOT_KEYS`` rows and is broadcast.
    """
    if hot is None:
        return rows.join(found.hint("merge"), key)
    named = F.broadcast(hot.select(F.col(key).alias("hot_key")))
    others = [F.col(c) for c in rows.columns]
    turn = F.pmod(F.xxhash64(*others), F.lit(share)) if len(others) > 1 else F.floor(F.rand(1) * share)
    turn = F.when(F.col("hot_key").isNull(), 0).otherwise(turn).cast("int")
    left = rows.join(named, F.col(key) == F.col("hot_key"), "left").select(*rows.columns, turn.alias("turn"))
    turns = F.when(F.col("hot_key").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(share - 1)))
    right = found.join(named, F.col(key) == F.col("hot_key"), "left").select(*found.columns, F.explode(turns).alias("turn"))
    return left.join(right.hint("merge"), [key, "turn"]).drop("turn")


def dropped(df: DataFrame) -> None:
    """Deletes the files behind a ``written`` table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

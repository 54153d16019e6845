"""Stages that resume: tables kept under a hash of what made them, published as a whole, reused or made again.

A stage's key is its name, its configuration and the fingerprint of each input.  Its table is written beside its place and then moved there, so
a reader sees all of it or nothing, and a run that dies leaves nothing that looks whole.  A manifest holds the key and the number of
rows; a table that doesn't fit its manifest is made again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.artifacts import canonical_hash
from quern.sources.files import exists, read_json, write_json


def fingerprint(df: DataFrame) -> dict:
    """Columns, rows and an order-free sum of row hashes, from one scan."""
    names = sorted(df.columns)
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in names]).cast("decimal(20,0)")).alias("sum")).first()
    kinds = dict(df.dtypes)
    return {"columns": {c: kinds[c] for c in names}, "rows": row.rows, "sum": str(row["sum"] or 0)}


class Stages:
    """Stored tables below one folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _stored(self, place: str, digest: str) -> DataFrame | None:
        """The table at ``place`` if all of it is there; the manifest has its schema, since an empty table may have no files."""
        if not exists(self.spark, f"{place}/manifest.json") or not exists(self.spark, f"{place}/table/_SUCCESS"):
            return None
        found = read_json(self.spark, f"{place}/manifest.json")
        table = self.spark.read.schema(T.StructType.fromJson(found["schema"])).parquet(f"{place}/table")
        return table if found["key"] == digest and found["rows"] == table.count() else None

    def table(self, name: str, configuration: dict, inputs: dict[str, DataFrame], make: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
        """The stage's table and how it came about: ``built``, ``reused``, or ``repaired`` if what was there wasn't whole."""
        digest = canonical_hash({"name": name, "configuration": configuration, "inputs": {k: fingerprint(v) for k, v in inputs.items()}})
        place = f"{self.folder}/{name}/{digest}"
        stored = self._stored(place, digest)
        if stored is not None:
            return stored, "reused"
        old, fs = self._fs(place)
        how = "repaired" if fs.exists(old) else "built"
        beside = f"{self.folder}/{name}/.{uuid.uuid4().hex}"
        try:
            made = make()
            made.write.option("compression", "zstd").parquet(f"{beside}/table")
            write_json(self.spark, {"key": digest, "schema": made.schema.jsonValue(), "rows": self.spark.read.schema(made.schema).parquet(f"{beside}/table").count()}, f"{beside}/manifest.json")
            fs.delete(old, True)
            if not fs.rename(self._fs(beside)[0], old):
                raise OSError(f"{place} can't be published")
        finally:
            fs.delete(self._fs(beside)[0], True)
        return self.spark.read.schema(made.schema).parquet(f"{place}/table"), how

    def keys(self, name: str) -> int:
        """How many versions of a stage are stored."""
        p, fs = self._fs(f"{self.folder}/{name}")
        return sum(not s.getPath().getName().startswith(".") for s in fs.listStatus(p)) if fs.exists(p) else 0

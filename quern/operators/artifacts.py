"""Prediction artifacts, canonical hashes, and the freeze and lock protocol."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.scalar import is_finite
from quern.sources.files import exists, read_json, write_json

# Names and order of an artifact's columns.
PREDICTION_COLUMNS = ["source_row_id", "split", "outcome_name", "model_name", "treatment", "observed_outcome", "uplift_hat", "model_config_hash", "source_file_sha256"]


def canonical_hash(value) -> str:
    """SHA-256 of a value as compact ASCII JSON with sorted keys (a fixed format: equal configurations must have equal hashes)."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()


def prediction_artifact(rows: DataFrame, score: str, *, split: str, outcome: str, model: str, config_hash: str, source_hash: str, observed: str | None = None) -> DataFrame:
    """The nine columns of a prediction; without ``observed`` the outcome is a typed null."""
    seen = F.col(observed).cast("tinyint") if observed else F.lit(None).cast("tinyint")
    return rows.select(
        F.col("source_row_id").cast("long").alias("source_row_id"), F.lit(split).alias("split"), F.lit(outcome).alias("outcome_name"), F.lit(model).alias("model_name"),
        F.col("treatment").cast("tinyint").alias("treatment"), seen.alias("observed_outcome"), F.col(score).cast("float").alias("uplift_hat"), F.lit(config_hash).alias("model_config_hash"), F.lit(source_hash).alias("source_file_sha256"),
    )


def artifact_checks(artifact: DataFrame, *, split: str, outcome: str, model: str, config_hash: str, source_hash: str) -> DataFrame:
    """Violations of what a blinded artifact must be, in one scan."""
    other = lambda c, v: F.count_if(~F.col(c).eqNullSafe(F.lit(v)))
    n = F.count(F.lit(1))
    return artifact.agg(
        n.alias("rows"), other("split", split).alias("wrong_split"), other("outcome_name", outcome).alias("wrong_outcome"), other("model_name", model).alias("wrong_model"),
        F.count_if(F.col("observed_outcome").isNotNull()).alias("unblinded_rows"), F.count_if(~is_finite(F.col("uplift_hat"))).alias("nonfinite_scores"),
        other("model_config_hash", config_hash).alias("wrong_config"), other("source_file_sha256", source_hash).alias("wrong_source"), (n - F.count_distinct("source_row_id")).alias("repeated_ids"),
    )


def violations(checks: DataFrame) -> list[str]:
    row = checks.first().asDict()
    return sorted(k for k, v in row.items() if k != "rows" and v)


def handoff_checks(artifacts: DataFrame, outcomes: list[str], models: list[str], config_hash: str, source_hash: str) -> DataFrame:
    """Violations of what the scores of all models and outcomes must share before test outcomes are read.

    ``artifacts`` are prediction artifacts in long form.  Every outcome and model must score the same ids, each
    once and with one arm, blinded, and under one configuration and source.
    """
    pairs = len(outcomes) * len(models)
    wanted = F.col("outcome_name").isin(outcomes) & F.col("model_name").isin(models)
    other = lambda c, v: F.count_if(~F.col(c).eqNullSafe(F.lit(v)))
    per_id = artifacts.where(wanted).groupBy("source_row_id").agg(
        F.count_distinct("outcome_name", "model_name").alias("pairs"), F.count(F.lit(1)).alias("rows"), F.count_distinct("treatment").alias("arms")
    )
    ids = per_id.agg(
        F.count(F.lit(1)).alias("ids"), F.count_if(F.col("pairs") < pairs).alias("ids_not_in_all"), F.count_if(F.col("rows") > F.col("pairs")).alias("repeated_ids"), F.count_if(F.col("arms") != 1).alias("ids_of_two_arms")
    )
    rows = artifacts.agg(
        (F.lit(pairs) - F.count_distinct(F.when(wanted, F.struct("outcome_name", "model_name")))).alias("missing_artifacts"), F.count_if(~wanted).alias("rows_of_others"),
        F.count_if(F.col("observed_outcome").isNotNull()).alias("unblinded_rows"), other("model_config_hash", config_hash).alias("wrong_config"), other("source_file_sha256", source_hash).alias("wrong_source"),
    )
    return ids.withColumn("k", F.lit(1)).join(F.broadcast(rows.withColumn("k", F.lit(1))), "k").drop("k")  # one row


class Protocol:
    """Frozen specifications in a folder: models are frozen, the evaluation is locked with all its inputs, and done once per lock."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}.json"

    def _read(self, name: str) -> dict | None:
        return read_json(self.spark, self._path(name)) if exists(self.spark, self._path(name)) else None

    def freeze(self, config: dict, source_hash: str) -> str:
        digest = canonical_hash(config)
        write_json(self.spark, {"model_config_hash": digest, "source_file_sha256": source_hash, "test_outcomes_used": False}, self._path("FROZEN"))
        return digest

    def check_frozen(self, config: dict, source_hash: str) -> None:
        found = self._read("FROZEN")
        if found is None or found["model_config_hash"] != canonical_hash(config) or found["source_file_sha256"] != source_hash:
            raise ValueError("the frozen specification doesn't belong to this configuration and source")

    def lock(self, evaluation: dict, *, inputs: dict | None = None) -> None:
        """Locks the specification and the hashes of its ``inputs`` (handoff, baselines, stability tables)."""
        locked = {"evaluation_hash": canonical_hash(evaluation), "input_hash": canonical_hash(inputs or {}), "test_outcomes_used": False}
        write_json(self.spark, locked, self._path("EVALUATION_SPEC"))

    def evaluate(self, evaluation: dict, run, *, inputs: dict | None = None, again: bool = False):
        """Runs ``run()`` once under the locked specification and inputs, and notes that test outcomes were used.

        A second run under the same lock is refused unless ``again`` says that it replays the first.
        """
        found, done = self._read("EVALUATION_SPEC"), self._read("TEST_EVALUATED")
        if found is None or found["evaluation_hash"] != canonical_hash(evaluation) or found["input_hash"] != canonical_hash(inputs or {}):
            raise ValueError("the evaluation differs from what was locked")
        if done and (done["evaluation_hash"], done["input_hash"]) == (found["evaluation_hash"], found["input_hash"]) and not again:
            raise ValueError("the test outcomes have been used under this lock")
        out = run()
        write_json(self.spark, found | {"test_outcomes_used": True}, self._path("TEST_EVALUATED"))
        return out

    def memoised(self, name: str, key: dict, make):
        """The stored result under ``name`` if its key is the same, else a new one."""
        digest = canonical_hash(key)
        found = self._read(name)
        if found and found["key"] == digest:
            return found["value"]
        value = make()
        write_json(self.spark, {"key": digest, "value": value}, self._path(name))
        return value

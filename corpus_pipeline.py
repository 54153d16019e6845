"""From raw documents to packed training sequences, in five written stages.

1. quality: documents that the rule ensemble scores below 0.3 go.
2. language: documents without a letter, or whose cosine with every language prototype is not above that of noise
   (0.15; 0 for documents of fewer than 30 letters, which can't be told from noise), go.
3. near_dedup: of documents that a Jaccard similarity of 0.8 or more of their word 5-grams connects, found by SimHash, that with
   the least id stays.
4. decontaminate: documents that overlap a benchmark item go.
5. packing: what is left becomes sequences of at most 2048 tokens.

Every stage works on all that the one before it kept.  Rows with a null id take part like any others;
in near_dedup they stay only where no row of their group has an id, one for each text.  Of rows of
equal ids that stay, near_dedup keeps one.  Null and empty texts: quality scores them like any other
text, language rejects them.  Empty tables give empty results; further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import scratch_path, table, written
from quern.llm.decontaminate import decontaminated
from quern.llm.language import FEW_LETTERS, LEAST_SCORE, NOISE_SCORE, UNDETERMINED, fit_languages, identify
from quern.llm.packing import pack
from quern.llm.quality import THRESHOLD, fit_quality, score_quality
from quern.llm.simhash import similar_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = score_quality(docs.select(F.struct("*").alias("d")), model, ["d"], text_col="d.text")
    return scored.where(F.col("score") >= THRESHOLD).select("d.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prototypes = fit_languages(docs)
    found = identify(docs.select(F.struct("*").alias("d")), prototypes, ["d"], text_col="d.text")
    few = F.length(F.regexp_replace("d.text", r"[^\p{L}]+", "")) < FEW_LETTERS
    known = (F.col("score") > NOISE_SCORE) | ((F.col("score") > LEAST_SCORE) & few)
    return found.where((F.col("lang_pred") != UNDETERMINED) & known).select("d.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    no_id = F.col("d.doc_id").isNull()
    key = F.struct(no_id.alias("no_id"), F.col("d.doc_id").alias("doc_id"), F.when(no_id, F.xxhash64("d.text")).alias("text_hash"))  # ids come first
    rows = docs.select(F.struct("*").alias("d")).select("d", key.alias("key"))
    found = similar_documents(rows, id_col="key", text_col="d.text")
    stays = found.where(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    stays = written(stays, "survivors")
    kept = rows.join(stays.hint("merge"), "key")  # survivors grow with the corpus: never broadcast
    if stays.where("n > 1").isEmpty():
        return kept.select("d.*")
    # of rows of one key, that with the least hash of its text
    return kept.groupBy("key").agg(F.min_by("d", F.xxhash64("d.text")).alias("d")).select("d.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: No stage but decontamination can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table ``documents``; each stage is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs

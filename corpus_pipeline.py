"""A corpus from raw documents to token files, in five stages.

Each stage reads what the one before has written. Language ID drops documents
without letters and those that no trained language codes in under `MAX_BITS`
bits a byte; near-dedup keeps one document of each group; decontamination
drops documents that hold a benchmark window; mixing repeats or leaves out
documents so that sources reach their target weights; the last stage writes
token files and reports them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm import decontaminate, langid, mixing, near_dup, token_bin
from loomstat.llm.common import scratch_path, table
from loomstat.llm.queries import _fold, tokenizer_path

#: Near copies share this many percent of their five-word shingles or more.
NEAR_PERCENT = 80
#: Natural text codes at 2 to 4 bits a byte, random bytes at 6 to 8.
MAX_BITS = 6.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.where(~_fold(4)))
    seen = langid.predict(model, docs)
    return seen.where((F.col("lang_pred") != "und") & (F.col("bits_per_byte") <= MAX_BITS)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs, percent=NEAR_PERCENT).select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(*docs.columns)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_bin.token_digest(docs, tokenizer_path=tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_files", write_token_files),
]

#: Language models, similarity joins and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

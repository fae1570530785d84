"""Corpus pipeline: documents through the operators of glossloom.llm, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps,
with the columns that documents have; the last returns the tokens. What a stage
decides: the quality classifier drops documents that it rejects; line dedup
drops lines found in ten documents or more, and keeps n_chars in step where the
table has it; near-dedup keeps one document of each group of similar texts;
decontamination drops documents that hold a benchmark passage; the encoder
gives each text's token ids, and the digest of what they decode to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossloom.llm import bpe, decontaminate, line_dedup, quality_resample, simhash_dedup
from glossloom.llm.common import checkpointed

RANKS = "byte_bpe_multi_50k.tiktoken"


#: Rows of an Arrow batch; workers hold a few batches at once, beside what earlier stages left them.
BATCH_ROWS = 2000


def _small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return quality_resample.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    out = line_dedup.drop_lines(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return simhash_dedup.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    encoded = bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return encoded.select("doc_id", "n_tokens", "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("SimHash near-dedup", near_copies), ("benchmark decontamination", benchmark), ("byte-level BPE", tokens)]
#: SQL has no SimHash, no fitted ratio and no BPE; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs

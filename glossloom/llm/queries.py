"""The queries of this subpackage: thin calls of its operators, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossloom.llm import ann, bpe, chat_format, decontaminate, html_extract, line_dedup, quality_resample, simhash_dedup, substring_dedup, url_filters


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    ours = spark.createDataFrame([(-1, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    talk = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(ours)
    return chat_format.digest(chat_format.formatted_parts(chat_format.events_of(talk)))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_resample.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.digest(simhash_dedup.near_duplicates(_read(spark, sf_dir, "documents")))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.removed_spans(_read(spark, sf_dir, "documents")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.counted(_read(spark, sf_dir, "documents")))


#: The list's history: list, kind, value, action, days after 2024-01-01.
URL_CHANGES = (
    ("spam", "domain", "example.net", "add", 100),
    ("spam", "domain", "example.net", "remove", 400),
    ("spam", "domain", "example.net", "add", 600),
    ("spam", "host", "blog.tionsh.example.com", "add", 30),
    ("spam", "host", "tionble.example.org", "add", 0),
    ("spam", "host", "tionble.example.org", "remove", 365),
    ("adult", "host", "m.ththhe.example.com", "add", 200),
    ("adult", "prefix", "www.ththre.example.net/en/", "add", 50),
    ("adult", "prefix", "www.ththre.example.net/en/", "add", 60),
    ("adult", "domain", "ththon.example.org", "add", 10),
    ("adult", "domain", "ththon.example.org", "remove", 500),
    ("adult", "domain", "ththon.example.org", "add", 500),
)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no fetch times, so a page is taken to be fetched as many days after 2024-01-01 as its id says, modulo two years."""
    day = F.lit("2024-01-01").cast("date")
    changes = spark.createDataFrame(URL_CHANGES, "list string, kind string, value string, action string, days int").withColumn("since", F.date_add(day, F.col("days")))
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", F.date_add(day, F.pmod("page_id", F.lit(730)).cast("int")).alias("fetched"))
    return url_filters.judged(pages, changes)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.encode(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.digest(html_extract.extract(_read(spark, sf_dir, "pages")))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


_ALL = (op1_chat_format, op2_quality_classifier, op3_simhash_dedup, op4_substring_dedup, op5_line_dedup, op6_url_filters, op7_benchmark_decontamination, op8_byte_bpe, op9_html_extraction, op10_nearest_neighbours)
QUERIES = {f.__name__: f for f in _ALL}

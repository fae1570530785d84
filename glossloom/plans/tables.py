"""Views over the tables that several queries share, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossloom.functions import text as T
from glossloom.operators import lines as L
from glossloom.profiles import LATIN


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def read_texts(spark: SparkSession, d: str, table: str) -> DataFrame:
    """A table whose texts are worked on row by row: one that is read in fewer tasks than there are cores is dealt out first."""
    df, cores = read(spark, d, table), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def document_lines(spark: SparkSession, d: str) -> DataFrame:
    return L.lines(read_texts(spark, d, "documents").select("doc_id", "text"), "doc_id", F.col("text"))


def benchmark_lines(spark: SparkSession, d: str) -> DataFrame:
    return L.lines(read(spark, d, "benchmark"), "item_id", F.col("text"))


def page_text():
    """Pages are one long line; blocks begin new ones."""
    out = F.col("html")
    for tag in ("<h1>", "<p>", "<footer>"):
        out = F.replace(out, F.lit(tag), F.lit("\n" + tag))
    return out


def page_lines(spark: SparkSession, d: str) -> DataFrame:
    return L.lines(read_texts(spark, d, "pages").select("page_id", "html"), "page_id", page_text())


def words(column: str = "raw"):
    return T.words(T.normalized(F.col(column), LATIN))


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as lines with links: an assistant's turn of over 300 characters is taken to point at its length's hundred."""
    own = F.when((F.col("role") == "assistant") & (F.length("text") > 300), F.floor(F.length("text") / 100).cast("long"))
    return read(spark, d, "conversations").select("conv_id", "turn", "role", own.alias("own"))


# --- the same in SQL --------------------------------------------------------------------------------------------------
SQL_DOCUMENT_LINES = "lines AS (SELECT doc_id AS id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS raw FROM (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS l FROM documents))"
SQL_BENCHMARK_LINES = "blines AS (SELECT item_id AS id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS raw FROM (SELECT item_id, string_split_regex(text, '\\r?\\n') AS l FROM benchmark))"
SQL_PAGE_LINES = "plines AS (SELECT page_id AS id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS raw FROM (SELECT page_id, string_split_regex(replace(replace(replace(html, '<h1>', chr(10) || '<h1>'), '<p>', chr(10) || '<p>'), '<footer>', chr(10) || '<footer>'), '\\r?\\n') AS l FROM pages))"
SQL_TURNS = "turns AS (SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND length(text) > 300 THEN floor(length(text) / 100)::BIGINT END AS own FROM conversations)"


def sql_quotes(x: str) -> str:
    out = f"regexp_replace({x}, '[׳''’‘´]{{2}}', '\"', 'g')"
    return f"regexp_replace(regexp_replace({out}, '[׳''’‘´]', '''', 'g'), '[״\"“”″‟„]', '\"', 'g')"


def sql_normalized(x: str) -> str:
    out = f"lower({sql_quotes(f'regexp_replace({x}, ' + chr(39) + '<[^>]*>' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')})"
    out = f"regexp_replace({out}, '[\\x{{0300}}-\\x{{036f}}]', '', 'g')"
    out = f"regexp_replace({out}, '[^a-z0-9''\"]+', ' ', 'g')"
    out = f"regexp_replace({out}, '(^| )[''\"]+', '\\1', 'g')"
    out = f"regexp_replace({out}, '\"+([.:]*(?: |$))', '\\1', 'g')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def sql_words(x: str) -> str:
    return f"list_filter(string_split({sql_normalized(x)}, ' '), lambda w: w <> '')"


def sql_low_words(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(regexp_replace(lower({x}), '[\\x{{0300}}-\\x{{036f}}]', '', 'g'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"

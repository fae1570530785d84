"""Exact word runs between short passages and lines, by an equality join of word trigrams.

A run of three words or more is a trigram shared at one difference of places;
consecutive ones make longer runs. Nothing is compared pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHORTEST = 3


def grams(rows: DataFrame, keys: list[str], words: Column, at: str, n: int = SHORTEST) -> DataFrame:
    """keys, place (from 0), gram."""
    # no filter on the words and no inner explode: both would work the words out once more
    long = rows.select(*keys, words.alias("w"))
    gram = F.transform("w", lambda x, i: F.when(i <= F.size("w") - n, F.concat_ws(" ", x, *(F.get("w", i + k) for k in range(1, n)))))
    return long.select(*keys, F.posexplode_outer(gram).alias(at, "gram")).where(F.col("gram").isNotNull())


def places(rows: DataFrame, keys: list[str], words: Column, at: str, n: int = SHORTEST) -> DataFrame:
    """keys, place (from 0), and the n words from there on in columns of their own: word_0, word_1, ..."""
    # every word of the texts passes here: it is joined as it is, and no string is made of it and the next ones.
    # An array that can't be null spares the planner's filter on it, which would work the words out once more.
    sure = F.coalesce(words, F.array().cast("array<string>"))
    each = rows.select(*keys, sure.alias("w")).select(*keys, "w", F.posexplode_outer("w").alias(at, "word_0"))
    return each.select(*keys, at, "word_0", *(F.get("w", F.col(at) + k).alias(f"word_{k}") for k in range(1, n))).where(F.col(f"word_{n - 1}").isNotNull())


def runs(passages: DataFrame, lines: DataFrame, passage_keys: list[str], line_keys: list[str], *, n: int = SHORTEST) -> DataFrame:
    """Maximal shared runs: keys, s and d (where they begin, from 0), n_words. Passages and lines are both grams, or both places."""
    shared = [c for c in passages.columns if c not in (*passage_keys, "s")]
    hits = passages.join(lines, shared).select(*passage_keys, *line_keys, "s", "d", (F.col("d") - F.col("s")).alias("diagonal"))
    along = Window.partitionBy(*passage_keys, *line_keys, "diagonal").orderBy("s")
    island = hits.withColumn("island", F.col("s") - F.row_number().over(along))
    return island.groupBy(*passage_keys, *line_keys, "diagonal", "island").agg(F.min("s").alias("s"), F.min("d").alias("d"), (F.count("*") + n - 1).alias("n_words")).drop("diagonal", "island")


def best_lines(found: DataFrame, passage_keys: list[str], line_keys: list[str], *, start_words: int = 3, k: int | None = 1) -> DataFrame:
    """For each passage its k lines of the longest run that begins early in the passage; ties to the first line. Without k all its lines, and no rank, as ranks would bring all lines of a passage to one task."""
    per = found.where(F.col("s") < start_words).groupBy(*passage_keys, *line_keys).agg(F.max("n_words").alias("n_words"))
    if k is None:
        return per
    order = Window.partitionBy(*passage_keys).orderBy(F.desc("n_words"), *line_keys)
    return per.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

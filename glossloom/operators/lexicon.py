"""Word statistics of a collection of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossloom.functions import similarity as S
from glossloom.functions import text as T
from glossloom.profiles import HEBREW, Script


def idf_words(raw: Column, script: Script = HEBREW) -> Column:
    """Words as the statistics count them: quotes part words here, so quoted words have no entry."""
    out = F.lower(raw) if script.lower else raw
    out = F.regexp_replace(F.regexp_replace(out, f"[{script.marks}]", ""), f"[^{script.letters}0-9]+", " ")
    return F.filter(F.split(out, " "), lambda w: w != "")


def document_frequency(ls: DataFrame, script: Script = HEBREW, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, word, n_lines that hold it, ratio of all lines (blank ones too)."""
    total = ls.groupBy(*keys).agg(F.count("*").alias("total"))
    held = ls.select(*keys, F.explode(F.array_distinct(idf_words(F.col("raw"), script))).alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("n_lines"))
    joined = held.join(total, list(keys)) if keys else held.crossJoin(total)
    return joined.select(*keys, "word", "n_lines", (F.col("n_lines") / F.col("total")).alias("ratio"))


def weights(frequency: DataFrame, script: Script = HEBREW) -> DataFrame:
    """word, base weight, idf factor and the weight that both give."""
    base, factor = S.word_weight(F.col("word"), script), S.idf_factor(F.col("ratio"))
    return frequency.select("word", base.alias("base"), factor.alias("factor"), S.combined_weight(base, factor).alias("weight"))


def opening_ratio(ls: DataFrame, script: Script = HEBREW) -> DataFrame:
    """word, how many content lines it opens, share of them that it opens."""
    rows = ls.where("NOT is_header").where(T.trimmed(F.col("raw")) != "")
    # lines without a word have an empty one: with a null, a join on the word would put a filter before the count, which works the words out once more
    first = rows.select(F.coalesce(F.get(T.words(T.normalized(F.col("raw"), script)), 0), F.lit("")).alias("word"))
    # the words and the total are made of the same counts, so the texts are read once
    counts = first.groupBy("word").agg(F.count_if(F.col("word") != "").alias("n"), F.count_if(F.col("word") == "").alias("wordless"))
    total = counts.agg(F.sum(F.col("n") + F.col("wordless")).alias("total"))
    return counts.where("n > wordless").crossJoin(total).select("word", "n", (F.col("n") / F.col("total")).alias("ratio"))

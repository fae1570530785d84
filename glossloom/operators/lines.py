"""Documents to lines, lines to segments, segments to the segments they answer to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossloom.functions import text as T
from glossloom.profiles import HEBREW, Script

MAIN_TITLE = "תוכן ראשי"


def lines(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """id, line_no (from 1), raw, is_header. A null text has no lines, an empty one has one."""
    # an outer explode, as the planner would add a filter before an inner one and so cut every text twice
    cut = docs.select(F.col(id_col).alias("id"), F.posexplode_outer(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n")).alias("at", "raw"))
    return cut.where("at IS NOT NULL").select("id", (F.col("at") + 1).alias("line_no"), "raw", T.is_header(F.col("raw")).alias("is_header"))


def content(raw: Column) -> Column:
    """A line's text: markup goes, but headers keep it."""
    return F.when(raw.rlike(T.HEADER), raw).otherwise(T.strip_markup(raw))


def numbered(ls: DataFrame) -> DataFrame:
    """Lines with seg_no: how many headers came up to the line."""
    up_to = Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return ls.withColumn("seg_no", F.sum(F.col("is_header").cast("int")).over(up_to))


def segments(ls: DataFrame) -> DataFrame:
    """id, seg_no, title, header_line, start_line, end_line. Without headers a document is one segment; lines before the first header are in none."""
    per = numbered(ls).groupBy("id", "seg_no").agg(
        F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.min_by("raw", "line_no").alias("top")
    )
    per = per.withColumn("headers", F.max("seg_no").over(Window.partitionBy("id")))
    whole = F.col("headers") == 0
    out = per.where(whole | (F.col("seg_no") > 0))
    return out.select(
        "id",
        F.col("seg_no"),
        F.when(whole, F.lit(MAIN_TITLE)).otherwise(T.header_title(F.col("top"))).alias("title"),
        F.when(whole, 0).otherwise(F.col("first")).alias("header_line"),
        F.when(whole, 1).otherwise(F.col("first") + 1).alias("start_line"),
        F.col("last").alias("end_line"),
    )


def _phrases(titles: DataFrame, key: str, lengths: DataFrame) -> DataFrame:
    """Each title with the shorter runs of its words (column phrase) that are as long as one of lengths (n)."""
    words = titles.withColumn("w", F.split(key, " ")).crossJoin(F.broadcast(lengths.agg(F.collect_set("n").alias("lengths"))))
    shorter = F.filter("lengths", lambda n: n < F.size("w"))
    each = words.withColumn("n", F.explode_outer(shorter)).where("n IS NOT NULL").withColumn("place", F.explode_outer(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)))
    return each.withColumn("phrase", F.array_join(F.slice("w", F.col("place"), F.col("n")), " ")).drop("w", "lengths", "n", "place")


def aligned(commentary: DataFrame, target: DataFrame, script: Script = HEBREW) -> DataFrame:
    """Each segment of commentary (id, seg_no, title) with its first segment of target (id, seg_no, title) of the same title, else the first whose title holds it or is held; null if there is none.

    Titles are compared as such, each once: with equal ones and with the runs of
    words that one of the other side can be. Of the segments of a title only the
    first counts, so no pair of segments is ever made.
    """
    c = commentary.select("id", "seg_no", T.header_key(F.col("title"), script).alias("key"))
    t = target.select(F.col("id").alias("t_id"), F.col("seg_no").alias("t_seg"), T.header_key(F.col("title"), script).alias("t_key"))
    asked = c.select("key").where("key <> ''").distinct()
    there = t.where("t_key <> ''").groupBy("t_key").agg(F.min(F.struct("t_id", "t_seg")).alias("at"))
    lengths = lambda df, k: df.select(F.size(F.split(k, " ")).alias("n"))
    hit = lambda held: F.struct(F.lit(held).alias("held"), "at.t_id", "at.t_seg").alias("hit")
    same = there.select(F.col("t_key").alias("key"), hit(False))
    holds = _phrases(there, "t_key", lengths(asked, "key")).groupBy(F.col("phrase").alias("key")).agg(F.min(hit(True)).alias("hit"))
    held = _phrases(asked, "key", lengths(there, "t_key")).join(there, F.col("phrase") == F.col("t_key")).select("key", hit(True))
    best = same.unionByName(holds).unionByName(held).groupBy("key").agg(F.min("hit").alias("hit"))
    return c.join(best, "key", "left").select("id", "seg_no", F.col("hit.t_id").alias("t_id"), F.col("hit.t_seg").alias("t_seg"))


def first_aligned(alignment: DataFrame) -> DataFrame:
    """For each document the first segment that is aligned; what stands before is front matter."""
    return alignment.where(F.col("t_seg").isNotNull()).groupBy("id").agg(F.min("seg_no").alias("first_seg"))

"""Lists of lines as an editor shows them: found by text, sorted, grouped by target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossloom.profiles import APPROVED_AT

ORDERS = ("book", "score_up", "score_down")


def matching(rows: DataFrame, query: str) -> DataFrame:
    """rows (line_no, raw, target_raw) of which either text holds the query, in any case, or whose number it is. An empty query keeps all."""
    q = query.strip().lower()
    if not q:
        return rows
    holds = lambda c: F.coalesce(F.lower(F.col(c)).contains(q), F.lit(False))
    return rows.where(holds("raw") | holds("target_raw") | (F.col("line_no").cast("string") == q))


def score(linked: Column, confidence: Column) -> Column:
    """0 without a link; a link without a confidence counts as just approved."""
    return F.when(linked, F.coalesce(confidence, F.lit(APPROVED_AT))).otherwise(0)


def ordered(rows: DataFrame, order: str = "book") -> DataFrame:
    """rows (line_no, line_index_2, confidence) in book order or by score, ties in book order."""
    if order not in ORDERS:
        raise ValueError(f"no such order: {order}")
    if order == "book":
        return rows.orderBy("line_no")
    by = score(F.col("line_index_2").isNotNull(), F.col("confidence"))
    return rows.orderBy(by.asc() if order == "score_up" else by.desc(), "line_no")


def by_target(links: DataFrame) -> DataFrame:
    """Links gathered by where they point: target (primary, rashi or tosafot), line, sources (in order)."""
    target = F.coalesce("secondary_target", F.lit("primary"))
    return links.groupBy("id", target.alias("target"), F.col("line_index_2").alias("line")).agg(F.array_sort(F.collect_list("line_index_1")).alias("sources"))


def target_key(links: DataFrame) -> Column:
    """One comparable value for where a link points."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat_ws("|", text("line_index_2"), text("secondary_target"), text("secondary_line_index"))


def latest_first(sessions: DataFrame) -> DataFrame:
    """Saved projects (id, title, saved_at) that have an id and a time, the latest first."""
    return sessions.where("id IS NOT NULL AND saved_at IS NOT NULL").orderBy(F.desc("saved_at"), "id")

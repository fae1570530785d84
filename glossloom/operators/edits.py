"""Changing links by hand: who inherits from whom, and what an edit does to those below.

Links are rows (id, line_index_1, line_index_2, is_inherited, confidence,
status, ...); lines are rows (id, line_no, breaks, blank, continues,
label_only), where continues says that a line only goes on with what the line
above quotes, by its wording or because it was marked so by hand.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossloom.functions.similarity import Words
from glossloom.operators.resolve import match_range
from glossloom.profiles import BULK_APPROVED_AT

TARGET = ("line_index_2", "he_ref_2", "path_2", "secondary_target", "secondary_line_index", "secondary_ref")


def with_marks(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """lines, where those in marks (id, line_no) continue too."""
    marked = marks.select("id", "line_no", F.lit(True).alias("by_hand")).distinct()
    return lines.join(marked, ["id", "line_no"], "left").withColumn("continues", F.col("continues") | F.col("by_hand").isNotNull()).drop("by_hand")


def index(lines: DataFrame, links: DataFrame) -> DataFrame:
    """id, line_no, role (head or member), parent, pending, n_followers of content lines.

    A head has a link of its own, or none and does not continue; members follow
    the head above. A header cuts that off unless the first line after it
    continues. A line that only names a book and has no link has no role.
    pending: a member without link waits for its head, which has none either.
    """
    linked = links.select("id", F.col("line_index_1").alias("line_no"), F.coalesce("is_inherited", F.lit(False)).alias("inherited"), F.lit(True).alias("linked"))
    rows = lines.join(linked, ["id", "line_no"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    by = Window.partitionBy("id").orderBy("line_no")
    content = ~F.col("breaks") & ~F.col("blank")
    next_continues = F.first(F.when(content, F.col("continues")), ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing))
    cuts = F.col("breaks") & ~F.coalesce(next_continues, F.lit(False))
    rows = rows.withColumn("chain", F.sum(cuts.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where(content & (F.col("linked") | ~F.col("label_only")))
    head = F.when(F.col("linked"), ~F.col("inherited")).otherwise(~F.col("continues"))
    rows = rows.withColumn("head", head)
    chain = Window.partitionBy("id", "chain").orderBy("line_no")
    above = chain.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("parent", F.when(~F.col("head"), F.last(F.when(F.col("head"), F.col("line_no")), ignorenulls=True).over(above)))
    rows = rows.withColumn("parent_linked", F.last(F.when(F.col("head"), F.col("linked")), ignorenulls=True).over(above))
    rows = rows.withColumn("island", F.sum(F.col("head").cast("int")).over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    below = F.count("*").over(Window.partitionBy("id", "chain", "island")) - 1
    waits = ~F.col("head") & ~F.col("linked") & F.col("parent").isNotNull() & ~F.col("parent_linked")
    return rows.select("id", "line_no", F.when(F.col("head"), "head").otherwise("member").alias("role"), "parent", waits.alias("pending"), F.when(F.col("head"), below).alias("n_followers"))


def cascaded(links: DataFrame, roles: DataFrame, heads: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """links after those of heads (id, line_no) changed: members below them point where their head points now, or nowhere if it has no link.

    A member keeps its lemma, else takes that of lemmas (id, line_index_1,
    dh_text); its match range belonged to another line and goes (rematched
    finds the new one); its candidates stay only if the head's target, in the
    primary source, is one of them, which then is the current one.
    """
    changed = roles.where("role = 'member'").join(heads.select("id", F.col("line_no").alias("parent")), ["id", "parent"]).select("id", F.col("line_no").alias("line_index_1"), "parent")
    keep = links.join(changed.select("id", "line_index_1"), ["id", "line_index_1"], "left_anti")
    own = [c for c in links.columns if c not in ("id", "line_index_1")]
    new = links.select("id", F.col("line_index_1").alias("parent"), *(F.col(c).alias(f"new_{c}") for c in own))
    rows = changed.join(new, ["id", "parent"]).join(links, ["id", "line_index_1"], "left")
    follow = {c: F.col(f"new_{c}") for c in own if c in TARGET} | {"is_inherited": F.lit(True)} | {c: F.coalesce(c, F.col(f"new_{c}")) for c in ("confidence", "status") if c in own}
    gone = lambda c: F.lit(None).cast(links.schema[c].dataType)
    if "match_range" in own:
        follow["match_range"] = gone("match_range")
    if "candidates" in own:
        place = F.array_position(F.transform("candidates", lambda c: c["line_num"].cast("long")), F.col("new_line_index_2").cast("long")) - 1
        stays = place >= 0
        if "secondary_target" in own:
            stays &= F.col("new_secondary_target").isNull()
        follow["candidates"] = F.when(stays, F.col("candidates"))
        if "candidate_index" in own:
            follow["candidate_index"] = F.when(stays, place).cast(links.schema["candidate_index"].dataType)
    if lemmas is not None and "dh_text" in own:
        rows = rows.join(lemmas.select("id", "line_index_1", F.col("dh_text").alias("own_lemma")), ["id", "line_index_1"], "left")
        follow["dh_text"] = F.coalesce("dh_text", "own_lemma")
    return keep.unionByName(rows.select("id", "line_index_1", *(follow.get(c, F.col(c)).alias(c) for c in own)).select(*links.columns))


def edited(links: DataFrame, edits: DataFrame) -> DataFrame:
    """links with those of edits (id, line_index_1, line_index_2; null: remove) put in their place, as set by hand."""
    rest = links.join(edits.select("id", "line_index_1"), ["id", "line_index_1"], "left_anti")
    by_hand = {"is_inherited": F.lit(False), "confidence": F.lit(100).cast(links.schema["confidence"].dataType), "status": F.lit("approved")}
    have = set(edits.columns)
    new = edits.where("line_index_2 IS NOT NULL").select(*(F.col(c) if c in have else by_hand.get(c, F.lit(None)).cast(links.schema[c].dataType).alias(c) for c in links.columns))
    return rest.unionByName(new)


def next_candidate(links: DataFrame) -> DataFrame:
    """links with candidates moved on to the next one, the first after the last."""
    n = F.size("candidates")
    at = F.when(n > 0, (F.coalesce("candidate_index", F.lit(0)) + 1) % n)
    there = F.get("candidates", at)
    # the match range was of the line left
    new = {"candidate_index": at, "line_index_2": there["line_num"], "confidence": there["confidence"], "match_range": F.lit(None)}
    return links.select(*(F.when(at.isNotNull(), new[c].cast(links.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in links.columns))


def rematched(links: DataFrame, targets: DataFrame) -> DataFrame:
    """links with the match range worked out where there is a lemma and none. targets: id, secondary_target (null: the primary source), line_no, raw."""
    there = targets.select(F.col("id").alias("t_id"), F.col("secondary_target").alias("t_of"), F.col("line_no").alias("t_line"), F.col("raw").alias("t_raw"))
    rows = links.join(there, (F.col("id") == F.col("t_id")) & F.col("secondary_target").eqNullSafe(F.col("t_of")) & (F.col("line_index_2") == F.col("t_line")), "left").drop("t_id", "t_of", "t_line")

    def run(batches):
        say = Words()
        for batch in batches:
            out = batch["match_range"].to_pylist()
            for i, (lemma, raw) in enumerate(zip(batch["dh_text"].to_pylist(), batch["t_raw"].to_pylist(), strict=True)):
                if out[i] is None and lemma and raw:
                    out[i] = match_range(say, raw, lemma)
            at = batch.schema.get_field_index("match_range")
            field = batch.schema.field(at)
            yield batch.set_column(at, field, pa.array(out, field.type)).drop_columns(["t_raw"])

    return rows.mapInArrow(run, links.schema)


def approved(links: DataFrame, at: int = BULK_APPROVED_AT) -> DataFrame:
    return links.withColumn("status", F.when(F.col("confidence") >= at, "approved").otherwise(F.col("status")))


def clamped(links: DataFrame, n_words) -> DataFrame:
    """Highlights (word_start, word_count) pulled back inside lines of n_words words."""
    start = F.greatest(F.lit(0), F.least(F.col("highlight.word_start"), n_words - 1))
    count = F.greatest(F.lit(1), F.least(F.col("highlight.word_count"), n_words - start))
    return links.withColumn("highlight", F.when(n_words > 0, F.struct(start.cast("int").alias("word_start"), count.cast("int").alias("word_count"))))

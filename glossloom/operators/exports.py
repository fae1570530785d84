"""What becomes of links: files, the same links read from the other side, spans in the text, score reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossloom.functions import similarity as S
from glossloom.profiles import HEBREW, Script

FIELDS = ("line_index_1", "line_index_2", "he_ref_2", "path_2", "connection_type")


def csv_field(c: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), '"', '""'), F.lit('"'))


def csv_line(*columns: Column) -> Column:
    return F.concat_ws(",", *map(csv_field, columns))


def reference(book: Column, title: Column) -> Column:
    return F.when(title != "", F.concat(book, F.lit(" - "), title)).otherwise(book)


def reverse(links: DataFrame, titles: DataFrame, book: str) -> DataFrame:
    """Links read from the target: titles (line, title) are those of the commentary, book is its name. Grouped by the book that owns the first line."""
    of = F.coalesce(F.concat(F.when(F.col("secondary_target") == "rashi", 'רש"י').when(F.col("secondary_target") == "tosafot", "תוספות"), F.lit(" על ")), F.lit(""))
    named = links.join(titles.select(F.col("line").alias("line_index_1"), "title"), "line_index_1", "left")
    return named.select(
        of.alias("owner"),
        F.col("line_index_2").alias("line_index_1"),
        F.col("line_index_1").alias("line_index_2"),
        reference(F.lit(book), F.coalesce("title", F.lit(""))).alias("he_ref_2"),
        F.lit(f"{book}.txt").alias("path_2"),
        F.lit("commentary").alias("connection_type"),
    )


def mirrored(links: DataFrame, mirror: DataFrame) -> DataFrame:
    """Links to a secondary, moved to the primary line that the secondary's line belongs to; lines that the mirror lacks go."""
    return links.join(mirror, (F.col("secondary_target") == F.col("series")) & (F.col("line_index_2") == F.col("comm_line"))).select("line_index_1", F.col("src_line").alias("line_index_2"))


def highlighted(line: Column, spans: Column) -> Column:
    """The line with <b> around each span (word_start, word_count); spans and blanks between words stay as they are."""
    tokens = F.regexp_extract_all(line, F.lit(r"(\s*\S+\s*?)(?=\s|$)"), 1)
    last = F.size(tokens) - 1

    def mark(token: Column, i: Column) -> Column:
        start = lambda s: F.greatest(F.lit(0), F.least(s["word_start"], last))
        end = lambda s: F.least(last, start(s) + F.greatest(F.lit(1), s["word_count"]) - 1)
        opens, closes = F.exists(spans, lambda s: start(s) == i), F.exists(spans, lambda s: end(s) == i)
        blank, word = F.regexp_extract(token, r"^(\s*)", 1), F.regexp_replace(token, r"^\s+", "")
        return F.concat(blank, F.when(opens, "<b>").otherwise(""), word, F.when(closes, "</b>").otherwise(""))

    return F.array_join(F.transform(tokens, mark), "")


def breakdown(words: Column, target: Column, weight, script: Script = HEBREW) -> Column:
    """For each word its best match, similarity and contribution; weight(word) gives a column."""

    def best(word: Column) -> Column:
        sims = F.transform(target, lambda t: F.struct(S.similarity(word, t, script).alias("sim"), t.alias("word")))
        top = F.array_max(F.transform(sims, lambda s: s["sim"]))
        first = F.get(F.filter(sims, lambda s: s["sim"] == top), F.lit(0))
        sim, w = F.coalesce(top, F.lit(0.0)), weight(word)
        label = F.format_string("%s->%s:%.2f*%.2f=%.2f", word, F.coalesce(first["word"], F.lit("none")), sim, w, sim * w)
        return F.struct(word.alias("word"), sim.alias("sim"), (sim * w).alias("gain"), (w * (1 - sim)).alias("loss"), F.when(sim >= 0.75, "ADD").otherwise("SUB").alias("kind"), label.alias("label"))

    return F.transform(words, best)


def drop_id(kind: Column, index: Column) -> Column:
    return F.concat_ws(":", kind, index.cast("string"))


def parsed_drop_id(c: Column) -> Column:
    """(target_type, index) of a well-formed id, else null."""
    index = F.regexp_extract(c, r"^(?:primary|rashi|tosafot):(\d{1,9})$", 1)
    return F.when((index != "") & (index.cast("long") >= 1), F.struct(F.split(c, ":")[0].alias("target_type"), index.cast("long").alias("index")))


def proportional(line: Column, n_lines: Column, n_target: Column) -> Column:
    """The target line that stands as far into its document."""
    return F.when((n_target <= 0) | (n_lines <= 0) | (line < 1), F.lit(1)).otherwise(F.greatest(F.lit(1), F.least(n_target, F.floor(line / n_lines * n_target + 0.5))))


def offered(lines: DataFrame, radius: int) -> DataFrame:
    """lines: keys, line, n_lines, n_target, current. With first and last, the target lines offered for a new link."""
    anchor = F.coalesce(F.when(F.col("current").between(1, F.col("n_target")), F.col("current")), proportional(F.col("line"), F.col("n_lines"), F.col("n_target")))
    bound = lambda c: F.greatest(F.lit(1), F.least(F.col("n_target"), c))
    return lines.withColumn("first", bound(anchor - radius)).withColumn("last", bound(anchor + radius))


def crossed(links: DataFrame, xref: DataFrame) -> DataFrame:
    """Links to a secondary with primary_line, the line that the first cross reference of theirs (series, line_index_1, line_index_2, nth) names; null if none does."""
    first = xref.groupBy("series", F.col("line_index_1").alias("at")).agg(F.min_by("line_index_2", "nth").alias("primary_line"))
    return links.join(first, (F.col("secondary_target") == F.col("series")) & (F.col("line_index_2") == F.col("at")), "left").drop("series", "at")


ANALYSIS = ("line_index_1", "commentary_line", "dh_text", "commentary_words", "line_index_2", "source_line", "source_words", "confidence", "status", "word_score_breakdown", "word_score_changes", "candidate_scores", "analysis_notes")


def analysis(links: DataFrame, own: DataFrame, target: DataFrame, factors: DataFrame, script: Script = HEBREW) -> DataFrame:
    """A row of ANALYSIS for each link (id, line_index_1, line_index_2, dh_text, confidence, status, candidates): how each word of the line scores.

    own and target: id, line_no, raw, words; factors: id, word, factor.
    """
    a = own.select("id", F.col("line_no").alias("line_index_1"), F.col("raw").alias("commentary_line"), F.col("words").alias("w"))
    b = target.select("id", F.col("line_no").alias("line_index_2"), F.col("raw").alias("source_line"), F.col("words").alias("t"))
    rows = links.join(a, ["id", "line_index_1"], "left").join(b, ["id", "line_index_2"], "left").withColumn("w", F.coalesce("w", F.array().cast("array<string>"))).withColumn("t", F.coalesce("t", F.array().cast("array<string>")))
    # only the factors of the line's own words come along
    used = rows.select("id", "line_index_1", F.explode(F.array_distinct("w")).alias("word")).join(factors, ["id", "word"])
    table = used.groupBy("id", "line_index_1").agg(F.map_from_entries(F.collect_list(F.struct("word", "factor"))).alias("idf"))
    rows = rows.join(table, ["id", "line_index_1"], "left")
    rows = rows.withColumn("b", breakdown(F.col("w"), F.col("t"), lambda w: S.combined_weight(S.word_weight(w, script), F.try_element_at("idf", w)), script))
    listed = lambda kind, sign, part: F.array_join(F.transform(F.filter("b", lambda x: x["kind"] == kind), lambda x: F.format_string(f"%s{sign}%.2f", x["word"], x[part])), "; ")
    some = lambda c: F.when(c == "", "none").otherwise(c)
    scores = F.coalesce(F.array_join(F.transform("candidates", lambda c: F.format_string("%d:%.2f", c["line_num"], c["score"])), "; "), F.lit(""))
    notes = F.format_string("dh_words=%d; source_words=%d; match_confidence=%d; candidates=%s", F.size("w"), F.size("t"), F.coalesce("confidence", F.lit(0)), some(scores))
    made = {
        "commentary_words": F.array_join("w", " "),
        "source_words": F.array_join("t", " "),
        "word_score_breakdown": F.array_join(F.transform("b", lambda x: x["label"]), " | "),
        "word_score_changes": F.concat(F.lit("added:"), some(listed("ADD", "+", "gain")), F.lit("; subtracted:"), some(listed("SUB", "-", "loss"))),
        "candidate_scores": scores,
        "analysis_notes": notes,
    }
    return rows.select(*(made[c].alias(c) if c in made else F.col(c) for c in ANALYSIS))

"""Queries for what is made of links, and for the engine itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossloom.functions import similarity as S
from glossloom.operators import exports as E
from glossloom.operators import link as K
from glossloom.operators import mirror as M
from glossloom.plans import queries as Q
from glossloom.plans import tables as V
from glossloom.profiles import LATIN

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _links(spark, d) -> DataFrame:
    """Best lines of passages as links."""
    best = Q._best(spark, d, 1)
    return best.select(F.col("item_id").alias("line_index_1"), F.col("line_no").alias("line_index_2"), F.format_string("doc %d - line", "id").alias("he_ref_2"), F.format_string("doc \"%d\".txt", "id").alias("path_2"), F.lit("commentary").alias("connection_type"), F.when(F.col("id") % 3 == 0, "rashi").when(F.col("id") % 3 == 1, "tosafot").alias("secondary_target"))


_SQL_LINKS = f"{Q._RUNS}, links AS (SELECT item_id AS line_index_1, line_no AS line_index_2, 'doc ' || id || ' - line' AS he_ref_2, 'doc \"' || id || '\".txt' AS path_2, 'commentary' AS connection_type, CASE id % 3 WHEN 0 THEN 'rashi' WHEN 1 THEN 'tosafot' END AS secondary_target FROM ranked WHERE rank = 1)"


@query(f"WITH {_SQL_LINKS} SELECT line_index_1, line_index_2, he_ref_2, path_2, connection_type FROM links")
def links_export(spark, d) -> DataFrame:
    return _links(spark, d).select(*E.FIELDS)


@query(f"WITH {_SQL_LINKS} SELECT '\"' || line_index_1 || '\",\"' || line_index_2 || '\",\"' || he_ref_2 || '\",\"' || replace(path_2, '\"', '\"\"') || '\",\"commentary\"' AS value FROM links")
def links_csv(spark, d) -> DataFrame:
    from glossloom.sources.files import csv_rows

    return csv_rows(_links(spark, d))


@query(f"""WITH {_SQL_LINKS} SELECT coalesce(CASE secondary_target WHEN 'rashi' THEN 'רש"י' WHEN 'tosafot' THEN 'תוספות' END || ' על ', '') AS owner, line_index_2 AS line_index_1, line_index_1 AS line_index_2, 'book - ' || b.text[1:8] AS he_ref_2, 'book.txt' AS path_2, 'commentary' AS connection_type FROM links JOIN benchmark b ON b.item_id = line_index_1""")
def reverse_links(spark, d) -> DataFrame:
    titles = V.read(spark, d, "benchmark").select(F.col("item_id").alias("line"), F.substring("text", 1, 8).alias("title"))
    return E.reverse(_links(spark, d), titles, "book")


_SQL_MIRROR = "turn_lines AS (SELECT conv_id, turn + 1 AS comm_line, length(text) AS src_line FROM conversations WHERE role <> 'system')"


def _mirror(spark, d) -> DataFrame:
    return V.read(spark, d, "conversations").where("role <> 'system'").select("conv_id", (F.col("turn") + 1).alias("comm_line"), F.length("text").cast("long").alias("src_line"))


@query(f"WITH {_SQL_MIRROR} SELECT conv_id, comm_line, src_line FROM turn_lines")
def mirror_delta_roundtrip(spark, d) -> DataFrame:
    """Turns and their lengths, encoded as differences and decoded again."""
    back = M.decoded(M.encoded(_mirror(spark, d), ["conv_id"], "src_line"), ["conv_id"])
    return back.select("conv_id", F.col("comm_line").cast("long").alias("comm_line"), F.col("src_line").cast("long").alias("src_line"))


_WORDS_2 = f"(SELECT item_id, {V.sql_words('text')} AS w FROM benchmark)"


@query(f"""WITH f AS (SELECT item_id, w, w[7:len(w)] AS line FROM {_WORDS_2}), x AS (SELECT item_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM f), y AS (SELECT item_id, unnest(line) AS word FROM f),
m AS (SELECT DISTINCT word FROM x), v AS (SELECT word, {Q._STEM.format('word')} AS stem FROM m), k AS (SELECT *, {Q._SKELETON.format('stem')} AS skel FROM v),
p AS (SELECT DISTINCT x.word AS a, y.word AS b FROM x JOIN y USING (item_id)),
z AS (SELECT a, b, {Q.sql_similarity('a', 'b', 'k.stem', 'l.stem', 'k.skel', 'l.skel')} AS sim FROM p JOIN k ON k.word = a JOIN k l ON l.word = b),
best AS (SELECT item_id, i, x.word, coalesce(max(sim), 0) AS sim FROM x LEFT JOIN (SELECT DISTINCT item_id, word FROM y) o USING (item_id) LEFT JOIN z ON a = x.word AND b = o.word GROUP BY ALL)
SELECT item_id, i, word, round(sim, 6) AS sim, round(sim * {Q._BASE}, 6) AS gain, CASE WHEN sim >= 0.75 THEN 'ADD' ELSE 'SUB' END AS kind FROM best""".replace("LEFT JOIN (SELECT DISTINCT item_id, word FROM y) o USING (item_id)", "LEFT JOIN (SELECT DISTINCT item_id, word FROM y) o ON o.item_id = x.item_id").replace("best AS (SELECT item_id,", "best AS (SELECT x.item_id,"))
def analysis_breakdown(spark, d) -> DataFrame:
    """Each word of a whole passage against its words from the seventh on, with what fuzzy matches give."""
    rows = V.read_texts(spark, d, "benchmark").select("item_id", V.words("text").alias("w"))
    each = rows.select("item_id", F.posexplode(E.breakdown(F.col("w"), F.slice("w", 7, F.greatest(F.size("w"), F.lit(1))), lambda w: S.word_weight(w, LATIN), LATIN)).alias("i", "b"))
    return each.select("item_id", F.col("i").cast("long").alias("i"), "b.word", F.round("b.sim", 6).alias("sim"), F.round("b.gain", 6).alias("gain"), "b.kind")


@query("""SELECT item_id, regexp_replace(text, '^(\\s*)(\\S+\\s+\\S+)', '\\1<b>\\2</b>') AS line FROM benchmark WHERE regexp_matches(text, '^\\s*\\S+\\s+\\S+')""")
def highlight_segments(spark, d) -> DataFrame:
    """The first two words of passages, marked."""
    span = F.array(F.struct(F.lit(0).alias("word_start"), F.lit(2).alias("word_count")))
    return V.read(spark, d, "benchmark").where(F.col("text").rlike(r"^\s*\S+\s+\S+")).select("item_id", E.highlighted(F.col("text"), span).alias("line"))


@query(f"""WITH {V.SQL_TURNS}, n AS (SELECT conv_id, turn, own, count(*) OVER (PARTITION BY conv_id) AS n_lines FROM turns), a AS (SELECT conv_id, turn, own AS current, CASE WHEN own BETWEEN 1 AND 40 THEN own ELSE greatest(1, least(40, floor((turn + 1) / n_lines * 40 + 0.5))) END::BIGINT AS anchor FROM n)
SELECT conv_id, turn, greatest(1, least(40, anchor - 12)) AS first, greatest(1, least(40, anchor + 12)) AS last FROM a""")
def drop_candidates(spark, d) -> DataFrame:
    """For each turn the lines of a target of forty that are offered for a new link."""
    n = Window.partitionBy("conv_id")
    rows = V.turns(spark, d).select("conv_id", "turn", (F.col("turn") + 1).alias("line"), F.count("*").over(n).alias("n_lines"), F.lit(40).cast("long").alias("n_target"), F.col("own").alias("current"))
    return E.offered(rows, 12).select("conv_id", "turn", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


# --- the engine -------------------------------------------------------------------------------------------------------
_LATIN, _HEBREW = "abcdefghijklmnopqrstuvwxyz", "אבגדהוזחטיכלמנסעפצקרשתאבגד"


def _talks(spark, d) -> DataFrame:
    """Each conversation as a linking job, in Hebrew letters: the last turn comments on those before it and quotes the first words of each."""
    text = F.translate(F.lower(F.replace("text", F.lit("\n"), F.lit(" "))), _LATIN, _HEBREW)
    rows = V.read(spark, d, "conversations").select(F.col("conv_id").alias("id"), "turn", text.alias("text"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", c.alias("x")))), lambda s: s["x"]), "\n").alias("text")
    source = rows.groupBy("id").agg(joined(F.col("text"))).select("id", F.lit("source").alias("role"), "text")
    quote = F.array_join(F.slice(F.split("text", " +"), 1, 6), " ")
    notes = rows.groupBy("id").agg(joined(F.concat(quote, F.lit(". ")))).select("id", F.lit("commentary").alias("role"), "text")
    return source.unionByName(notes)


@query(None)
def fuzzy_link(spark, d) -> DataFrame:
    """The engine in one pass."""
    return K.links(K.link(_talks(spark, d), K.Config(title="book"))).drop("candidates", "match_range")


@query(None)
def multipass_link(spark, d) -> DataFrame:
    """The engine in thirteen passes, with windows, pruning and gap filling."""
    return K.links(K.link(_talks(spark, d), K.Config(title="book", category="halacha", numbered=False))).drop("candidates", "match_range")

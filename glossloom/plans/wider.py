"""Queries for operators over Hebrew texts, edits, dictionaries and library tables.

The tables hold Latin texts. Where an operator knows Hebrew only, their letters
are exchanged for Hebrew ones, and what the operator is to find is put in front
of each line by its number, so that SQL knows what has to come out.
"""

from __future__ import annotations

from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossloom.functions import text as T
from glossloom.operators import catalog as C
from glossloom.operators import dictionary as D
from glossloom.operators import edits as A
from glossloom.operators import exports as E
from glossloom.operators import mirror as M
from glossloom.operators import quality as U
from glossloom.operators import views as W
from glossloom.plans import exports as X
from glossloom.plans import queries as Q
from glossloom.plans import reports as R
from glossloom.plans import tables as V
from glossloom.profiles import ABBREVIATION_DAMP, HEBREW, LATIN, NUMERALS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


# --- Hebrew texts -----------------------------------------------------------------------------------------------------
_FROM, _TO = "abcdefghijklmnopqrstuvwxyz", "בגדהזחטיכלמנסעפצקרתבגדהזחט"  # no letters of the marks and names below begin a word of these alone


def hebrew(c: Column) -> Column:
    return F.translate(F.lower(c), _FROM, _TO)


def _quoted(x: str) -> str:
    return x.replace("'", "''")


def _picked(choices: tuple[str, ...], number: str = "turn") -> str:
    return "CASE " + " ".join(f"WHEN {number} % {len(choices)} = {i} THEN '{_quoted(x)}'" for i, x in enumerate(choices)) + " END"


def _pick(choices: tuple[str, ...], number: str = "turn") -> Column:
    return F.element_at(F.array(*map(F.lit, choices)), (F.col(number) % len(choices) + 1).cast("int"))


def _turns(spark, d) -> DataFrame:
    return V.read(spark, d, "conversations").select("conv_id", "turn", hebrew(F.regexp_replace("text", "[^A-Za-z]+", " ")).alias("text"))


_TURNS = f"t AS (SELECT conv_id, turn, translate(lower(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), '{_FROM}', '{_TO}') AS text FROM conversations)"


@query(f"""WITH x AS (SELECT conv_id, turn, translate(lower(text), '{_FROM}', '{_TO}') AS s FROM conversations),
q AS (SELECT conv_id, turn, {V.sql_quotes("regexp_replace(s, '<[^>]*>', ' ', 'g')")} AS s FROM x),
r AS (SELECT conv_id, turn, regexp_replace(regexp_replace(s, '[\\x{{0591}}-\\x{{05c7}}]', '', 'g'), '[^א-ת0-9''"]+', ' ', 'g') AS s FROM q)
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(s, '(^| )[''"]+', '\\1', 'g'), '"+( |$)', '\\1', 'g'), ' +', ' ', 'g')) AS norm FROM r""")
def hebrew_normalize(spark, d) -> DataFrame:
    rows = V.read(spark, d, "conversations").select("conv_id", "turn", hebrew(F.col("text")).alias("text"))
    return rows.select("conv_id", "turn", T.normalized(F.col("text"), HEBREW).alias("norm"))


_STARTS = ("רש\"י ", "בגמרא ", "תוס' ", "במשנה ", "", "רשיבה ", "תוספות ", "מתני' ")


@query(f"WITH {_TURNS} SELECT conv_id, turn, turn % 8 = 0 AS rashi, turn % 8 IN (2, 6) AS tosafot, turn % 8 IN (1, 3, 7) AS main FROM t")
def source_keywords(spark, d) -> DataFrame:
    norm = T.normalized(F.concat(_pick(_STARTS), F.lit("ב "), F.col("text")), HEBREW)
    return _turns(spark, d).select("conv_id", "turn", T.names_rashi(norm).alias("rashi"), T.names_tosafot(norm).alias("tosafot"), T.names_primary(norm).alias("main"))


_LEADS = ("1. ", "(א) ", "[ב] ", "• ", "גמ' ", "12) * ", "בגמרא: ", "")


@query(f"WITH {_TURNS} SELECT conv_id, turn, trim('ב ' || text) AS rest FROM t")
def leading_marks(spark, d) -> DataFrame:
    """Turns with numbers, brackets, bullets and names in front, and without them again."""
    return _turns(spark, d).select("conv_id", "turn", T.strip_leading_marks(F.trim(F.concat(_pick(_LEADS), F.lit("ב "), F.col("text")))).alias("rest"))


_SOURCES = ('רש"י ד"ה ', 'תוס\' ד"ה ', 'ד"ה ', "בדה ", 'שם ד"ה ', "תוספות ", "1. רש\"י ", "")


@query(f"WITH {_TURNS} SELECT conv_id, turn, trim('ב ' || text) AS rest FROM t")
def secondary_prefix(spark, d) -> DataFrame:
    """Turns with what names a secondary source in front, and without it again."""
    return _turns(spark, d).select("conv_id", "turn", T.strip_source_prefix(F.trim(F.concat(_pick(_SOURCES), F.lit("ב "), F.col("text")))).alias("rest"))


_AGAIN = ('בא"ד ', 'שם א"ד ', "", "אד ", "אדם ", 'באו"ד. ')


@query(f"WITH {_TURNS} SELECT conv_id, turn, turn % 6 IN (0, 1, 3, 5) AS continues FROM t")
def ibid_lines(spark, d) -> DataFrame:
    return _turns(spark, d).select("conv_id", "turn", T.is_ibid(F.concat(_pick(_AGAIN), F.lit("ב "), F.col("text"))).alias("continues"))


_LETTERS = "".join(NUMERALS)


@query(f"""WITH v(letter, worth) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in NUMERALS.items())}),
n AS (SELECT conv_id, turn, '{_LETTERS}'[(turn % 22 + 1)::INT] AS a, '{_LETTERS}'[(conv_id % 22 + 1)::INT] AS b FROM conversations)
SELECT conv_id, turn, CASE WHEN p.worth > q.worth THEN a || b END AS letters FROM n JOIN v p ON p.letter = a JOIN v q ON q.letter = b""")
def numbered_lines(spark, d) -> DataFrame:
    """Two letters in brackets of three kinds before each turn: a number only if the second is worth less."""
    letter = lambda c: F.substring(F.lit(_LETTERS), (F.col(c) % 22 + 1).cast("int"), F.lit(1))
    rows = _turns(spark, d).withColumn("two", F.concat(letter("turn"), letter("conv_id")))
    raw = F.concat(_pick(("(", "[", "")), "two", _pick((")", "]", ". ")), F.lit(" "), F.col("text"))
    return rows.select("conv_id", "turn", T.numbering(raw).alias("letters"))


@query(f"SELECT conv_id, turn, 'דף ' || '{_LETTERS}'[(turn % 22 + 1)::INT] || CASE WHEN turn % 4 < 4 THEN ' עמוד ' || CASE turn % 4 WHEN 0 THEN 'א' WHEN 1 THEN 'ב' WHEN 2 THEN 'א' ELSE 'ב' END END AS key FROM conversations")
def page_headers(spark, d) -> DataFrame:
    """Page marks in headings, written out."""
    letter = F.substring(F.lit(_LETTERS), (F.col("turn") % 22 + 1).cast("int"), F.lit(1))
    title = F.concat(F.lit("<h2>דף "), letter, _pick((".", ":", ' ע"א', ' ע"ב')), F.lit("</h2>"))
    return V.read(spark, d, "conversations").select("conv_id", "turn", T.header_key(title, HEBREW).alias("key"))


_ENDS = (" - ", ". ", " כו' ", " וגו' ", ": ", " וכולי ")


@query(f"""WITH {_TURNS}, w AS (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda x: x <> '')[1:4] AS w FROM t)
SELECT conv_id, turn, (length(array_to_string(w, ' ')))::BIGINT AS n FROM w WHERE len(w) = 4""")
def lemma_ends(spark, d) -> DataFrame:
    """Four words of a turn with what ends a lemma behind them, in six ways."""
    w = F.slice(F.filter(F.split("text", " "), lambda x: x != ""), 1, 4)
    rows = _turns(spark, d).withColumn("w", w).where(F.size("w") == 4)
    return rows.select("conv_id", "turn", T.lemma_end(F.concat(F.array_join("w", " "), _pick(_ENDS), F.lit("ב"))).cast("long").alias("n"))


# --- runs with abbreviations ------------------------------------------------------------------------------------------


@query(f"""WITH f AS (SELECT item_id, w FROM (SELECT item_id, {V.sql_words('text')} AS w FROM benchmark) WHERE len(w) >= 6),
x AS (SELECT item_id, unnest(w[1:6]) AS word, unnest(range(6)) AS i FROM f),
g AS (SELECT item_id, sum({Q._BASE}) FILTER (WHERE i < 3) AS three, sum({Q._BASE}) FILTER (WHERE i >= 3) AS rest FROM x GROUP BY item_id),
o AS (SELECT item_id, {Q._BASE.replace("word", "own")} AS own FROM (SELECT item_id, w[1][1:1] || w[2][1:1] || w[3][1:1] AS own FROM f))
SELECT item_id, 4::BIGINT AS n_words, round(greatest(own, {ABBREVIATION_DAMP} * three) + rest, 6) AS score, 4.0::DOUBLE AS similarity FROM g JOIN o USING (item_id)""")
def abbreviation_run(spark, d) -> DataFrame:
    """A passage's first three words as their initials, which a dictionary writes out, and three more, against the passage."""

    def run(batches):
        from glossloom.functions.similarity import Words
        from glossloom.operators.resolve import Resolver

        one = Resolver.__new__(Resolver)
        one.say, one.weighted, one.spec = Words(LATIN), True, SimpleNamespace(start_words=1, fuzzy=False, shallow=1, deep_run=99)
        for batch in batches:
            out = []
            for item, words in zip(batch["item_id"].to_pylist(), batch["w"].to_pylist(), strict=True):
                initials = "".join(w[0] for w in words[:3])
                units = [D.Abbreviation(initials, tuple(words[:3])), *words[3:6]]
                score, n, sims = one._run(units, one._weights(["", *words[3:6]], None), words, True)
                out.append((item, n, round(score, 6), sims))
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["item_id", "n_words", "score", "similarity"])

    rows = V.read(spark, d, "benchmark").select("item_id", V.words("text").alias("w")).where(F.size("w") >= 6)
    return rows.mapInArrow(run, "item_id long, n_words long, score double, similarity double")


# --- links, edits, views ----------------------------------------------------------------------------------------------
_TABLE = f"{V.SQL_TURNS}, n AS (SELECT conv_id AS id, turn AS line_index_1, own AS line_index_2, CASE turn % 3 WHEN 0 THEN 'rashi' WHEN 1 THEN 'tosafot' END AS secondary_target, (own * 7 % 101)::INT AS confidence FROM turns WHERE own IS NOT NULL)"


def _table(spark, d) -> DataFrame:
    """Turns that point somewhere, as links."""
    rows = V.turns(spark, d).where("own IS NOT NULL")
    return rows.select(F.col("conv_id").alias("id"), F.col("turn").alias("line_index_1"), F.col("own").alias("line_index_2"), F.when(F.col("turn") % 3 == 0, "rashi").when(F.col("turn") % 3 == 1, "tosafot").alias("secondary_target"), (F.col("own") * 7 % 101).cast("int").alias("confidence"))


@query(f"WITH {_TABLE} SELECT id, line_index_1, CASE WHEN confidence >= 80 THEN 'approved' ELSE 'pending' END AS status FROM n")
def bulk_approval(spark, d) -> DataFrame:
    return A.approved(_table(spark, d).withColumn("status", F.lit("pending"))).select("id", "line_index_1", "status")


@query(f"WITH {_TABLE} SELECT id, line_index_1, line_index_2 || '|' || coalesce(secondary_target, '') || '|' || CASE WHEN secondary_target IS NULL THEN '' ELSE line_index_2::VARCHAR END AS key FROM n")
def link_target_keys(spark, d) -> DataFrame:
    rows = _table(spark, d).withColumn("secondary_line_index", F.when(F.col("secondary_target").isNotNull(), F.col("line_index_2")))
    return rows.select("id", "line_index_1", W.target_key(rows).alias("key"))


_VIEW = f"{V.SQL_TURNS}, v AS (SELECT conv_id * 1000 + turn AS line_no, own AS line_index_2, CASE WHEN own % 5 > 0 THEN (own * 7 % 101)::INT END AS confidence FROM turns)"


def _view(spark, d) -> DataFrame:
    rows = V.turns(spark, d)
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"), F.col("own").alias("line_index_2"), F.when(F.col("own") % 5 > 0, (F.col("own") * 7 % 101).cast("int")).alias("confidence"))


@query(f"WITH {_VIEW} SELECT line_no, row_number() OVER (ORDER BY line_no) AS place FROM v ORDER BY place LIMIT 200")
def sort_by_book_order(spark, d) -> DataFrame:
    """The first two hundred lines of the view in book order, numbered."""
    return _placed(W.ordered(_view(spark, d), "book").limit(200), spark)


@query(f"WITH {_VIEW} SELECT line_no, row_number() OVER (ORDER BY CASE WHEN line_index_2 IS NULL THEN 0 ELSE coalesce(confidence, 85) END, line_no) AS place FROM v ORDER BY place LIMIT 200")
def sort_by_least_score(spark, d) -> DataFrame:
    """The two hundred lines of the least scores, numbered."""
    return _placed(W.ordered(_view(spark, d), "score_up").limit(200), spark)


def _placed(rows: DataFrame, spark) -> DataFrame:
    # a list as long as a screen shows; its order is what is looked at
    return spark.createDataFrame([(r.line_no, i) for i, r in enumerate(rows.collect(), 1)], "line_no long, place long")


@query("SELECT conv_id, turn AS line_no FROM conversations WHERE contains(lower(text), 'the on') OR contains(lower(role), 'the on') OR turn::VARCHAR = 'the on'")
def text_filter(spark, d) -> DataFrame:
    rows = V.read(spark, d, "conversations").select("conv_id", F.col("turn").alias("line_no"), F.col("text").alias("raw"), F.col("role").alias("target_raw"))
    return W.matching(rows, " The On").select("conv_id", "line_no")


@query(f"""WITH {R._INDEX}, l AS (SELECT t.conv_id AS id, t.turn, t.own FROM turns t WHERE own IS NOT NULL),
after AS (SELECT id, turn, CASE WHEN turn % 2 = 1 THEN own + 1000 ELSE own END AS own FROM l WHERE turn % 5 > 0),
m AS (SELECT id, turn, parent FROM p WHERE parent IS NOT NULL AND (id, parent) IN (SELECT (id, turn) FROM l WHERE turn % 2 = 1 OR turn % 5 = 0))
SELECT id, turn AS line_index_1, own AS line_index_2, false AS is_inherited, NULL::BIGINT AS candidate_index FROM after WHERE (id, turn) NOT IN (SELECT (id, turn) FROM m)
UNION ALL SELECT m.id, m.turn, a.own, true, NULL FROM m JOIN after a ON a.id = m.id AND a.turn = m.parent""")
def cascade_on_edit(spark, d) -> DataFrame:
    """Heads on odd turns moved by a thousand lines, those on every fifth removed, and what their followers make of it."""
    turns = V.turns(spark, d).where("own IS NOT NULL")
    none = F.lit(None).cast("array<struct<line_num: long, score: double, confidence: int>>")
    links = turns.select(F.col("conv_id").alias("id"), F.col("turn").alias("line_index_1"), F.col("own").alias("line_index_2"), F.lit(False).alias("is_inherited"), F.lit(50).alias("confidence"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("secondary_target"), none.alias("candidates"), F.lit(None).cast("int").alias("candidate_index"))
    touched = links.where("line_index_1 % 2 = 1 OR line_index_1 % 5 = 0")
    edits = touched.select("id", "line_index_1", F.when(F.col("line_index_1") % 5 > 0, F.col("line_index_2") + 1000).alias("line_index_2"))
    out = A.cascaded(A.edited(links, edits), R._index(spark, d), touched.select("id", F.col("line_index_1").alias("line_no")))
    return out.select("id", "line_index_1", "line_index_2", "is_inherited", F.col("candidate_index").cast("long").alias("candidate_index"))


@query(f"""WITH {V.SQL_TURNS}, c AS (SELECT conv_id AS id, turn AS line_index_1, own, turn % 3 AS place FROM turns WHERE own IS NOT NULL)
SELECT id, line_index_1, (own + (place + 1) % 3)::BIGINT AS line_index_2, (90 - 10 * ((place + 1) % 3))::INT AS confidence, ((place + 1) % 3)::INT AS candidate_index FROM c""")
def candidate_cycling(spark, d) -> DataFrame:
    """Links with three candidates each, moved on to the next."""
    rows = V.turns(spark, d).where("own IS NOT NULL")
    three = F.transform(F.array(*map(F.lit, range(3))), lambda i: F.struct((F.col("own") + i).alias("line_num"), F.lit(1.0).alias("score"), (F.lit(90) - 10 * i).alias("confidence")))
    links = rows.select(F.col("conv_id").alias("id"), F.col("turn").alias("line_index_1"), F.col("own").alias("line_index_2"), F.lit(90).alias("confidence"), three.alias("candidates"), (F.col("turn") % 3).cast("int").alias("candidate_index"))
    return A.next_candidate(links).select("id", "line_index_1", "line_index_2", "confidence", "candidate_index")


@query(f"WITH {X._SQL_LINKS}, m AS (SELECT CASE conv_id % 2 WHEN 0 THEN 'rashi' ELSE 'tosafot' END AS series, turn + 1 AS comm_line, min(length(text)) AS src_line FROM conversations GROUP BY ALL) SELECT line_index_1, src_line AS line_index_2 FROM links JOIN m ON series = secondary_target AND comm_line = line_index_2")
def mirror_links(spark, d) -> DataFrame:
    table = V.read(spark, d, "conversations").groupBy(F.when(F.col("conv_id") % 2 == 0, "rashi").otherwise("tosafot").alias("series"), (F.col("turn") + 1).alias("comm_line")).agg(F.min(F.length("text")).cast("long").alias("src_line"))
    return E.mirrored(X._links(spark, d), table)


@query(f"WITH {X._SQL_LINKS}, r AS (SELECT CASE conv_id % 2 WHEN 0 THEN 'rashi' ELSE 'tosafot' END AS series, turn + 1 AS place, min_by(length(text), conv_id) AS primary_line FROM conversations GROUP BY ALL) SELECT line_index_1, links.line_index_2, primary_line FROM links LEFT JOIN r ON series = secondary_target AND place = links.line_index_2")
def cross_references(spark, d) -> DataFrame:
    rows = V.read(spark, d, "conversations").select(F.when(F.col("conv_id") % 2 == 0, "rashi").otherwise("tosafot").alias("series"), (F.col("turn") + 1).alias("line_index_1"), F.length("text").cast("long").alias("line_index_2"), F.col("conv_id").alias("nth"))
    return E.crossed(X._links(spark, d), rows).select("line_index_1", "line_index_2", "primary_line")


@query(f"""WITH {X._SQL_MIRROR}, s AS (SELECT *, src_line - coalesce(lag(src_line) OVER w, 0) AS step, comm_line - coalesce(lag(comm_line) OVER w, 1) AS gap FROM turn_lines WINDOW w AS (PARTITION BY conv_id ORDER BY comm_line))
SELECT conv_id, string_agg(repeat(',', gap::INT) || CASE WHEN step < 0 THEN '-' ELSE '' END || lower(to_base(abs(step), 36)), '' ORDER BY comm_line) AS encoded FROM s GROUP BY conv_id""")
def mirror_encoding(spark, d) -> DataFrame:
    """The text form of each conversation's lengths; of two links of a line the later one counts."""
    rows = X._mirror(spark, d).withColumn("nth", F.lit(2))
    return M.encoded(rows.unionByName(rows.withColumn("nth", F.lit(1)).withColumn("src_line", F.col("src_line") + 99)), ["conv_id"], "nth")


@query("SELECT item_id, 'primary:' || (item_id + 1) AS id, 'primary' AS target_type, item_id + 1 AS index FROM benchmark")
def drop_ids(spark, d) -> DataFrame:
    rows = V.read(spark, d, "benchmark").select("item_id", E.drop_id(F.lit("primary"), F.col("item_id") + 1).alias("id")).withColumn("p", E.parsed_drop_id(F.col("id")))
    return rows.select("item_id", "id", "p.target_type", F.col("p.index").alias("index"))


@query(f"WITH {R._JUDGED}, b AS (SELECT floor(least(confidence, 99) / 10) AS band, count(*) AS n, avg(confidence) AS stated, 100 * avg(correct::INT) AS precision FROM judged GROUP BY 1) SELECT round(sum(n * abs(stated - precision)) / sum(n), 6) AS ece FROM b")
def calibration_error(spark, d) -> DataFrame:
    return U.calibration_error(U.reliability(R._judged(spark, d))).select(F.round("ece", 6).alias("ece"))


@query(f"WITH {X._SQL_LINKS}, runs AS (SELECT DISTINCT item_id, line_no FROM ranked WHERE rank = 1 AND n_words >= 6) SELECT line_index_1, line_index_2, runs.item_id IS NOT NULL AS correct FROM links LEFT JOIN runs ON item_id = line_index_1 AND line_no = line_index_2")
def verbatim_judge(spark, d) -> DataFrame:
    """Links judged by a run of six words that both lines share."""
    best = Q._best(spark, d, 1).select(F.col("item_id").alias("line_index_1"), F.col("line_no").alias("line_index_2"), "n_words")
    return U.judged_verbatim(X._links(spark, d), best, ["line_index_1", "line_index_2"], 6).select("line_index_1", "line_index_2", "correct")


@query(f"WITH {V.SQL_TURNS} SELECT t.conv_id AS id, t.turn AS line_no, 'line ' || t.turn || chr(10) || chr(10) || c.text || chr(10) || chr(10) || 'source:' || chr(10) || s.n AS report FROM turns t JOIN conversations c USING (conv_id, turn) JOIN (SELECT conv_id, count(*)::VARCHAR AS n FROM conversations GROUP BY conv_id) s USING (conv_id) WHERE own IS NULL")
def unlinked_report(spark, d) -> DataFrame:
    """Turns that point nowhere, with what stands in for their segment's source."""
    rows = V.turns(spark, d).where("own IS NULL").join(V.read(spark, d, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn"])
    texts = V.read(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.count("*").cast("string").alias("text")).select("id", F.lit(1).alias("seg_no"), F.lit("source").alias("role"), "text")
    return U.unlinked_report(rows.select(F.col("conv_id").alias("id"), F.col("turn").alias("line_no"), F.lit(1).alias("seg_no"), F.col("text").alias("raw")), texts)


# --- dictionaries and the library -------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT regexp_replace(p_brand, '[''"]', '', 'g') AS key, p_type AS option, (p_partkey, p_brand) AS place FROM part), f AS (SELECT key, option, min(place) AS place FROM o GROUP BY ALL)
SELECT key, string_agg(option, '|' ORDER BY place) AS options, count(*) AS n FROM f GROUP BY key""")
def dictionary_union(spark, d) -> DataFrame:
    """Brands as abbreviations, quoted in two ways by entry, and types as what they stand for, merged under clean keys; the entry's number keeps their order."""
    rows = V.read(spark, d, "part").select(F.concat(F.lit('"'), "p_brand", F.lit('"')).alias("brand"), "p_partkey", "p_type")
    table = rows.groupBy("brand").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_type"))), lambda x: x["p_type"]).alias("options")).select(F.col("brand").alias("key"), "options")
    return D.merged(table).select("key", F.array_join("options", "|").alias("options"), F.size("options").cast("long").alias("n"))


@query("""WITH o AS (SELECT p_brand AS key, p_type AS option, min(p_partkey) AS place FROM part GROUP BY ALL), x AS (SELECT * FROM o UNION ALL SELECT 'Brand#11', 'a new one', 1099511627776 UNION ALL SELECT 'new', 'word', 1),
y AS (SELECT * FROM x WHERE NOT (key = 'Brand#12' AND option = (SELECT min(p_type) FROM part WHERE p_brand = 'Brand#12')))
SELECT key, string_agg(option, '|' ORDER BY place) AS options FROM y GROUP BY key""")
def dictionary_edits(spark, d) -> DataFrame:
    """Options added behind those a key has, a key added, an option taken out."""
    rows = V.read(spark, d, "part").groupBy(F.col("p_brand").alias("key"), F.col("p_type").alias("option")).agg(F.min("p_partkey").alias("place"))
    table = rows.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "option"))), lambda x: x["option"]).alias("options"))
    first = V.read(spark, d, "part").where("p_brand = 'Brand#12'").agg(F.min("p_type")).first()[0]
    table = D.with_option(D.with_option(table, "Brand#11", " a new one "), "new", "word")
    return D.without_option(table, "Brand#12", first or "").select("key", F.array_join("options", "|").alias("options"))


@query("SELECT conv_id AS book_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id")
def paged_books(spark, d) -> DataFrame:
    """Conversations as books that come in pages."""
    return C.pages_joined(V.read(spark, d, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("offset"), "text"))


@query("SELECT p_partkey::VARCHAR AS book_id, trim(p_name) AS title, '' AS path, p_type AS type FROM part WHERE trim(p_name) <> '' AND contains(lower(trim(p_name)), 'an')")
def library_search(spark, d) -> DataFrame:
    """Parts as books under other names of their columns, found by a piece of the title."""
    raw = V.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))
    return C.found(C.books(raw), F.lit("AN")).where(F.lower("title").contains("an")).select("book_id", "title", "path", "type")


@query("""WITH link AS (SELECT l_orderkey * 10 + l_linenumber AS link_id, l_partkey % 2000 AS s, l_suppkey AS t, l_linenumber % 3 AS kind FROM lineitem)
SELECT link_id, 's' || p.p_partkey AS source_ref, p.p_size AS source_index, 't' || q.p_partkey AS target_ref, q.p_size AS target_index FROM link JOIN part p ON p.p_partkey = s JOIN part q ON q.p_partkey = t WHERE kind = 1""")
def library_links(spark, d) -> DataFrame:
    """Order lines as a library's links between lines of books, parts as the lines."""
    link = V.read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.lit(1).alias("source_book"), F.lit(2).alias("target_book"), (F.col("l_partkey") % 2000).alias("source_line"), F.col("l_suppkey").alias("target_line"), (F.col("l_linenumber") % 3).alias("type"))
    part = V.read(spark, d, "part")
    line = part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("line_index"), F.col("p_partkey").cast("string").alias("ref"))
    none = spark.createDataFrame([], "link_id long, side string, char_start int, char_end int, label string")
    out = C.book_links(link, line, none, none.select("link_id", "side", F.col("char_end").alias("end_line")), 1)
    return out.select("link_id", F.concat(F.lit("s"), "source_ref").alias("source_ref"), "source_index", F.concat(F.lit("t"), "target_ref").alias("target_ref"), "target_index")

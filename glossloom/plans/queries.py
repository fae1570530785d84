"""One query or more for each family of operators, over the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossloom.functions import similarity as S
from glossloom.functions import text as T
from glossloom.operators import chains as C
from glossloom.operators import lexicon as X
from glossloom.operators import lines as L
from glossloom.operators import runs as R
from glossloom.operators import scoring as P
from glossloom.plans import tables as V
from glossloom.profiles import LATIN

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


# --- lines and headers ------------------------------------------------------------------------------------------------


@query(f"WITH {V.SQL_DOCUMENT_LINES} SELECT id, line_no, length(raw) AS n_chars, regexp_matches(raw, '^\\s*$') AS blank FROM lines")
def parse_lines(spark, d) -> DataFrame:
    return V.document_lines(spark, d).select("id", F.col("line_no").cast("long").alias("line_no"), F.length("raw").cast("long").alias("n_chars"), (T.trimmed(F.col("raw")) == "").alias("blank"))


@query(f"WITH {V.SQL_DOCUMENT_LINES} SELECT id, count(*) AS n_lines, count(*) FILTER (WHERE NOT regexp_matches(raw, '^\\s*$')) AS n_content FROM lines GROUP BY id")
def nonblank_lines(spark, d) -> DataFrame:
    return V.document_lines(spark, d).groupBy("id").agg(F.count("*").alias("n_lines"), F.count_if(T.trimmed(F.col("raw")) != "").alias("n_content"))


@query(f"WITH {V.SQL_PAGE_LINES} SELECT id, line_no, trim(regexp_replace(regexp_replace(regexp_extract(trim(raw), '(?i)<h[1-6][^>]*>(.*?)</h[1-6]>', 1), '<[^>]*>', '', 'g'), '[ \\t]{{2,}}', ' ', 'g')) AS title FROM plines WHERE regexp_matches(trim(raw), '(?i)<h[1-6][^>]*>.*</h[1-6]>')")
def header_lines(spark, d) -> DataFrame:
    found = V.page_lines(spark, d).where("is_header")
    return found.select("id", F.col("line_no").cast("long").alias("line_no"), F.trim(T.header_title(F.col("raw"))).alias("title"))


@query(f"""WITH {V.SQL_PAGE_LINES}, h AS (SELECT *, regexp_matches(trim(raw), '(?i)<h[1-6][^>]*>.*</h[1-6]>') AS is_header FROM plines),
s AS (SELECT *, sum(is_header::INT) OVER (PARTITION BY id ORDER BY line_no) AS seg_no FROM h)
SELECT id, seg_no::BIGINT AS seg_no, min(line_no) AS header_line, min(line_no) + 1 AS start_line, max(line_no) AS end_line FROM s WHERE seg_no > 0 GROUP BY id, seg_no""")
def header_segments(spark, d) -> DataFrame:
    return L.segments(V.page_lines(spark, d)).select("id", "seg_no", *(F.col(c).cast("long").alias(c) for c in ("header_line", "start_line", "end_line")))


@query("""WITH h AS (SELECT page_id, list_filter(string_split_regex(regexp_replace(lower(regexp_extract(html, '<h1>(.*?)</h1>', 1)), '[^a-z0-9]+', ' ', 'g'), ' +'), lambda w: w <> '') AS w FROM pages),
c AS (SELECT page_id, array_to_string(w[1:3], ' ') AS key FROM h WHERE len(w) >= 3), t AS (SELECT page_id AS t_id, array_to_string(w, ' ') AS t_key FROM h WHERE len(w) >= 3),
m AS (SELECT c.page_id AS id, t_id, c.key <> t_key AS held FROM c JOIN t ON (' ' || t_key || ' ') LIKE ('% ' || c.key || ' %') OR (' ' || c.key || ' ') LIKE ('% ' || t_key || ' %'))
SELECT c.page_id AS id, (SELECT t_id FROM m WHERE m.id = c.page_id ORDER BY held, t_id LIMIT 1) AS t_id FROM c""")
def segment_align(spark, d) -> DataFrame:
    """The first three words of each page's heading as a commentary's title, all headings as targets."""
    key = F.regexp_replace(F.lower(F.regexp_extract("html", "<h1>(.*?)</h1>", 1)), "[^a-z0-9]+", " ")
    heads = V.read(spark, d, "pages").select("page_id", F.filter(F.split(key, " +"), lambda w: w != "").alias("w")).where(F.size("w") >= 3)
    own = heads.select(F.col("page_id").alias("id"), F.lit(0).alias("seg_no"), F.array_join(F.slice("w", 1, 3), " ").alias("title"))
    target = heads.select(F.col("page_id").alias("id"), F.lit(0).alias("seg_no"), F.array_join("w", " ").alias("title"))
    return L.aligned(own, target, LATIN).select("id", "t_id")


@query("""WITH c AS (SELECT conv_id, turn, role FROM conversations)
SELECT conv_id AS id, min(turn) AS first_seg FROM c WHERE role = 'assistant' GROUP BY conv_id""")
def front_matter(spark, d) -> DataFrame:
    """Turns as segments, of which only an assistant's are aligned: what comes before the first is front matter."""
    talk = V.read(spark, d, "conversations")
    return L.first_aligned(talk.select(F.col("conv_id").alias("id"), F.col("turn").alias("seg_no"), F.when(F.col("role") == "assistant", F.col("turn")).alias("t_seg")))


# --- markup and normalisation -----------------------------------------------------------------------------------------


@query("SELECT page_id, sha256(regexp_replace(html, '<[^>]*>', ' ', 'g')) AS plain, length(regexp_replace(html, '<[^>]*>', ' ', 'g')) AS n_chars FROM pages")
def strip_tags(spark, d) -> DataFrame:
    out = T.strip_tags(F.col("html"))
    return V.read(spark, d, "pages").select("page_id", F.sha2(out, 256).alias("plain"), F.length(out).cast("long").alias("n_chars"))


@query(f"WITH {V.SQL_PAGE_LINES} SELECT id, line_no, sha256(CASE WHEN contains(raw, '<') THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '(?i)(?:<[^>]*>)*<\\s*br\\b[^>]*>(?:<[^>]*>)*', ' ', 'g'), '<[^>]*>', '', 'g'), '[ \\t]{{2,}}', ' ', 'g'), '^\\s+|\\s+$', '', 'g') ELSE raw END) AS line FROM plines")
def strip_markup(spark, d) -> DataFrame:
    return V.page_lines(spark, d).select("id", F.col("line_no").cast("long").alias("line_no"), F.sha2(T.strip_markup(F.col("raw")), 256).alias("line"))


@query(f"WITH {V.SQL_DOCUMENT_LINES} SELECT id, line_no, {V.sql_normalized('raw')} AS norm FROM lines")
def normalize_text(spark, d) -> DataFrame:
    return V.document_lines(spark, d).select("id", F.col("line_no").cast("long").alias("line_no"), T.normalized(F.col("raw"), LATIN).alias("norm"))


@query(f"WITH {V.SQL_DOCUMENT_LINES} SELECT id, line_no, len(w) AS n_words, w[1] AS first_word, w[-1] AS last_word FROM (SELECT id, line_no, {V.sql_words('raw')} AS w FROM lines)")
def tokenize(spark, d) -> DataFrame:
    rows = V.document_lines(spark, d).select("id", F.col("line_no").cast("long").alias("line_no"), V.words().alias("w"))
    return rows.select("id", "line_no", F.size("w").cast("long").alias("n_words"), F.get("w", F.lit(0)).alias("first_word"), F.get("w", F.size("w") - 1).alias("last_word"))


@query(f"SELECT item_id, array_to_string(w[1:12], ' ') AS lemma, least(len(w), 12) AS n_words FROM (SELECT item_id, {V.sql_words('text')} AS w FROM benchmark)")
def first_k_words(spark, d) -> DataFrame:
    rows = V.read(spark, d, "benchmark").select("item_id", V.words("text").alias("w"))
    return rows.select("item_id", F.array_join(F.slice("w", 1, 12), " ").alias("lemma"), F.least(F.size("w"), F.lit(12)).cast("long").alias("n_words"))


@query("""WITH b AS (SELECT item_id, text, length(regexp_extract(text, '^((?s:.*?))[.:;]+(?:\\s|$)', 1)) AS cut FROM benchmark)
SELECT item_id, CASE WHEN cut > 0 THEN cut END AS cut, CASE WHEN cut > 0 THEN text[1:cut] ELSE text END AS lemma FROM b""")
def lemma_extract(spark, d) -> DataFrame:
    """Lemmas end at the first points before a space."""
    rows = V.read(spark, d, "benchmark").select("item_id", "text", T.lemma_end(F.col("text")).alias("cut"))
    return rows.select("item_id", F.col("cut").cast("long").alias("cut"), F.when(F.col("cut") > 0, F.substring("text", F.lit(1), F.col("cut"))).otherwise(F.col("text")).alias("lemma"))


@query("SELECT url, regexp_replace(regexp_replace(url, '\"', '', 'g'), '[/\\\\?%*:|<>]', '_', 'g') AS file_name, count(*) AS n FROM pages GROUP BY url")
def safe_file_names(spark, d) -> DataFrame:
    return V.read(spark, d, "pages").groupBy("url").agg(F.count("*").alias("n")).select("url", T.safe_file_name(F.col("url")).alias("file_name"), "n")


# --- word statistics and similarity -----------------------------------------------------------------------------------

_DF = f"""{V.SQL_DOCUMENT_LINES}, {V.SQL_BENCHMARK_LINES}, al AS (SELECT raw FROM lines UNION ALL SELECT raw FROM blines),
df AS (SELECT word, count(*) AS n_lines, count(*) / (SELECT count(*) FROM al) AS ratio FROM (SELECT unnest(list_distinct({V.sql_low_words('raw')})) AS word FROM al) GROUP BY word)"""
_BASE = "CASE WHEN word IN ({}) THEN 0.35 WHEN length(word) <= 2 THEN 0.45 WHEN length(word) >= 6 THEN 1.25 ELSE 1.0 END::DOUBLE".format(", ".join(f"'{w}'" for w in LATIN.stop_words))
_FACTOR = "CASE WHEN ratio > 0.08 THEN greatest(0.35::DOUBLE, 1 - 2 * ratio) WHEN ratio < 0.01 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END"


def _frequency(spark, d) -> DataFrame:
    return X.document_frequency(V.document_lines(spark, d).unionByName(V.benchmark_lines(spark, d)), LATIN)


@query(f"WITH {_DF} SELECT word, n_lines FROM df")
def doc_frequency(spark, d) -> DataFrame:
    return _frequency(spark, d).select("word", "n_lines")


@query(f"WITH {_DF} SELECT word, round({_FACTOR}, 6) AS factor FROM df")
def idf_factor(spark, d) -> DataFrame:
    return _frequency(spark, d).select("word", F.round(S.idf_factor(F.col("ratio")), 6).alias("factor"))


@query(f"WITH {_DF} SELECT word, round(least(1.30::DOUBLE, greatest(0.25::DOUBLE, {_BASE} * {_FACTOR})), 6) AS weight FROM df")
def word_weight(spark, d) -> DataFrame:
    return X.weights(_frequency(spark, d), LATIN).select("word", F.round("weight", 6).alias("weight"))


@query(f"""WITH {V.SQL_DOCUMENT_LINES}, c AS (SELECT {V.sql_words('raw')} AS w FROM lines WHERE NOT regexp_matches(raw, '^\\s*$'))
SELECT w[1] AS word, count(*) AS n, round(count(*) / (SELECT count(*) FROM c), 9) AS ratio FROM c WHERE len(w) > 0 GROUP BY w[1]""")
def opening_ratio(spark, d) -> DataFrame:
    return X.opening_ratio(V.document_lines(spark, d), LATIN).select("word", "n", F.round("ratio", 9).alias("ratio"))


_VOCABULARY = f"vocabulary AS (SELECT DISTINCT unnest({V.sql_low_words('text')}) AS word FROM benchmark)"


def _vocabulary(spark, d) -> DataFrame:
    return V.read(spark, d, "benchmark").select(F.explode(X.idf_words(F.col("text"), LATIN)).alias("word")).distinct()


_STEM = "CASE WHEN length(regexp_replace({0}, '^[aeo]+', '')) >= 3 THEN regexp_replace({0}, '^[aeo]+', '') ELSE {0} END"
_SKELETON = "CASE WHEN length(regexp_replace({0}, '[iu]', '', 'g')) >= 3 THEN regexp_replace(regexp_replace(regexp_replace({0}, '[iu]', '', 'g'), 'e$', 'a'), 'n$', 'm') ELSE regexp_replace({0}, '[iu]', '', 'g') END"


@query(f"WITH {_VOCABULARY} SELECT word, {_STEM.format('word')} AS stem FROM vocabulary")
def stem_strip(spark, d) -> DataFrame:
    return _vocabulary(spark, d).select("word", S.stem(F.col("word"), LATIN).alias("stem"))


@query(f"WITH {_VOCABULARY} SELECT word, {_SKELETON.format('word')} AS skeleton FROM vocabulary")
def spelling_skeleton(spark, d) -> DataFrame:
    return _vocabulary(spark, d).select("word", S.skeleton(F.col("word"), LATIN).alias("skeleton"))


def sql_similarity(a: str, b: str, s: str, t: str, x: str, y: str) -> str:
    """Similarity of the words a and b with stems s and t and skeletons x and y, all columns."""
    lo, hi, away = f"least(length({s}), length({t}))", f"greatest(length({s}), length({t}))", f"levenshtein({s}, {t})"
    near = f"CASE WHEN {away} <= CASE WHEN {lo} >= 7 THEN 2 ELSE 1 END AND 1 - {away} / {hi} >= 0.75 THEN 1 - {away} / {hi} ELSE 0 END"
    return f"(CASE WHEN {a} = {b} THEN 1 WHEN {s} = {t} AND ({s} <> {a} OR {t} <> {b}) THEN 0.92 WHEN {hi} - {lo} > 2 THEN 0 WHEN {s} <> {t} AND length({x}) >= 2 AND {x} = {y} THEN 0.9 WHEN {lo} <= 3 THEN 0 ELSE {near} END)::DOUBLE"


@query(f"""WITH {_VOCABULARY}, v AS (SELECT word, {_STEM.format('word')} AS stem FROM vocabulary), s AS (SELECT *, {_SKELETON.format('stem')} AS skel FROM v),
z AS (SELECT a.word AS a, b.word AS b, {sql_similarity('a.word', 'b.word', 'a.stem', 'b.stem', 'a.skel', 'b.skel')} AS sim FROM s a JOIN s b ON a.word < b.word)
SELECT a, b, round(sim, 6) AS sim FROM z WHERE sim > 0""")
def similarity_pairs(spark, d) -> DataFrame:
    """All similar words; SQL compares each with each."""
    return S.similar_pairs(_vocabulary(spark, d), LATIN).select("a", "b", F.round("sim", 6).alias("sim"))


# --- candidates -------------------------------------------------------------------------------------------------------

_RUNS = f"""{V.SQL_DOCUMENT_LINES}, bw AS (SELECT item_id, ({V.sql_words('text')})[1:12] AS w FROM benchmark), lw AS (SELECT id, line_no, {V.sql_words('raw')} AS w FROM lines),
b AS (SELECT item_id, unnest(w) AS word, unnest(range(len(w))) AS s FROM bw), l AS (SELECT id, line_no, unnest(w) AS word, unnest(range(len(w))) AS d FROM lw),
hit AS (SELECT item_id, id, line_no, s, d FROM b JOIN l USING (word)),
isl AS (SELECT *, s - row_number() OVER (PARTITION BY item_id, id, line_no, d - s ORDER BY s) AS g FROM hit),
run AS (SELECT item_id, id, line_no, min(s) AS s, min(d) AS d, count(*) AS n_words FROM isl GROUP BY item_id, id, line_no, d - s, g HAVING count(*) >= 3),
best AS (SELECT item_id, id, line_no, max(n_words) AS n_words FROM run WHERE s < 3 GROUP BY item_id, id, line_no),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n_words DESC, id, line_no) AS rank FROM best)"""


def _runs(spark, d) -> DataFrame:
    passages = R.places(V.read(spark, d, "benchmark"), ["item_id"], F.slice(V.words("text"), 1, 12), "s")
    lines = R.places(V.document_lines(spark, d), ["id", "line_no"], V.words(), "d")
    return R.runs(passages, lines, ["item_id"], ["id", "line_no"])


def _best(spark, d, k: int) -> DataFrame:
    out = R.best_lines(_runs(spark, d), ["item_id"], ["id", "line_no"], k=k)
    return out.select("item_id", "id", F.col("line_no").cast("long").alias("line_no"), F.col("n_words").cast("long").alias("n_words"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_RUNS} SELECT item_id, id, line_no, s, d, n_words FROM run")
def exact_run_candidates(spark, d) -> DataFrame:
    """All runs of three words or more that a lemma and a line share."""
    return _runs(spark, d).select("item_id", "id", *(F.col(c).cast("long").alias(c) for c in ("line_no", "s", "d", "n_words")))


@query(f"WITH {_RUNS} SELECT item_id, id, line_no, n_words, rank FROM ranked WHERE rank = 1")
def exact_run_links(spark, d) -> DataFrame:
    """The flagship: each benchmark passage with its best document line."""
    return _best(spark, d, 1)


@query(f"WITH {_RUNS} SELECT item_id, id, line_no, n_words, rank FROM ranked WHERE rank <= 3")
def topk_candidates(spark, d) -> DataFrame:
    return _best(spark, d, 3)


@query(f"WITH {_RUNS} SELECT item_id, max(n_words) FILTER (WHERE rank = 1) AS best, coalesce(max(n_words) FILTER (WHERE rank = 2), 0) AS rival, round((max(n_words) FILTER (WHERE rank = 1) - coalesce(max(n_words) FILTER (WHERE rank = 2), 0)) / max(n_words) FILTER (WHERE rank = 1), 6) AS margin FROM ranked WHERE rank <= 2 GROUP BY item_id")
def runner_up_margin(spark, d) -> DataFrame:
    two = _best(spark, d, 2).groupBy("item_id").agg(F.max(F.when(F.col("rank") == 1, F.col("n_words"))).alias("best"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("n_words"))), F.lit(0)).alias("rival"))
    return two.select("item_id", "best", "rival", F.round((F.col("best") - F.col("rival")) / F.col("best"), 6).alias("margin"))


@query(f"""WITH {V.SQL_TURNS} SELECT a.conv_id, a.turn, b.turn AS near FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 12 AND a.turn + 12 AND a.turn <> b.turn WHERE a.own IS NOT NULL AND b.own IS NOT NULL""")
def near_window_join(spark, d) -> DataFrame:
    """Linked turns at most twelve apart: equality on the conversation, then the range."""
    own = V.turns(spark, d).where("own IS NOT NULL").select("conv_id", "turn")
    return own.join(own.withColumnRenamed("turn", "near"), "conv_id").where(F.col("near").between(F.col("turn") - 12, F.col("turn") + 12) & (F.col("near") != F.col("turn"))).select("conv_id", "turn", "near")


@query(f"""WITH {V.SQL_DOCUMENT_LINES}, a AS (SELECT item_id, array_to_string(w[1:2], ' ') AS anchor FROM (SELECT item_id, {V.sql_words('text')} AS w FROM benchmark) WHERE len(w) >= 2),
l AS (SELECT DISTINCT id, line_no, w[i] || ' ' || w[i + 1] AS anchor FROM (SELECT id, line_no, w, unnest(range(1, len(w))) AS i FROM (SELECT id, line_no, {V.sql_words('raw')} AS w FROM lines)))
SELECT item_id, anchor, min(id) AS id, min(line_no) AS line_no FROM a JOIN l USING (anchor) GROUP BY item_id, anchor HAVING count(*) = 1""")
def unique_anchor(spark, d) -> DataFrame:
    """Opening word pairs that one line alone has."""
    rows = V.read(spark, d, "benchmark").select("item_id", V.words("text").alias("w")).where(F.size("w") >= 2)
    anchors = rows.select("item_id", F.array_join(F.slice("w", 1, 2), " ").alias("anchor"))
    pairs = R.grams(V.document_lines(spark, d), ["id", "line_no"], V.words(), "at", 2).withColumnRenamed("gram", "anchor")
    # a pair's first line is its last one: nothing but the passages' own pairs is shuffled, and of these one row a task
    held = pairs.join(anchors.select("anchor").distinct(), "anchor", "left_semi").groupBy("anchor").agg(F.min(F.struct("id", "line_no")).alias("at"), F.max(F.struct("id", "line_no")).alias("last"))
    once = anchors.groupBy("item_id", "anchor").agg(F.count("*").alias("n")).where("n = 1")
    return once.join(held.where("at <=> last"), "anchor").select("item_id", "anchor", "at.id", F.col("at.line_no").cast("long").alias("line_no"))


@query(f"""WITH {V.SQL_DOCUMENT_LINES}, c AS (SELECT {V.sql_words('raw')} AS w FROM lines WHERE NOT regexp_matches(raw, '^\\s*$')), o AS (SELECT w[1] AS word, count(*) / (SELECT count(*) FROM c) AS ratio FROM c WHERE len(w) > 0 GROUP BY w[1])
SELECT item_id, w[1] AS word, coalesce(ratio, 0) <= 0.008 AND length(w[1]) >= 3 AS rare FROM (SELECT item_id, {V.sql_words('text')} AS w FROM benchmark) LEFT JOIN o ON word = w[1]""")
def rarity_gate(spark, d) -> DataFrame:
    """May a passage's first word alone be its anchor?"""
    rows = V.read(spark, d, "benchmark").select("item_id", F.get(V.words("text"), F.lit(0)).alias("word"))
    opening = X.opening_ratio(V.document_lines(spark, d), LATIN).select("word", "ratio")
    return rows.join(opening, "word", "left").select("item_id", "word", ((F.coalesce("ratio", F.lit(0.0)) <= 0.008) & (F.length("word") >= 3)).alias("rare"))


# --- thresholds and confidence ----------------------------------------------------------------------------------------


@query("""SELECT DISTINCT l_quantity, l_linenumber::BIGINT AS l_linenumber, l_returnflag = 'R' AS explicit, round(least(1.5::DOUBLE, greatest(CASE WHEN l_linenumber <= 2 THEN 0.4 WHEN l_linenumber <= 4 THEN 0.55 ELSE 0.7 END::DOUBLE,
  l_quantity / 10 * (CASE WHEN l_linenumber <= 2 THEN 0.55 WHEN l_linenumber <= 4 THEN 0.6 ELSE 0.65 END::DOUBLE + CASE WHEN l_returnflag = 'R' THEN 0 ELSE 0.05 END::DOUBLE))), 6) AS threshold FROM lineitem""")
def dynamic_threshold(spark, d) -> DataFrame:
    """Quantities stand for ten times the expected weight, line numbers for word counts."""
    rows = V.read(spark, d, "lineitem").select("l_quantity", F.col("l_linenumber").cast("long").alias("l_linenumber"), (F.col("l_returnflag") == "R").alias("explicit")).distinct()
    return rows.withColumn("threshold", F.round(P.threshold(F.col("l_quantity") / 10, F.col("l_linenumber"), F.col("explicit")), 6))


_Z = """(0.35 + 3.2 * (least(1.0, l_quantity / 50) - 0.5) + 2.4 * ((1 - exp(-l_linenumber / 3.5)) - 0.55) + 2.6 * (least(1.0, 1 - l_tax) - 0.9) + 1.1 * (least(1.0, l_quantity / 50 * 8 / l_linenumber / 1.3) - 0.55)
 + 1.7 * (l_discount * 10 - 0.35) + CASE WHEN l_linestatus = 'F' THEN 1.15 ELSE 0 END + CASE WHEN l_returnflag = 'R' THEN 0.45 ELSE 0 END)"""


@query(f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, greatest(5, least(99, floor(100 / (1 + exp(-(0.5163 * {_Z} + 0.1358))) + 0.5)))::BIGINT AS confidence FROM lineitem")
def confidence_model(spark, d) -> DataFrame:
    """Line items as evidence: quantity for coverage, tax for similarity, discount for the margin."""
    c = F.col
    out = P.confidence(c("l_quantity") / 50 * 8, F.lit(8.0), c("l_linenumber"), (1 - c("l_tax")) * c("l_linenumber"), F.lit(1.0), 1 - c("l_discount") * 10, c("l_linestatus") == "F", c("l_returnflag") == "R")
    return V.read(spark, d, "lineitem").select("l_orderkey", c("l_linenumber").cast("long").alias("l_linenumber"), out.cast("long").alias("confidence"))


@query("SELECT DISTINCT p_size::BIGINT AS p_size, p_size % 13 AS pass_no, round(CASE WHEN p_size % 13 <= 0 THEN 0 ELSE greatest(0.0::DOUBLE, 0.18::DOUBLE * (p_size % 13) - 0.9::DOUBLE * (1 - least(1.0::DOUBLE, greatest(0.0::DOUBLE, (p_size - 1) / 8)))) END, 6) AS penalty FROM part")
def pass_penalty(spark, d) -> DataFrame:
    rows = V.read(spark, d, "part").select(F.col("p_size").cast("long").alias("p_size")).distinct().withColumn("pass_no", (F.col("p_size") % 13).cast("int"))
    return rows.withColumn("penalty", F.round(P.pass_penalty(F.col("pass_no"), F.col("p_size")), 6))


@query("SELECT c_custkey, c_acctbal >= 0 AS known, greatest(5, least(99, floor(100 * (CASE WHEN c_acctbal > 0 THEN least(99, c_acctbal / 100) ELSE 70 END / 100 * pow(0.8, greatest(1, c_nationkey % 4))) + 0.5)))::BIGINT AS confidence FROM customer")
def inherited_confidence(spark, d) -> DataFrame:
    parent = F.when(F.col("c_acctbal") > 0, F.least(F.lit(99), F.col("c_acctbal") / 100))
    return V.read(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") >= 0).alias("known"), P.inherited_confidence(parent, F.col("c_nationkey") % 4).cast("long").alias("confidence"))


# --- ordered operators ------------------------------------------------------------------------------------------------


@query(f"""WITH {V.SQL_TURNS}, i AS (SELECT *, last_value(own IGNORE NULLS) OVER w AS target, count(own) OVER w AS g FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, target, target IS NOT NULL AND own IS NULL AS is_inherited, CASE WHEN target IS NOT NULL THEN row_number() OVER (PARTITION BY conv_id, g ORDER BY turn) - 1 END AS depth FROM i""")
def inherit_asof(spark, d) -> DataFrame:
    out = C.inherited(V.turns(spark, d), ["conv_id"], "turn", "own")
    return out.select("conv_id", "turn", "target", "is_inherited", F.col("depth").cast("long").alias("depth"))


@query(f"""WITH {V.SQL_TURNS}, k AS (SELECT *, sum((role = 'user' AND turn % 4 = 0)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS chain FROM turns)
SELECT conv_id, turn, last_value(own IGNORE NULLS) OVER (PARTITION BY conv_id, chain ORDER BY turn) AS target FROM k""")
def chain_islands(spark, d) -> DataFrame:
    """Inheritance that every fourth user turn severs."""
    return C.inherited(V.turns(spark, d), ["conv_id"], "turn", "own", (F.col("role") == "user") & (F.col("turn") % 4 == 0)).select("conv_id", "turn", "target")


@query(f"""WITH {V.SQL_TURNS}, i AS (SELECT *, count(own) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM turns) SELECT conv_id, min(turn) AS turn, count(*) - 1 AS n_followers FROM i WHERE g > 0 GROUP BY conv_id, g""")
def follower_count(spark, d) -> DataFrame:
    return C.followers(V.turns(spark, d), ["conv_id"], "turn", "own")


@query(f"""WITH {V.SQL_TURNS}, w AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo, first_value(own IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hi FROM turns)
SELECT conv_id, turn, lo, hi, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN greatest(1, hi - lo + 1) END AS width FROM w""")
def window_bounds(spark, d) -> DataFrame:
    out = C.windows(V.turns(spark, d), ["conv_id"], "turn", "own")
    return out.select("conv_id", "turn", "lo", "hi", F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), F.col("width")).alias("width"))


@query(f"""WITH {V.SQL_TURNS}, t AS (SELECT conv_id, turn, own // 4 AS own FROM turns), w AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo, first_value(own IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hi FROM t)
SELECT conv_id, turn, lo AS target FROM w WHERE own IS NULL AND lo = hi""")
def gap_fill(spark, d) -> DataFrame:
    coarse = V.turns(spark, d).withColumn("own", F.floor(F.col("own") / 4))
    return C.gaps(coarse, ["conv_id"], "turn", "own")


@query(f"""WITH {V.SQL_TURNS}, l AS (SELECT conv_id, own < lag(own) OVER (PARTITION BY conv_id ORDER BY turn) AS back FROM turns WHERE own IS NOT NULL) SELECT conv_id, count(*) AS n_links, count(*) FILTER (WHERE back) AS n_violations FROM l GROUP BY conv_id""")
def order_violations(spark, d) -> DataFrame:
    return C.order_violations(V.turns(spark, d), ["conv_id"], "turn", "own")


@query(f"""WITH {V.SQL_TURNS}, i AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS target FROM turns)
SELECT count(*) AS n_lines, count(own) AS n_own, count(*) FILTER (WHERE own IS NULL AND target IS NOT NULL) AS n_inherited, count(*) FILTER (WHERE target IS NULL) AS n_none, round(100 * count(target) / count(*), 6) AS coverage FROM i""")
def coverage_metrics(spark, d) -> DataFrame:
    out = C.inherited(V.turns(spark, d), ["conv_id"], "turn", "own")
    return out.agg(F.count("*").alias("n_lines"), F.count("own").alias("n_own"), F.count_if("is_inherited").alias("n_inherited"), F.count_if(F.col("target").isNull()).alias("n_none"), F.round(100 * F.count("target") / F.count("*"), 6).alias("coverage"))


@query(f"""WITH {V.SQL_TURNS}, w AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo, first_value(own IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hi FROM turns)
SELECT greatest(1, hi - lo + 1) AS width, count(*) AS n FROM w WHERE lo IS NOT NULL AND hi IS NOT NULL AND own IS NULL GROUP BY 1""")
def window_width_hist(spark, d) -> DataFrame:
    out = C.windows(V.turns(spark, d), ["conv_id"], "turn", "own").where("lo IS NOT NULL AND hi IS NOT NULL AND own IS NULL")
    return out.groupBy("width").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM m) SELECT conv_id, any_value(role) AS value, min(turn) AS first, max(turn) AS last, count(*) AS n FROM r GROUP BY conv_id, run""")
def consecutive_groups(spark, d) -> DataFrame:
    return C.groups(V.read(spark, d, "conversations"), ["conv_id"], "turn", F.col("role"))


@query(f"""WITH {V.SQL_TURNS} SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(own, 85) DESC, turn) AS place FROM turns""")
def sort_by_confidence(spark, d) -> DataFrame:
    by = Window.partitionBy("conv_id").orderBy(F.coalesce("own", F.lit(85)).desc(), "turn")
    return V.turns(spark, d).select("conv_id", "turn", F.row_number().over(by).cast("long").alias("place"))


@query(f"WITH {_RUNS} SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM ranked)")
def unlinked_anti(spark, d) -> DataFrame:
    return V.read(spark, d, "benchmark").select("item_id").join(_best(spark, d, 1), "item_id", "left_anti")


@query(f"WITH {_RUNS} SELECT id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM best WHERE n_words >= 12 GROUP BY id")
def links_by_document(spark, d) -> DataFrame:
    """Links gathered by the document they point at."""
    full = R.best_lines(_runs(spark, d), ["item_id"], ["id", "line_no"], k=None).where("n_words >= 12")
    return full.groupBy("id").agg(F.countDistinct("item_id").alias("n_items"), F.array_join(F.array_sort(F.collect_set(F.col("item_id").cast("string"))), ",").alias("items"))

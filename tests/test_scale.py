"""What grew faster than its input: each of these took minutes, or far more rows, before."""

import itertools
import re
import time

from pyspark.sql import functions as F

from glossloom.functions import similarity
from glossloom.functions import text as T
from glossloom.operators import lexicon, lines, quality, runs
from glossloom.plans import registry
from glossloom.plans.queries import QUERIES
from glossloom.profiles import LATIN


def test_titles_of_many_copies_are_aligned_without_making_pairs(spark):
    n = 60_000
    c = spark.range(n).select("id", F.lit(0).alias("seg_no"), F.when(F.col("id") % 3 == 0, "the of and").when(F.col("id") % 3 == 1, "the x").otherwise("of and the far").alias("title"))
    t = spark.range(n, 2 * n).select("id", F.lit(0).alias("seg_no"), F.when(F.col("id") % 2 == 0, "the of and to in").otherwise("and the").alias("title"))
    began = time.perf_counter()
    got = {(r["title"], r["t_id"]): r["n"] for r in lines.aligned(c, t, LATIN).join(c, ["id", "seg_no"]).groupBy("title", "t_id").count().withColumnRenamed("count", "n").collect()}
    assert time.perf_counter() - began < 60
    assert got == {("the of and", n): n // 3, ("the x", None): n // 3, ("of and the far", n + 1): n // 3}


def test_texts_are_cut_and_normalised_once(spark):
    """Filters that the planner derives, or pushes down, would cut and normalise each line again."""
    docs = spark.createDataFrame([(1, "Où va\r\nthe far côte\n"), (2, None), (3, "")], "id int, text string")
    ls = lines.lines(docs, "id", F.col("text"))
    assert sorted((r.id, r.line_no, r.raw) for r in ls.collect()) == [(1, 1, "Où va"), (1, 2, "the far côte"), (1, 3, ""), (3, 1, "")]
    grams = runs.grams(ls, ["id", "line_no"], T.words(T.normalized(F.col("raw"), LATIN)), "at")
    assert [tuple(r) for r in grams.collect()] == [(1, 2, 0, "the far c"), (1, 2, 1, "far c te")]
    opening = lexicon.opening_ratio(ls, LATIN)
    assert {r.word: (r.n, r.ratio) for r in opening.collect()} == {"o": (1, 0.5), "the": (1, 0.5)}
    for df in (grams, opening):
        plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        filters = [x for x in plan if "Filter" in x]
        assert not [x for x in filters if "split" in x or "translate" in x or "lower" in x]


def test_quotes_and_spaces_at_edges(spark):
    raw = ["'a' \"b\". c\"d '' e'", "''", " \t x ", "x́'´y “z”:", "﻿", "a' \"' b", "#  ", " ## x", "#x"]
    rows = spark.createDataFrame(list(enumerate(raw)), "i int, raw string")
    got = rows.select("i", T.normalized(F.col("raw"), LATIN, keep_points=True).alias("n"), T.trimmed(F.col("raw")).alias("t"), T.is_header(F.col("raw")).alias("h")).orderBy("i").collect()
    assert [r["n"] for r in got] == ["a' b. c\"d e'", "", "x", "x\"y z:", "", "a' b", "", "x", "x"]
    assert [r["t"] for r in got][2:5] == ["x", raw[3], ""]
    assert [r["h"] for r in got] == [False] * 7 + [True, False]


def test_unique_anchors_shuffle_no_pair_of_words_but_the_passages_own(spark, tmp_path):
    spark.createDataFrame([(1, "far côte x"), (2, "of the x"), (3, "no such"), (4, "one"), (5, "b a"), (5, "b a")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(7, "of the\nof the far c te\nfar c te far c"), (8, "b a"), (8, "b a")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["unique_anchor"](spark, str(tmp_path))
    assert [tuple(r) for r in found.collect()] == []
    spark.createDataFrame([(7, "of the\nof the y"), (8, "b a"), (8, "b a"), (9, "far c te far c")], "doc_id long, text string").write.parquet(f"{tmp_path}/more/documents.parquet")
    spark.read.parquet(f"{tmp_path}/benchmark.parquet").where("item_id <> 5").unionByName(spark.createDataFrame([(6, "b a")], "item_id long, text string")).write.parquet(f"{tmp_path}/more/benchmark.parquet")
    found = QUERIES["unique_anchor"](spark, f"{tmp_path}/more")
    assert sorted(tuple(r) for r in found.collect()) == [(1, "far c", 9, 1), (6, "b a", 8, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    explode, semi = (next(i for i, x in enumerate(plan) if what in x) for what in ("Generate posexplode(transform", "LeftSemi"))
    assert not [x for x in plan[semi:explode] if "Aggregate" in x and "line_no" in x]
    assert not [x for x in plan if "Aggregate [id" in x]


def test_similar_words_are_found_by_their_spelling_and_not_one_by_one():
    import random

    draw = random.Random(7)
    words = {"".join(draw.choice("אבוי") for _ in range(draw.randint(1, 9))) for _ in range(300)}
    long = ["".join(draw.choice("גדהט") for _ in range(n)) for n in (13, 14, 15, 16, 17, 18, 19, 40)]
    words |= {w[:i] + x + w[j:] for w in long for i, j in ((2, 3), (4, 4), (5, 6), (7, 9)) for x in ("", "נ", "נס")} | {"ו" * 2 + w for w in long} | set(long)
    say = similarity.Words()
    there = similarity.Vocabulary(say, words)
    for a in [*words, "", "אב'", long[3][1:], "ש" + long[4]]:
        assert there.near(a) == {b: s for b in words if (s := say._similarity(a, b)) > 0}
    unlike = ["".join(draw.choice("גדהטנסעפצקרת") for _ in range(8)) for _ in range(400)]
    say = similarity.Words()
    there = similarity.Vocabulary(say, unlike)
    for a in unlike:
        there.near(a)
    assert say.similarity.cache_info().misses < 4_000  # of 160,000 pairs


def test_the_rarity_gate_reads_each_text_once(spark, tmp_path):
    """The join on the word put a filter before the count, which normalised each line twice; the total read the documents once more."""
    spark.createDataFrame([(1, "the far x"), (2, "far"), (3, "of it"), (4, "..."), (5, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "The a\n\n...\r\nfar\n# far"), (2, None), (3, "the\n" + "x\n" * 200)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["rarity_gate"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(1, "the", False), (2, "far", True), (3, "of", False), (4, None, None), (5, None, None)]
    plan = found._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    assert plan.count("array_remove(split(") == 2  # the passages' and the lines'
    assert plan.count("FileScan parquet") == 2
    opening = QUERIES["opening_ratio"](spark, str(tmp_path)).collect()
    assert {r.word: (r.n, r.ratio) for r in opening} == {"the": (2, round(2 / 204, 9)), "far": (1, round(1 / 204, 9)), "x": (200, round(200 / 204, 9))}


def test_links_by_document_rank_no_lines(spark, tmp_path):
    """A rank over all lines of a passage was one task for each passage, which held a row for every line."""
    opening = "one two three four five six seven eight nine ten eleven twelve"
    spark.createDataFrame([(1, opening + " more"), (2, opening), (3, "one two three four")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, f"{opening}\nand {opening}\none two three") for k in range(300)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["links_by_document"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(k, 2, "1,2") for k in range(300)]
    ranked = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [row_number()" in x]
    assert len(ranked) == 1 and "diagonal" in ranked[0]  # the runs' own


def test_ties_are_counted_without_gathering_candidates(spark):
    """A window over each passage's candidates was one task for all of its lines."""
    n = 100_000
    rows = spark.range(n).select(F.lit(1).alias("item_id"), F.when(F.col("id") % 2 == 0, 9).otherwise(F.col("id") % 5).alias("score"))
    rows = rows.unionByName(spark.createDataFrame([(2, 3), (2, 3), (2, 4), (3, None), (3, None), (4, 0), (4, None), (4, 0)], "item_id int, score long"))
    found = quality.tied(rows, ["item_id"])
    assert sorted(map(tuple, found.collect())) == [(1, n // 2), (4, 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_runs_make_no_string_for_each_place_of_a_line(spark, tmp_path):
    """A string of three words was made, and by interpreted code, for each word of each line."""
    passages = {1: "a b a b a b c", 2: "the far côte of the far c te of it all and more than twelve words", 3: "x y", 4: "", 5: None, 6: "q q q q q", 7: "a b a b a b c"}
    texts = {1: "a b a b a b c\nb a b\r\nx y z\n\nq q", 2: "On the far c te: of the, far “c” te of it all and more than twelve words", 3: "", 4: None, 5: "q q q q\n" * 3 + "a b", 6: "c a b a x a b a b"}
    spark.createDataFrame(list(passages.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, "user", "xy"), (2, 0, "user", "x"), (2, 3, "user", None)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower().replace("ô", " "))
    expected, best = [], {}
    for item, p in passages.items():
        a = words(p)[:12]
        for doc, text in texts.items():
            for line_no, line in enumerate(re.split("\r?\n", text) if text is not None else [], 1):
                b = words(line)
                for s, d in itertools.product(range(len(a)), range(len(b))):
                    if s and d and a[s - 1] == b[d - 1]:
                        continue
                    n = sum(1 for _ in itertools.takewhile(lambda xy: xy[0] == xy[1], zip(a[s:], b[d:])))
                    if n >= 3:
                        expected.append((item, doc, line_no, s, d, n))
                        if s < 3:
                            best.setdefault(item, {}).setdefault((doc, line_no), []).append(n)
    assert len(expected) > 20
    found = QUERIES["exact_run_candidates"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    ranked = {item: sorted((-max(n), *at) for at, n in per.items()) for item, per in best.items()}
    top = QUERIES["topk_candidates"](spark, str(tmp_path))
    assert sorted(map(tuple, top.collect())) == sorted((item, doc, line_no, -n, k) for item, per in ranked.items() for k, (n, doc, line_no) in enumerate(per[:3], 1))
    for name in ("topk_candidates", "links_csv", "reverse_links", "runner_up_margin", "exact_run_candidates", "cross_references", "mirror_links", "exact_run_links", "links_export"):
        plan = registry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "concat_ws( ," not in plan and "posexplode(transform(" not in plan, name
        assert plan.count("array_remove(split(") == 2, name  # the passages' and the lines'


def test_lines_of_plain_characters_are_normalised_by_one_look(spark):
    """A line with an accent, as most are in some languages, was searched for each kind of quote and for marks."""
    chars = [*map(chr, range(0x100)), *"׳’‘״“”″‟„́̅İKſא"]
    raw = [f"A{x}b {x}C {x}{x}d{x} e{x}1 é{y}" for x in chars for y in ("", "'", "<i>", "́", "İ")]
    rows = spark.createDataFrame(list(enumerate(raw)), "i int, raw string")

    def norm(t: str) -> str:
        t = re.sub("<[^>]*>", " ", t)
        t = re.sub("[״“”″‟„]", '"', re.sub("[׳’‘´]", "'", t).replace("''", '"'))
        t = re.sub("[̀-ͯ]", "", t.lower())
        t = re.sub("[^a-z0-9'\"]+", " ", t)
        t = re.sub(r"\"+(?=[.:]*(?: |$))", "", re.sub("(?<![^ ])[\"']+", "", t))
        return re.sub(" {2,}", " ", t).strip(" ")

    found = rows.select("i", T.normalized(F.col("raw"), LATIN).alias("n"))
    assert [r.n for r in found.orderBy("i").collect()] == [norm(t) for t in raw]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"CASE WHEN RLIKE\([^,]*, \[\^", plan)

import random

from pyspark.sql import functions as F

from glossloom.operators import catalog, chains, exports, lines, mirror
from glossloom.profiles import HEBREW
from glossloom.sources import files


def test_mirror_round_trip(spark):
    rng = random.Random(1)
    rows = [(b, s, k, rng.randint(1, 5000)) for b in ("x", "y") for s in ("rashi", "tosafot") for k in sorted(rng.sample(range(1, 300), 80))]
    df = spark.createDataFrame(rows, "book string, series string, comm_line int, src_line long")
    back = mirror.decoded(mirror.encoded(df, ["book", "series"], "src_line"), ["book", "series"])
    assert {tuple(r) for r in back.collect()} == set(rows)
    text = mirror.encoded(spark.createDataFrame([("b", 1, 40), ("b", 4, 3)], "k string, comm_line int, src_line long"), ["k"], "src_line").first().encoded
    assert text == "14,,,-11"
    odd = mirror.decoded(spark.createDataFrame([("k", ",a,,-1,!,z")], "k string, encoded string"), ["k"])
    assert [(r.comm_line, r.src_line) for r in odd.orderBy("comm_line").collect()] == [(2, 10), (4, 9), (6, 44)]


def test_reverse_and_mirror_links(spark):
    links = spark.createDataFrame([(1, 5, None), (2, 6, "rashi"), (3, 7, "tosafot"), (4, 9, "rashi")], "line_index_1 int, line_index_2 int, secondary_target string")
    titles = spark.createDataFrame([(1, "דף ב"), (2, "")], "line int, title string")
    got = {r.line_index_2: (r.owner, r.line_index_1, r.he_ref_2, r.path_2) for r in exports.reverse(links, titles, "פירוש").collect()}
    assert got == {1: ("", 5, "פירוש - דף ב", "פירוש.txt"), 2: ('רש"י על ', 6, "פירוש", "פירוש.txt"), 3: ("תוספות על ", 7, "פירוש", "פירוש.txt"), 4: ('רש"י על ', 9, "פירוש", "פירוש.txt")}
    table = spark.createDataFrame([("rashi", 6, 60), ("tosafot", 6, 61)], "series string, comm_line int, src_line int")
    assert [tuple(r) for r in exports.mirrored(links, table).collect()] == [(2, 60)]


def test_csv_and_drop_ids(spark):
    row = spark.createDataFrame([(1, 'a"b', None)], "a int, b string, c string").select(exports.csv_line(F.col("a"), F.col("b"), F.col("c")).alias("x")).first()
    assert row.x == '"1","a""b",""'
    ids = spark.createDataFrame([(x,) for x in ("primary:3", "rashi:12", "rashi:0", "rashi:3junk", "other:1", "primary:", None)], "v string")
    got = [r.p and tuple(r.p) for r in ids.select(exports.parsed_drop_id(F.col("v")).alias("p")).collect()]
    assert got == [("primary", 3), ("rashi", 12), None, None, None, None, None]


def test_highlight(spark):
    row = spark.createDataFrame([("  a  b c\td ", [(1, 2)]), ("a b", [(0, 1), (1, 9)]), ("x", [(5, 1)])], "line string, spans array<struct<word_start: int, word_count: int>>")
    got = [r.x for r in row.select(exports.highlighted(F.col("line"), F.col("spans")).alias("x")).collect()]
    assert got[1:] == ["<b>a</b> <b>b</b>", "<b>x</b>"] and got[0].startswith("  a  <b>b c</b>\td")


def test_breakdown(spark):
    row = spark.createDataFrame([(["ואמר", "זר"], ["אמר", "רבא"])], "w array<string>, t array<string>")
    out = row.select(exports.breakdown(F.col("w"), F.col("t"), lambda w: F.lit(1.0), HEBREW).alias("b")).first().b
    assert [(x.kind, round(x.sim, 2), x.label) for x in out] == [("ADD", 0.92, "ואמר->אמר:0.92*1.00=0.92"), ("SUB", 0.0, "זר->אמר:0.00*1.00=0.00")]


def test_offered_lines(spark):
    df = spark.createDataFrame([(1, 10, 100, None), (10, 10, 100, None), (5, 10, 100, 30), (5, 10, 100, 300), (1, 0, 5, None)], "line int, n_lines int, n_target int, current int")
    got = [(r["first"], r["last"]) for r in exports.offered(df, 8).orderBy(F.monotonically_increasing_id()).collect()]
    assert got == [(2, 18), (92, 100), (22, 38), (42, 58), (1, 5)]


def test_segments(spark):
    docs = spark.createDataFrame([(1, "pre\r\n<h2>A</h2>\nx\n\n# B\ny"), (2, "a\nb"), (3, ""), (4, None)], "id long, text string")
    got = {(r.id, r.title, r.header_line, r.start_line, r.end_line) for r in lines.segments(lines.lines(docs, "id", F.col("text"))).collect()}
    assert got == {(1, "A", 2, 3, 4), (1, "B", 5, 6, 6), (2, lines.MAIN_TITLE, 0, 1, 2), (3, lines.MAIN_TITLE, 0, 1, 1)}


def test_alignment_prefers_equal_titles(spark):
    c = spark.createDataFrame([(1, 1, "דף ב"), (1, 2, "דף ג."), (1, 3, "אחר"), (1, 4, "דף ד עמוד א פרק"), (1, 5, "")], "id long, seg_no int, title string")
    t = spark.createDataFrame([(9, 1, "דף ב עמוד א"), (9, 2, "דף ב"), (9, 3, "דף ג עמוד א"), (9, 4, "עמוד א"), (9, 5, "דף ד")], "id long, seg_no int, title string")
    assert {r.seg_no: r.t_seg for r in lines.aligned(c, t).collect()} == {1: 2, 2: 3, 3: None, 4: 4, 5: None}


def test_chains(spark):
    rows = [(1, 1, None), (1, 2, 7), (1, 3, None), (1, 4, None), (1, 5, 7), (1, 6, None), (1, 7, 9), (2, 1, None)]
    df = spark.createDataFrame(rows, "d int, line int, own int")
    got = {(r.d, r.line): (r.target, r.is_inherited, r.depth) for r in chains.inherited(df, ["d"], "line", "own").collect()}
    assert got[1, 1] == (None, False, None) and got[1, 4] == (7, True, 2) and got[1, 7] == (9, False, 0) and got[2, 1] == (None, False, None)
    cut = {(r.d, r.line): r.target for r in chains.inherited(df, ["d"], "line", "own", F.col("line") == 4).collect()}
    assert cut[1, 3] == 7 and cut[1, 4] is None
    assert {(r.line, r.target) for r in chains.gaps(df, ["d"], "line", "own").collect()} == {(3, 7), (4, 7)}
    assert {(r.line, r.n_followers) for r in chains.followers(df, ["d"], "line", "own").collect()} == {(2, 2), (5, 1), (7, 0)}
    assert {(r.d, r.value, r["first"], r["last"], r.n) for r in chains.groups(df, ["d"], "line", F.col("own")).collect()} == {(1, None, 1, 1, 1), (1, 7, 2, 2, 1), (1, None, 3, 4, 2), (1, 7, 5, 5, 1), (1, None, 6, 6, 1), (1, 9, 7, 7, 1), (2, None, 1, 1, 1)}


def test_catalog(spark):
    raw = spark.createDataFrame([("1", "ברכות", None), ("1", "ברכות", "p"), ("2", " ", None), (None, "x", None), ("3", "רש\"י על ברכות", "q")], "bookId string, title string, path string")
    books = catalog.books(raw)
    assert {(r.book_id, r.title, r.path) for r in books.collect()} == {("1", "ברכות", ""), ("2", "2", ""), ("3", "רש\"י על ברכות", "q")}
    wanted = spark.createDataFrame([("ברכות",), ("רש\"י על",), ("מסכת ברכות",), ("שבת",)], "name string")
    assert {r.name: r.book_id for r in catalog.resolved(wanted, books).collect()} == {"ברכות": "1", "רש\"י על": "3", "מסכת ברכות": "1", "שבת": None}
    pages = spark.createDataFrame([("1", 5000, "b"), ("1", 0, "a")], "book_id string, offset int, text string")
    assert catalog.pages_joined(pages).first().text == "a\nb"
    assert catalog.found(books, F.lit("רש")).count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "ספר א.txt").write_text("﻿שורה\nשנייה", encoding="utf-8")
    row = files.texts(spark, str(tmp_path / "in")).first()
    assert row.title == "ספר א" and row.text == "שורה\nשנייה"
    links = spark.createDataFrame([(1, 2, 'a "b"', "p.txt", "commentary", "x")], "line_index_1 int, line_index_2 int, he_ref_2 string, path_2 string, connection_type string, book string")
    files.write_links_json(links, str(tmp_path / "json"), ["book"])
    assert files.links_json(spark, str(tmp_path / "json" / "book=x")).first().he_ref_2 == 'a "b"'
    files.write_csv(links, str(tmp_path / "csv"))
    assert b"".join(p.read_bytes() for p in (tmp_path / "csv").glob("part-*")) == b'"1","2","a ""b""","p.txt","commentary"\r\n'
    files.save_session({"links": links}, str(tmp_path / "s"))
    assert files.load_session(spark, str(tmp_path / "s"), ["links"])["links"].count() == 1
    (tmp_path / "d.json").write_text('{"א": "ב"}', encoding="utf-8")
    assert files.json_dictionaries(spark, str(tmp_path / "d.json")).first().options == ["ב"]


def test_analysis(spark):
    links = spark.createDataFrame([(1, 1, 4, "אמר רבא", 90, "approved", [(4, 2.5, 90), (6, 1.0, 50)]), (1, 2, 9, "x", None, "pending", None)], "id long, line_index_1 int, line_index_2 int, dh_text string, confidence int, status string, candidates array<struct<line_num: int, score: double, confidence: int>>")
    own = spark.createDataFrame([(1, 1, "אמר רבא.", ["אמר", "רבא"]), (1, 2, "", [])], "id long, line_no int, raw string, words array<string>")
    target = spark.createDataFrame([(1, 4, "ואמר רב", ["ואמר", "רב"])], "id long, line_no int, raw string, words array<string>")
    factors = spark.createDataFrame([(1, "רבא", 1.2), (2, "רבא", 9.0)], "id long, word string, factor double")
    one, two = exports.analysis(links, own, target, factors).orderBy("line_index_1").collect()
    assert tuple(one.asDict()) == exports.ANALYSIS
    assert one.word_score_breakdown == "אמר->ואמר:0.92*0.35=0.32 | רבא->ואמר:0.00*1.20=0.00"
    assert one.word_score_changes == "added:אמר+0.32; subtracted:רבא-1.20"
    assert one.candidate_scores == "4:2.50; 6:1.00" and one.analysis_notes == "dh_words=2; source_words=2; match_confidence=90; candidates=4:2.50; 6:1.00"
    assert two.word_score_changes == "added:none; subtracted:none" and two.source_line is None


def test_cross_references(spark):
    links = spark.createDataFrame([(1, 5, "rashi"), (2, 6, "rashi"), (3, 5, None)], "line_index_1 int, line_index_2 int, secondary_target string")
    xref = spark.createDataFrame([("rashi", 5, 70, 2), ("rashi", 5, 60, 1), ("tosafot", 6, 1, 1)], "series string, line_index_1 int, line_index_2 int, nth int")
    assert {r.line_index_1: r.primary_line for r in exports.crossed(links, xref).collect()} == {1: 60, 2: None, 3: None}


def test_analysis_breakdown_of_whole_passages(spark, tmp_path):
    from glossloom.functions import similarity as S
    from glossloom.plans import registry
    from glossloom.plans import tables as V
    from glossloom.profiles import LATIN

    texts = ["alpha bravo", "", None, "the colour of a river is not the color of rivers nor of aich or ouch " * 2, "remember winter and summer one two three remembers wintr somer alpha four"]
    passages = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "item_id long, text string")
    passages.write.parquet(f"{tmp_path}/benchmark.parquet")
    own, want = S.Words(LATIN), set()
    for r in passages.select("item_id", V.words("text").alias("w")).collect():
        for i, word in enumerate(r.w or []):
            sim = max((own.similarity(word, other) for other in r.w[6:]), default=0.0)
            want.add((r.item_id, i, word, round(sim, 6), round(sim * own.weight(word), 6), "ADD" if sim >= 0.75 else "SUB"))
    rows = registry.QUERIES["analysis_breakdown"](spark, str(tmp_path)).collect()
    assert {(r.item_id, r.i, r.word, r.sim, r.gain, r.kind) for r in rows} == want and len(rows) == len(want)
    assert {kind for *_, sim, _, kind in want if 0 < sim < 1} == {"ADD"} and any(len(x[2]) > 3 and x[5] == "SUB" for x in want)


def test_the_last_link_of_a_line_stays(spark):
    df = spark.createDataFrame([("b", 1, 9, 0), ("b", 1, 4, 1), ("b", 3, 5, 2)], "k string, comm_line int, src_line long, nth int")
    assert mirror.encoded(df, ["k"], "nth").first().encoded == "4,,1"

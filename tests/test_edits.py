import math
import random

import pytest
from pyspark.sql import functions as F

from glossloom.operators import edits, quality

LINES = "id long, line_no int, breaks boolean, blank boolean, continues boolean, label_only boolean"
LINKS = "id long, line_index_1 int, line_index_2 int, he_ref_2 string, is_inherited boolean, confidence int, status string"


def lines(spark, *kinds):
    """h: header, .: blank, c: content, i: it continues, l: names a book only."""
    return spark.createDataFrame([(1, k + 1, x == "h", x == ".", x == "i", x == "l") for k, x in enumerate(kinds)], LINES)


def links(spark, **targets):
    rows = [(1, int(k[1:]), abs(v), f"ref {abs(v)}", v < 0, 90, "approved") for k, v in targets.items()]
    return spark.createDataFrame(rows, LINKS)


def roles(df):
    return {r.line_no: (r.role, r.parent, r.pending, r.n_followers) for r in df.collect()}


def test_index(spark):
    text = lines(spark, *"hci.ilchihcci")
    got = roles(edits.index(text, links(spark, l2=5, l3=-5, l7=6)))
    assert got == {
        2: ("head", None, False, 2), 3: ("member", 2, False, None), 5: ("member", 2, False, None),
        7: ("head", None, False, 1), 9: ("member", 7, False, None),  # the first line after the header continues
        11: ("head", None, False, 0), 12: ("head", None, False, 1), 13: ("member", 12, True, None),
    }


def test_index_equals_a_walk(spark):
    rng = random.Random(5)
    kinds = [rng.choice("hccciii.l") for _ in range(300)]
    held = {f"l{k + 1}": rng.choice([1, -1]) * rng.randint(1, 9) for k, x in enumerate(kinds) if x in "cil" and rng.random() < 0.5}
    want, head = {}, None
    for k, x in enumerate(kinds, 1):
        if x == "h":
            after = next((y for y in kinds[k:] if y in "cil"), None)
            head = head if after == "i" else None
        elif x in "cil":
            target = held.get(f"l{k}")
            if target is None and x == "l":
                continue
            if target is not None and target > 0 or target is None and x != "i":
                want[k], head = ("head", None), k
            else:
                want[k] = ("member", head)
    got = roles(edits.index(lines(spark, *kinds), links(spark, **held)))
    assert {k: v[:2] for k, v in got.items()} == want
    assert all(v[3] == sum(w[1] == k for w in want.values()) for k, v in got.items() if v[0] == "head")


def test_edit_and_cascade(spark):
    text, own = lines(spark, *"ciici"), links(spark, l1=5, l2=-5, l4=6, l5=-6)
    after = edits.edited(own, spark.createDataFrame([(1, 1, 8), (1, 4, None)], "id long, line_index_1 int, line_index_2 int"))
    table = edits.index(text, own)
    out = edits.cascaded(after, table, spark.createDataFrame([(1, 1), (1, 4)], "id long, line_no int"))
    got = {r.line_index_1: (r.line_index_2, r.is_inherited, r.confidence) for r in out.collect()}
    assert got == {1: (8, False, 100), 2: (8, True, 90), 3: (8, True, 100)}
    assert roles(edits.index(edits.with_marks(lines(spark, *"cc"), spark.createDataFrame([(1, 2)], "id long, line_no int")), own.limit(0)))[2][:2] == ("member", 1)


def test_cascade_leaves_nothing_of_the_old_target(spark):
    schema = "id long, line_index_1 int, line_index_2 int, secondary_target string, is_inherited boolean, dh_text string, confidence int, status string, match_range struct<word_start: int, word_count: int, segments: array<struct<word_start: int, word_count: int>>>, candidates array<struct<line_num: int, score: double, confidence: int>>, candidate_index int"
    old, many = (0, 1, [(0, 1)]), [(5, 2.0, 90), (8, 1.0, 60)]
    rows = [(1, 1, 8, None, False, "אמר רבי", 100, "approved", None, None, None), (1, 2, 5, None, True, "שמע ישראל", 90, "approved", old, many, 0), (1, 3, 5, None, True, None, 90, "approved", old, [(5, 1.0, 80)], 0)]
    rows += [(2, 1, 8, "rashi", False, "אמר", 100, "approved", None, None, None), (2, 2, 8, None, True, "שמע", 70, "pending", old, many, 1)]
    links = spark.createDataFrame(rows, schema)
    table = spark.createDataFrame([(i, k, "head" if k == 1 else "member", None if k == 1 else 1) for i in (1, 2) for k in (1, 2, 3)], "id long, line_no int, role string, parent int")
    lemmas = spark.createDataFrame([(1, 3, "דבר אחר"), (1, 2, "no")], "id long, line_index_1 int, dh_text string")
    out = edits.cascaded(links, table, spark.createDataFrame([(1, 1), (2, 1)], "id long, line_no int"), lemmas)
    got = {(r.id, r.line_index_1): r for r in out.collect()}
    assert got.keys() == {(i, k) for i in (1, 2) for k in (1, 2, 3)}
    assert all(r.line_index_2 == 8 and r.match_range is None for r in got.values())
    assert [(r.line_num, r.score) for r in got[1, 2].candidates] == [(5, 2.0), (8, 1.0)] and got[1, 2].candidate_index == 1
    assert got[1, 3].candidates is None and got[1, 3].candidate_index is None and got[1, 3].dh_text == "דבר אחר" and got[1, 2].dh_text == "שמע ישראל"
    assert got[2, 2].candidates is None and got[2, 2].secondary_target == "rashi"
    targets = spark.createDataFrame([(1, None, 8, "כתוב שמע ישראל דבר אחר"), (2, "rashi", 8, "בי שמע")], "id long, secondary_target string, line_no int, raw string")
    again = {(r.id, r.line_index_1): r.match_range for r in edits.rematched(out, targets).collect()}
    assert tuple(again[1, 2])[:2] == (1, 2) and tuple(again[1, 3])[:2] == (3, 2) and tuple(again[2, 2])[:2] == (1, 1) and again[1, 1] is None


def test_candidates_and_approval(spark):
    schema = "line_index_2 int, confidence int, status string, candidates array<struct<line_num: int, score: double, confidence: int>>, candidate_index int"
    df = spark.createDataFrame([(1, 90, "pending", [(1, 2.0, 90), (7, 1.0, 60)], 0), (7, 60, "pending", [(1, 2.0, 90), (7, 1.0, 60)], 1), (3, 80, "pending", None, None)], schema)
    assert [(r.line_index_2, r.confidence, r.candidate_index) for r in edits.next_candidate(df).collect()] == [(7, 60, 1), (1, 90, 0), (3, 80, None)]
    assert [r.status for r in edits.approved(df).collect()] == ["approved", "pending", "approved"]
    spans = spark.createDataFrame([((2, 9), 4), ((9, 1), 3), ((0, 1), 0)], "highlight struct<word_start: int, word_count: int>, n int")
    assert [r.highlight and tuple(r.highlight) for r in edits.clamped(spans, F.col("n")).collect()] == [(2, 2), (2, 1), None]


def test_reliability(spark):
    df = spark.createDataFrame([(95, True), (97, True), (91, False), (55, True), (52, False), (100, True)], "confidence int, correct boolean")
    bands = {r.band: (r.n, r.stated, r.precision) for r in quality.reliability(df).collect()}
    assert bands == {90: (4, 95.75, 75.0), 50: (2, 53.5, 50.0)}
    assert quality.calibration_error(quality.reliability(df)).first().ece == pytest.approx((4 * 20.75 + 2 * 3.5) / 6)
    assert {r.bar: r.n for r in quality.precision_at(df, (50, 90)).collect()} == {50: 6, 90: 4}


def test_platt(spark):
    rng = random.Random(7)
    rows = [(z, rng.random() < 1 / (1 + math.exp(-(0.5 * z + 0.2)))) for z in (rng.uniform(-4, 4) for _ in range(4000))]
    a, b = quality.platt(spark.createDataFrame(rows, "z double, correct boolean"))
    assert abs(a - 0.5) < 0.1 and abs(b - 0.2) < 0.12


def test_ties_judge_and_report(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (1, 1.0), (2, 3.0)], "line int, score double")
    assert [tuple(r) for r in quality.tied(df, ["line"]).collect()] == [(1, 2)]
    judged = quality.judged_verbatim(spark.createDataFrame([(1, 5), (2, 6)], "line int, target int"), spark.createDataFrame([(1, 5, 4), (2, 6, 2)], "line int, target int, n_words int"), ["line", "target"])
    assert {r.line: r.correct for r in judged.collect()} == {1: True, 2: False}
    rows = quality.unlinked_report(spark.createDataFrame([(1, 3, 1, "raw"), (1, 9, 2, "x")], "id long, line_no int, seg_no int, raw string"), spark.createDataFrame([(1, 1, "source", "text")], "id long, seg_no int, role string, text string"))
    assert {r.line_no: r.report for r in rows.collect()} == {3: "line 3\n\nraw\n\nsource:\ntext", 9: "line 9\n\nx"}

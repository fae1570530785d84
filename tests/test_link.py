"""The engine on small Hebrew books."""

import random

import pytest
from pyspark.sql import functions as F

from glossloom.operators import link as K
from glossloom.operators.dictionary import Expander, entries, merged
from glossloom.operators.resolve import Link, Words, match_range, prune, windows

SOURCE = """<h2>דף ב.</h2>
מאימתי קורין את שמע בערבית משעה שהכהנים נכנסים לאכול בתרומתן
עד סוף האשמורה הראשונה דברי רבי אליעזר וחכמים אומרים עד חצות
רבן גמליאל אומר עד שיעלה עמוד השחר מעשה ובאו בניו מבית המשתה
<h2>דף ב:</h2>
תנא היכא קאי דקתני מאימתי ותו מאי שנא דתני בערבית ברישא
לתני דשחרית ברישא תנא אקרא קאי דכתיב בשכבך ובקומך"""
RASHI = """<h2>דף ב.</h2>
משעה שהכהנים נכנסים כהנים שנטמאו וטבלו
עד סוף האשמורה הראשונה שליש הלילה
<h2>דף ב:</h2>
היכא קאי מהיכא קא סליק"""
COMMENTARY = """הקדמה של הספר
<h1>ברכות</h1>
דברי פתיחה שאינם מן הענין
<h2>דף ב.</h2>
מאימתי קורין את שמע. נראה לפרש
בא"ד וכן כתב הרב
רש"י ד"ה משעה שהכהנים נכנסים. יש לעיין
ד"ה עד סוף האשמורה. עוד שם
גמ' רבן גמליאל אומר. תימה
<h2>דף ב:</h2>
תנא היכא קאי דקתני. כלומר
לתני דשחרית ברישא. קשה"""


def linked(spark, config=K.Config(title="ברכות"), texts=(COMMENTARY, SOURCE, RASHI), id_=1):
    roles = ("commentary", "source", "rashi")
    rows = [(id_, r, t) for r, t in zip(roles, texts, strict=True) if t is not None]
    return {r.line_index_1: r for r in K.links(K.link(spark.createDataFrame(rows, "id long, role string, text string"), config)).collect()}


def test_shas(spark):
    got = linked(spark)
    assert {k: (r.line_index_2, r.secondary_target, r.is_inherited) for k, r in got.items()} == {
        5: (2, None, False),
        6: (2, None, True),  # ibid
        7: (2, "rashi", False),
        8: (3, "rashi", False),  # a lemma mark alone stays with the source before
        9: (4, None, False),  # names the primary source
        11: (6, None, False),
        12: (7, None, False),
    }
    assert got[5].he_ref_2 == "ברכות - דף ב." and got[5].path_2 == "ברכות.txt"
    assert got[7].he_ref_2 == 'רש"י - דף ב.' and got[7].path_2 == 'רש"י על ברכות.txt' and got[7].secondary_line_index == 2
    assert got[6].he_ref_2 == got[5].he_ref_2 and got[6].confidence < got[5].confidence
    assert got[5].status == ("approved" if got[5].confidence >= 85 else "pending")
    assert got[5].candidates[0].line_num == 2 and len(got[5].candidates) <= 3
    assert (got[5].match_range.word_start, got[5].match_range.word_count) == (0, 4)


def test_front_matter_gets_no_links(spark):
    result = K.link(spark.createDataFrame([(1, "commentary", COMMENTARY), (1, "source", SOURCE)], "id long, role string, text string"), K.Config(title="x"))
    assert min(r.line_index_1 for r in result.collect()) == 5
    assert {r.line_index_1 for r in K.unlinked(result).collect()} == {7}  # it names a book that was not given


def test_documents_do_not_mix_and_order_does_not_matter(spark):
    alone = linked(spark)
    rows = [(i, r, t) for i in (1, 2, 3) for r, t in (("commentary", COMMENTARY), ("source", SOURCE), ("rashi", RASHI))] + [(4, "commentary", COMMENTARY), (5, "source", None), (5, "commentary", None), (6, "commentary", ""), (6, "source", "")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "id long, role string, text string").repartition(7)
    got = K.links(K.link(df, K.Config(title="ברכות"))).collect()
    assert {r.id for r in got} == {1, 2, 3}
    for i in (1, 2, 3):
        assert {r.line_index_1: r[2:] for r in got if r.id == i} == {k: r[2:] for k, r in alone.items()}


def test_fuzzy_and_exact(spark):
    texts = ("<h2>דף ב.</h2>\nמאמתי קורים את שמע בערבית. לפרש", SOURCE, None)
    assert linked(spark, K.Config(title="x"), texts)[2].line_index_2 == 2
    assert 2 not in linked(spark, K.Config(title="x", fuzzy=False, weighted=False), ("<h2>דף ב.</h2>\nמאמתי קורים שמעו בערבין. לפרש", SOURCE, None))


def test_abbreviations(spark):
    texts = ("<h2>דף ב.</h2>\nדר\"א וחכמים אומרים", SOURCE, None)
    with_words = K.Config(title="x", dictionaries=({'דר"א': ["דברי רבי אליעזר"]},))
    assert linked(spark, with_words, texts)[2].line_index_2 == 3


def test_continued_lemma(spark):
    texts = ("<h2>דף ב.</h2>\nעד סוף האשמורה כו' וחכמים אומרים עד חצות", SOURCE, None)
    got = linked(spark, K.Config(title="x"), texts)
    assert got[2].line_index_2 == 3


LAW_SOURCE = "<h3>סימן א</h3>\n" + "\n".join(["ראוי לאדם להתגבר כארי לעמוד בבוקר", "המשכים להתחנן לפני בוראו יכוון לשעות", "טוב מעט תחנונים בכוונה מהרבות בלא כוונה", "ראוי לכל ירא שמים שיהא מיצר ודואג", "פרשת הקרבנות לא יאמר אלא ביום", "יכוין שיהא סמוך לחלון מזרחי"])
LAW = "<h3>סימן א</h3>\n" + "\n".join(["(א) להתגבר כארי - פירוש גבורה", "והוא מדברי חכמים", "(ב) לפני בוראו יכוון - לשון בקשה", "(ג) דבר אחר לגמרי - אין כאן", "(ד) מיצר ודואג - על החורבן", "המשך הדברים", "(ה) פרשת הקרבנות - כל הפרשיות"])


def test_halacha(spark):
    got = linked(spark, K.Config(title="או\"ח", category="halacha"), (LAW, LAW_SOURCE, None))
    assert {k: r.line_index_2 for k, r in got.items() if not r.is_inherited} == {2: 2, 4: 3, 6: 5, 8: 6}
    assert got[3].is_inherited and got[3].line_index_2 == 2 and got[7].line_index_2 == 5
    own = [r.line_index_2 for _, r in sorted(got.items()) if not r.is_inherited]
    assert own == sorted(own)


def test_gaps_are_filled_between_equal_anchors(spark):
    law = "<h3>סימן א</h3>\n(א) להתגבר כארי לעמוד - כן\n(ב) אין קשר כלל - לא\n(ג) כארי לעמוד בבוקר - כן"
    got = linked(spark, K.Config(title="x", category="halacha"), (law, LAW_SOURCE, None))
    assert got[3].is_inherited and got[3].line_index_2 == 2


def test_prune_keeps_the_heaviest_order():
    make = lambda line, target, w: Link(line, target, None, "", "", None, False, "", 90, None, [(target, w, 90)])
    rng = random.Random(4)
    for _ in range(200):
        own = [make(i, rng.randint(1, 6), rng.choice([1.0, 2.0, 3.5])) for i in range(1, 8)]
        links = {x.line: x for x in own}
        prune(links, [(i, 0) for i in links])
        kept = [x.target for x in links.values()]
        assert kept == sorted(kept)
        best = 0.0
        for mask in range(1 << len(own)):
            some = [x for k, x in enumerate(own) if mask >> k & 1]
            if all(a.target <= b.target for a, b in zip(some, some[1:], strict=False)):
                best = max(best, sum(x.candidates[0][1] for x in some))
        assert sum(x.candidates[0][1] for x in links.values()) == best


def test_windows():
    make = lambda line, target, inherited=False: Link(line, target, None, "", "", None, inherited, "", 90)
    links = {2: make(2, 10), 3: make(3, 10, True), 5: make(5, 14), 7: make(7, 3)}
    units = [(1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (6, 1), (7, 1)]
    assert windows(units, links) == {1: (None, 10), 3: (10, 14), 4: (10, 14), 6: (None, 3)}


def test_match_range():
    say = Words()
    assert match_range(say, "אמר רבא הלכה כרבי מאיר", "הלכה כרבי") == {"word_start": 2, "word_count": 2, "segments": [{"word_start": 2, "word_count": 2}]}
    assert match_range(say, "אמר רבא", "יום טוב") is None
    assert match_range(say, "", "x") is None


def test_expander():
    e = Expander({'ר"א': ["רבי אליעזר"], "קמשמע לן": ["קא משמע לן"]})
    assert e.expand('אמר ר"א שם', "דברי רבי אליעזר") == "אמר רבי אליעזר שם"
    assert e.expand('אמר ר"א שם', "דברי אחרים") == 'אמר ר"א שם'
    assert e.expand('וא"ת כן', "ואם תאמר") == 'וא"ת כן'
    assert e.expand('א"ת כן', "אם תאמר") == "אם תאמר כן"
    assert e.expand("", "x") == "" and e.expand("x", " ") == "x"


def test_dictionaries(spark):
    raw = spark.createDataFrame([('{"ר\\"א": ["רבי אליעזר", " "], "רא": "רבי אבא", "": ["x"], "ב": [], "ג": " "}',)], "value string")
    table = entries(raw)
    assert {r.key: r.options for r in table.collect()} == {'ר"א': ["רבי אליעזר"], "רא": ["רבי אבא"]}
    assert {r.key: r.options for r in merged(table).collect()} == {"רא": ["רבי אליעזר", "רבי אבא"]}


@pytest.mark.parametrize("category", ["shas", "halacha"])
def test_long_documents(spark, category):
    rng = random.Random(6)
    words = ["".join(rng.choice("אבגדהזחטכלמנסעפצקרשת") for _ in range(rng.randint(3, 7))) for _ in range(800)]
    lines = [" ".join(rng.choice(words) for _ in range(14)) for _ in range(150)]
    notes = [" ".join(line.split()[:5]) + ". הערה" for line in lines[::2]]
    got = linked(spark, K.Config(title="x", category=category, numbered=False), ("\n".join(notes), "\n".join(lines), None))
    right = sum(got[i + 1].line_index_2 == 2 * i + 1 for i in range(len(notes)) if i + 1 in got)
    assert right >= 0.95 * len(notes)


def test_null_ids(spark):
    """Null ids are jobs of their own that nothing matches."""
    df = spark.createDataFrame([(None, "commentary", COMMENTARY), (None, "source", SOURCE)], "id long, role string, text string")
    assert K.links(K.link(df, K.Config(title="x"))).where(F.col("id").isNotNull()).count() == 0


def test_an_abbreviation_is_one_unit_of_a_run():
    from types import SimpleNamespace

    from glossloom.functions.similarity import Words
    from glossloom.operators.dictionary import Abbreviation
    from glossloom.operators.resolve import Resolver

    e = Expander({'ר"א': ["רבי אליעזר"], "קמשמע לן": ["קא משמע לן"]})
    assert e.units('אמר ר"א שם', "דברי רבי אליעזר") == ["אמר", Abbreviation('ר"א', ("רבי", "אליעזר")), "שם"]
    assert e.units('אמר ר"א שם', "דברי אחרים") == ["אמר", 'ר"א', "שם"] and e.units("", "x") == []
    one = Resolver.__new__(Resolver)
    one.say, one.weighted, one.spec = Words(), False, SimpleNamespace(start_words=2, fuzzy=False, shallow=9, deep_run=3)
    units = ["אמר", Abbreviation('ר"א', ("רבי", "אליעזר")), "שם"]
    line = "כך אמר רבי אליעזר שם".split()
    assert one._run(units, [1.0, 0.0, 1.0], line, False) == (1 + 0.6 * 2 + 1, 3, 3.0)
    long = Abbreviation("א", ("רבי",))  # never less than the abbreviation's own weight
    assert one._run(["אמר", long], [1.0, 0.0], line, False) == (2.0, 2, 2.0)
    assert one._run(units, [1.0, 0.0, 1.0], "אמר רבי שם".split(), False) == (1.0, 1, 1.0)
    assert one._run(units, [1.0, 0.0, 1.0], "אמר רבי".split(), False) == (1.0, 1, 1.0)

from pyspark.sql import functions as F

from glossloom.functions import text as T
from glossloom.operators.normal import normal
from glossloom.profiles import LATIN


def ask(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_normalized(spark):
    values = ['<b>שָׁלוֹם</b>,  "עולם"', 'רש״י ד׳׳ה', "א ב ג﻿ד", "''פתיחה", 'סוף"". אחר', "abc", "", None, "ר' 12"]
    want = ["שלום עולם", 'רש"י ד"ה', "א ב ג ד", "פתיחה", "סוף אחר", "", "", "", "ר' 12"]
    assert ask(spark, T.normalized, *values) == want
    assert [normal(v or "") for v in values] == want
    assert ask(spark, lambda c: T.normalized(c, keep_points=True), 'אמר: כן.', 'סוף". ') == ["אמר: כן.", "סוף."]
    assert ask(spark, lambda c: T.normalized(c, LATIN), "Hello, <i>World</i>") == ["hello world"]


def test_markup(spark):
    assert ask(spark, T.strip_markup, "no  tags ", "a<b>b</b>c", "x<br/>y", "<p>a</p>  <p>b</p>", "q<i><BR></i>z") == ["no  tags ", "abc", "x y", "a b", "q z"]
    assert ask(spark, T.strip_tags, "a<b>c") == ["a c"]


def test_headers(spark):
    lines = ["<h2>דף ב.</h2>", "## סימן א", "##no", "text", " <H1 class=x>A<b>B</b></H1> "]
    assert ask(spark, T.is_header, *lines) == [True, True, False, False, True]
    assert ask(spark, T.header_title, *lines) == ["דף ב.", "סימן א", "##no", "text", "AB"]
    assert ask(spark, T.header_key, "דף ב.", "דף ב:", 'דף ב ע"א', "<h2>דף ב ע\"ב</h2>") == ["דף ב עמוד א", "דף ב עמוד ב", "דף ב עמוד א", "דף ב עמוד ב"]
    pairs = [("דף ב", "דף ב"), ("דף ב", "דף ב עמוד א"), ("דף ב עמוד א", "דף ב"), ("דף ב", "דף בג"), ("", "דף"), ("", "")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    assert [r.m for r in rows.select("i", T.headers_match(F.col("a"), F.col("b")).alias("m")).orderBy("i").collect()] == [True, True, True, False, False, False]


def test_sources_are_named_by_whole_words(spark):
    assert ask(spark, T.names_rashi, 'רש"י ד"ה אמר', "רשיון", "פירש\"י כאן", "תוס") == [True, False, True, False]
    assert ask(spark, T.names_tosafot, "תוס' כאן", "תוספות", "תוספתא", "בתו אמר", "בתוך") == [True, True, False, True, False]
    assert ask(spark, T.names_primary, "גמ' אמר", "גמרות", "במשנה", "מתני' כל") == [True, False, True, True]


def test_prefixes(spark):
    assert ask(spark, T.strip_leading_marks, "(א) גמ' אמר", "3. • אמר", "שם. אמר", 'שם ד"ה אמר') == ["אמר", "אמר", "אמר", 'ד"ה אמר']
    assert ask(spark, T.strip_source_prefix, 'רש"י ד"ה אמר רבא', "תוס' ד\"ה אמר", 'בא"ד וכן', "גמ' אמר", 'ד"ה אמר', 'רש"י', "אמר") == ["אמר רבא", "אמר", "וכן", "אמר", "אמר", "", "אמר"]
    assert ask(spark, T.is_ibid, 'בא"ד וכן', 'שם בא"ד', "באד", "באדם", "אמר") == [True, True, True, False, False]


def test_numbering(spark):
    lines = ["(א) טקסט", "[יב] x", "{ג}", "ד) x", "ה. x", "<b>(ו)</b> x", "(אב) x", "(של) x", "(יי) x", "טקסט", '(י"ב) x', "א x"]
    assert ask(spark, T.numbering, *lines) == ["א", "יב", "ג", "ד", "ה", "ו", None, "של", None, None, "יב", None]


def test_lemma_end(spark):
    lines = ["אמר רבא - כן", "אמר. כן", "אמר.כן", "אמר כו' וכן", "- אמר", "אמר רבא", "אמר רבא:"]
    assert ask(spark, T.lemma_end, *lines) == [7, 3, None, 3, None, None, 7]


def test_small_ones(spark):
    assert ask(spark, T.vowel_print, "שָׁלוֹם", "abc") == ["ao", ""]
    assert ask(spark, T.safe_file_name, ' רש"י על/א:ב ', "a?b*c|d") == ["רשי על_א_ב", "a_b_c_d"]

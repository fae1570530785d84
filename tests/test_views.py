import pytest
from pyspark.sql import functions as F

from glossloom.operators import catalog, dictionary, views


def test_lists(spark):
    rows = spark.createDataFrame([(1, "Abc", None, None, None), (2, "x", 5, 90, "target ABC"), (3, "y", 6, None, None), (12, "z", 7, 40, "q")], "line_no int, raw string, line_index_2 int, confidence int, target_raw string")
    numbers = lambda df: [r.line_no for r in df.collect()]
    assert numbers(views.matching(rows, " aBc")) == [1, 2] and numbers(views.matching(rows, "12")) == [12] and len(numbers(views.matching(rows, " "))) == 4
    assert numbers(views.ordered(rows, "score_down")) == [2, 3, 12, 1] and numbers(views.ordered(rows, "score_up")) == [1, 12, 3, 2] and numbers(views.ordered(rows)) == [1, 2, 3, 12]
    with pytest.raises(ValueError):
        views.ordered(rows, "x")


def test_targets(spark):
    links = spark.createDataFrame([(1, 3, 5, None, None), (1, 1, 5, None, None), (1, 2, 5, "rashi", 5)], "id long, line_index_1 int, line_index_2 int, secondary_target string, secondary_line_index int")
    assert {(r.target, r.line): r.sources for r in views.by_target(links).collect()} == {("primary", 5): [1, 3], ("rashi", 5): [2]}
    assert {r.k for r in links.select(views.target_key(links).alias("k")).collect()} == {"5||", "5|rashi|5"}
    saved = spark.createDataFrame([("a", "x", 1), ("b", "y", 3), (None, "z", 9), ("c", "w", None)], "id string, title string, saved_at long")
    assert [r.id for r in views.latest_first(saved).collect()] == ["b", "a"]


def test_dictionary_edits(spark):
    table = spark.createDataFrame([("a", ["x", "y"]), ("b", ["z"])], "key string, options array<string>")
    as_dict = lambda df: {r.key: r.options for r in df.collect()}
    assert as_dict(dictionary.with_option(table, "a", "x")) == {"a": ["x", "y"], "b": ["z"]}
    assert as_dict(dictionary.with_option(table, "c", " w "))["c"] == ["w"]
    assert as_dict(dictionary.with_option(table, "a", "b")) == {"a": ["x", "y", "b"], "b": ["z"]}
    assert dictionary.with_option(table, "c", " ") is table
    assert as_dict(dictionary.without_option(table, "b", "z")) == {"a": ["x", "y"]}
    assert as_dict(dictionary.without_key(table, "a")) == {"b": ["z"]}
    text = dictionary.to_json(table)
    assert text.first().value == '{"a":["x","y"],"b":["z"]}' and as_dict(dictionary.entries(text)) == as_dict(table)


def test_secondary_books(spark):
    books = spark.createDataFrame([(str(k), t) for k, t in enumerate(['רש"י על ברכות', "תוס' על ברכות", 'תוספות הרא"ש על שבת', "תוספות ישנים שבת", "רשי פסחים"])], "book_id string, title string")
    got = {(r.title, r.series): r.book_id for r in catalog.secondary_of(spark.createDataFrame([("מסכת ברכות",), ("שבת",), ("פסחים",)], "title string"), books).collect()}
    assert got == {("מסכת ברכות", "rashi"): "0", ("מסכת ברכות", "tosafot"): "1", ("שבת", "rashi"): None, ("שבת", "tosafot"): "3", ("פסחים", "rashi"): "4", ("פסחים", "tosafot"): None}


def test_library_links(spark):
    link = spark.createDataFrame([(1, 10, 20, 100, 200, 2), (2, 10, 20, 101, 200, 3)], "id long, source_book long, target_book long, source_line long, target_line long, type int")
    line = spark.createDataFrame([(100, 0, "a"), (101, 1, "b"), (200, 5, "c")], "id long, line_index int, ref string")
    anchors = spark.createDataFrame([(1, "s", 3, 9, "x"), (1, "s", 1, 2, "y")], "link_id long, side string, char_start int, char_end int, label string")
    ranges = spark.createDataFrame([], "link_id long, side string, end_line int")
    [row] = catalog.book_links(link, line, anchors, ranges, 2).collect()
    assert (row.link_id, row.source_ref, row.target_index, [a.char_start for a in row.anchors], row.ranges) == (1, "a", 5, [1, 3], None)
    assert catalog.book_links(link, line, anchors, ranges, 3).where(F.col("anchors").isNull()).count() == 1

"""What the resolver needs to know of each line, as column expressions, so that all of it is computed in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossloom.functions import text as T
from glossloom.operators.lines import content
from glossloom.profiles import IBID, LEMMA_MARKS, Book

_S = T._S
_ELLIPSIS = f"(?:^|{_S})ו?כו'(?:{_S}|$|[.,:;])"
_OPEN_END = f"(?:^|{_S})(?:ו?כו'|וגו'|וגומר|וכולי)(?:{_S}|$|[.,:;])"
_BARE_NUMBER = "^[א-ת]{1,3}(?:[\"'׳״][א-ת]{1,2})?$"
_LEAD = f"(?:{_S}|#{{1,6}}{_S}|<[^>]*>)*"


def marked(ls: DataFrame, raw: Column, book: Book) -> DataFrame:
    """Lines with raw as given, and number (its leading numeral or null), bare (the header is a number only), breaks (it ends a segment).

    Each step is a column, so that what several others need is worked out once.
    """
    rows = ls.withColumn("raw", raw).withColumn("header", T.is_header(F.col("raw")))
    if not book.strips_numbering:
        return rows.withColumn("number", F.lit(None).cast("string")).withColumn("bare", F.lit(False)).withColumn("breaks", F.col("header"))
    rows = rows.withColumn("letters", T.number_letters(F.col("raw"))).withColumn("number", F.when(T.is_numeral(F.col("letters")), F.col("letters")))
    rows = rows.withColumn("inner", T.trimmed(F.regexp_replace(T.strip_tags(F.col("raw")), T.HASHES, "")))
    only = F.col("inner").rlike(_BARE_NUMBER) & T.is_numeral(F.regexp_replace("inner", "[\"'׳״]", ""))
    rows = rows.withColumn("bare", F.col("header") & only)
    in_text = ~F.col("inner").contains("סימן") & (F.col("number").isNotNull() | F.col("bare"))
    return rows.withColumn("breaks", F.col("header") & ~in_text if book.numbered_headers_are_content else F.col("header")).drop("letters", "inner")


def _without_numbering(raw: Column, number: Column) -> Column:
    letters = "[א-ת]{1,3}(?:[\"'׳״][א-ת]{1,2})?"
    cut = F.regexp_replace(raw, rf"^({_LEAD})(?:[(\[{{]{_S}*{letters}{_S}*[)\]}}]|{letters}{_S}*[)\]}}.]){_S}*", "$1")
    return F.when(number.isNotNull(), cut).otherwise(raw)


def _without_gloss(raw: Column, word: Column) -> Column:
    return F.when(word.rlike("^[ובשכל]{0,2}הגהה?$"), F.regexp_replace(raw, rf"^({_LEAD})\S+{_S}+(?=\S)", "$1")).otherwise(raw)


def _with_lemma(rows: DataFrame, book: Book, n: int, name: str) -> DataFrame:
    """Column name: the lemma's text, its words, and whether its end was marked. Needs plain, cut, open_end and sayable."""
    part = F.when(F.col("cut").isNotNull(), F.substring("plain", F.lit(1), F.greatest("cut", F.lit(0)))).otherwise(F.col("plain"))
    rows = rows.withColumn("part", T.trimmed(part)).withColumn("tokens", F.filter(F.split("part", f"{_S}+"), lambda w: w != ""))
    rows = rows.withColumn("part", F.when(~F.col("sayable"), "").when(F.size("tokens") > n, F.array_join(F.slice("tokens", 1, n), " ")).otherwise(F.col("part")))
    explicit = F.col("sayable") & (F.col("cut").isNotNull() | F.col("open_end"))
    return rows.withColumn(name, F.struct(F.col("part").alias("text"), T.words(T.normalized(F.col("part"))).alias("words"), explicit.alias("explicit"))).drop("part", "tokens")


def _with_cut(rows: DataFrame, book: Book, delimiter: str | None) -> DataFrame:
    """Column cut: where the lemma ends in plain, null if nothing marks it."""
    given, points, dots = F.lit(None).cast("int"), F.lit(0), F.lit(0)
    if delimiter and delimiter.strip():
        given = F.when(F.col("plain").contains(delimiter.strip()), F.instr("plain", delimiter.strip()) - 1)
    if book.ends_at_punctuation:
        points, dots = T.lemma_points(F.col("plain")), T.lemma_dots(F.col("plain"))
    rows = rows.withColumn("given", given).withColumn("points", F.nullif(points, F.lit(0))).withColumn("dots", F.nullif(dots, F.lit(0)))
    rows = rows.withColumn("end", F.least("points", "dots") - 1)
    fits = (F.col("end") > 0) & (T.trimmed(F.substring("plain", F.lit(1), F.col("end"))) != "")
    return rows.withColumn("cut", F.coalesce("given", F.when(fits, F.col("end")))).drop("given", "points", "dots", "end")


def commentary(ls: DataFrame, book: Book, delimiter: str | None = None) -> DataFrame:
    """Columns for the resolver, of lines (id, line_no, raw)."""
    rows = marked(ls, content(F.col("raw")), book).withColumn("line", F.col("raw"))
    if book.strips_numbering:
        rows = rows.withColumn("line", _without_numbering(F.col("raw"), F.col("number")))
        rows = rows.withColumn("empty", T.trimmed(F.regexp_replace("line", "<[^>]*>", "")) == "")
        rows = rows.withColumn("marker", F.col("bare") | F.col("number").isNotNull() & (F.col("header") | F.col("empty")))
    else:
        rows = rows.withColumn("marker", F.lit(False))
    if book.strips_gloss:
        rows = rows.withColumn("gloss", F.regexp_replace(F.regexp_extract("line", rf"^{_LEAD}(\S+){_S}+(?=\S)", 1), "[\"'׳״.,:;־–-]", ""))
        rows = rows.withColumn("line", _without_gloss(F.col("line"), F.col("gloss")))
    rows = rows.withColumn("line", T.trimmed(F.col("line"))).withColumn("norm", T.normalized(F.col("line")))
    bullet = rf"^(?:\d+[.)]|[ א-ת][.)]|\([^)]+\)|\[[^\]]+\]|[•\-*]){_S}*"
    ibid = f"^שם{_S}*[:.\\-]?{_S}*(?!{'|'.join(LEMMA_MARKS + IBID)})"
    rows = rows.withColumn("top", T.trimmed(F.regexp_replace(F.regexp_replace("norm", bullet, ""), ibid, "")))
    rows = rows.withColumn("bared", T.strip_leading_marks(F.col("top"))).withColumn("named", F.coalesce(F.nullif("bared", F.lit("")), F.nullif("top", F.lit("")), F.col("norm")))
    rows = rows.withColumn("stripped", T.strip_source_prefix(F.col("line"))).withColumn("body", F.when(F.col("stripped") != "", F.col("stripped")).otherwise(F.col("line")))
    rows = rows.withColumn("plain", T.strip_tags(F.col("body"))).withColumn("words", T.words(T.normalized(F.col("body"))))
    rows = rows.withColumn("sayable", T.normalized(F.col("plain"), keep_points=True) != "")
    rows = rows.withColumn("open_end", F.col("plain").rlike(_OPEN_END) if book.continuations else F.lit(False))
    rows = _with_cut(rows, book, delimiter)
    rows = _with_lemma(_with_lemma(rows, book, book.lemma_words, "lemma"), book, 7, "short_lemma")
    again = f"^(?:שם )?(?:{'|'.join(sorted(IBID + LEMMA_MARKS, key=len, reverse=True))})(?: |$|[:.\\-])"
    count = lambda c: F.size(F.filter(F.split(c, f"{_S}+"), lambda w: w != ""))
    pieces = F.filter(F.transform(F.split("body", _ELLIPSIS), T.trimmed), lambda p: p != "")
    named, norm = F.col("named"), F.col("norm")
    return rows.select(
        "id", "line_no", "raw", "breaks", "line", "marker", "body", "words", "lemma", "short_lemma",
        (T.trimmed(F.col("raw")) == "").alias("blank"),
        F.col("number").isNotNull().alias("numbered"),
        T.names_rashi(named).alias("rashi"),
        T.names_tosafot(named).alias("tosafot"),
        T.names_primary(F.col("top")).alias("primary"),
        norm.rlike(again).alias("again"),
        T.is_ibid(F.col("line")).alias("ibid"),
        (norm.startswith("שם") & ~norm.rlike("^שם (?:ד\"ה|דה|בד\"ה|בדה)(?: |$|[:.\\-])")).alias("bare"),
        (F.col("stripped") == "").alias("label_only"),
        (F.lit(book.continuations) & (F.col("body").rlike(_ELLIPSIS) | F.col("line").rlike(_ELLIPSIS))).alias("continued"),
        F.transform(pieces, lambda p: T.words(T.normalized(p))).alias("pieces"),
        F.get("words", F.lit(0)).alias("opens"),
        count("raw").alias("n_raw"), count("line").alias("n_line"),
        F.when(F.col("breaks"), T.header_title(F.col("raw"))).alias("title"), F.when(F.col("breaks"), T.header_key(F.col("raw"))).alias("title_key"),
    )


def target(ls: DataFrame, book: Book) -> DataFrame:
    """Columns of lines that links point at."""
    rows = marked(ls, content(F.col("raw")), book).withColumn("norm", T.normalized(F.col("raw")))
    title, key = T.header_title(F.col("raw")), T.header_key(F.col("raw"))
    return rows.select("id", "line_no", "raw", "breaks", "norm", T.words(F.col("norm")).alias("words"), F.when(F.col("breaks"), title).alias("title"), F.when(F.col("breaks"), key).alias("title_key"))

"""Books of a library: their metadata, lookups that fall back, searches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def books(raw: DataFrame) -> DataFrame:
    """book_id, title, path, type of rows that name these one way or another; rows without id or title go, an id comes once."""
    have = set(raw.columns)
    pick = lambda *names: reduce(lambda a, b: F.coalesce(a, b), [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in have] or [F.lit(None).cast("string")])
    out = raw.select(pick("book_id", "bookId", "id", "path").alias("book_id"), pick("title", "name", "book_id", "bookId").alias("title"), F.coalesce(pick("path"), F.lit("")).alias("path"), F.coalesce(pick("type"), F.lit("book")).alias("type"))
    return out.where("book_id IS NOT NULL AND title IS NOT NULL").groupBy("book_id").agg(F.min("title").alias("title"), F.min("path").alias("path"), F.min("type").alias("type"))


def found(catalog: DataFrame, query: Column) -> DataFrame:
    return catalog.where(F.lower("title").contains(F.lower(query)) | F.lower("book_id").contains(F.lower(query)))


def resolved(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """For each wanted name its book: the same title, else one whose title holds the name, else one whose title the name holds; null if none. The shortest title, then the first, wins."""
    w = wanted.select("name").distinct()
    near = w.join(F.broadcast(catalog), F.col("title").contains(F.col("name")) | F.col("name").contains(F.col("title")), "left")
    rank = F.when(F.col("title") == F.col("name"), 0).when(F.col("title").contains(F.col("name")), 1).otherwise(2)
    order = Window.partitionBy("name").orderBy(rank, F.length("title"), "title", "book_id")
    return near.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("name", "book_id", "title")


def pages_joined(pages: DataFrame) -> DataFrame:
    """Contents that came in pages (book_id, offset, text) as one text each."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "text")))
    return pages.groupBy("book_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


#: Words in titles of other books on the same tractate by that name.
OTHER_TOSAFOT = ("יהודה", "החסיד", 'רא"ש', 'הרא"ש', "פרץ", "ריצב", 'רש"ש', 'מהר"ם')
NAMES = {"rashi": ('רש"י', "רשי"), "tosafot": ("תוספות", "תוס'", "תוס", "תוסות")}


def secondary_of(books: DataFrame, catalog: DataFrame) -> DataFrame:
    """title (of books) and series with the book of the catalog that is its secondary: named in full first, then by a shorter name, then any whose title holds both names and none that tells another work; null if none."""
    series = [(s, n, k) for s, names in NAMES.items() for k, n in enumerate(names)]
    names = catalog.sparkSession.createDataFrame(series, "series string, called string, place int")
    base = F.trim(F.regexp_replace("title", r"^(?:מסכת|ספר)\s+", ""))
    asked = books.select("title").distinct().withColumn("base", base).join(F.broadcast(names))
    wanted = F.array(*(F.concat("called", F.lit(mid), name) for name in (F.col("title"), F.col("base")) for mid in (" על ", " ")), F.concat("called", F.lit(" על מסכת "), "base"), F.concat("called", F.lit(" על ספר "), "base"))
    exact = asked.select("title", "series", "place", F.posexplode(wanted).alias("form", "t_title")).join(catalog.select("book_id", F.col("title").alias("t_title")), "t_title").select("title", "series", F.struct(F.lit(0).alias("near"), "place", "form", "t_title", "book_id").alias("hit"))
    other = F.lit(False)
    for word in OTHER_TOSAFOT:
        other = other | F.col("t_title").contains(word)
    rows = asked.where("place = 0").withColumn("w", F.split("base", " ")[0])
    each = catalog.select("book_id", F.col("title").alias("t_title"), F.explode(F.array_distinct(F.split("title", " "))).alias("w"))
    short = F.when(F.col("series") == "rashi", "רש").otherwise("תוס")
    near = rows.join(each, "w").where(F.col("t_title").contains(F.col("base")) & F.col("t_title").contains(short) & ((F.col("series") == "rashi") | ~other))
    near = near.select("title", "series", F.struct(F.lit(1).alias("near"), F.lit(0).alias("place"), F.length("t_title").alias("form"), "t_title", "book_id").alias("hit"))
    best = exact.unionByName(near).groupBy("title", "series").agg(F.min("hit").alias("hit"))
    return asked.select("title", "series").distinct().join(best, ["title", "series"], "left").select("title", "series", F.col("hit.book_id").alias("book_id"))


def book_links(link: DataFrame, line: DataFrame, anchors: DataFrame, ranges: DataFrame, connection_type: int) -> DataFrame:
    """A library's links of one type with the references of both lines, and their anchors and ranges gathered.

    link: id, source_book, target_book, source_line, target_line, type; line:
    id, line_index, ref; anchors: link_id, side, char_start, char_end, label;
    ranges: link_id, side, end_line.
    """
    side = lambda name: line.select(F.col("id").alias(f"{name}_line"), F.col("line_index").alias(f"{name}_index"), F.col("ref").alias(f"{name}_ref"))
    rows = link.where(F.col("type") == connection_type).join(side("source"), "source_line").join(side("target"), "target_line")
    gather = lambda df, name, *columns: df.groupBy("link_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    rows = rows.withColumnRenamed("id", "link_id").join(gather(anchors, "anchors", "side", "char_start", "char_end", "label"), "link_id", "left").join(gather(ranges, "ranges", "side", "end_line"), "link_id", "left")
    return rows.select("link_id", "source_book", "target_book", "source_index", "source_ref", "target_index", "target_ref", "anchors", "ranges")

"""Line-to-line tables in a compact text form: comma-separated differences in base 36, an empty place for a line without a link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _signed(c: Column) -> Column:
    """Base 36 with a sign; the function for bases knows none."""
    size = F.conv(F.regexp_replace(c, "^-", ""), 36, 10).cast("long")
    return F.when(c.startswith("-"), -size).otherwise(size)


def decoded(table: DataFrame, keys: list[str], column: str = "encoded") -> DataFrame:
    """keys, comm_line, src_line."""
    parts = table.select(*keys, F.posexplode(F.split(column, ",")).alias("at", "part")).where(F.col("part").rlike("^-?[0-9a-zA-Z]+$"))
    so_far = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return parts.select(*keys, (F.col("at") + 1).alias("comm_line"), F.sum(_signed(F.col("part"))).over(so_far).alias("src_line"))


def encoded(pairs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, encoded, of pairs (keys, comm_line, src_line, and the order they come in); of several links of a line the last stays."""
    one = pairs.groupBy(*keys, "comm_line").agg(F.max_by("src_line", F.struct(order, "src_line")).alias("src_line"))
    by = Window.partitionBy(*keys).orderBy("comm_line")
    step = F.col("src_line") - F.coalesce(F.lag("src_line").over(by), F.lit(0))
    text = F.concat(F.when(step < 0, "-").otherwise(""), F.lower(F.conv(F.abs(step).cast("string"), 10, 36)))
    places = F.repeat(F.lit(","), F.col("comm_line") - F.coalesce(F.lag("comm_line").over(by), F.lit(1)))
    rows = one.select(*keys, "comm_line", F.concat(places, text).alias("part"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("comm_line", "part"))), lambda x: x["part"]), "").alias("encoded"))

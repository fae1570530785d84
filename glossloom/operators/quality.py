"""How good links are: reliability of the confidence, its calibration, an independent judge, ties."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reliability(judged: DataFrame, width: int = 10) -> DataFrame:
    """judged: confidence (percent), correct. By band: n, mean confidence, precision (percent)."""
    band = (F.floor(F.least(F.col("confidence"), F.lit(99)) / width) * width).cast("int")
    return judged.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.avg("confidence").alias("stated"), (100 * F.avg(F.col("correct").cast("int"))).alias("precision"))


def calibration_error(bands: DataFrame) -> DataFrame:
    """Mean distance of stated confidence and precision, in points, weighted by band."""
    return bands.agg((F.sum(F.col("n") * F.abs(F.col("stated") - F.col("precision"))) / F.sum("n")).alias("ece"))


def precision_at(judged: DataFrame, bars: tuple[int, ...] = (50, 60, 70, 80, 85, 90)) -> DataFrame:
    """For each bar: how many links reach it, and the share of them that is right."""
    rows = judged.withColumn("bar", F.explode(F.array(*map(F.lit, bars)))).where("confidence >= bar")
    return rows.groupBy("bar").agg(F.count("*").alias("n"), (100 * F.avg(F.col("correct").cast("int"))).alias("precision"))


def platt(judged: DataFrame, rounds: int = 20) -> tuple[float, float]:
    """Slope and offset that fit correct to log-odds z (judged: z, correct), by Newton's method; each round is one aggregation."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(a * F.col("z") + b)))
        rest, w = F.col("correct").cast("double") - p, p * (1 - p)
        z = F.col("z")
        ga, gb, haa, hab, hbb = judged.agg(F.sum(rest * z), F.sum(rest), F.sum(w * z * z), F.sum(w * z), F.sum(w)).first()
        det = haa * hbb - hab * hab
        if not det:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a + da, b + db
        if math.hypot(da, db) < 1e-10:
            break
    return a, b


def tied(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Winners with a rival of the same score: keys, n. candidates: keys, score."""
    # counts by score, not a window over the keys, which would bring all candidates of one to one task
    counts = candidates.where("score IS NOT NULL").groupBy(*keys, "score").agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.max_by("n", "score").alias("n")).where("n > 1")


def judged_verbatim(links: DataFrame, found_runs: DataFrame, keys: list[str], at_least: int = 3) -> DataFrame:
    """links with correct: do the line and its target share a run of words at least so long? (operators.runs)"""
    long = found_runs.where(F.col("n_words") >= at_least).select(*keys).distinct().withColumn("hit", F.lit(True))
    return links.join(long, keys, "left").withColumn("correct", F.col("hit").isNotNull()).drop("hit")


def unlinked_report(unlinked: DataFrame, segment_text: DataFrame) -> DataFrame:
    """unlinked: id, line_no, seg_no, raw; segment_text: id, seg_no, role, text. A text for each line: it, and what it could have been linked to."""
    parts = segment_text.groupBy("id", "seg_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("role", "text"))), lambda x: F.concat(x["role"], F.lit(":\n"), x["text"])), "\n\n").alias("there"))
    return unlinked.join(parts, ["id", "seg_no"], "left").select("id", "line_no", F.concat_ws("\n\n", F.format_string("line %d", "line_no"), "raw", "there").alias("report"))

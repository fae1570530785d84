"""Linking passages as they come in, and inheritance kept over micro-batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glossloom.operators import runs as R


def link_passages(stream: DataFrame, line_grams: DataFrame, path: str, checkpoint: str, *, words, once: bool = False) -> StreamingQuery:
    """Best lines of passages (item_id, ...) of a stream, written as Parquet with a folder for each batch.

    line_grams are the lines' trigrams (operators.runs.grams), which do not
    change. A batch that runs again after a failure writes its folder anew, so
    each passage is linked once.
    """

    def batch(df: DataFrame, number: int) -> None:
        grams = R.grams(df, ["item_id"], words, "s")
        found = R.runs(grams, line_grams, ["item_id"], ["id", "line_no"])
        R.best_lines(found, ["item_id"], ["id", "line_no"]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def inherited(stream: DataFrame) -> DataFrame:
    """Lines (id, line_no, own) with target: own, or the last own one of the document, also of batches before. State is one number a document."""

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("line_no")
        out = []
        for line, own in zip(rows["line_no"], rows["own"], strict=True):
            fresh = own is not None and own == own
            last = int(own) if fresh else last
            out.append((key[0], line, last, last is not None and not fresh))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["id", "line_no", "target", "is_inherited"]).astype({"target": "Int64"})

    return stream.select("id", "line_no", "own").groupBy("id").applyInPandasWithState(step, "id long, line_no long, target long, is_inherited boolean", "last long", "append", GroupStateTimeout.NoTimeout)


def recent_counts(stream: DataFrame, time_col: str, *, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events by type and window; what comes later than the watermark allows is left out and its state dropped."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, window), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")

from pyspark.sql import functions as F

from glossloom.functions import text as T
from glossloom.operators import runs
from glossloom.profiles import LATIN
from glossloom.streaming import incremental


def words():
    return T.words(T.normalized(F.col("text"), LATIN))


def test_passages_are_linked_as_they_come(spark, tmp_path):
    lines = spark.createDataFrame([(1, 1, "one two three four five"), (1, 2, "six seven eight nine"), (2, 1, "one two three other")], "id long, line_no int, text string")
    grams = runs.grams(lines, ["id", "line_no"], words(), "d")
    schema = "item_id long, text string"
    for k, rows in enumerate(([(1, "One two three four."), (2, "nothing here at all")], [(3, "seven eight nine")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        incremental.link_passages(stream, grams, str(tmp_path / "out"), str(tmp_path / "cp"), words=words(), once=True).awaitTermination(60)
        got = {(r.item_id, r.id, r.line_no, r.n_words) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        assert got == ({(1, 1, 1, 4)} if k == 0 else {(1, 1, 1, 4), (3, 1, 2, 3)})


def test_inheritance_goes_on_over_batches(spark, tmp_path):
    schema = "id long, line_no long, own long"
    for rows in ([(1, 1, None), (1, 2, 7)], [(1, 3, None), (2, 1, None)], [(1, 4, 9), (1, 5, None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = incremental.inherited(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)
    got = {(r.id, r.line_no): (r.target, r.is_inherited) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 1): (None, False), (1, 2): (7, False), (1, 3): (7, True), (2, 1): (None, False), (1, 4): (9, False), (1, 5): (9, True)}


def test_counts_by_window(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01 00:01:00", "a"), (2, "2024-01-01 00:09:00", "a"), (3, "2024-01-01 00:11:00", "b")], "event_id long, ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = incremental.recent_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts")
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.event_type, r.n) for r in spark.table("counts").collect()} == {("a", 2), ("b", 1)}

"""Queries for edits of links and for reports on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossloom.operators import edits as A
from glossloom.operators import quality as U
from glossloom.plans import queries as Q
from glossloom.plans import tables as V

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


_JUDGED = "judged AS (SELECT n_chars % 101 AS confidence, quality = 1 AS correct FROM documents JOIN labels USING (doc_id))"


def _judged(spark, d) -> DataFrame:
    """Labelled documents as judged links: their length stands for the confidence."""
    rows = V.read(spark, d, "documents").select("doc_id", "n_chars").join(V.read(spark, d, "labels"), "doc_id")
    return rows.select((F.col("n_chars") % 101).alias("confidence"), (F.col("quality") == 1).alias("correct"))


@query(f"WITH {_JUDGED} SELECT (floor(least(confidence, 99) / 10) * 10)::INT AS band, count(*) AS n, round(avg(confidence), 6) AS stated, round(100 * avg(correct::INT), 6) AS precision FROM judged GROUP BY 1")
def reliability_report(spark, d) -> DataFrame:
    return U.reliability(_judged(spark, d)).select("band", "n", F.round("stated", 6).alias("stated"), F.round("precision", 6).alias("precision"))


@query(f"WITH {_JUDGED} SELECT bar, count(*) AS n, round(100 * avg(correct::INT), 6) AS precision FROM judged JOIN (VALUES (50), (60), (70), (80), (85), (90)) b(bar) ON confidence >= bar GROUP BY bar")
def precision_at_bars(spark, d) -> DataFrame:
    return U.precision_at(_judged(spark, d)).select("bar", "n", F.round("precision", 6).alias("precision"))


@query(f"WITH {Q._RUNS}, m AS (SELECT *, max(n_words) OVER (PARTITION BY item_id) AS top FROM best) SELECT item_id, count(*) AS n FROM m WHERE n_words = top GROUP BY item_id HAVING count(*) > 1")
def tie_audit(spark, d) -> DataFrame:
    """Passages whose best line has a rival as good."""
    per = Q._runs(spark, d).where("s < 3").groupBy("item_id", "id", "line_no").agg(F.max("n_words").alias("score"))
    return U.tied(per, ["item_id"])


_INDEX = f"""{V.SQL_TURNS}, t AS (SELECT conv_id AS id, turn, role = 'system' AS breaks, role = 'user' AND turn % 3 = 0 AS continues, own IS NOT NULL AS linked FROM turns),
n AS (SELECT *, first_value(CASE WHEN NOT breaks THEN continues END IGNORE NULLS) OVER (PARTITION BY id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM t),
c AS (SELECT *, sum((breaks AND NOT coalesce(nxt, false))::INT) OVER (PARTITION BY id ORDER BY turn) AS chain FROM n),
h AS (SELECT *, CASE WHEN linked THEN true ELSE NOT continues END AS head FROM c WHERE NOT breaks),
p AS (SELECT *, CASE WHEN NOT head THEN last_value(CASE WHEN head THEN turn END IGNORE NULLS) OVER (PARTITION BY id, chain ORDER BY turn) END AS parent FROM h)"""


def _index(spark, d) -> DataFrame:
    """Turns as lines: the system's are headers, every third by a user continues."""
    turns = V.turns(spark, d)
    rows = turns.select(F.col("conv_id").alias("id"), F.col("turn").alias("line_no"), (F.col("role") == "system").alias("breaks"), F.lit(False).alias("blank"), ((F.col("role") == "user") & (F.col("turn") % 3 == 0)).alias("continues"), F.lit(False).alias("label_only"))
    links = turns.where("own IS NOT NULL").select(F.col("conv_id").alias("id"), F.col("turn").alias("line_index_1"), F.lit(False).alias("is_inherited"))
    return A.index(rows, links)


@query(f"WITH {_INDEX} SELECT id, turn AS line_no, CASE WHEN head THEN 'head' ELSE 'member' END AS role, parent FROM p")
def inheritance_index(spark, d) -> DataFrame:
    return _index(spark, d).select("id", "line_no", "role", "parent")


@query(f"WITH {_INDEX} SELECT p.id, p.turn AS line_no, p.parent AS head FROM p JOIN p q ON p.id = q.id AND p.parent = q.turn WHERE NOT p.linked AND NOT q.linked")
def pending_head(spark, d) -> DataFrame:
    """Lines that wait for a head which has no link yet."""
    return _index(spark, d).where("pending").select("id", "line_no", F.col("parent").alias("head"))

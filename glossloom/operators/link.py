"""Linking commentaries to their sources: lines and features in parallel, then one grouped map by document."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossloom.functions import similarity as S
from glossloom.operators import features, lexicon
from glossloom.operators.dictionary import Expander
from glossloom.operators.lines import lines
from glossloom.operators.resolve import Resolver, Target
from glossloom.profiles import APPROVED_AT, book_for, passes_for

TARGETS = ("source", "rashi", "tosafot")
LINES = (
    "id long, line_index_1 int, line_index_2 int, he_ref_2 string, path_2 string, connection_type string, secondary_target string, secondary_line_index int, secondary_ref string, is_inherited boolean, dh_text string, confidence int, status string, "
    "match_range struct<word_start: int, word_count: int, segments: array<struct<word_start: int, word_count: int>>>, candidates array<struct<line_num: int, score: double, confidence: int>>, candidate_index int, highlight struct<word_start: int, word_count: int>"
)


@dataclass(frozen=True)
class Config:
    """How documents are linked."""

    title: str = ""
    category: str = "shas"
    delimiter: str | None = None
    fuzzy: bool = True
    weighted: bool = True
    dictionaries: tuple[dict, ...] = field(default_factory=tuple)
    inherit_on_bare: bool = False
    multi_line: bool = True
    numbered: bool = True


def link(docs: DataFrame, config: Config) -> DataFrame:
    """docs: id, role (commentary, source, rashi or tosafot), text. A row for each line that was looked at: its highlight, and its link if it has one.

    Documents without a source give no rows. A text is one row already, so
    gathering its lines again gathers nothing that had been apart.
    """
    book = book_for(config.category, config.multi_line, config.numbered)
    of = lambda role: lines(docs.where(F.col("role") == role), "id", F.col("text")).select("id", "line_no", "raw")
    own = of("commentary")
    rows = features.commentary(own, book, config.delimiter)
    pack = lambda df, name: df.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("line_no", *(c for c in df.columns if c not in ("id", "line_no"))))).alias(name))
    jobs = pack(rows, "commentary")
    for role in TARGETS:
        t = of(role)
        jobs = jobs.join(pack(features.target(t, book), role), "id", "inner" if role == "source" else "left")
        if config.weighted:
            df = lexicon.document_frequency(t.unionByName(own.join(t.select("id").distinct(), "id", "left_semi")), keys=("id",))
            factors = df.select("id", "word", S.idf_factor(F.col("ratio")).alias("factor")).where("factor <> 1.0")
            jobs = jobs.join(factors.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "factor"))).alias(f"{role}_idf")), "id", "left")
        else:
            jobs = jobs.withColumn(f"{role}_idf", F.lit(None).cast("map<string,double>"))
    return jobs.mapInArrow(lambda batches: _resolved(batches, config, book), LINES)


def _resolved(batches, config: Config, book):
    schema, say = None, S.Words()
    expander = Expander(*config.dictionaries) if config.dictionaries else None
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch[c][i].as_py() for c in batch.schema.names}
            targets = {r: Target(r, row[r], dict(row[f"{r}_idf"] or ())) for r in TARGETS if row[r]}
            if "source" not in targets:
                continue
            done = Resolver(row["commentary"], targets, book, passes_for(book, config.fuzzy), title=config.title, weighted=config.weighted, expander=expander, inherit_on_bare=config.inherit_on_bare, say=say).run()
            out = [_row(row["id"], k, done.links.get(k), done.highlights.get(k)) for k in sorted(done.links.keys() | done.highlights.keys())]
            schema = schema or _arrow()
            yield pa.RecordBatch.from_pylist(out, schema)


def _row(id_, line, link, highlight) -> dict:
    out = {"id": id_, "line_index_1": line, "highlight": highlight and {"word_start": highlight[0], "word_count": highlight[1]}}
    if link is not None:
        out |= {"line_index_2": link.target, "he_ref_2": link.ref, "path_2": link.path, "connection_type": "commentary", "secondary_target": link.secondary, "secondary_line_index": link.target if link.secondary else None, "secondary_ref": link.secondary_ref, "is_inherited": link.inherited, "dh_text": link.lemma, "confidence": link.confidence}
        out |= {"status": "approved" if link.confidence >= APPROVED_AT else "pending", "match_range": link.match, "candidates": [{"line_num": a, "score": b, "confidence": c} for a, b, c in link.candidates] or None, "candidate_index": 0}
    return out


def _arrow() -> pa.Schema:
    i, s = pa.int32(), pa.string()
    span = [("word_start", i), ("word_count", i)]
    kinds = dict(id=pa.int64(), line_index_1=i, line_index_2=i, he_ref_2=s, path_2=s, connection_type=s, secondary_target=s, secondary_line_index=i, secondary_ref=s, is_inherited=pa.bool_(), dh_text=s, confidence=i, status=s)
    kinds |= dict(match_range=pa.struct([*span, ("segments", pa.list_(pa.struct(span)))]), candidates=pa.list_(pa.struct([("line_num", i), ("score", pa.float64()), ("confidence", i)])), candidate_index=i, highlight=pa.struct(span))
    return pa.schema(list(kinds.items()))


def links(result: DataFrame) -> DataFrame:
    return result.where("line_index_2 IS NOT NULL").drop("highlight")


def unlinked(result: DataFrame) -> DataFrame:
    return result.where("line_index_2 IS NULL").select("id", "line_index_1")

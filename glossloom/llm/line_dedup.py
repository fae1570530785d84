"""Line dedup with sharded cuckoo filters over exact reference counts.

A line's key is the line with white space stripped at both ends and A-Z
lower-cased; keys found in at least `min_docs` documents lose all their lines.

The index has one row for each shard, a range of key hashes: the exact table
(128-bit key hash -> number of documents that hold it) and a cuckoo filter over
the keys that reach min_docs. Documents are inserted and deleted by adding or
subtracting their references; a key that crosses the bound enters or leaves the
filter, so deleting what was inserted gives back the exact table and the set of
keys in the filter as they were; a filter that had to grow stays grown. The
index knows keys, not documents: to delete one that was not inserted is an
error only if some line of it is not there as often. A lookup asks the filter
first and looks in the exact table for what it reports, and for nothing else.

Documents come in packed units; a unit sends each distinct key once to its
shard with its number of documents, so a line that every document holds is as
light as any other, and one bit for each comes back.

Results: a null or empty text is one empty line, which is never dropped. Each
row is a document of its own, equal ids or not. White space is [\\x20\\x09-\\x0D]
only. An empty table gives an empty result. All other columns pass through
`drop_lines` unchanged, whatever their names; `counted` leaves them out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossloom.llm.common import checkpointed
from glossloom.llm.units import ANSWER, Sent, answer_of, flags_of, grouped, packed_bytes, ranges_for, send, units, with_answers

MIN_DOCS = 10
_SLOTS = 4
_KICKS = 500


class CuckooFilter:
    """Membership with deletion: 16-bit fingerprints, buckets of four slots, two buckets a key. Keys are rows of two 64-bit hashes."""

    def __init__(self, table: np.ndarray):
        self.table = table  # (buckets, 4) uint16, 0 is free; the number of buckets is a power of two

    @classmethod
    def of(cls, keys: np.ndarray, buckets: int = 0) -> CuckooFilter:
        buckets = max(buckets, 8)
        while buckets * _SLOTS * 0.8 < len(keys):
            buckets *= 2
        while True:
            out = cls(np.zeros((buckets, _SLOTS), np.uint16))
            if all(map(out.insert, *out._at(keys))):
                return out
            buckets *= 2

    def _at(self, keys: np.ndarray) -> tuple[list[int], list[int]]:
        prints = (keys[:, 1] >> np.uint64(48)).astype(np.int64)
        prints[prints == 0] = 1
        return prints.tolist(), (keys[:, 1] & np.uint64(len(self.table) - 1)).astype(np.int64).tolist()

    def _other(self, bucket: int, fingerprint: int) -> int:
        return bucket ^ (fingerprint * 0x5BD1E995 & len(self.table) - 1)

    def insert(self, fingerprint: int, bucket: int) -> bool:
        """False if no room was found; then the filter must be made anew, larger."""
        for kick in range(_KICKS):
            for b in (bucket, self._other(bucket, fingerprint)):
                free = np.flatnonzero(self.table[b] == 0)
                if len(free):
                    self.table[b, free[0]] = fingerprint
                    return True
            slot = kick % _SLOTS
            fingerprint, self.table[b, slot] = int(self.table[b, slot]), fingerprint
            bucket = self._other(b, fingerprint)
        return False

    def delete(self, fingerprint: int, bucket: int) -> None:
        """Of a key that is in."""
        for b in (bucket, self._other(bucket, fingerprint)):
            own = np.flatnonzero(self.table[b] == fingerprint)
            if len(own):
                self.table[b, own[0]] = 0
                return
        raise KeyError("not in the filter")

    def __contains__(self, key: np.ndarray) -> bool:
        return bool(self.may_hold(key.reshape(1, 2))[0])

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        prints, first = (np.array(x, np.int64) for x in self._at(keys))
        second = first ^ (prints * 0x5BD1E995 & len(self.table) - 1)
        sought = prints.astype(np.uint16)[:, None]
        return ((self.table[first] == sought) | (self.table[second] == sought)).any(1)


INDEX = "part long, keys binary, refs binary, filter binary"


def _keys(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64).reshape(-1, 2)


def _refs(keys: np.ndarray, refs: np.ndarray, sought: np.ndarray) -> np.ndarray:
    """The references of each sought key; keys are in order."""
    out = np.zeros(len(sought), np.int64)
    if not len(keys):
        return out
    first = keys[:, 0]
    at = np.searchsorted(first, sought[:, 0])
    begins = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
    for step in range(int(np.diff(np.append(begins, len(first))).max())):
        own = np.minimum(at + step, len(keys) - 1)
        out = np.where((keys[own] == sought).all(1), refs[own], out)
    return out


def line_key(line: bytes) -> bytes:
    return line.strip().lower()  # bytes.strip() and bytes.lower() know ASCII only


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode().split(b"\n")


class _Lines:
    """The lines of a unit's documents; keys are the distinct non-empty ones of each document."""

    def __init__(self, batches: list[pa.RecordBatch], column: str):
        self.docs = [[_split(t) for t in b.column(column).to_pylist()] for b in batches]
        found, self.sizes, self.places = [], [], []
        for docs in self.docs:
            for lines in docs:
                own = {}
                places = [own.setdefault(k, len(own)) if (k := line_key(line)) else -1 for line in lines]
                found += map(xxhash.xxh3_128_digest, own)
                self.sizes.append(len(own))
                self.places.append(places)
        self.keys = np.frombuffer(b"".join(found), ">u8").astype(np.uint64).reshape(-1, 2)


def _combined(before: dict | None, changes: np.ndarray, amounts: np.ndarray, min_docs: int) -> dict:
    """An index row after the changes. before: the row it had, if any."""
    old_keys = _keys(before["keys"]) if before else np.zeros((0, 2), np.uint64)
    old_refs = np.frombuffer(before["refs"], np.int64) if before else np.zeros(0, np.int64)
    met = Sent(np.concatenate([old_keys, changes]), np.concatenate([old_refs, amounts]))
    was = np.zeros(len(met.keys), np.int64)
    was[met.of[: len(old_keys)]] = old_refs
    if (met.count < 0).any():
        raise ValueError("a document was deleted that had not been inserted")
    come, gone = (met.count >= min_docs) & (was < min_docs), (met.count < min_docs) & (was >= min_docs)
    filter_ = CuckooFilter(np.frombuffer(before["filter"], np.uint16).reshape(-1, _SLOTS).copy()) if before else None
    if filter_ is not None:
        for fingerprint, bucket in zip(*filter_._at(met.keys[gone]), strict=True):
            filter_.delete(fingerprint, bucket)
        if not all(map(filter_.insert, *filter_._at(met.keys[come]))):
            filter_ = None
    if filter_ is None:
        filter_ = CuckooFilter.of(met.keys[met.count >= min_docs])
    stay = met.count > 0
    return {"keys": met.keys[stay].tobytes(), "refs": met.count[stay].tobytes(), "filter": filter_.table.tobytes()}


class LineIndex:
    """Reference counts of line keys over a set of documents that may grow and shrink."""

    def __init__(self, spark, shards: int, min_docs: int = MIN_DOCS, table: DataFrame | None = None):
        self.shards, self.min_docs = shards, min_docs
        self.table = table if table is not None else spark.createDataFrame([], INDEX)

    def keys_of(self, packed: DataFrame, text_col: str = "text") -> DataFrame:
        return checkpointed(send(packed, lambda batches: Sent(_Lines(batches, text_col).keys), self.shards))

    def _changed(self, sent: DataFrame, sign: int) -> LineIndex:
        min_docs = self.min_docs
        own = self.table.select("part", F.lit(-1).cast("long").alias("unit"), "keys", F.col("refs").alias("counts"), "filter")
        rows = own.unionByName(sent.select("part", "unit", "keys", "counts", F.lit(None).cast("binary").alias("filter")))

        def run(batches):
            for part, group in grouped(batches, "part"):
                # the index's row has unit -1 and sorts first
                old = group["unit"][0].as_py() < 0
                before = {"keys": group["keys"][0].as_py(), "refs": group["counts"][0].as_py(), "filter": group["filter"][0].as_py()} if old else None
                new = group.slice(int(old))
                keys, counts = packed_bytes(new["keys"])[0].view(np.uint64).reshape(-1, 2), packed_bytes(new["counts"])[0].view(np.uint32).astype(np.int64)
                row = _combined(before, keys, sign * counts, min_docs)
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), **{k: pa.array([v], pa.binary()) for k, v in row.items()}})

        table = rows.repartition("part").sortWithinPartitions("part", "unit").mapInArrow(run, INDEX)
        return LineIndex(None, self.shards, min_docs, checkpointed(table))

    def insert(self, sent: DataFrame) -> LineIndex:
        """The index with the documents whose keys were sent (by keys_of)."""
        return self._changed(sent, 1)

    def delete(self, sent: DataFrame) -> LineIndex:
        """The index without them."""
        return self._changed(sent, -1)

    def frequent(self, sent: DataFrame) -> DataFrame:
        """One bit for each key sent: is it in min_docs documents or more?"""
        min_docs = self.min_docs
        own = self.table.select("part", F.lit(-1).cast("long").alias("unit"), "keys", "refs", "filter")
        none = F.lit(None).cast("binary")
        rows = own.unionByName(sent.select("part", "unit", "keys", none.alias("refs"), none.alias("filter")))

        def run(batches):
            for _, group in grouped(batches, "part"):
                old = group["unit"][0].as_py() < 0
                asked = group.slice(int(old))
                if not asked.num_rows:
                    continue
                raw, at = packed_bytes(asked["keys"])
                keys = raw.view(np.uint64).reshape(-1, 2)
                found = np.zeros(len(keys), bool)
                if old:
                    filter_ = CuckooFilter(np.frombuffer(group["filter"][0].as_py(), np.uint16).reshape(-1, _SLOTS))
                    hits = np.flatnonzero(filter_.may_hold(keys))
                    found[hits] = _refs(_keys(group["keys"][0].as_py()), np.frombuffer(group["refs"][0].as_py(), np.int64), keys[hits]) >= min_docs
                yield answer_of(asked, found, np.diff(at) // 16)

        return rows.repartition("part").sortWithinPartitions("part", "unit").mapInArrow(run, ANSWER)


def index_of(packed: DataFrame, *, text_col: str = "text", min_docs: int = MIN_DOCS) -> tuple[LineIndex, DataFrame]:
    """An index of the documents in units, and the keys they sent."""
    empty = LineIndex(packed.sparkSession, ranges_for(packed, 1 / 60), min_docs)
    sent = empty.keys_of(packed, text_col)
    return empty.insert(sent), sent


def drop_lines(docs: DataFrame, *, text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the lines gone whose keys min_docs documents hold; all columns stay."""
    packed = units(docs)
    index, sent = index_of(packed, text_col=text_col, min_docs=min_docs)
    return apply_index(docs.schema, packed, index, sent, text_col=text_col)


def counted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """For each row: doc_id, text (what stays), n_lines (before dropping), n_dropped."""
    packed = units(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    index, sent = index_of(packed, min_docs=min_docs)
    return with_answers(packed, index.frequent(sent).withColumn("level", F.lit(0)), _dropped("text", index.shards, True), "doc_id long, text string, n_lines long, n_dropped long")


def apply_index(schema, packed: DataFrame, index: LineIndex, sent: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Packed documents without the lines that are frequent in the index. sent: their keys, by index.keys_of."""
    return with_answers(packed, index.frequent(sent).withColumn("level", F.lit(0)), _dropped(text_col, index.shards, False), schema)


def _dropped(text_col: str, shards: int, counts: bool):
    def run(_unit, batches, found):
        lines = _Lines(batches, text_col)
        flags = flags_of(Sent(lines.keys), found[0], shards).tolist()
        at = d = 0
        for batch, docs in zip(batches, lines.docs, strict=True):
            texts, n_dropped = batch.column(text_col).to_pylist(), []
            for i, own in enumerate(docs):
                gone = flags[at : at + lines.sizes[d]] + [False]  # place -1: the empty key
                if any(gone):
                    kept = [line for line, p in zip(own, lines.places[d], strict=True) if not gone[p]]
                    texts[i] = b"\n".join(kept).decode()
                    n_dropped.append(len(own) - len(kept))
                else:
                    n_dropped.append(0)
                at, d = at + lines.sizes[d], d + 1
            place = batch.schema.get_field_index(text_col)
            field = batch.schema.field(place)
            result = batch.set_column(place, field, pa.array(texts, field.type))
            if counts:
                result = result.append_column("n_lines", pa.array([len(x) for x in docs], pa.int64())).append_column("n_dropped", pa.array(n_dropped, pa.int64()))
            yield result

    return run


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns, from counted()."""
    return result.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))

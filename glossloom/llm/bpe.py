"""Byte-level BPE encoding and decoding by recursive DuckDB queries in each partition.

A text is cut at the matches of the tokenizer's pattern. Words not met before
go to DuckDB as token-position rows, one for each byte. A recursive query joins
neighbours with the merge table, takes each word's leftmost pair of least rank,
contracts it, and so on until no word has a pair left; ordered aggregation
gives the ids. Decoding knows the ids only: position rows of whole texts join
the vocabulary, and ordered aggregation puts their bytes together.

A word's ids depend on the word alone, so a task keeps those it met; when they
are too many, only those of the texts at hand. Words over LONG_BYTES take a variant of the
recursion that keeps only the last state of each position and contracts all of
a word's pairs of least rank at once, wherever that equals doing it one by one;
else it takes the leftmost. Why that is equal: contracted from left to right, a
pair meets on its left what is contracted already and on its right what is not
yet. So the pairs that come about on the way are those of the state after all
contractions, and those of a new token with the token that stood behind it
before. If none of them has a lesser rank, the leftmost pair of least rank is
always the next of those found; none can have the same rank, as the rank names
the contracted bytes and theirs are more. Both kinds are looked at.

Results: a null or empty text has no tokens and decodes to no bytes; each row
gives one row, also where ids are null or equal. An id that the vocabulary does
not have is an error. Other columns are left out.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossloom.llm.common import text_blocks

#: Words that a task's memory holds before it lets others than the latest go.
KNOWN_WORDS = 200_000
#: Words met repeatedly that a worker keeps for its next task.
COMMON_WORDS = 50_000
#: Words that go to DuckDB together, and bytes that they have at most together.
BATCH_WORDS, BATCH_BYTES = 50_000, 600_000
#: Ids that one group of a decoding query has at most, and all its groups together.
PIECE, DECODED_IDS = 1 << 16, 1 << 19
#: Texts that are cut into words together.
TEXT_BYTES = 4 << 20
LONG_BYTES = 64

# a word and a position in it are one number, 128 * word + position, which sorts fastest; so are both tokens of a pair
_STEP = """
WITH RECURSIVE t(step, k, tok) AS (
  SELECT 0, (w * 128 + pos)::INT, tok FROM given
  UNION ALL (
    WITH pairs AS (SELECT step, k, tok, lead(tok) OVER row AS next_tok, lead(k) OVER row AS next_k, lag(k) OVER row AS before FROM t WINDOW row AS (ORDER BY k)),
    best AS (SELECT k >> 7 AS w, min(merged * 128 + (k & 127)) AS b FROM pairs JOIN merges ON (tok::BIGINT << 32 | next_tok) = lr WHERE (k >> 7) = (next_k >> 7) GROUP BY k >> 7),
    hit AS (SELECT w, w * 128 + (b & 127) AS place, b >> 7 AS merged FROM best)
    SELECT step + 1, k, CASE WHEN k = place THEN merged ELSE tok END FROM pairs JOIN hit ON (k >> 7) = w WHERE before IS DISTINCT FROM place
  )
)
SELECT k >> 7 AS w, k & 127 AS pos, tok FROM t JOIN (SELECT k >> 7 AS w, max(step) AS last FROM t GROUP BY 1) ended ON ended.w = (k >> 7) AND step = last
"""

# tok is -1 where a position was contracted away. `pick` holds the pairs of least rank to contract, every second
# of a run of overlapping ones; `risky` the words in which contracting them one by one would make a pair of a lesser rank on the way.
_LONG = """
WITH RECURSIVE t(w, pos, tok) USING KEY (w, pos) AS (
  SELECT w, pos, tok FROM given
  UNION (
    WITH live AS (SELECT w, pos, tok FROM recurring.t WHERE tok >= 0),
    pairs AS (SELECT w, pos, tok, row_number() OVER word AS i, lead(tok) OVER word AS next_tok, lead(pos) OVER word AS next_pos, lead(tok, 2) OVER word AS third FROM live WINDOW word AS (PARTITION BY w ORDER BY pos)),
    ranked AS (SELECT pairs.*, merged FROM pairs JOIN merges ON tok = l AND next_tok = r),
    least AS (SELECT *, i - row_number() OVER (PARTITION BY w ORDER BY i) AS run FROM ranked QUALIFY merged = min(merged) OVER (PARTITION BY w)),
    found AS (SELECT w, pos, i, next_pos, third, merged FROM (SELECT *, i - min(i) OVER (PARTITION BY w, run) AS nth FROM (SELECT w, pos, i, next_pos, third, merged, i - row_number() OVER (PARTITION BY w ORDER BY i) AS run FROM least)) WHERE nth % 2 = 0),
    after AS (SELECT p.w, p.pos, coalesce(f.merged, p.tok) AS tok, f.merged IS NOT NULL AS fresh FROM pairs p LEFT JOIN found f ON f.w = p.w AND f.pos = p.pos WHERE NOT EXISTS (FROM found g WHERE g.w = p.w AND g.next_pos = p.pos)),
    met AS (SELECT w, tok, lead(tok) OVER word AS next_tok, fresh OR lead(fresh) OVER word AS fresh FROM after WINDOW word AS (PARTITION BY w ORDER BY pos)),
    rank AS (SELECT w, min(merged) AS rank, min(pos) AS first FROM found GROUP BY w),
    risky AS (SELECT DISTINCT w FROM (SELECT w, tok, next_tok FROM met WHERE fresh UNION ALL SELECT w, merged, third FROM found) JOIN merges ON tok = l AND next_tok = r JOIN rank USING (w) WHERE merged < rank),
    pick AS (SELECT f.* FROM found f JOIN rank USING (w) WHERE f.pos = rank.first OR f.w NOT IN (FROM risky))
    SELECT p.w, p.pos, CASE WHEN f.pos IS NOT NULL THEN f.merged ELSE -1 END
    FROM pairs p LEFT JOIN pick f ON f.w = p.w AND f.pos = p.pos LEFT JOIN pick g ON g.w = p.w AND g.next_pos = p.pos WHERE f.pos IS NOT NULL OR g.pos IS NOT NULL
  )
)
SELECT w, pos, tok FROM t WHERE tok >= 0
"""
_IDS = "SELECT w, list(tok ORDER BY pos) AS ids FROM ({}) GROUP BY w"
# a byte is the character of its number, so that strings can be put together
_DECODE = "SELECT w, string_agg(bytes, '' ORDER BY pos) AS decoded, bool_and(bytes IS NOT NULL) AS known FROM given LEFT JOIN vocabulary USING (tok) GROUP BY w"


class Tokenizer:
    """The ranks of one file, in DuckDB."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern).findall
        # a word that is a token is not contracted, as the tiktoken library does it; the last place stands for none
        texts = {text: rank for t, rank in ranks.items() if (text := t.decode(errors="ignore")).encode() == t}
        self.whole = pa.array(texts, pa.large_string())
        self.whole_ids = np.array([*(np.int32(rank).tobytes() for rank in texts.values()), None], object)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        merges = [(ranks[t[:i]], ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.merges = pa.table([*(pa.array(c, pa.int32()) for c in zip(*merges, strict=True)), pa.array([x << 32 | y for x, y, _ in merges], pa.int64())], ["l", "r", "merged", "lr"])
        self.vocabulary = pa.table({"tok": pa.array(ranks.values(), pa.int32()), "bytes": pa.array([t.decode("latin-1") for t in ranks])})
        self.db: duckdb.DuckDBPyConnection | None = None
        # words to their ids, as the bytes of 32-bit numbers
        self.known: dict[str, bytes] = {}
        self.common: set[str] = set()

    def _query(self, sql: str, w: np.ndarray, pos: np.ndarray, tok: np.ndarray) -> pa.Table:
        if self.db is None:
            self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
            for name in ("merges", "vocabulary"):
                self.db.register("table_", getattr(self, name))
                self.db.execute(f"CREATE TABLE {name} AS FROM table_")
                self.db.unregister("table_")
        self.db.register("given", pa.table({"w": w.astype(np.int32), "pos": pos.astype(np.int32), "tok": tok.astype(np.int32)}))
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister("given")

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each of distinct words."""
        every = pa.array(words, pa.large_string())
        at = pc.fill_null(pc.index_in(every, value_set=self.whole), -1).to_numpy()
        found = self.whole_ids[at]
        rest = np.flatnonzero(at < 0)
        sizes = pc.binary_length(every).to_numpy()[rest]
        order = np.argsort(sizes, kind="stable")
        rest, sizes = rest[order], sizes[order]
        n_short, ends, first = int(np.searchsorted(sizes, LONG_BYTES, "right")), np.cumsum(sizes), 0
        while first < len(rest):
            long = first >= n_short
            to = int(np.searchsorted(ends, ends[first] - sizes[first] + BATCH_BYTES, "right"))
            to = min(max(to, first + 1), first + BATCH_WORDS, len(rest) if long else n_short)
            lengths = sizes[first:to]
            texts = every.take(pa.array(rest[first:to]))
            data = np.frombuffer(texts.buffers()[2], np.uint8)[: lengths.sum()]
            table = self._query(_IDS.format(_LONG if long else _STEP), np.repeat(np.arange(to - first), lengths), _places(lengths), self.of_byte[data])
            ids = table["ids"].combine_chunks()
            offsets, raw = ids.offsets.to_numpy() * 4, ids.values.to_numpy().tobytes()
            found[rest[first + table["w"].to_numpy()]] = [raw[a:z] for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            first = to
        return found.tolist()

    def encode(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where those of each begin; the last entry is the end."""
        cut = [self.split(t) for t in texts]
        words = pa.array(chain.from_iterable(cut), pa.large_string(), size=sum(map(len, cut))).dictionary_encode()
        distinct, words = words.dictionary.to_pylist(), words.indices.to_numpy()
        have = list(map(self.known.get, distinct))
        new = [w for w, ids in zip(distinct, have, strict=True) if ids is None]
        if len(self.common) < COMMON_WORDS and len(new) < len(have):
            self.common.update(w for w, ids in zip(distinct, have, strict=True) if ids is not None)
        ids_of_new = self.encode_words(new)
        fresh = iter(ids_of_new)
        here = [next(fresh) if ids is None else ids for ids in have]
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known = {w: ids for w, ids in zip(distinct, here, strict=True) if len(w) <= LONG_BYTES}
        else:
            self.known.update((w, ids) for w, ids in zip(new, ids_of_new, strict=True) if len(w) <= LONG_BYTES)
        sizes = np.fromiter(map(len, here), np.int64, len(here)) // 4
        every, first = np.frombuffer(b"".join(here), np.int32), np.cumsum(sizes) - sizes
        own = sizes[words]
        ends = np.concatenate([[0], np.cumsum(own)])
        return every[np.repeat(first[words], own) + _places(own)], ends[np.cumsum([0, *map(len, cut)])]

    def forget(self) -> None:
        """All but words met repeatedly; the database gives its memory back."""
        if self.db is not None:
            self.db.close()
            self.db = None
        self.known = {w: self.known[w] for w in self.common if w in self.known}
        self.common = set()
        pa.default_memory_pool().release_unused()

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes that ids[offsets[i] : offsets[i + 1]] stand for."""
        pieces = -(-np.diff(offsets) // PIECE)  # a very long text is decoded in pieces
        begins = np.repeat(offsets[:-1], pieces) + PIECE * _places(pieces)
        ends = np.minimum(begins + PIECE, np.repeat(offsets[1:], pieces))
        found, at = [b""] * len(begins), 0
        while at < len(begins):
            to = max(at + 1, int(np.searchsorted(ends, begins[at] + DECODED_IDS, "right")))
            lengths = (ends - begins)[at:to]
            table = self._query(_DECODE, np.repeat(np.arange(to - at), lengths), _places(lengths), ids[begins[at] : ends[to - 1]])
            if not all(table["known"].to_pylist()):
                raise ValueError("an id is not in the vocabulary")
            for w, decoded in zip(table["w"].to_pylist(), table["decoded"].to_pylist(), strict=True):
                found[at + w] = decoded.encode("latin-1")
            at = to
        first = np.cumsum([0, *pieces]).tolist()
        return [found[a] if z == a + 1 else b"".join(found[a:z]) for a, z in zip(first[:-1], first[1:], strict=True)]


def _places(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of lengths."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _joined(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Decimal ids of each text, joined by commas."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pc.cast(pa.array(ids), pa.string())), ",")


def _parted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The other way round."""
    rows = [np.array(x.split(","), np.int64) if x else np.zeros(0, np.int64) for x in texts.to_pylist()]
    return np.concatenate([*rows, np.zeros(0, np.int64)]), np.cumsum([0, *map(len, rows)])


_made: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(ranks_path: str, pattern: str) -> Tokenizer:
    """One for each worker process and file."""
    if (ranks_path, pattern) not in _made:
        _made[ranks_path, pattern] = Tokenizer(ranks_path, pattern)
    return _made[ranks_path, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, n_tokens, token_ids (decimal, joined by commas), decoded (the bytes that the ids stand for)."""

    def run(batches):
        tok = tokenizer(ranks_path, pattern)
        try:
            for t in text_blocks(batches, "text", TEXT_BYTES):
                ids, offsets = tok.encode(x or "" for x in t.batch["text"].to_pylist())
                yield pa.RecordBatch.from_pydict({"doc_id": t.batch["doc_id"], "n_tokens": pa.array(np.diff(offsets), pa.int64()), "token_ids": _joined(ids, offsets), "decoded": pa.array(tok.decode(ids, offsets), pa.binary())})
        finally:
            # the process may serve other operators for hours
            tok.forget()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, token_ids string, decoded binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """For each row of ids, joined by commas: doc_id, decoded."""

    def run(batches):
        tok = tokenizer(ranks_path, pattern)
        try:
            for t in text_blocks(batches, "ids", TEXT_BYTES):
                yield pa.RecordBatch.from_pydict({"doc_id": t.batch["doc_id"], "decoded": pa.array(tok.decode(*_parted(t.batch["ids"])), pa.binary())})
        finally:
            tok.forget()

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("string").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, decoded binary")


def digest(encoded: DataFrame) -> DataFrame:
    """The contract's columns."""
    return encoded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

"""Helpers that the operators of this subpackage share.

Text work runs over Arrow batches: the UTF-8 bytes of a batch are looked at as
one numpy array, so tokenising and window hashing cost a few array passes and
no Python object per word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of one numpy block together hold at most this many bytes, unless one text alone is longer.
BLOCK_BYTES = 1 << 18

_MASK = (1 << 64) - 1
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session on one machine, as in tests, may do without the setting and gets one of our own."""
    sc = spark.sparkContext
    if (there := sc.getCheckpointDir()) is not None:
        return there
    if not (to := spark.conf.get("spark.checkpoint.dir", None)):
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        to = "/tmp/checkpoints/glossloom"
    sc.setCheckpointDir(to)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Two columns that tell rows apart as far as their results can differ; null-safe, so plain equality joins on them."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("__k1"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__k2")]


class Texts(NamedTuple):
    """A block of texts: their bytes, where each begins and ends in them, and the batch's other columns."""

    data: np.ndarray
    offsets: np.ndarray
    batch: pa.RecordBatch

    def __len__(self) -> int:
        return len(self.offsets) - 1


def text_blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[Texts]:
    """Cut Arrow batches into blocks of bounded size; null texts read as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = pc.fill_null(batch.column(column), "").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        at, n = 0, len(texts)
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            to = min(to, n)
            yield Texts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], batch.slice(at, to - at))
            at = to


class Words(NamedTuple):
    """The words of a block: byte ranges, and for document d the words first[d]:first[d + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def left(self) -> np.ndarray:
        """For each word, how many words its document has from there on."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))


def find_words(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> Words:
    """Maximal runs of bytes for which in_word holds; a run never crosses from one text into the next."""
    inside = np.zeros(len(data) + 1, bool)
    np.take(in_word, data, out=inside[:-1])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (edge | ~before))
    ends = np.flatnonzero(before & (edge | ~inside))
    return Words(starts, ends, np.searchsorted(starts, offsets))


def byte_class(pattern: Iterable[int]) -> np.ndarray:
    """Table over bytes that is True for those given."""
    table = np.zeros(256, bool)
    table[list(pattern)] = True
    return table


#: Everything but [\x20\x09-\x0D].
NOT_SPACE = ~byte_class([0x20, *range(0x09, 0x0E)])
#: Lower-cases A-Z only.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0..n-1 of base and of its inverse modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, BLOCK_BYTES + 64)
        up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if n <= 4 * BLOCK_BYTES:
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_values(which: int) -> np.ndarray:
    return mix((np.arange(256, dtype=np.uint64) + np.uint64(1 + which * 256)) * np.uint64(_BASES[0]))


_VALUES = (_byte_values(0), _byte_values(1))


def word_hashes(data: np.ndarray, words: Words, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes; which 0 and 1 are independent hashes."""
    up, down = _power(_BASES[which], len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[which][data] * up[: len(data)], out=sums[1:])
    return mix((sums[words.ends] - sums[words.starts]) * down[words.starts] + (words.ends - words.starts).astype(np.uint64))


class WindowHasher:
    """Hashes of windows of any number of words, from prefix sums of the words' hashes."""

    def __init__(self, hashes: np.ndarray, which: int = 0):
        n = len(hashes)
        up, self.down = _power(_BASES[2 + which], n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * up[:n], out=self.sums[1:])

    def at(self, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return mix((self.sums[starts + length] - self.sums[starts]) * self.down[starts] + np.asarray(length).astype(np.uint64))

    def all(self, length: int) -> np.ndarray:
        """Of every position that has length words behind it in the block, across documents too."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n] + np.uint64(length))


def sliding(ufunc: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """ufunc (minimum or maximum) over x[i : i + width], for each i where that fits; log2(width) passes."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = ufunc(x[:-step], x[step:]) if len(x) > step else x[:0]
        have += step
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def ids_of(batch: pa.RecordBatch, column: str = "doc_id") -> pa.Array:
    return batch.column(column).cast(pa.int64())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges has the long columns a and b. Returns node, component (the smallest
    node reachable) for each node that some edge names, except those that are
    their own component's smallest. No node's neighbours meet in one task: each
    step takes a minimum by key, which combines on the map side, and a join that
    adaptive execution may split. Each round is kept in the shared folder.
    Self-loops, repeated edges and nulls change nothing.
    """
    e = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct()
    e = checkpointed(e)
    before = None
    for _ in range(rounds):
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct()
        least = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        small = large.join(least, F.col("hi") == F.col("u"))
        e = small.select(F.col("m").alias("lo"), F.col("lo").alias("hi")).unionByName(least.select(F.col("m").alias("lo"), F.col("u").alias("hi"))).where("lo < hi").distinct()
        e = checkpointed(e)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        before = now
    raise RuntimeError("components did not settle")

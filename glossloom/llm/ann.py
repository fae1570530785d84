"""Approximate nearest neighbours by multiprobe p-stable hashing.

Nearness is the largest inner product. Vectors are lengthened by one component
that gives all of them the largest norm, so nearest by inner product is nearest
by distance. Each of TABLES tables has HASHES functions floor((a.v + b) / w)
with Gaussian a; their values, clipped to SLOTS around the middle, are a cell.
All rows are indexed.

For a query, the chance that a neighbour at the distance expected for the k-th
lies in a cell is the product of Gaussian slot probabilities. The query visits
cells in order of that chance until the chances reach SUCCESS (and the cells
hold a few times k rows), so two tables miss one neighbour in twenty-five or so.
The expected distance is fitted to a sample of SAMPLE rows by hash of the id, the
query's own left out.
A sample's neighbours are farther than the whole table's, which errs towards
more visits. Cells are packed, in order, into blocks of about BLOCK_ROWS rows;
a cell of more rows, such as a vector that very many rows have, is dealt over
several. Per table there are at most SLOTS ** HASHES cells, so their sizes are
known to the driver. In a block queries stream past its rows and leave with the
k best of the cells they visit, by exact scores in double precision; table
candidates are then merged and ranked.

Results: rows with null ids, with null or zero vectors, with null or non-finite
components, or of another length than most rows have (of equally many, the
longer) take no part. Each row is a candidate, also where rows are equal: they
are searched as one and given as often as there are. A query's candidates are
all rows but those of its id. Each query row gives its own list; so an id that
comes twice among the queries has two. If there are fewer candidates than k,
all are given. Ties go to the smaller id.
Other columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossloom.llm.common import checkpointed
from glossloom.llm.units import grouped

NEIGHBOURS = 20
TABLES = 2
HASHES = 4
#: Width of a hash slot, in root mean square distances between rows.
WIDTH = 1.06
SLOTS = 9
SUCCESS = 0.82
SAMPLE = 2048
BLOCK_ROWS = 4096
SEED = 20

_erf = np.vectorize(math.erf, otypes=[float])


def _usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


@dataclass
class Hashing:
    """What was fitted: projections of the lengthened vectors, offsets, width, the middle slots, the norm and the sample."""

    a: np.ndarray  # (tables, dim + 1, hashes)
    b: np.ndarray  # (tables, hashes)
    width: float
    middle: np.ndarray  # (tables, hashes)
    norm: float
    sample: np.ndarray
    sample_ids: np.ndarray
    nth: int  # which neighbour in the sample stands for the k-th

    @classmethod
    def fit(cls, sample: np.ndarray, sample_ids: np.ndarray, norm: float, rows: int, k: int) -> Hashing:
        rng = np.random.default_rng(SEED)
        a = rng.normal(size=(TABLES, sample.shape[1] + 1, HASHES))
        long = cls._longer(sample, norm)
        spread = math.sqrt(max(0.0, 2 * ((long**2).sum(1).mean() - (long.mean(0) ** 2).sum())))
        width = WIDTH * spread or 1.0
        out = cls(a, rng.uniform(0, width, (TABLES, HASHES)), width, np.zeros((TABLES, HASHES), np.int64), norm, sample, sample_ids, min(len(sample) - 1, k * len(sample) // max(1, rows)))
        out.middle = np.stack([np.floor(np.median(out._places(long, t), axis=0)) for t in range(TABLES)]).astype(np.int64)
        return out

    @staticmethod
    def _longer(v: np.ndarray, norm: float) -> np.ndarray:
        return np.hstack([v, np.sqrt(np.maximum(0, norm * norm - (v**2).sum(1)))[:, None]])

    def _places(self, long: np.ndarray, table: int) -> np.ndarray:
        return (long @ self.a[table] + self.b[table]) / self.width

    def cells(self, v: np.ndarray, table: int) -> np.ndarray:
        slots = np.floor(self._places(self._longer(v, self.norm), table)).astype(np.int64) - self.middle[table] + SLOTS // 2
        return np.ravel_multi_index(np.clip(slots, 0, SLOTS - 1).T, [SLOTS] * HASHES)

    def chances(self, q: np.ndarray, ids: np.ndarray, table: int, cells: np.ndarray) -> np.ndarray:
        """For each query and cell, the estimated chance that the k-th neighbour lies there. Equal inputs give equal bits, wherever they are computed."""
        scores = q @ self.sample.T
        # a query is no neighbour of its own
        own = ids[:, None] == self.sample_ids
        scores[own] = -np.inf
        left = (~own).sum(1)
        near = -np.sort(-scores, axis=1)[np.arange(len(q)), np.minimum(self.nth, np.maximum(left - 1, 0))]
        near[left == 0] = 0
        # rounded, as products of other shapes may differ in their last bits
        far = np.round(np.sqrt(np.maximum(1e-12, (q**2).sum(1) + self.norm**2 - 2 * near)), 6) + 1e-6
        at = np.round(self._places(np.hstack([q, np.zeros((len(q), 1))]), table), 6)
        borders = np.arange(SLOTS + 1) - SLOTS // 2 + self.middle[table][:, None]  # (hashes, slots + 1)
        below = 0.5 * (1 + _erf((borders[None] - at[:, :, None]) * (self.width / far / math.sqrt(2))[:, None, None]))
        below[:, :, 0], below[:, :, -1] = 0, 1
        slot = np.diff(below, axis=2)  # (queries, hashes, slots)
        out = np.ones((len(q), len(cells)))
        for j, place in enumerate(np.unravel_index(cells, [SLOTS] * HASHES)):
            out *= slot[:, j, place]
        return out


@dataclass
class Blocks:
    """Where the rows of each cell are kept. All arrays are over non-empty cells, in order."""

    cells: list[np.ndarray]  # by table
    rows: list[np.ndarray]
    first: list[np.ndarray]
    parts: list[np.ndarray]

    @classmethod
    def pack(cls, counts: dict[tuple[int, int], int]) -> Blocks:
        out, block = cls([], [], [], []), 0
        for table in range(TABLES):
            own = sorted((cell, n) for (t, cell), n in counts.items() if t == table)
            first, parts, room = [], [], 0
            for _, n in own:
                if n > room:
                    block, room = block + 1, BLOCK_ROWS
                first.append(block)
                parts.append(-(-n // BLOCK_ROWS))
                block, room = block + parts[-1] - 1, room - n if parts[-1] == 1 else 0
            out.cells.append(np.array([c for c, _ in own], np.int64))
            out.rows.append(np.array([n for _, n in own], np.int64))
            out.first.append(np.array(first, np.int64))
            out.parts.append(np.array(parts, np.int64))
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel(), kind), rows.shape[1]).cast(pa.list_(kind)) if rows.size else pa.array([], pa.list_(kind))


# key tells rows of one id apart, copies says how many equal rows there are
_DEALT = "block long, asks int, id long, key long, copies long, vector array<double>, bar double"


def _dealt(block, asks, ids, keys, copies, vectors, bars) -> pa.RecordBatch:
    numbers = [pa.array(block, pa.int64()), pa.array(np.full(len(ids), asks), pa.int32()), *(pa.array(x, pa.int64()) for x in (ids, keys, copies))]
    return pa.RecordBatch.from_arrays([*numbers, _lists(vectors, pa.float64()), pa.array(bars, pa.float64())], ["block", "asks", "id", "key", "copies", "vector", "bar"])


def _named(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch[c].to_numpy() for c in ("id", "key", "copies")]


def _index(hashing: Hashing, blocks: Blocks):
    """Rows to their blocks, one in each table."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            names, v = _named(batch), _matrix(batch["vector"])
            ids = names[0]
            for t in range(TABLES):
                at = np.searchsorted(blocks.cells[t], hashing.cells(v, t))
                spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64)
                yield _dealt(blocks.first[t][at] + spread % blocks.parts[t][at], 0, *names, v, np.zeros(len(ids)))

    return run


def _visits(hashing: Hashing, blocks: Blocks, k: int):
    """Queries to the blocks that hold cells they visit; bar is the least chance of those."""

    def run(batches):
        for batch in batches:
            names = _named(batch)
            for i in range(0, batch.num_rows, 64):
                own, key, copies = (x[i : i + 64] for x in names)
                v = _matrix(batch["vector"].slice(i, 64))
                for t in range(TABLES):
                    chance = hashing.chances(v, own, t, blocks.cells[t])
                    order = np.argsort(-chance, axis=1, kind="stable")
                    ranked = np.take_along_axis(chance, order, 1)
                    n_for_chance = (np.cumsum(ranked, 1) < SUCCESS).sum(1)
                    n_for_rows = (np.cumsum(blocks.rows[t][order], 1) < 4 * k + 1).sum(1)
                    last = np.minimum(np.maximum(n_for_chance, n_for_rows), ranked.shape[1] - 1)
                    bars = ranked[np.arange(len(own)), last]
                    for q in range(len(own)):
                        visited = np.flatnonzero(chance[q] >= bars[q])
                        parts = blocks.parts[t][visited]
                        to = np.unique(np.repeat(blocks.first[t][visited], parts) + np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
                        yield _dealt(to, 1, *(np.repeat(x[q], len(to)) for x in (own, key, copies)), np.repeat(v[q : q + 1], len(to), 0), np.repeat(bars[q], len(to)))

    return run


_FOUND = "query_id long, query_key long, query_copies long, ids array<long>, keys array<long>, copies array<long>, scores array<double>"


def _best(scores: np.ndarray, ids: np.ndarray, keys: np.ndarray, copies: np.ndarray, k: int) -> list[np.ndarray]:
    """The k best, ties to smaller ids, each row once."""
    order = np.lexsort((keys, ids, -scores))
    ids, keys = ids[order], keys[order]
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
    return [x[fresh][:k] for x in (scores[order], ids, keys, copies[order])]


def _search(hashing: Hashing, blocks: Blocks, k: int):
    """In each block, rows come first, then the queries."""
    table_of = np.concatenate([np.full(len(f), t) for t, f in enumerate(blocks.first)])
    firsts = np.concatenate(blocks.first)

    def run(batches):
        block, names, v, cells, table = None, [], [], None, 0

        for batch in batches:
            if not batch.num_rows:
                continue
            at, asks = batch["block"].to_numpy(), batch["asks"].to_numpy()
            cut = np.flatnonzero((np.diff(at, prepend=at[0] - 1) != 0) | (np.diff(asks, prepend=asks[0]) != 0))
            for a, z in zip(cut, np.append(cut[1:], len(at)), strict=True):
                part = batch.slice(a, z - a)
                if at[a] != block:
                    block, names, v, cells = at[a], [], [], None
                if not asks[a]:
                    names.append(_named(part))
                    v.append(_matrix(part["vector"]))
                    continue
                if not names:
                    continue
                if cells is None:
                    own, keys, copies = (np.concatenate(x) for x in zip(*names, strict=True))
                    rows = np.concatenate(v)
                    longest = np.sqrt((rows**2).sum(1).max())
                    # the block's table: that of the last cell that begins at or before it
                    table = int(table_of[np.searchsorted(firsts, block, "right") - 1])
                    cells, of = np.unique(hashing.cells(rows, table), return_inverse=True)
                out = []
                for i in range(0, part.num_rows, 128):
                    q, bars = _matrix(part["vector"].slice(i, 128)), part["bar"].slice(i, 128).to_numpy()
                    asked, asked_key, asked_copies = _named(part.slice(i, 128))
                    # more than products added up in another order can differ by
                    slack = 1e-15 * (rows.shape[1] + 1) * longest * np.sqrt((q**2).sum(1))
                    allowed = hashing.chances(q, asked, table, cells) >= bars[:, None] * (1 - 1e-9)
                    scores = q @ rows.T
                    scores[~allowed[:, of] | (own[None] == asked[:, None])] = -np.inf
                    for j in range(len(asked)):
                        s = scores[j]
                        bar = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -np.inf
                        near = np.flatnonzero((s > -np.inf) & (s >= bar - slack[j]))
                        if len(near):
                            # exact scores, added up in one order whatever the block's shape
                            out.append(((asked[j], asked_key[j], asked_copies[j]), _best((rows[near] * q[j]).sum(1), own[near], keys[near], copies[near], k)))
                lists = [pa.array([found[n].tolist() for _, found in out], pa.list_(kind)) for n, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.int64()), (0, pa.float64()))]
                yield pa.RecordBatch.from_arrays([*(pa.array([query[n] for query, _ in out], pa.int64()) for n in range(3)), *lists], ["query_id", "query_key", "query_copies", "ids", "keys", "copies", "scores"])

    return run


def _merge(k: int):
    def run(batches):
        for query, every in grouped(batches, "query_id"):
            key = every["query_key"].to_numpy()
            for one in np.unique(key):
                rows = every.filter(pa.array(key == one))
                scores, ids, _, copies = _best(*(rows[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("scores", "ids", "keys", "copies")), k)
                ids, scores = (np.repeat(x, np.minimum(copies, k))[:k] for x in (ids, scores))
                result = pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), query)), pa.array(np.arange(1, len(ids) + 1, dtype=np.int32)), pa.array(ids), pa.array(scores)], ["query_id", "rank", "vec_id", "score"])
                for _ in range(rows["query_copies"][0].as_py()):
                    yield result

    return run


def nearest(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEIGHBOURS) -> DataFrame:
    """For the rows of which is_query (of the column id) holds: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & _usable(F.col("vector")))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    lengths = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"), F.max(norm).alias("norm")).orderBy(F.desc("n"), F.desc("dim")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if lengths is None:
        return empty
    # once each, or repeats take places among a block's best; combined on the map side, so a common row is light
    rows = rows.where(F.size("vector") == lengths["dim"]).groupBy("id", "vector").agg(F.count("*").alias("copies"))
    rows = checkpointed(rows.withColumn("key", F.xxhash64("vector")))
    n = rows.count()
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", "vector").collect()
    hashing = Hashing.fit(np.array([r[1] for r in picked]), np.array([r[0] for r in picked], np.int64), lengths["norm"], n, k)

    def cells(batches):
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch["vector"])
                for t in range(TABLES):
                    cell, n = np.unique(hashing.cells(v, t), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), t), pa.int32()), pa.array(cell), pa.array(n)], ["t", "cell", "n"])

    counts = rows.select("vector").mapInArrow(cells, "t int, cell long, n long").groupBy("t", "cell").agg(F.sum("n").alias("n"))
    blocks = Blocks.pack({(r["t"], r["cell"]): r["n"] for r in counts.collect()})
    asked = rows.where(is_query)
    dealt = rows.mapInArrow(_index(hashing, blocks), _DEALT).unionByName(asked.mapInArrow(_visits(hashing, blocks, k), _DEALT))
    found = dealt.repartition("block").sortWithinPartitions("block", "asks", "id").mapInArrow(_search(hashing, blocks, k), _FOUND)
    return found.repartition("query_id").sortWithinPartitions("query_id", "query_key").mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")

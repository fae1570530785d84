"""Corpus in units of bounded size, and counting of hashes across units.

Operators that ask "does this line or window also occur elsewhere?" would
shuffle one row for each line or window, and one hot value would meet in one
task. Here the corpus is cut into units of a few MB, packed, dealt over
partitions once and kept in the shared folder so: what later comes back to a
unit goes to its partition, and the corpus itself is not shuffled again. A unit
sends each distinct hash it holds once, however often it occurs there, grouped
by hash range; the range's task answers with one bit for each hash sent. So a
value found in every document costs one entry a unit, the same as any other
hash, and no group of rows is ever gathered.

A message is what one unit sends to one range, so there are never more messages
than distinct hashes in units: as many as units times ranges at first, then one
for each hash. Both ends handle messages as arrays, without a Python object for
each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossloom.llm.common import checkpointed

#: A unit's texts hold about this many bytes; one longer text is a unit by itself.
UNIT_BYTES = 4 << 20
#: Hashes that one range holds on average, whatever the size of the corpus.
RANGE_HASHES = 1_000_000
#: Bytes of the input, as its source has them, for each partition of units, and the most partitions there may be.
PARTITION_BYTES, MOST_PARTITIONS = 8 << 20, 100_000

_OPTIONS = pa.ipc.IpcWriteOptions(compression="zstd")


def _pack(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=_OPTIONS) as out:
        for b in batches:
            out.write_batch(b)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> list[pa.RecordBatch]:
    return list(pa.ipc.open_stream(blob))


@contextmanager
def _fixed_partitions(spark: SparkSession):
    """What is planned inside keeps its partitioning for good: adaptive plans do not say how they are partitioned."""
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _partitions(docs: DataFrame) -> int:
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # where sizes are not known, the planner multiplies or takes the largest number there is
    known = -(-size // PARTITION_BYTES) if size < 1 << 50 else int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(2 * spark.sparkContext.defaultParallelism, min(MOST_PARTITIONS, known))


def units(docs: DataFrame) -> DataFrame:
    """Pack all columns of docs into rows (unit, n_bytes, blob), in the shared folder, partitioned and sorted by unit. Row order within a unit is kept."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seq, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def row():
            return pa.RecordBatch.from_pydict({"unit": pa.array([first + seq], pa.int64()), "n_bytes": pa.array([size], pa.int64()), "blob": pa.array([_pack(held)], pa.binary())})

        for batch in batches:
            if not batch.num_rows:
                continue
            each = max(1, UNIT_BYTES * batch.num_rows // max(1, batch.nbytes) // 4)
            for at in range(0, batch.num_rows, each):
                part = batch.slice(at, each)
                held.append(part)
                size += part.nbytes
                if size >= UNIT_BYTES:
                    yield row()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield row()

    with _fixed_partitions(docs.sparkSession):
        return checkpointed(docs.mapInArrow(pack, "unit long, n_bytes long, blob binary").repartition(_partitions(docs), "unit").sortWithinPartitions("unit"))


def ranges_for(packed: DataFrame, hashes_per_byte: float) -> int:
    """A power of two of hash ranges, so that each holds about RANGE_HASHES."""
    total = packed.agg(F.sum("n_bytes")).first()[0] or 0
    n = 8
    while n * RANGE_HASHES < total * hashes_per_byte:
        n *= 2
    return n


class Sent:
    """Distinct hashes of one unit in sending order. keys is an array of rows of one or two 64-bit columns."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray | None = None):
        keys = keys[:, None] if keys.ndim == 1 else keys
        order = np.lexsort(keys.T[::-1]) if keys.shape[1] > 1 else np.argsort(keys[:, 0], kind="stable")
        at = keys[order]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (at[1:] != at[:-1]).any(1)
        self.keys = at[fresh]
        group = np.cumsum(fresh) - 1
        self.count = np.bincount(group, None if weights is None else weights[order], len(self.keys)).astype(np.int64)
        self.of = np.empty(len(keys), np.int64)  # input position -> place in keys
        self.of[order] = group

    def by_range(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranges that hold some of the keys, and where each begins; keys are in order of their leading bits already."""
        part = (self.keys[:, 0] >> np.uint64(64 - (n.bit_length() - 1))).astype(np.int64)
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        return part[starts], np.append(starts, len(part))


def packed_bytes(values: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array, one value after the other, and where each begins; the last entry is the end."""
    values = values.cast(pa.large_binary())
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks() if values.num_chunks != 1 else values.chunk(0)
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary array of the bytes between offsets; those of one unit or range, so they are far from 2 GB."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8).reshape(-1))])


SENT = "unit long, part long, keys binary, counts binary"


def send(packed: DataFrame, hashes: Callable[[list[pa.RecordBatch]], Sent], n: int) -> DataFrame:
    """Each unit's distinct hashes by range."""

    def run(batches):
        for batch in batches:
            for unit, blob in zip(batch["unit"].to_pylist(), batch["blob"], strict=True):
                yield message_of(unit, hashes(unpack(blob.as_buffer())), n)

    return packed.select("unit", "blob").mapInArrow(run, SENT)


def message_of(unit: int, sent: Sent, n: int) -> pa.RecordBatch:
    parts, starts = sent.by_range(n)
    return pa.RecordBatch.from_pydict({"unit": pa.array(np.full(len(parts), unit), pa.int64()), "part": pa.array(parts, pa.int64()), "keys": binaries(sent.keys, starts * 8 * sent.keys.shape[1]), "counts": binaries(sent.count.astype(np.uint32), starts * 4)})


def grouped(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Runs of rows with the same key, of input sorted by it."""
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch[key].to_numpy()
        cut = np.flatnonzero(np.diff(at, prepend=at[0] - 1))
        for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(at)], strict=True):
            if held and at[a] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = int(at[a])
            held.append(batch.slice(a, z - a))
    if held:
        yield now, pa.Table.from_batches(held)


ANSWER = "unit long, part long, flags binary"


def answer_of(rows: pa.Table, flags: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """flags, of which sizes belong to each row in turn, as one bit each; a row's bits begin at a byte of their own."""
    bytes_ = -(-sizes // 8)
    ends = np.cumsum(bytes_)
    bits = np.zeros(8 * int(bytes_.sum()), bool)
    bits[np.repeat(8 * (ends - bytes_) - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flags))] = flags
    return pa.RecordBatch.from_pydict({"unit": rows["unit"].combine_chunks(), "part": rows["part"].combine_chunks(), "flags": binaries(np.packbits(bits), np.append(0, ends))})


def answer(sent: DataFrame, width: int, judge: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """For each range, sum the counts of equal hashes over units; judge(range, keys, totals) says which to flag. One bit goes back for each hash sent."""

    def run(batches):
        for part, rows in grouped(batches, "part"):
            counts, at = packed_bytes(rows["counts"])
            met = Sent(packed_bytes(rows["keys"])[0].view(np.uint64).reshape(-1, width), counts.view(np.uint32))
            yield answer_of(rows, judge(part, met.keys, met.count)[met.of], np.diff(at) // 4)

    return sent.repartition("part").sortWithinPartitions("part", "unit").mapInArrow(run, ANSWER)


def more_than_once(_part: int, _keys: np.ndarray, totals: np.ndarray) -> np.ndarray:
    return totals > 1


class Answers:
    """What came back to a unit for one level: parts in order, and the flags' bytes for each."""

    def __init__(self, rows: pa.Table):
        self.parts = rows["part"].to_numpy()
        self.rows = rows["flags"]

    def by_part(self) -> dict[int, bytes]:
        return dict(zip(self.parts.tolist(), self.rows.to_pylist(), strict=True))


def flags_of(sent: Sent, answers: Answers, n: int) -> np.ndarray:
    """The answers' bits in the order of the hashes that Sent was made from."""
    parts, starts = sent.by_range(n)
    if not np.array_equal(parts, answers.parts):
        raise ValueError("answers do not fit what was sent")
    data, at = packed_bytes(answers.rows)
    sizes = np.diff(starts)
    bits = np.unpackbits(data).astype(bool)
    return bits[np.repeat(8 * at[:-1] - starts[:-1], sizes) + np.arange(len(sent.keys))][sent.of]


def with_answers(packed: DataFrame, answers: DataFrame, run: Callable[[int, list[pa.RecordBatch], list[Answers]], Iterable[pa.RecordBatch]], schema, levels: int = 1) -> DataFrame:
    """Bring answers (with a column level, from 0) back to their units, which stay where they are. run(unit, batches, answers by level) gives the result's batches."""
    types = pa.schema(_arrow_schema(packed.sparkSession, schema))

    def each(key, unit, back):
        found = []
        if unit.num_rows:
            back = back.sort_by([("level", "ascending"), ("part", "ascending")])
            at = np.searchsorted(back["level"].to_numpy(), np.arange(levels + 1))
            own = [Answers(back.slice(a, z - a)) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            found = [b for b in run(key[0].as_py(), unpack(unit["blob"][0].as_buffer()), own) if b.num_rows]
        return pa.Table.from_batches(found).select(types.names).cast(types) if found else types.empty_table()

    back = answers.select("unit", F.col("level").cast("int").alias("level"), "part", "flags")
    return packed.select("unit", "blob").groupBy("unit").cogroup(back.groupBy("unit")).applyInArrow(each, schema)


def _arrow_schema(spark: SparkSession, schema) -> pa.Schema:
    return spark.createDataFrame([], schema).toArrow().schema

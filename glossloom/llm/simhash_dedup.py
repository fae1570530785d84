"""Near duplicates by SimHash, found in a segment-popcount embedding.

A fingerprint is embedded as the bit counts of its 32 two-bit segments. The
Manhattan distance of two embeddings is never above the Hamming distance of the
fingerprints, so fingerprints within `distance` bits are within `distance`
there. The segments are dealt to distance + 4 groups; as each unit of Manhattan
distance touches one group, two embeddings in range agree in at least four
groups. So the grid has a cell for each choice of four groups and each value
they take; in a cell pairs are compared by their Manhattan distance, if their
total bit counts, a coarser bound still, allow it, and of those in range the
Hamming distance is taken exactly. Counts written as 0, 1 and 11 make the
Manhattan distance the number of bits that differ.

Equal fingerprints are one node before the grid is made, so copies cost no
pairs. A cell gives at most one link a node: to the smallest node it reaches in
the cell. A cell of very many fingerprints is not compared pair by pair: each
looks the 2,081 values within two bits up, which is linear. Components come
from alternating star steps; no links or groups are gathered.

That is `near_duplicates`. `one_of_each` works for texts that share most of
their shingles, which differ in far more bits than a grid can have groups for.
It takes 256-bit fingerprints of distinct five-word shingles, links at WIDE_DISTANCE
bits, and has grids of the counts of some segments each. Two unrelated texts
agree in a segment with a chance of 3/8, two of similarity 0.8 with 0.73; so a
grid is made of as many segments as leave CELL_NODES unrelated nodes in a cell,
and there are as many grids as let two texts of similarity 0.8 meet in one at
least with a chance of 0.97. That is a number of grids of about N to the power
of 0.32, and comparisons in proportion to it for each node; to compare some
hundred nodes costs about as much as to deal a node to one more grid. A cell of more than
LARGE_CELL nodes is dealt once more by grids of its own.
Nodes there are distinct sets of shingles. What hangs together by such links is
a candidate group only: a link needs a Jaccard similarity of SIMILAR, taken
exactly on the sets. A group of more than BLOCK_SHINGLES is dealt over pairs of
blocks. Before, all its sets are compared with one, the pivot: those it links
need no comparison with each other, and as 1 - Jaccard is a metric, only sets
within twice the distance of the pivot can be similar to one of these.

Results: every row has a fingerprint; texts that are null, empty or blank have
fingerprint zero, linked like any other. Rows of a null id take part; their
component is the smallest id reachable, null if there is none. Equal rows are
in one component. Of each component `one_of_each` keeps the row of the smallest
id, and of equal ones one. Other columns pass unchanged.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossloom.llm.common import checkpointed, components, mix, signed, text_blocks
from glossloom.llm.units import unpack, units, with_answers

DISTANCE = 2
SHINGLE = 3
SEED = 42
#: From this many fingerprints on, a cell is searched by looking neighbours up.
LARGE_CELL = 4096
_RUN = 8
WIDE_SHINGLE, WIDE_WORDS, WIDE_DISTANCE = 5, 4, 52
#: Unrelated nodes that a cell holds on average; chances that two unrelated or two similar texts agree in a segment, and that similar ones meet.
CELL_NODES, UNRELATED, ALIKE, MEET = 512, 3 / 8, 0.73, 0.97
#: Sets of fewer shingles are too small for a fingerprint; if two are as similar as 0.8 and one has fewer, they have
#: ten at most, and the shingles that both have are left when one or two are deleted. Below four only equal sets are.
FEW, LEAST_KEYED, MOST_KEYED = 9, 4, 10
#: Least Jaccard similarity of a link, as a fraction.
SIMILAR = (4, 5)
#: Shingles of a block of sets.
BLOCK_SHINGLES = 1 << 16
#: A node is the place of a row: partition, unit and row within the unit, by bits.
_UNIT_BITS, _PLACE_BITS = 20, 23
_SEED = 7
_HALF = 0x5555555555555555
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _shingles(text: str | None, shingle: int) -> list[np.ndarray]:
    """XXH64 of each shingle, in chunks; of a text of fewer words, of all."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return []
    digest, joined = xxhash.xxh64_intdigest, b" ".join(tokens)
    ends = np.cumsum([len(w) + 1 for w in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(tokens))
    starts, ends = starts[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist()
    chunks = range(0, len(starts), 1 << 17)
    return [np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + (1 << 17)], ends[i : i + (1 << 17)], strict=True)], np.uint64) for i in chunks]


def shingle_set(text: str | None, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """The distinct shingles' hashes, in order."""
    found = _shingles(text, shingle)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def deletion_keys(own: np.ndarray) -> np.ndarray:
    """Keys of a small set and of what is left of it without one or two shingles."""
    if not LEAST_KEYED <= len(own) <= MOST_KEYED:
        return np.zeros(0, np.uint64)
    h = mix(own)
    one = h.sum(dtype=np.uint64) - h
    i, j = np.triu_indices(len(h), 1)
    return mix(np.concatenate([h.sum(dtype=np.uint64, keepdims=True), one, one[i] - h[j]]))


def fingerprints_of(texts: list[str | None], shingle: int = SHINGLE, words: int = 1, sets: list[np.ndarray] | None = None) -> np.ndarray:
    """SimHash of each text: a bit is set if it is in over half of the shingles' XXH64. More words than one take distinct shingles and further hashes made from theirs; the result is (texts, words)."""
    hashes, sizes = [], []
    totals = np.zeros((len(texts), 64 * words), np.int64)
    at = []

    def count():
        if not hashes:
            return
        rows, h = np.repeat(np.arange(len(at)), sizes), np.concatenate(hashes)
        for w in range(words):
            own = h if not w else mix(h + np.uint64(w * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            for byte, column in enumerate(own.view(np.uint8).reshape(-1, 8).T):
                seen = np.bincount(rows * 256 + column, minlength=len(at) * 256).reshape(-1, 256)
                totals[np.array(at), w * 64 + byte * 8 : w * 64 + byte * 8 + 8] += seen @ _BITS
        hashes.clear(), sizes.clear(), at.clear()

    n, few = np.zeros(len(texts), np.int64), {}
    for d, text in enumerate(texts):
        found = _shingles(text, shingle) if sets is None else [sets[d]] if len(sets[d]) else []
        if not found:
            continue
        if words > 1:
            # a set of shingles: else a phrase that fills a text makes it like all others of that phrase
            found = [np.unique(np.concatenate(found))]
            if len(found[0]) < FEW:
                few[d] = int(found[0].sum(dtype=np.uint64))
        n[d] = sum(map(len, found))
        for own in found:
            hashes.append(own)
            sizes.append(len(own))
            at.append(d)
            if sum(sizes) >= 1 << 17 or len(at) >= 4096:
                count()
    count()
    bits = (totals * 2 > n[:, None]).astype(np.uint8)
    out = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(len(texts), words)
    for d, total in few.items():
        out[d] = mix(np.array([total], np.uint64) + np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """For each row: doc_id, fp (the fingerprint's bits as a long)."""

    def run(batches):
        for t in text_blocks(batches, "text"):
            fp = fingerprints_of(t.batch["text"].to_pylist(), shingle)[:, 0].copy()
            yield pa.RecordBatch.from_pydict({"doc_id": t.batch["doc_id"], "fp": pa.array(signed(fp))})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _masks(distance: int) -> list[int]:
    """For each choice of four groups, the bits of the embedding that belong to them."""
    groups = distance + 4
    bits = [sum(3 << 2 * s for s in range(32) if s * groups // 32 == g) for g in range(groups)]
    return [sum(chosen) for chosen in combinations(bits, 4)]


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of n reaches over links a-b."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def _cell_links(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within distance in one cell, as places; for a large cell by looking neighbours up."""
    if len(fp) >= LARGE_CELL:
        order = np.argsort(fp)
        at = fp[order]
        left, right = [], []
        flips = [sum(1 << b for b in bits) for k in range(1, distance + 1) for bits in combinations(range(64), k)]
        for flip in flips:
            want = at ^ np.uint64(flip)
            place = np.minimum(np.searchsorted(at, want), len(at) - 1)
            hit = np.flatnonzero((at[place] == want) & (at < want))
            left.append(order[hit])
            right.append(order[place[hit]])
        return np.concatenate(left), np.concatenate(right)
    ones = np.bitwise_count(fp).astype(np.int64)
    order = np.argsort(ones, kind="stable")
    at, ones, embedded = fp[order], ones[order], _embedded(fp[order])
    end = np.searchsorted(ones, ones + distance, "right")
    left, right = [], []
    for i in range(0, len(at), 256):
        j = slice(i, end[min(i + 255, len(at) - 1)])
        near = np.argwhere(np.bitwise_count(embedded[i : i + 256, None] ^ embedded[None, j]) <= distance) + i
        near = near[near[:, 0] < near[:, 1]]
        near = near[np.bitwise_count(at[near[:, 0]] ^ at[near[:, 1]]) <= distance]
        left.append(order[near[:, 0]])
        right.append(order[near[:, 1]])
    return np.concatenate(left), np.concatenate(right)


def _dealt_links(fp: np.ndarray, distance: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a large cell, by grids of its own."""
    left, right = [], []
    low = fp & np.uint64(_HALF)
    high = fp >> np.uint64(1) & np.uint64(_HALF)
    counts = (low & high) << np.uint64(1) | low ^ high
    for mask in _wide_masks(*_grids_for(len(fp)), seed):
        key = np.zeros(len(fp), np.uint64)
        for w, m in enumerate(mask):
            key = mix(key ^ (counts[:, w] & np.uint64(m)))
        order = np.argsort(key, kind="stable")
        cut = np.flatnonzero(np.diff(key[order])) + 1
        for own in np.split(order, cut):
            if len(own) > 1:
                # texts that no grid tells apart are near each other, and few pivots settle them
                i, j = _wide_links(fp[own], distance, seed + 1 if 2 * len(own) < len(fp) else None)
                left.append(own[i])
                right.append(own[j])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def _wide_links(fp: np.ndarray, distance: int, seed: int | None = 1) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all of a cell that pairs within distance join. A first node and all near it are one; each other node is compared with them, and they no more with each other."""
    if len(fp) > LARGE_CELL and seed is not None:
        return _dealt_links(fp, distance, seed)
    left, right = [], []
    rest = np.arange(len(fp))
    while len(rest) > 1:
        near = _bits_apart(fp[rest], fp[rest[0]]) <= distance
        own, rest = rest[near], rest[~near]
        left.append(own[1:])
        right.append(np.repeat(own[0], len(own) - 1))
        if len(own) == 1:
            continue
        for i in range(0, len(rest), 256):
            part = rest[i : i + 256]
            met = np.zeros(len(part), bool)
            for j in range(1, len(own), 4096):
                met |= (_bits_apart(fp[part][:, None], fp[own[j : j + 4096]][None]) <= distance).any(1)
            left.append(part[met])
            right.append(np.repeat(own[0], met.sum()))
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def _embedded(fp: np.ndarray) -> np.ndarray:
    """The bit counts of two-bit segments as 0, 1 and 11, so that Manhattan distances are numbers of differing bits."""
    low, high = fp & np.uint64(_HALF), fp >> np.uint64(1) & np.uint64(_HALF)
    return low | high | (low & high) << np.uint64(1)


def _bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def _links(batches, distance: int, words: int = 1):
    """Links of each cell, of rows sorted by cell; a cell that goes over the end of a batch is carried on."""
    kept: list[list[np.ndarray]] = []
    find = _wide_links if words > 1 else lambda fp, d: _cell_links(fp[:, 0], d)

    def of(rows):
        cell, fp, node = rows
        if not len(fp):
            return
        begins = np.append(np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]).any(1)])), len(fp))
        run = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
        size = np.diff(begins)[run]
        a, b, embedded = [], [], _embedded(fp)
        for k in range(1, _RUN):
            i = np.flatnonzero((run[:-k] == run[k:]) & (size[:-k] <= _RUN)) if len(run) > k else np.zeros(0, np.int64)
            i = i[_bits_apart(embedded[i], embedded[i + k]) <= distance]
            i = i[_bits_apart(fp[i], fp[i + k]) <= distance]
            a.append(node[i])
            b.append(node[i + k])
        for r in np.flatnonzero(np.diff(begins) > _RUN):
            own = slice(begins[r], begins[r + 1])
            i, j = find(fp[own], distance)
            label = _labels(begins[r + 1] - begins[r], i, j)
            moved = np.flatnonzero(label != np.arange(len(label)))
            a.append(node[own][moved])
            b.append(node[own][label[moved]])
        a, b = np.concatenate(a), np.concatenate(b)
        yield pa.RecordBatch.from_pydict({"a": pa.array(a[a != b]), "b": pa.array(b[a != b])})

    for batch in batches:
        cell = np.stack([batch["choice"].to_numpy(zero_copy_only=False).astype(np.int64), batch["cell"].to_numpy()], 1)
        fp = np.stack([batch[f"fp{w}" if w else "fp"].to_numpy().view(np.uint64) for w in range(words)], 1)
        rows = [cell, fp, batch["node"].to_numpy()]
        if not len(fp):
            continue
        # the last cell may go on in the next batch; one of many batches is put together once
        other = np.flatnonzero((cell != cell[-1]).any(1))
        last = int(other[-1]) + 1 if len(other) else 0
        if kept and (last or (kept[-1][0][-1] != cell[0]).any()):
            end = last if (kept[-1][0][-1] == cell[0]).all() else 0
            yield from of([np.concatenate(x) for x in zip(*kept, [x[:end] for x in rows], strict=True)])
            kept, rows, last = [], [x[end:] for x in rows], last - end
        if last:
            yield from of([x[:last] for x in rows])
        kept.append([x[last:] for x in rows])
    if kept:
        yield from of([np.concatenate(x) for x in zip(*kept, strict=True)])


def _counts_of(fp):
    """The embedding: each two-bit segment holds its number of set bits."""
    low, high = fp.bitwiseAND(F.lit(_HALF)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_HALF))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))


def _grids_for(n: int) -> tuple[int, int]:
    """How many segments a grid is made of, and how many grids there are, for n nodes."""
    segments = max(4, math.ceil(math.log(max(1, n) / CELL_NODES) / math.log(1 / UNRELATED)))
    return segments, math.ceil(math.log(1 - MEET) / math.log(1 - ALIKE**segments))


def _wide_masks(segments: int, grids: int, seed: int = 0) -> list[list[int]]:
    """For each grid, the bits of each word's embedding that it is made of."""
    rng = np.random.default_rng([_SEED, seed])
    picked = [rng.choice(32 * WIDE_WORDS, segments, replace=False).tolist() for _ in range(grids)]
    return [[sum(3 << 2 * (s % 32) for s in own if s // 32 == w) for w in range(WIDE_WORDS)] for own in picked]


def _linked_nodes(grid: DataFrame, nodes: DataFrame, fp: list[str], distance: int) -> DataFrame:
    """nodes with the smallest node that each reaches by links of the grid's cells."""
    links = grid.repartition("choice", "cell").sortWithinPartitions("choice", "cell", *fp).mapInArrow(lambda b: _links(b, distance, len(fp)), "a long, b long")
    return nodes.join(components(links), "node", "left").select(*fp, F.coalesce("component", "node").alias("node"))


def _nodes(prints: DataFrame, fp: list[str]) -> DataFrame:
    # a fingerprint that only rows without id have is named by itself, below all ids there may be
    return checkpointed(prints.groupBy(*fp).agg(F.coalesce(F.min("doc_id"), F.lit(-(1 << 62)) - F.shiftrightunsigned(F.xxhash64(*fp), 2)).alias("node")))


def linked(prints: DataFrame, *, distance: int = DISTANCE) -> DataFrame:
    """prints (doc_id, fp, more columns) with component_id for each row; and __node, which tells components apart where that is null."""
    nodes = _nodes(prints, ["fp"])
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("choice"), F.col("c").bitwiseAND(F.lit(_long(m))).alias("cell")) for i, m in enumerate(_masks(distance)))))
    grid = nodes.select("fp", "node", _counts_of(F.col("fp")).alias("c")).select("fp", "node", cells.alias("g")).select("g.choice", "g.cell", "fp", "node")
    named = _linked_nodes(grid, nodes, ["fp"], distance).withColumnRenamed("node", "__node")
    return prints.join(named, "fp", "left").withColumn("component_id", F.when(F.col("__node") > -(1 << 62) + (1 << 61), F.col("__node")))


def _candidates(prints: DataFrame, distance: int) -> DataFrame:
    """The distinct sets of prints: s0, s1 (a set's digest), node, and label, the least node of its candidate group."""
    fp = ["fp", *(f"fp{w}" for w in range(1, WIDE_WORDS))]
    nodes = checkpointed(prints.groupBy("s0", "s1").agg(F.min("node").alias("node"), *(F.min(f).alias(f) for f in fp)).withColumn("label", F.col("node")))
    keyed = prints.where(F.size("keys") > 0).select("s0", "s1", F.explode("keys").alias("key")).distinct().join(nodes.select("s0", "s1", "node"), ["s0", "s1"]).select("key", "node")
    least = keyed.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least")
    small = keyed.join(least, "key").where("node > least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    masks = list(enumerate(_wide_masks(*_grids_for(nodes.count()))))
    # a group of copies hangs together after a few grids; the others then only link what is not linked yet
    half = -(-len(masks) // 2)
    for own in (masks[:half], masks[half:]):
        counts = nodes.select(*fp, F.col("label").alias("node"), *(_counts_of(F.col(f)).alias(f"c{w}") for w, f in enumerate(fp)))
        cells = F.explode(F.array(*(F.struct(F.lit(i).alias("choice"), F.xxhash64(*(F.col(f"c{w}").bitwiseAND(F.lit(_long(m))) for w, m in enumerate(mask))).alias("cell")) for i, mask in own)))
        grid = counts.select(*fp, "node", cells.alias("g")).select("g.choice", "g.cell", *fp, "node")
        links = grid.repartition("choice", "cell").sortWithinPartitions("choice", "cell", *fp).mapInArrow(lambda b: _links(b, distance, len(fp)), "a long, b long")
        if own[0][0] == 0:
            links = links.unionByName(small)
        found = components(links).withColumnsRenamed({"node": "label", "component": "to"})
        nodes = checkpointed(nodes.join(found, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to"))
    return nodes.select("s0", "s1", "node", "label")


def _pairs_in_cells(pivots: bool):
    """Compare sets in each cell, of rows sorted by cell: those of side 0 with those of side 1, and in a cell of one block (i = j) with each other. Gives links; with pivots, kind for each set of side 1: 0 linked, 1 within twice a link's distance, 2 farther."""
    p, q = SIMILAR

    def of(nodes, sides, sets, one_block):
        sides, size = np.array(sides), np.array([len(x) for x in sets])
        order = np.argsort(sides, kind="stable")
        nodes, sides, size, sets = np.array(nodes)[order], sides[order], size[order], [sets[i] for i in order]
        # equal sets are one node, so at most one is empty; it is like no other
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        ends = np.cumsum(size)
        n_left, a, b, kinds = int((sides == 0).sum()), [], [], []
        for i in range(n_left):
            first = i + 1 if one_block else n_left
            if first >= len(nodes) or not size[i] or not size[first:].any():
                near = np.zeros(max(0, len(nodes) - first), np.int64)
            else:
                mark = np.zeros(len(codes) + 1, np.int64)
                mark[codes[ends[i] - size[i] : ends[i]]] = 1
                at = np.concatenate([[0], np.cumsum(mark[codes])])
                near = at[ends[first:]] - at[ends[first:] - size[first:]]
            either = size[first:] + size[i] - near
            linked = near * q >= p * either
            linked &= near > 0
            if pivots:
                # 1 - near / either <= 2 * (1 - p / q)
                kinds.append(np.where(linked, 0, np.where(near * q >= (2 * p - q) * either, 1, 2)))
                linked[:] = True
            a.append(np.full(int(linked.sum()), nodes[i]))
            b.append(nodes[first:][linked])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        kinds = np.concatenate(kinds) if kinds else np.zeros(len(a), np.int64)
        if not pivots and len(a):
            # links that join the same
            names = np.unique(np.concatenate([a, b]))
            label = _labels(len(names), np.searchsorted(names, a), np.searchsorted(names, b))
            a, b = names, names[label]
            a, b = a[a != b], b[a != b]
            kinds = np.zeros(len(a), np.int64)
        return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "kind": pa.array(kinds, pa.int32())})

    def run(batches):
        cell, nodes, sides, sets = None, [], [], []
        for batch in batches:
            keys = zip(*(batch[c].to_pylist() for c in ("label", "which", "i", "j")), strict=True)
            for key, side, node, own in zip(keys, batch["side"].to_pylist(), batch["node"].to_pylist(), batch["own"], strict=True):
                if key != cell:
                    if len(nodes) > 1:
                        yield of(nodes, sides, sets, cell[1] == 0 and cell[2] == cell[3])
                    cell, nodes, sides, sets = key, [], [], []
                nodes.append(node)
                sides.append(side)
                sets.append(np.frombuffer(own.as_py(), np.uint64))
        if len(nodes) > 1:
            yield of(nodes, sides, sets, cell[1] == 0 and cell[2] == cell[3])

    return run


def _compared(dealt: DataFrame, pivots: bool = False) -> DataFrame:
    """dealt: label, cell (which, i, j, side), node, own."""
    rows = dealt.select("label", "cell.*", "node", "own").repartition("label", "which", "i", "j").sortWithinPartitions("label", "which", "i", "j", "side", "node")
    return rows.mapInArrow(_pairs_in_cells(pivots), "a long, b long, kind int")


def _cell(which: int, i, j, side):
    return F.struct(F.lit(which).alias("which"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))


def _blocks(weight):
    return F.ceil(F.sum(weight) / BLOCK_SHINGLES).cast("int")


def _verified(members: DataFrame) -> DataFrame:
    """Links a-b between the sets of each candidate group that are similar. members: label, node, n, own (the set); kept in the shared folder."""
    zero, at = F.lit(0), lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    sizes = checkpointed(members.groupBy("label").agg(F.greatest(_blocks("n"), F.lit(1)).alias("blocks")))
    sized = members.join(sizes, "label")
    links = _compared(sized.where("blocks = 1").withColumn("cell", _cell(0, zero, zero, zero)))
    large = sized.where("blocks > 1")
    # the pivot, whose node names its group, goes to each block
    pivot = large.where("node = label").withColumn("cell", F.explode(F.transform(F.sequence(zero, F.col("blocks") - 1), lambda k: _cell(1, zero, k, zero))))
    others = large.where("node != label").withColumn("cell", _cell(1, zero, at("blocks"), F.lit(1)))
    kinds = checkpointed(_compared(pivot.unionByName(others), True))
    links = links.unionByName(kinds.where("kind = 0"))
    large = large.select("label", "node", "n", "own").join(kinds.select(F.col("b").alias("node"), "kind"), "node", "left").withColumn("kind", F.coalesce("kind", zero))
    large = checkpointed(large)
    parts = large.groupBy("label").agg(_blocks(F.when(F.col("kind") > 0, F.col("n")).otherwise(0)).alias("rest"), _blocks(F.when(F.col("kind") == 1, F.col("n")).otherwise(0)).alias("ring"), _blocks(F.when(F.col("kind") == 0, F.col("n")).otherwise(0)).alias("star"))
    large = large.join(checkpointed(parts), "label")
    upto = lambda n: F.sequence(zero, F.col(n) - 1)
    rest = large.where("kind > 0 AND rest > 0").withColumn("own_block", at("rest"))
    rest = rest.withColumn("cell", F.explode(F.transform(upto("rest"), lambda k: _cell(0, F.least(k, F.col("own_block")), F.greatest(k, F.col("own_block")), F.col("own_block") > k)))).drop("own_block")
    ring = large.where("kind = 1 AND ring > 0").withColumn("own_block", at("ring"))
    ring = ring.withColumn("cell", F.explode(F.transform(upto("star"), lambda k: _cell(2, F.col("own_block"), k, zero)))).drop("own_block")
    star = large.where("kind = 0 AND ring > 0").withColumn("own_block", at("star"))
    star = star.withColumn("cell", F.explode(F.transform(upto("ring"), lambda k: _cell(2, k, F.col("own_block"), F.lit(1))))).drop("own_block")
    return links.unionByName(_compared(rest.unionByName(ring).unionByName(star))).select("a", "b")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = WIDE_DISTANCE, shingle: int = WIDE_SHINGLE) -> DataFrame:
    """docs, all columns as they are, with one row of each component of similar texts."""
    packed = units(docs)

    def run(batches):
        for batch in batches:
            for unit, blob in zip(batch["unit"].to_pylist(), batch["blob"], strict=True):
                at = 0
                for rows in unpack(blob.as_buffer()):
                    sets = [shingle_set(t, shingle) for t in rows.column(text_col).to_pylist()]
                    fp = fingerprints_of([None] * len(sets), shingle, WIDE_WORDS, sets)
                    digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), np.int64).reshape(-1, 2)
                    first = (unit >> 32) << (_UNIT_BITS + _PLACE_BITS) | (unit & (1 << 32) - 1) << _PLACE_BITS
                    out = {"unit": pa.array([unit] * len(fp), pa.int64()), "place": pa.array(np.arange(at, at + len(fp))), "doc_id": rows.column(id_col).cast(pa.int64())}
                    out |= {"node": pa.array(first + np.arange(at, at + len(fp))), "s0": pa.array(digests[:, 0].copy()), "s1": pa.array(digests[:, 1].copy())}
                    out |= {"keys": pa.array([signed(deletion_keys(x)) for x in sets], pa.list_(pa.int64()))}
                    yield pa.RecordBatch.from_pydict(out | {f"fp{w}" if w else "fp": pa.array(signed(fp[:, w].copy())) for w in range(WIDE_WORDS)})
                    at += len(fp)

    schema = "unit long, place long, doc_id long, node long, s0 long, s1 long, keys array<long>, fp long" + "".join(f", fp{w} long" for w in range(1, WIDE_WORDS))
    prints = checkpointed(packed.select("unit", "blob").mapInArrow(run, schema))
    nodes = _candidates(prints, distance)
    groups = nodes.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select("label")
    unit = F.shiftleft(F.shiftright("node", _UNIT_BITS + _PLACE_BITS), 32).bitwiseOR(F.shiftright("node", _PLACE_BITS).bitwiseAND(F.lit((1 << _UNIT_BITS) - 1)))
    wanted = nodes.join(groups, "label").select(unit.alias("unit"), F.lit(0).alias("level"), F.col("node").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).alias("part"), F.concat_ws(",", "node", "label").cast("binary").alias("flags"))

    def sets_of(_unit, batches, found):
        at, found = 0, found[0].by_part()
        for rows in batches:
            own = [i for i in range(rows.num_rows) if at + i in found]
            names = [tuple(map(int, found[at + i].decode().split(","))) for i in own]
            sets = [shingle_set(t, shingle) for t in rows.column(text_col).take(pa.array(own, pa.int64())).to_pylist()]
            at += rows.num_rows
            yield pa.RecordBatch.from_pydict({"node": pa.array([x[0] for x in names], pa.int64()), "label": pa.array([x[1] for x in names], pa.int64()), "n": pa.array([len(x) for x in sets], pa.int64()), "own": pa.array([x.tobytes() for x in sets], pa.binary())})

    members = checkpointed(with_answers(packed, wanted, sets_of, "node long, label long, n long, own binary"))
    named = nodes.join(components(_verified(members)), "node", "left").select("s0", "s1", F.coalesce("component", "node").alias("__node"))
    # null ids last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "unit", "place")).alias("first")
    stay = prints.select("s0", "s1", "doc_id", "unit", "place").join(named, ["s0", "s1"]).groupBy("__node").agg(first).select("first.unit", F.lit(0).alias("level"), F.col("first.place").alias("part"), F.lit(b"").alias("flags"))

    def keep(_unit, batches, found):
        at, found = 0, found[0].parts
        for rows in batches:
            yield rows.filter(pa.array(np.isin(np.arange(at, at + rows.num_rows), found)))
            at += rows.num_rows

    return with_answers(packed, stay, keep, docs.schema)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """For each row: doc_id, fp, component_id."""
    prints = checkpointed(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    return linked(prints, distance=distance).select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

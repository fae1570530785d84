"""Benchmark decontamination with a broadcast set of normalised n-grams.

Words are what stays of a text after lower-casing A-Z and cutting at every
ASCII character that is neither letter nor digit. A window is `n` consecutive
words of a benchmark item; an item of fewer words, but not none, is one window.
A document word inside any occurrence of a window is hit.

The windows are broadcast in blocks of about WINDOWS_PER_BLOCK, counted first
and dealt by hash of window and item, so that a window of very many items is in
many blocks; as a rule there is one. With more blocks the documents are scanned
once for each, what was found so far is kept in the shared folder, and a block
is let go before the next is made. A scan looks
windows up by hash and compares the words of each one found, so no other text
is ever hit. Nothing is shuffled.

Results: null texts have no words and no hits; so have empty ones. Rows with
equal ids are scanned each by itself. Items with a null id count as one item
named by the empty string; an id that comes several times counts once. An empty
benchmark hits nothing, an empty table gives an empty result. Columns of other
names, also those used here, pass through the filters unchanged.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossloom.llm.common import LOWER, WindowHasher, byte_class, checkpointed, find_words, text_blocks, word_hashes

NGRAM = 10
#: A window takes about 150 bytes in a worker.
WINDOWS_PER_BLOCK = 500_000

IN_WORD = ~byte_class([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_WORDS = bytes(b if IN_WORD[b] else 0x20 for b in LOWER)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


def _windows(benchmark: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """Distinct (item, length, window)."""

    def cut(batches):
        for batch in batches:
            items, lengths, windows = [], [], []
            for item, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist(), strict=True):
                w = words_of(text)
                size = min(n, len(w))
                for i in range(len(w) - size + 1 if w else 0):
                    items.append(item)
                    lengths.append(size)
                    windows.append(b" ".join(w[i : i + size]))
            yield pa.RecordBatch.from_pydict({"item": pa.array(items, pa.string()), "length": pa.array(lengths, pa.int32()), "window": pa.array(windows, pa.binary())})

    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, "item string, length int, window binary").distinct()


class _Matcher:
    """Looks the windows of a block of words up."""

    def __init__(self, windows: dict[bytes, tuple[int, list[str]]]):
        by = defaultdict(list)
        for window, (length, items) in windows.items():
            by[length].append((window, items))
        self.tables = {}
        for length, own in by.items():
            data = np.frombuffer(b"".join(w for w, _ in own), np.uint8)
            at = np.cumsum([0] + [len(w) for w, _ in own])
            hashes = WindowHasher(word_hashes(data, find_words(data, at, IN_WORD))).at(np.arange(len(own)) * length, length)
            near = np.zeros(1 << 20, bool)
            near[hashes & np.uint64((1 << 20) - 1)] = True
            self.tables[length] = near, np.unique(hashes)
        self.windows = windows

    def find(self, texts):
        """The words, which of them are hit, and each document's items."""
        data = LOWER[texts.data]
        words = find_words(data, texts.offsets, IN_WORD)
        marks, items = np.zeros(len(words.starts) + 1, np.int64), defaultdict(set)
        if self.tables and len(words.starts):
            by, left = WindowHasher(word_hashes(data, words)), words.left()
            for length, (near, hashes) in self.tables.items():
                h = by.all(length)
                at = np.flatnonzero(near[h & np.uint64((1 << 20) - 1)] & (left[: len(h)] >= length))
                place = np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)
                at = at[hashes[place] == h[at]]
                docs = np.searchsorted(words.first, at, "right") - 1
                for i, d in zip(at.tolist(), docs.tolist(), strict=True):
                    window = b" ".join(data[a:b].tobytes() for a, b in zip(words.starts[i : i + length], words.ends[i : i + length], strict=True))
                    found = self.windows.get(window)
                    if found and found[0] == length:
                        marks[i] += 1
                        marks[i + length] -= 1
                        items[d].update(found[1])
        return words, np.cumsum(marks)[:-1] > 0, items


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, n: int, limit: int):
    """The windows in broadcast blocks, each at most about limit of them, one at a time, and whether it is the last."""
    windows = checkpointed(_windows(benchmark, id_col, text_col, n))
    total = windows.count()
    if total == 0:
        yield True, benchmark.sparkSession.sparkContext.broadcast({})
    blocks = -(-total // limit)
    for k in range(blocks):
        own: dict[bytes, tuple[int, list[str]]] = {}
        part = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == k)
        for item, length, window in part.toLocalIterator():
            own.setdefault(bytes(window), (length, []))[1].append(item)
        yield k + 1 == blocks, benchmark.sparkSession.sparkContext.broadcast(own)


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = NGRAM, limit: int = WINDOWS_PER_BLOCK) -> DataFrame:
    """For each row: doc_id, n_words, hits (word ranges array<struct<first, last>>), n_hit, items (sorted as strings)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(None).cast("binary").alias("marks"), F.lit(None).cast("array<string>").alias("items"))
    for last, block in _blocks(benchmark, item_col, item_text_col, n, limit):
        rows = rows.mapInArrow(_scan(block), "doc_id long, text string, marks binary, items array<string>, n_words long, n_hit long")
        if not last:
            rows = checkpointed(rows.drop("n_words", "n_hit"))
            block.destroy()
    return rows.mapInArrow(_ranges, "doc_id long, n_words long, hits array<struct<first: long, last: long>>, n_hit long, items array<string>")


def _scan(block):
    def run(batches):
        matcher = _Matcher(block.value)
        for t in text_blocks(batches):
            words, hit, items = matcher.find(t)
            marks, all_items, hits = [], [], []
            for d, (before, known) in enumerate(zip(t.batch["marks"].to_pylist(), t.batch["items"].to_pylist(), strict=True)):
                own = hit[words.first[d] : words.first[d + 1]]
                if before is not None:
                    own = own | np.unpackbits(np.frombuffer(before, np.uint8), count=len(own)).astype(bool)
                marks.append(np.packbits(own).tobytes())
                all_items.append(sorted(items.get(d, set()).union(known or ())))
                hits.append(int(own.sum()))
            yield pa.RecordBatch.from_pydict({"doc_id": t.batch["doc_id"], "text": t.batch["text"], "marks": pa.array(marks, pa.binary()), "items": pa.array(all_items, pa.list_(pa.string())), "n_words": pa.array(words.counts, pa.int64()), "n_hit": pa.array(hits, pa.int64())})

    return run


def _ranges(batches):
    """Bits to ranges of words; texts go no further."""
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    for b in batches:
        out = []
        for marks, n, hit in zip(b["marks"].to_pylist(), b["n_words"].to_pylist(), b["n_hit"].to_pylist(), strict=True):
            if not hit:
                out.append([])
                continue
            bits = np.zeros(n + 2, np.int8)
            bits[1:-1] = np.unpackbits(np.frombuffer(marks, np.uint8), count=n)
            edge = np.flatnonzero(np.diff(bits))
            out.append([{"first": int(a), "last": int(z) - 1} for a, z in zip(edge[::2], edge[1::2], strict=True)])
        yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "n_words": b["n_words"], "hits": pa.array(out, kind), "n_hit": b["n_hit"], "items": b["items"]})


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = NGRAM, spans: bool = False, limit: int = WINDOWS_PER_BLOCK) -> DataFrame:
    """docs, all columns as they are, without the contaminated rows; or, with spans, with the hit words (and what stands between them) cut out of the texts."""
    for last, block in _blocks(benchmark, item_col, item_text_col, n, limit):

        def run(batches, block=block):
            matcher = _Matcher(block.value)
            for t in text_blocks(batches, text_col):
                words, hit, _ = matcher.find(t)
                sums = np.concatenate([[0], np.cumsum(hit)])
                dirty = sums[words.first[1:]] > sums[words.first[:-1]]
                if not spans:
                    yield t.batch.filter(pa.array(~dirty))
                    continue
                texts = t.batch.column(text_col).to_pylist()
                for d in np.flatnonzero(dirty):
                    texts[d] = _without(t, words, hit, d)
                at = t.batch.schema.get_field_index(text_col)
                yield t.batch.set_column(at, t.batch.schema.field(at), pa.array(texts, t.batch.schema.field(at).type))

        docs = docs.mapInArrow(run, docs.schema)
        if not last:
            docs = checkpointed(docs)
            block.destroy()
    return docs


def _without(t, words, hit, d) -> str:
    lo, hi = words.first[d], words.first[d + 1]
    base, end = t.offsets[d], t.offsets[d + 1]
    keep = np.ones(end - base, bool)
    for i in range(lo, hi):
        if hit[i]:
            to = words.starts[i + 1] if i + 1 < hi and hit[i + 1] else words.ends[i]
            keep[words.starts[i] - base : to - base] = False
    return t.data[base:end][keep].tobytes().decode()


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))

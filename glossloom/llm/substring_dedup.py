"""Substring dedup by level-wise doubling.

Words covered by a window of `window` consecutive words whose word sequence
starts anywhere else too are removed, in all places. Windows of a quarter of
that length are looked at first, only those that repeat are extended to twice
their length, and so on until the wanted length is reached or none survives.

At the first level not every window needs a look: of the quarter-length windows
inside any full window, the one of the least hash is an anchor. The choice
depends on the words alone, so if a full window repeats, its anchor repeats
with it, and about one word in fourteen is an anchor. An anchor that repeats is
extended to both sides; a full window stays a candidate only if the extension
that lies inside it repeats as well. Up to here hashes from prefix sums do, as they
only choose; a full window is known by an XXH3 hash of 128 bits of its words.

Results: a null text has no words, and neither has an empty or all-blank one;
they keep the empty string. Each row is a document of its own, so two equal
rows repeat each other. Rows with a null id are treated like others. Other
columns, whatever their names, are left out of the result. An empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossloom.llm.common import NOT_SPACE, WindowHasher, checkpointed, find_words, mix, sliding, text_blocks, word_hashes
from glossloom.llm.units import SENT, Sent, answer, flags_of, message_of, more_than_once, ranges_for, send, units, with_answers

WINDOW = 35
_TOP = np.uint64((1 << 64) - 1)


class _Block:
    """One block's words, and the candidate windows of each level."""

    def __init__(self, texts, window: int):
        self.texts, self.window = texts, window
        self.words = find_words(texts.data, texts.offsets, NOT_SPACE)
        self.n, self.left = len(self.words.starts), self.words.left()
        self.seen = np.arange(self.n) - np.repeat(self.words.first[:-1], self.words.counts)
        self.hash = word_hashes(texts.data, self.words)
        self.by = WindowHasher(self.hash)
        self.base, self.double = max(1, -(-window // 4)), min(window, 2 * max(1, -(-window // 4)))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Where base-length windows of the least hash of some full window start, and their hashes."""
        n, span = self.n, self.window - self.base + 1
        grams = np.full(n, _TOP)
        all_ = self.by.all(self.base)
        grams[: len(all_)] = all_
        least = sliding(np.minimum, grams, span)
        least[self.left[: len(least)] < self.window] = 0
        around = np.zeros(len(least) + 2 * (span - 1), np.uint64)
        around[span - 1 : span - 1 + len(least)] = least
        top = sliding(np.maximum, around, span)[:n] if len(least) else np.zeros(n, np.uint64)
        at = np.flatnonzero((top == grams[: len(top)]) & (self.left[: len(top)] >= self.base))
        return at, grams[at]

    def extended(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The doubled windows from and up to each anchor: which fit, and both hashes one after the other."""
        back = self.double - self.base
        right, left = self.left[at] >= self.double, self.seen[at] >= back
        return right, left, np.concatenate([self.by.at(at[right], self.double), self.by.at(at[left] - back, self.double)])

    def candidates(self, at: np.ndarray, right: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Starts of full windows with an anchor whose extension inside them repeats."""
        rights, lefts = np.zeros(self.n + 1, np.int64), np.zeros(self.n + 1, np.int64)
        near, far = self.window - self.double, self.window - self.base
        for p, marks, lo, hi in ((at[right], rights, 0, near), (at[left], lefts, near + 1, far)):
            # the window starts hi..lo words before the anchor
            np.add.at(marks, np.maximum(p - hi, 0), 1)
            np.add.at(marks, np.maximum(p - lo + 1, 0), -1)
        inside = (np.cumsum(rights)[: self.n] > 0) | (np.cumsum(lefts)[: self.n] > 0)
        return np.flatnonzero(inside & (self.left >= self.window))

    def keys(self, starts: np.ndarray) -> np.ndarray:
        """128-bit hashes of the full windows at starts: of their words, joined by one space."""
        if not len(starts):
            return np.zeros((0, 2), np.uint64)
        # each word and a space, one after the other
        lengths = self.words.ends - self.words.starts + 1
        ends = np.cumsum(lengths)
        at = np.repeat(self.words.starts - (ends - lengths), lengths) + np.arange(ends[-1])
        data = np.append(self.texts.data, np.uint8(0x20))[np.minimum(at, len(self.texts.data))]
        data[ends - 1] = 0x20
        joined, digest = memoryview(data.tobytes()), xxhash.xxh3_128_digest
        first, last = (ends - lengths)[starts], ends[starts + self.window - 1] - 1
        return np.frombuffer(b"".join([digest(joined[a:z]) for a, z in zip(first.tolist(), last.tolist(), strict=True)]), np.uint64).reshape(-1, 2)


def _join(parts: list[np.ndarray], empty: tuple[int, ...] = (0,)) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(empty, np.uint64)


def _cut(flags: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(flags, np.cumsum(sizes)[:-1]) if sizes else []


class _Unit:
    """All blocks of a unit; what a level sends is made again from the levels before, so nothing else needs to be kept."""

    def __init__(self, batches: list[pa.RecordBatch], column: str, window: int):
        self.blocks = [_Block(t, window) for t in text_blocks(batches, column)]
        self.anchored = [b.anchors() for b in self.blocks]

    def first(self) -> Sent:
        # least hashes all begin with zeros; mixed again they are spread over the ranges
        return Sent(mix(_join([h for _, h in self.anchored])))

    def second(self, flags: np.ndarray) -> Sent:
        self.kept = [at[f] for (at, _), f in zip(self.anchored, _cut(flags, [len(h) for _, h in self.anchored]), strict=True)]
        self.doubled = [b.extended(at) for b, at in zip(self.blocks, self.kept, strict=True)]
        return Sent(_join([h for _, _, h in self.doubled]))

    def third(self, flags: np.ndarray) -> Sent:
        self.starts = []
        for b, at, (right, left, _), f in zip(self.blocks, self.kept, self.doubled, _cut(flags, [len(h) for _, _, h in self.doubled]), strict=True):
            ok_right, ok_left = right.copy(), left.copy()
            ok_right[right], ok_left[left] = f[: right.sum()], f[right.sum() :]
            self.starts.append(b.candidates(at, ok_right, ok_left))
        return Sent(_join([b.keys(s) for b, s in zip(self.blocks, self.starts, strict=True)], (0, 2)))

    def covered(self, flags: np.ndarray):
        for b, s, f in zip(self.blocks, self.starts, _cut(flags, [len(s) for s in self.starts]), strict=True):
            marks = np.zeros(b.n + 1, np.int64)
            marks[s[f]] += 1
            marks[s[f] + b.window] -= 1
            yield b, np.cumsum(marks)[: b.n] > 0


def removed_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """For each row: doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    packed = units(docs)
    # anchors come 2 in (window - base + 2) words of about six bytes, doubled windows and candidates no oftener than one a word
    n = ranges_for(packed, 1 / 40)
    wide = 4 * n

    def unit(batches):
        return _Unit(batches, "text", window)

    one = answer(send(packed, lambda b: unit(b).first(), n), 1, more_than_once)
    one = checkpointed(one.select("unit", F.lit(0).alias("level"), "part", "flags"))

    def second(key, batches, found):
        u = unit(batches)
        yield message_of(key, u.second(flags_of(u.first(), found[0], n)), n)

    two = answer(with_answers(packed, one, second, SENT), 1, more_than_once)
    two = checkpointed(one.unionByName(two.select("unit", F.lit(1).alias("level"), "part", "flags")))

    def third(key, batches, found):
        u = unit(batches)
        doubled = u.second(flags_of(u.first(), found[0], n))
        yield message_of(key, u.third(flags_of(doubled, found[1], n)), wide)

    three = answer(with_answers(packed, two, third, SENT, 2), 2, more_than_once)
    three = two.unionByName(three.select("unit", F.lit(2).alias("level"), "part", "flags"))

    def last(_key, batches, found):
        u = unit(batches)
        doubled = u.second(flags_of(u.first(), found[0], n))
        full = u.third(flags_of(doubled, found[1], n))
        for b, gone in u.covered(flags_of(full, found[2], wide)):
            total, removed, kept = b.words.counts, [], []
            sums = np.concatenate([[0], np.cumsum(gone)])
            for d in range(len(b.texts)):
                lo, hi = b.words.first[d], b.words.first[d + 1]
                removed.append(int(sums[hi] - sums[lo]))
                words = bytes(b.texts.data[b.texts.offsets[d] : b.texts.offsets[d + 1]]).split()
                kept.append(b" ".join(w for w, g in zip(words, gone[lo:hi].tolist(), strict=True) if not g) if removed[-1] else b" ".join(words))
            yield pa.RecordBatch.from_pydict({"doc_id": b.texts.batch["doc_id"], "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array([k.decode() for k in kept], pa.string())})

    return with_answers(packed, three, last, "doc_id long, n_words long, n_removed long, kept string", 3)


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns."""
    return result.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))



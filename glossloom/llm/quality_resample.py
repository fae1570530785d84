"""Quality classifier by importance resampling.

Two generative models over hashed n-grams are counted in one scan: the raw one
over all documents, the target one over those that a sample of labels marks as
good and not toxic. The sample has at most `label_rows` rows, taken by hash of
the id. N-grams are tokens - words, lower-cased, or runs of punctuation -, pairs
of tokens, the first bytes of longer tokens, for words that are only ever
inflected, and eight equal tokens in a row, which are all one n-gram. Models
count documents that hold an n-gram, in two tables of 2^18 buckets with
independent hashes, so that an n-gram shares both of its buckets with hardly
any other.

A bucket's value is the log ratio of target to raw, smoothed by one document on
either side and drawn towards 0 by two of its standard errors: what is seen
little says little. An n-gram takes the smaller value, whichever its sign, of
its two buckets. A document is as likely under the target as its least likely
passage: its log weight is the least sum of the values of the n-grams that
begin in eight successive tokens, passages beginning at every fourth token, and
0 at most. Over whole documents the values' sum would do little but measure
length, and a few words that the target shuns would be outweighed.

Documents are then drawn without replacement by Gumbel top-k: log weight times
`sharpness`, an inverse temperature, plus Gumbel noise, the k largest. At 1 the
draw is in proportion to the weights; the default lets hardly a rejected
document in by luck. Unless k is given, it is the number of good documents as
estimated from the labels: their share in the sample, with a cut of the weights
as control variate. The cut is the one that tells the labels apart best; what
it finds in all documents, plus the difference of the sample's good share and
what it finds there, has a far smaller error than the share alone. k is not
less than what the cut finds: where labels are too few to tell bad documents
from others, these are kept rather than as many good ones drawn out.

The noise comes from a hash of id and text, so runs and retries agree. The k-th
key is found by radix selection, 16 bits a pass, over a small table in the
shared folder: nothing is sorted or gathered as a whole. Only the buckets that
have a value are broadcast, at most 2^19. Counts are added up in two steps, so
that no task reads from all others.

Results: each row gives one row. A null or empty text has no n-grams and weight
0. Equal rows have equal keys; where the k-th key is shared, all that share it
are kept. Labels with nulls count as not good; a document with several labels
is good if all say so. Without good labels every weight is 0 and, unless k says
otherwise, all is kept. Other columns, whatever their names, pass `kept`
unchanged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossloom.llm.common import LOWER, Words, byte_class, checkpointed, find_words, mix, text_blocks, word_hashes

TABLES = 2
BUCKET_BITS = 18
LABEL_ROWS = 50_000
SHARPNESS = 16.0
#: Documents added to each count, and standard errors taken from each ratio.
SMOOTHING, ERRORS = 1.0, 2.0
#: Tokens of a passage.
PASSAGE = 8
SEED = 42

#: Bytes of a longer token that are an n-gram too, and how many equal tokens in a row are one.
BEGINNING, REPEATS = 4, 8

_SIZE = 1 << BUCKET_BITS
_CHUNK = 4096
#: Tasks whose counts are added up first.
_GROUP = 64
#: Weights are told apart by so much when the cut is looked for, down to so many steps below 0.
_STEP, _STEPS = 0.05, 2000
_WORD = byte_class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_MARK = ~_WORD & ~byte_class([*range(0x21), 0x7F])


def _tokens(texts) -> tuple[np.ndarray, np.ndarray, Words]:
    """Hashes and places of words and runs of punctuation, in order, and hashes of the tokens' first bytes."""
    data = LOWER[texts.data]
    parts = [find_words(data, texts.offsets, table) for table in (_WORD, _MARK)]
    starts = np.concatenate([p.starts for p in parts])
    order = np.argsort(starts, kind="stable")
    starts = starts[order]
    words = Words(starts, np.concatenate([p.ends for p in parts])[order], np.searchsorted(starts, texts.offsets))
    begins = word_hashes(data, words._replace(ends=np.minimum(words.ends, words.starts + BEGINNING)))
    return word_hashes(data, words), begins, words


def grams(texts) -> tuple[np.ndarray, np.ndarray, Words]:
    """The n-grams of a block: the token where each begins, its buckets in both tables as one number, and the tokens."""
    h, begins, words = _tokens(texts)
    doc = np.repeat(np.arange(len(texts)), words.counts)
    pair = np.flatnonzero(doc[:-1] == doc[1:])
    n = max(0, len(h) - REPEATS + 1)
    same = doc[:n] == doc[len(doc) - n :]
    for k in range(1, REPEATS):
        same &= h[:n] == h[k : n + k]
    same = np.flatnonzero(same)
    long = np.flatnonzero(words.ends - words.starts > BEGINNING)
    pairs = mix(h[pair] * np.uint64(3) + mix(h[pair + 1] + np.uint64(7))) if len(pair) else h[:0]
    every = np.concatenate([h, pairs, mix(begins[long] + np.uint64(1)), np.full(len(same), 1, np.uint64)])
    # the leading bits are the first table's bucket, the next ones the second's
    return np.concatenate([np.arange(len(h)), pair, long, same]), every >> np.uint64(64 - 2 * BUCKET_BITS), words


def _buckets(both: np.ndarray) -> np.ndarray:
    low = (both & np.uint64((1 << 2 * BUCKET_BITS) - 1)).astype(np.int64)
    return np.stack([low >> BUCKET_BITS, low & _SIZE - 1])


def _labelled(labels: DataFrame, id_col: str, quality_col: str, toxic_col: str, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the label sample, sorted, and which are good."""
    own = labels.select(F.col(id_col).cast("long").alias("id"), (F.coalesce(F.col(quality_col), F.lit(0)) >= 1).alias("fine"), (F.coalesce(F.col(toxic_col), F.lit(1)) >= 1).alias("toxic")).where("id IS NOT NULL")
    own = own.groupBy("id").agg((F.min("fine") & ~F.max("toxic")).alias("good"))
    picked = sorted(map(tuple, own.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(rows).collect()))
    return np.array([i for i, _ in picked], np.int64), np.array([g for _, g in picked], bool)


_COUNTS = ("every", "good")
_CHUNKS = TABLES * _SIZE // _CHUNK


def _counts(docs: DataFrame, ids: np.ndarray, good: np.ndarray) -> DataFrame:
    """Documents by bucket - all and good ones - as chunks of buckets; the last chunk's first entry is over all documents."""
    ids = ids[good]

    def count(batches):
        total, any_ = np.zeros((2, (_CHUNKS + 1) * _CHUNK), np.int64), False
        for t in text_blocks(batches, "text"):
            any_ = True
            at, both, words = grams(t)
            doc = np.repeat(np.arange(len(t), dtype=np.uint64), words.counts)[at]
            met = np.unique(doc << np.uint64(2 * BUCKET_BITS) | both)
            doc, buckets = (met >> np.uint64(2 * BUCKET_BITS)).astype(np.int64), _buckets(met)
            own = t.batch["id"].fill_null(-1).to_numpy()
            fine = np.isin(own, ids) & t.batch["id"].is_valid().to_numpy(zero_copy_only=False)
            for i, mark in enumerate((np.ones(len(own), bool), fine)):
                chosen = mark[doc]
                for table in range(TABLES):
                    total[i, table * _SIZE : (table + 1) * _SIZE] += np.bincount(buckets[table][chosen], minlength=_SIZE)
                total[i, _CHUNKS * _CHUNK] += mark.sum()
        if any_:
            yield _chunks(range(_CHUNKS + 1), total.reshape(2, -1, _CHUNK), TaskContext.get().partitionId() // _GROUP)

    def add(batches):
        for chunk, total in _sums(batches):
            yield _chunks([chunk], total[:, None], 0)

    schema = "chunk int, part int, " + ", ".join(f"{c} binary" for c in _COUNTS)
    some = docs.mapInArrow(count, schema).repartition("chunk", "part").sortWithinPartitions("chunk", "part").mapInArrow(add, schema)
    return some.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(add, schema).drop("part")


def _chunks(names, total: np.ndarray, part: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"chunk": pa.array(list(names), pa.int32()), "part": pa.array([part] * len(names), pa.int32()), **{c: pa.array([x.tobytes() for x in total[i]], pa.binary()) for i, c in enumerate(_COUNTS)}})


def _sums(batches):
    """Chunks of one part added up as they stream in."""
    now, total = None, None
    for batch in batches:
        for chunk, part, *counts in zip(*(batch[c].to_pylist() for c in ("chunk", "part", *_COUNTS)), strict=True):
            if (chunk, part) != now:
                if total is not None:
                    yield now[0], total
                now, total = (chunk, part), np.zeros((2, _CHUNK), np.int64)
            total += np.array([np.frombuffer(c, np.int64) for c in counts])
    if total is not None:
        yield now[0], total


def log_ratios(every: np.ndarray, good: np.ndarray, usual: float) -> np.ndarray:
    """Log ratio of target to raw of each bucket, less what may be chance. usual: target documents to raw ones."""
    seen, due = good + SMOOTHING, every * usual + SMOOTHING
    ratio = np.log(seen / due)
    return np.sign(ratio) * np.maximum(0, np.abs(ratio) - ERRORS * np.sqrt(1 / seen + 1 / due))


class Classifier:
    """A fitted ratio; scores documents wherever it is sent."""

    def __init__(self, ratios: np.ndarray, ids: np.ndarray, good: np.ndarray):
        self.places = [np.flatnonzero(r) for r in ratios]
        self.values = [r[p] for r, p in zip(ratios, self.places, strict=True)]
        self.ids, self.good = ids, good
        self.tables = None

    def __getstate__(self):
        return self.__dict__ | {"tables": None, "ids": None, "good": None}

    def weights(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Log weight and number of n-grams of each text of a block."""
        if self.tables is None:
            self.tables = np.zeros((TABLES, _SIZE))
            for table, p, v in zip(self.tables, self.places, self.values, strict=True):
                table[p] = v
        at, both, words = grams(texts)
        one, other = (t[b] for t, b in zip(self.tables, _buckets(both), strict=True))
        # added up in steps of 2^-20, so that the order never shows
        value = np.round(np.where(np.abs(one) < np.abs(other), one, other) * (1 << 20))
        tokens = np.bincount(at, value, len(words.starts))
        doc = np.repeat(np.arange(len(texts)), words.counts)
        place = np.arange(len(doc)) - words.first[doc]
        least = np.zeros(len(texts))
        for offset in (0, PASSAGE // 2):
            begins = np.flatnonzero((place == 0) | ((place + offset) % PASSAGE == 0))
            if len(begins):
                np.minimum.at(least, doc[begins], np.add.reduceat(tokens, begins))
        return least / (1 << 20), np.bincount(doc[at], minlength=len(texts))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", quality_col: str = "quality", toxic_col: str = "toxic", label_rows: int = LABEL_ROWS) -> Classifier:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ids, good = _labelled(labels, label_id_col, quality_col, toxic_col, label_rows)
    total = np.zeros((2, _CHUNKS + 1, _CHUNK), np.int64)
    for chunk, *counts in _counts(rows, ids, good).toLocalIterator():
        total[:, chunk] = [np.frombuffer(c, np.int64) for c in counts]
    n, n_good = total[:, -1, 0].tolist()
    every, fine = total[:, :-1].reshape(2, TABLES, _SIZE)
    ratios = [log_ratios(e, f, n_good / n) if n_good else np.zeros(_SIZE) for e, f in zip(every, fine, strict=True)]
    return Classifier(np.array(ratios), ids, good)


def _noise(id_col: str, text_col: str):
    """Gumbel noise from a hash of the row."""
    u = (F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.lit(SEED)), 11) + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def _with_weights(docs: DataFrame, model: Classifier, id_col: str, text_col: str, sharpness: float) -> tuple[DataFrame, list[str]]:
    """docs with three more columns - n-grams, log weight and key -, kept in the shared folder, and their names."""
    sent, names = docs.sparkSession.sparkContext.broadcast(model), []
    taken = {c.lower() for c in docs.columns}
    for name in ("n_grams", "log_weight", "gumbel_key"):
        while name in taken:
            name += "_"
        names.append(name)

    def run(batches):
        for t in text_blocks(batches, text_col):
            w, n = sent.value.weights(t)
            yield t.batch.append_column(names[0], pa.array(n, pa.int64())).append_column(names[1], pa.array(w))

    schema = type(docs.schema)(list(docs.schema.fields)).add(names[0], "long").add(names[1], "double")
    out = docs.mapInArrow(run, schema).withColumn(names[2], F.lit(sharpness) * F.col(names[1]) + _noise(id_col, text_col))
    return checkpointed(out), names


def good_documents(scored: DataFrame, model: Classifier, id_col: str, weight_col: str) -> int:
    """How many documents are good, as the labels let one estimate."""
    step = F.greatest(F.lit(-_STEPS), F.floor(F.col(weight_col) / _STEP)).cast("int")
    table = scored.sparkSession.createDataFrame(pa.table({"__id": pa.array(model.ids), "__good": pa.array(model.good)}))
    own = scored.select(F.col(id_col).cast("long").alias("__id"), step.alias("step")).join(F.broadcast(table), "__id", "left")
    counts = np.zeros((3, _STEPS + 1), np.int64)
    for at, good, n in own.groupBy("step", "__good").count().collect():
        counts[0, at + _STEPS] += n
        if good is not None:
            counts[1 if good else 2, at + _STEPS] += n
    every, good, bad = counts
    if not good.sum():
        return int(every.sum())
    # of each cut: good ones above and bad ones below; the lowest of the best
    above = np.cumsum(good[::-1])[::-1]
    cut = int(np.argmax(above + np.cumsum(bad) - bad))
    found = (above[cut] + bad[cut:].sum()) / (good.sum() + bad.sum())
    share = good.sum() / (good.sum() + bad.sum())
    return int(round(every[cut:].sum() + max(0.0, share - found) * every.sum()))


def cutoff(scored: DataFrame, k: int) -> float:
    """The k-th largest key: -inf if there are no more than k, inf if k is 0."""
    if k <= 0:
        return math.inf

    def order(batches):
        for b in batches:
            # a double's bits as an unsigned number in the same order
            bits = (b["key"].to_numpy() + 0.0).view(np.int64)
            up = np.where(bits < 0, ~bits, bits ^ np.int64(-(1 << 63))).view(np.uint64)
            yield pa.RecordBatch.from_pydict({f"d{i}": pa.array((up >> np.uint64(48 - 16 * i) & np.uint64(0xFFFF)).astype(np.int32)) for i in range(4)})

    digits = scored.select(F.col("gumbel_key").alias("key")).mapInArrow(order, "d0 int, d1 int, d2 int, d3 int")
    found, left = 0, k
    for i in range(4):
        for digit, n in sorted(((r[0], r[1]) for r in digits.groupBy(f"d{i}").count().collect()), reverse=True):
            if n >= left:
                break
            left -= n
        else:
            return -math.inf
        found = found << 16 | digit
        digits = digits.where(F.col(f"d{i}") == digit)
    up = np.array([found], np.uint64)
    bits = np.where(up >> np.uint64(63), up ^ np.uint64(1 << 63), ~up)
    return float(bits.view(np.float64)[0])


def _drawn(docs: DataFrame, labels: DataFrame, k: int | None, sharpness: float, id_col: str, text_col: str, fitting: dict) -> tuple[DataFrame, list[str], float]:
    """docs with weights and keys, the names of those columns, and the least key that is drawn."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **fitting)
    scored, names = _with_weights(docs, model, id_col, text_col, sharpness)
    if k is None:
        k = good_documents(scored, model, id_col, names[1])
    return scored, names, cutoff(scored.select(F.col(names[2]).alias("gumbel_key")), k)


def resample(docs: DataFrame, labels: DataFrame, *, k: int | None = None, sharpness: float = SHARPNESS, id_col: str = "doc_id", text_col: str = "text", **fitting) -> DataFrame:
    """For each row: doc_id, n_grams, log_weight, gumbel_key, kept."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored, _, least = _drawn(rows, labels, k, sharpness, "doc_id", "text", fitting)
    return scored.select("doc_id", "n_grams", "log_weight", "gumbel_key", (F.col("gumbel_key") >= least).alias("kept"))


def kept(docs: DataFrame, labels: DataFrame, *, k: int | None = None, sharpness: float = SHARPNESS, id_col: str = "doc_id", text_col: str = "text", **fitting) -> DataFrame:
    """The rows of docs that are drawn, all columns as they are."""
    scored, names, least = _drawn(docs, labels, k, sharpness, id_col, text_col, fitting)
    return scored.where(F.col(names[2]) >= least).drop(*names)

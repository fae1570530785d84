"""Substring dedup, line dedup, decontamination and near-dedup against brute force."""

import collections
import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from glossloom.llm import common, decontaminate, line_dedup, simhash_dedup, substring_dedup, units
from tests.llm.data import documents, frame, plain

SPACE = " \t\n\x0b\f\r"


def words(text):
    return [w for w in re.split(f"[{SPACE}]+", text or "") if w]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows(df):
    return collections.Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("window", [35, 8, 3])
def test_substring_dedup(spark, window):
    docs = documents()
    seen = collections.Counter(tuple(w[i : i + window]) for _, t in docs for w in [words(t)] for i in range(len(w) - window + 1))
    want = collections.Counter()
    for i, t in docs:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        want[i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    got = substring_dedup.digest(substring_dedup.removed_spans(frame(spark, docs), window=window))
    assert rows(got) == want


def test_substring_dedup_of_words_that_prefix_sums_confuse(spark):
    """Two words of 1,024 bytes for which any polynomial modulo 2^64 with an odd base is the same."""
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    rest = [f"w{k}" for k in range(34)]
    docs = [(1, " ".join([one, *rest])), (2, " ".join([one.translate(str.maketrans("ab", "ba")), *rest])), (3, " ".join(["c", one, *rest[:20]]))]
    assert [r.n_removed for r in substring_dedup.removed_spans(plain(spark, docs)).orderBy("doc_id").collect()] == [0, 0, 0]


def test_substring_dedup_over_units(spark, monkeypatch):
    monkeypatch.setattr(units, "UNIT_BYTES", 2000)
    monkeypatch.setattr(units, "RANGE_HASHES", 50)
    test_substring_dedup(spark, 35)


@pytest.mark.parametrize("min_docs", [10, 2])
def test_line_dedup(spark, min_docs):
    docs = documents()
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(SPACE))
    seen = collections.Counter(k for _, t in docs for k in {key(x) for x in (t or "").split("\n")} if k)
    want = collections.Counter()
    for i, t in docs:
        own = (t or "").split("\n")
        kept = [x for x in own if not (key(x) and seen[key(x)] >= min_docs)]
        want[i, len(own), len(own) - len(kept), sha("\n".join(kept))] += 1
    assert rows(line_dedup.digest(line_dedup.counted(frame(spark, docs).withColumnsRenamed({"fp": "__n_lines", "part": "n_dropped"}), min_docs=min_docs))) == want


def test_line_dedup_keeps_columns(spark):
    docs = frame(spark, documents())
    out = line_dedup.drop_lines(docs)
    assert out.schema == docs.schema
    assert rows(out.drop("text")) == rows(docs.drop("text"))


def test_line_index_is_reversible(spark):
    docs = documents()
    first, second = plain(spark, docs[:45]), plain(spark, docs[45:])
    a, b = units.units(first), units.units(second)
    index = line_dedup.LineIndex(spark, 8, 3)
    sent_a, sent_b = index.keys_of(a), index.keys_of(b)
    content = lambda i: {r["part"]: (bytes(r["keys"]), bytes(r["refs"]), sorted(np.frombuffer(r["filter"], np.uint16).tolist())) for r in i.table.collect() if r["keys"]}
    one = index.insert(sent_a)
    both = one.insert(sent_b)
    assert content(both) == content(index.insert(sent_a.unionByName(sent_b)))
    assert content(both.delete(sent_b)) == content(one)
    with pytest.raises(Exception, match="had not been inserted"):
        one.delete(sent_b).table.count()


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, (5000, 2)).astype(np.uint64)
    table = line_dedup.CuckooFilter.of(keys[:4000])
    assert table.may_hold(keys[:4000]).all()
    assert table.may_hold(keys[4000:]).mean() < 0.01
    for print_, bucket in zip(*table._at(keys[:2000]), strict=True):
        table.delete(print_, bucket)
    assert table.may_hold(keys[2000:4000]).all()
    assert table.may_hold(keys[:2000]).mean() < 0.01
    assert keys[3000] in table


def _low_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("limit", [500_000, 7])
def test_contamination(spark, limit):
    docs = documents()
    items = [(1, " ".join(words(docs[40][1])[35:60])), (12, "SAME-word, same"), (2, docs[50][1]), (3, None), (4, ""), (5, "--"), (None, "null ID text"), (12, "theta of nothing"), (7, docs[50][1])]
    n = 10
    want = collections.Counter()
    windows = {(tuple(w[i : i + min(n, len(w))]), "" if k is None else str(k)) for k, t in items for w in [_low_words(t)] if w for i in range(len(w) - min(n, len(w)) + 1)}
    by = collections.defaultdict(set)
    for w, k in windows:
        by[w].add(k)
    sizes = {len(w) for w in by}
    for i, t in docs:
        w = _low_words(t)
        hit, found = set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if ids := by.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    found |= ids
        want[i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)] += 1
    found = decontaminate.contamination(frame(spark, docs), plain(spark, items, "item_id long, text string"), limit=limit)
    assert rows(decontaminate.digest(found)) == want
    dirty = collections.Counter(k[0] for k in want.elements() if k[-1])
    left = decontaminate.clean_documents(frame(spark, docs), plain(spark, items, "item_id long, text string"), limit=limit)
    assert collections.Counter(r.doc_id for r in left.collect()) == collections.Counter(i for i, _ in docs) - dirty
    for r in found.collect():
        assert sum(h.last - h.first + 1 for h in r.hits) == r.n_hit


def test_clean_documents_cuts_spans(spark):
    docs = [(1, "keep THIS, one two three four - keep that"), (2, "nothing"), (3, None)]
    out = decontaminate.clean_documents(frame(spark, docs), plain(spark, [(1, "one two three four")], "item_id long, text string"), spans=True)
    assert {r.doc_id: r.text for r in out.collect()} == {1: "keep THIS,  - keep that", 2: "nothing", 3: None}
    none = decontaminate.clean_documents(frame(spark, docs), plain(spark, [], "item_id long, text string"))
    assert none.count() == 3


def _simhash(text, k=3):
    w = (text or "").encode().lower().split()
    n = min(k, len(w))
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(len(w) - n + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates(spark):
    docs = documents()
    prints = [_simhash(t) for _, t in docs]
    group = list(range(len(docs)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            group[find(b)] = find(a)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    want = collections.Counter((i, f"{f:016x}", least.get(find(k))) for k, ((i, _), f) in enumerate(zip(docs, prints, strict=True)))
    assert rows(simhash_dedup.digest(simhash_dedup.near_duplicates(frame(spark, docs)))) == want


def test_near_duplicates_of_close_fingerprints(spark):
    """Chains of one or two bits, in any place, with a crowd that fills cells."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 300)
    fp = list(base)
    for x in base[:100]:
        for _ in range(rng.integers(1, 4)):
            x = int(x) ^ (1 << int(rng.integers(0, 63))) ^ (1 << int(rng.integers(0, 63)))
            fp.append(x)
    fp += [int(base[0]) ^ m for m in range(1, 1 << 7)]
    fp = [int(x) for x in dict.fromkeys(map(int, fp))]
    got = {r.doc_id: r.component_id for r in simhash_dedup.linked(plain(spark, list(enumerate(fp)), "doc_id long, fp long")).collect()}
    a = np.array(fp, np.uint64)
    near = np.argwhere(np.bitwise_count(a[:, None] ^ a[None]) <= 2)
    label = simhash_dedup._labels(len(a), near[:, 0], near[:, 1])
    assert got == dict(enumerate(label.tolist()))


def test_large_cells_find_the_same_links(monkeypatch):
    rng = np.random.default_rng(4)
    a = np.unique(rng.integers(0, 1 << 14, 700).astype(np.uint64))
    few = simhash_dedup._cell_links(a, 2)
    monkeypatch.setattr(simhash_dedup, "LARGE_CELL", 10)
    many = simhash_dedup._cell_links(a, 2)
    pairs = lambda x: {tuple(sorted(p)) for p in zip(*map(list, x), strict=True)}
    assert pairs(few) == pairs(many)
    wide = simhash_dedup._wide_links(a[:, None], 2, None)
    assert (simhash_dedup._labels(len(a), *few) == simhash_dedup._labels(len(a), *wide)).all()


def test_one_of_each(spark):
    docs = documents()
    kept = simhash_dedup.one_of_each(frame(spark, docs))
    assert kept.schema == frame(spark, docs).schema
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None and i < 100) == list(range(40))  # clean ones stay
    assert ids.count(300) == 1 and not {301, 302, 303, 304, 400, 401} & set(ids)
    assert 500 in ids and not {501, 502, 503} & set(ids)  # texts without words are one group
    assert {600, 601, 700, 701, 702} <= set(ids)


def _like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def _groups_by_hand(texts):
    """Of each text, the first text that it hangs together with by Jaccard similarities of 0.8 or more."""
    sets = []
    for text in texts:
        w = text.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    to = list(range(len(sets)))

    def root(i):
        while to[i] != i:
            i = to[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        if _like(sets[i], sets[j]) >= 0.8:
            to[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(sets))]


@pytest.mark.parametrize("block", [1 << 16, 400])
def test_one_of_each_drops_at_similarity_only(spark, monkeypatch, block):
    monkeypatch.setattr(simhash_dedup, "BLOCK_SHINGLES", block)
    rng = np.random.default_rng(8)
    texts = []
    for changes in (1, 2, 3, 4, 4, 5, 6, 8) * 3:
        base = [f"w{x}" for x in rng.integers(0, 5000, 150)]
        for _ in range(5):
            edited = list(base)
            for at in rng.choice(29, changes, replace=False):
                edited[at * 5 + 3] = f"v{rng.integers(0, 5000)}"
            texts.append(" ".join(edited))
    chain = [f"w{x}" for x in rng.integers(0, 5000, 150)]
    for k in range(0, 60, 3):  # each is like the next, not like those after
        texts.append(" ".join(["v"] * k + chain[k:]) + f" {k}")
    kept = {r.doc_id for r in simhash_dedup.one_of_each(plain(spark, list(enumerate(texts)))).collect()}
    by_hand = set(_groups_by_hand(texts))
    assert 60 < len(by_hand) < len(texts) - 20
    assert kept == by_hand


@pytest.mark.parametrize(("n", "more"), [(4, 1), (5, 1), (6, 1), (7, 1), (8, 1), (8, 2)])
def test_one_of_each_finds_short_near_copies(spark, n, more):
    texts = []
    for k in range(12):
        w = [f"w{k}x{i}" for i in range(n + 4 + more)]
        texts += [" ".join(w), " ".join(w[:-more] if k % 2 else w[more:])]
        # one word less at each end: no copies below nine shingles
        texts.append(" ".join(w[: n + 3]) + " other")
    kept = {r.doc_id for r in simhash_dedup.one_of_each(plain(spark, list(enumerate(texts)))).collect()}
    assert kept == set(_groups_by_hand(texts)) and not {3 * k + 1 for k in range(12)} & kept


def test_manhattan_distance_of_embeddings():
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 1 << 63, (2, 500)).astype(np.uint64)
    counts = lambda x: np.stack([(x >> np.uint64(2 * s) & np.uint64(1)) + (x >> np.uint64(2 * s + 1) & np.uint64(1)) for s in range(32)], 1).astype(int)
    manhattan = np.abs(counts(a) - counts(b)).sum(1)
    assert (np.bitwise_count(simhash_dedup._embedded(a) ^ simhash_dedup._embedded(b)) == manhattan).all()
    assert (manhattan <= np.bitwise_count(a ^ b)).all()


def test_cells_over_batches():
    """A cell's rows may be spread over any batches."""
    rng = np.random.default_rng(6)
    cell = np.sort(rng.integers(0, 40, 1500))
    cell[600:1000] = cell[600]
    fp = rng.integers(0, 1 << 10, 1500).astype(np.int64)

    def links(sizes):
        at = np.cumsum([0, *sizes])
        batches = [pa.RecordBatch.from_pydict({"choice": pa.array(np.zeros(b - a, np.int32)), "cell": pa.array(cell[a:b]), "fp": pa.array(fp[a:b]), "node": pa.array(np.arange(a, b))}) for a, b in zip(at[:-1], at[1:], strict=True)]
        found = [x for b in simhash_dedup._links(batches, 2) for x in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True)]
        a, b = np.array(found).T
        return simhash_dedup._labels(1500, a, b).tolist()

    whole = links([1500])
    assert whole == links([1] * 1500) == links([100] * 15) == links([0, 7, 600, 0, 50, 50, 793])


def test_large_wide_cells():
    """Grids within a cell find the near copies that comparing all with all finds."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, (3000, 4)).astype(np.uint64)
    near = base.copy()
    for row in near:
        for bit in rng.choice(256, 38, replace=False):  # what texts of similarity 0.8 differ by
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    i, j = simhash_dedup._wide_links(np.concatenate([base, near]), 52)
    met = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    assert len({(k, k + 3000) for k in range(3000)} & met) > 0.95 * 3000
    assert not {(a, b) for a, b in met if b - a != 3000}


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (5, 6), (6, 5), (7, 7), (None, 4), *((k, k + 1) for k in range(100, 160)), *((1000, k) for k in range(1001, 1100))]
    got = {r.node: r.component for r in common.components(plain(spark, edges, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 9: 1, 6: 5, **{k: 100 for k in range(101, 161)}, **{k: 1000 for k in range(1001, 1100)}}


def test_empty_tables(spark):
    none = frame(spark, [])
    items = plain(spark, [], "item_id long, text string")
    assert substring_dedup.removed_spans(none).count() == 0
    assert line_dedup.drop_lines(none).count() == 0
    assert simhash_dedup.near_duplicates(none).count() == 0
    assert simhash_dedup.one_of_each(none).count() == 0
    assert decontaminate.contamination(none, items).count() == 0

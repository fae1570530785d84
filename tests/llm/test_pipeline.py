"""Each stage of the pipeline against brute force on its own input."""

import base64
import collections
import hashlib
import os
import random
import re

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from glossloom.llm import queries
from tests.llm.data import documents, prose

SPACE = " \t\n\x0b\f\r"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(11)
    passage = prose(rng, 30)
    docs = [r for r in documents() if r[0] is None or r[0] < 700]
    docs += [(2000 + i, prose(rng, rng.randint(20, 90)) + (" %%% ### %%%" if i % 4 == 0 else " scum" if i % 9 == 0 else "")) for i in range(300)]
    docs += [(3000 + i, f"{prose(rng, 15)} {passage.upper()} {prose(rng, 15)}") for i in range(5)]
    rows = [(i, t, "en", "s", len(t or ""), k) for k, (i, t) in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __node int").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(2000 + i, int(i % 4 > 0), int(i % 9 == 0)) for i in range(0, 300)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Rows before the first stage and after each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [(docs.columns, docs.collect())]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        path = f"{sf_dir}/{name.replace(' ', '_')}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((docs.columns, docs.collect()))
    return out


def test_columns_stay(stages):
    assert all(sorted(c) == sorted(stages[0][0]) for c, _ in stages[:-1])


def test_quality(stages):
    before, after = ({r["__node"]: r for r in rows} for _, rows in stages[:2])
    bad = {k for k, r in before.items() if re.search("scum|%%%", r.text or "")}
    gone = before.keys() - after.keys()
    assert gone == bad
    assert all(after[k] == before[k] for k in after)


def test_lines(stages):
    before, after = ({r["__node"]: r for r in rows} for _, rows in stages[1:3])
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(SPACE))
    seen = collections.Counter(k for r in before.values() for k in {key(x) for x in (r.text or "").split("\n")} if k)
    assert before.keys() == after.keys()
    for k, r in before.items():
        kept = "\n".join(x for x in (r.text or "").split("\n") if not (key(x) and seen[key(x)] >= 10))
        assert (after[k].text or "") == kept and after[k].n_chars == (r.n_chars if r.text is None else len(kept))
    assert any(after[k].text != before[k].text for k in after)


def _shingles(text):
    w = (text or "").encode().lower().split()
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def test_near_copies(stages):
    before, after = ({r["__node"]: r for r in rows} for _, rows in stages[2:4])
    sets = {k: _shingles(r.text) for k, r in before.items()}
    like = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) if sets[a] or sets[b] else 1.0
    left = sorted(after)
    assert not [(a, b) for a in left for b in left if a < b and like(a, b) >= 0.8]
    for k in before.keys() - after.keys():
        assert max(like(k, other) for other in before if other != k) >= 0.5


def test_benchmark(stages, spark, sf_dir):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = words(r.text)
        grams |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    before, after = ({r["__node"]: r for r in rows} for _, rows in stages[3:5])
    dirty = {k for k, r in before.items() for w in [words(r.text)] if any(tuple(w[i : i + 10]) in grams for i in range(len(w) - 9))}
    assert dirty and before.keys() - after.keys() == dirty


def test_tokens(stages):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(corpus_pipeline.RANKS), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter()
    for r in stages[4][1]:
        ids = enc.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), ",".join(map(str, ids)), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, stages[5][1])) == want


def test_run(spark, sf_dir, stages):
    assert collections.Counter(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == collections.Counter(map(tuple, stages[5][1]))


def test_empty_documents(spark, sf_dir, tmp_path):
    d = str(tmp_path)
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0


TESTDATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(TESTDATA), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_have_their_sql_s_rows(spark, name):
    import duckdb

    from glossloom.llm import oracles

    rows = queries.QUERIES[name](spark, TESTDATA)
    names = sorted(rows.columns)
    got = collections.Counter(tuple(r[c] if not isinstance(r[c], list) else tuple(r[c]) for c in names) for r in rows.collect())
    assert got
    if name in oracles.ORACLES:
        db = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "conversations"):
            db.execute(f"CREATE VIEW {t} AS FROM '{TESTDATA}/{t}.parquet'")
        found = db.execute(oracles.ORACLES[name])
        at = [d[0] for d in found.description]
        assert collections.Counter(tuple(r[at.index(c)] for c in names) for r in found.fetchall()) == got

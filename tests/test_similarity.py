import os
import random

import pytest
from pyspark.sql import functions as F

from glossloom.functions import similarity as S
from glossloom.operators import scoring as P
from glossloom.operators.resolve import Evidence, confidence, inherited_confidence, threshold
from glossloom.profiles import HEBREW, LATIN, SHAS, Pass, halacha, passes_for


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    now = [i]
    for j, y in enumerate(b, 1):
        now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
    return now


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        for most in (1, 2):
            assert S.edit_distance(a, b, most) == min(most + 1, levenshtein(a, b))


@pytest.mark.parametrize("a, b, sim", [("אמר", "אמר", 1), ("ואמר", "אמר", 0.92), ("שאמר", "ואמר", 0.92), ("שומר", "שמר", 0.9), ("דיבור", "דבור", 0.9), ("אמר", "אמן", 0), ("גדולים", "גדולות", 0), ("אברהם", "אברהס", 0.8), ("של", "על", 0), ("עשרה", "עשרא", 0.9)])
def test_similarity_ladder(spark, a, b, sim):
    say = S.Words()
    assert say.similarity(a, b) == pytest.approx(sim) == say.similarity(b, a)
    row = spark.range(1).select(S.similarity(F.lit(a), F.lit(b)).alias("x")).first()
    assert row.x == pytest.approx(sim)


@pytest.mark.parametrize("script, letters", [(HEBREW, "אבגדהויכלמןנ"), (LATIN, "aeinrstu")])
def test_columns_and_words_agree(spark, script, letters):
    rng = random.Random(2)
    say = S.Words(script)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(120)]
    pairs = [(a, b) for a in words for b in [rng.choice(words), a[:-1] + "x", "ו" + a, a[1:], a]]
    rows = spark.createDataFrame([(a, b) for a, b in pairs], "a string, b string").select("a", "b", S.similarity(F.col("a"), F.col("b"), script).alias("s"), S.word_weight(F.col("a"), script).alias("w"), S.skeleton(F.col("a"), script).alias("k")).collect()
    for r in rows:
        assert r.s == pytest.approx(say.similarity(r.a, r.b)), (r.a, r.b)
        assert r.w == say.weight(r.a) and r.k == say.skeleton(r.a)


def test_confidence_agrees(spark):
    rng = random.Random(3)
    cases = [(rng.uniform(0, 9), rng.uniform(0.1, 9), rng.randint(0, 12), rng.uniform(0, 12), rng.uniform(0, 9), rng.uniform(0, 9), rng.random() < 0.5, rng.random() < 0.5) for _ in range(200)]
    names = "matched window n sim score rival exact explicit".split()
    rows = spark.createDataFrame(cases, "matched double, window double, n int, sim double, score double, rival double, exact boolean, explicit boolean")
    for r in rows.withColumn("c", P.confidence(*map(F.col, names))).collect():
        assert r.c == confidence(Evidence(r.matched, r.window, r.n, r.sim, r.score, r.rival, r.exact), r.explicit, None, 0, None)
    got = spark.createDataFrame([(0, 1), (90, 1), (90, 3), (None, 2)], "p int, d int").select(P.inherited_confidence(F.col("p"), F.col("d")).alias("c")).collect()
    assert [r.c for r in got] == [inherited_confidence(p, d) for p, d in ((0, 1), (90, 1), (90, 3), (None, 2))] == [56, 72, 46, 45]


def test_threshold(spark):
    spec = Pass()
    assert threshold(1.0, 2, True, 0.65, spec) == pytest.approx(0.55)
    assert threshold(1.0, 3, False, 0.65, spec) == pytest.approx(0.65)
    assert threshold(9.0, 9, True, 0.65, spec) == 1.5
    assert threshold(1.0, 9, True, 0.4, spec) == pytest.approx(0.7)
    assert threshold(1.0, 9, True, 0.65, Pass(min_score=3.6)) == 3.6


def test_pass_table():
    passes = passes_for(halacha())
    assert len(passes) == 13 and [i + 1 for i, p in enumerate(passes) if p.prunes] == [5, 13]
    scores = [p.min_score for p in passes if p.min_score is not None]
    assert scores == sorted(scores, reverse=True)
    assert all(not p.windowed for p in passes[:4]) and all(p.windowed for p in passes[4:])
    assert passes[-1].max_width == 3 and passes[11].start_words == 4
    assert not any(p.fuzzy for p in passes_for(halacha(), fuzzy=False))
    assert len(passes_for(SHAS)) == 1


def _by_hand(words, script):
    own, words = S.Words(script), sorted(set(words))
    return {(a, b): round(own.similarity(a, b), 6) for i, a in enumerate(words) for b in words[i + 1 :] if own.similarity(a, b) > 0}


@pytest.mark.parametrize(("script", "letters"), [(LATIN, "aeiounmx"), (HEBREW, "אבוימןר")])
def test_similar_pairs_are_all_pairs(spark, script, letters):
    rng = random.Random(4)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(250)] + ["aich", "ouch", "aiaian", "aivian"]
    for w in words[:200]:
        at = rng.randrange(len(w))
        words.append(w[:at] + rng.choice(letters) + w[at + rng.randint(0, 1) :])
    got = {(r.a, r.b): round(r.sim, 6) for r in S.similar_pairs(spark.createDataFrame([(w,) for w in words], "word string"), script).collect()}
    assert len(got) > 100 and got == _by_hand(words, script)


def test_similarity_pairs_of_the_benchmark(spark):
    from glossloom.plans import registry

    tables = "/root/testdata/sf0.01"
    if not os.path.isdir(tables):
        pytest.skip("no test tables")
    words = [r.word for r in registry.QUERIES["stem_strip"](spark, tables).collect()]
    got = {(r.a, r.b): r.sim for r in registry.QUERIES["similarity_pairs"](spark, tables).collect()}
    assert got == _by_hand(words, LATIN)

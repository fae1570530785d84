"""Spelling variants and word weights: column expressions, and the same rules for Arrow functions."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossloom.profiles import HEBREW, IDF_COMMON, IDF_RARE, LONG_WEIGHT, SHORT_WEIGHT, STOP_WEIGHT, WEIGHT_RANGE, Script

STEM_SIM, SPELLING_SIM, LEAST_SIM = 0.92, 0.9, 0.75


def stem(word: Column, script: Script = HEBREW) -> Column:
    """Without prefix letters, if three letters stay."""
    rest = F.regexp_replace(word, f"^[{script.prefixes}]+", "")
    return F.when(F.length(rest) >= 3, rest).otherwise(word)


def skeleton(word: Column, script: Script = HEBREW) -> Column:
    """Without letters that spelling adds or drops; of three or more, last letters taken for each other are one."""
    out = F.regexp_replace(word, f"[{script.silent}]", "")
    last = out
    for a, b in script.finals:
        last = F.regexp_replace(last, f"{a}$", b)
    return F.when(F.length(out) >= 3, last).otherwise(out)


def spelling_variant(a: Column, b: Column, script: Script = HEBREW) -> Column:
    x, y = skeleton(a, script), skeleton(b, script)
    return (a != b) & (F.abs(F.length(a) - F.length(b)) <= 2) & (F.length(x) >= 2) & (x == y)


def similarity(a: Column, b: Column, script: Script = HEBREW, fuzzy: bool = True) -> Column:
    """1 for equal words; with fuzzy less for equal stems, spelling variants and few letters changed; else 0."""
    if not fuzzy:
        return F.when(a == b, 1.0).otherwise(0.0)
    s, t = stem(a, script), stem(b, script)
    short, long = F.least(F.length(s), F.length(t)), F.greatest(F.length(s), F.length(t))
    away = F.levenshtein(s, t)
    near = 1 - away / long
    allowed = F.when(short >= 7, 2).otherwise(1)
    return (
        F.when(a == b, 1.0)
        .when((s == t) & ((s != a) | (t != b)), STEM_SIM)
        .when(long - short > 2, 0.0)
        .when(spelling_variant(s, t, script), SPELLING_SIM)
        .when(short <= 3, 0.0)
        .when((away <= allowed) & (near >= LEAST_SIM), near)
        .otherwise(0.0)
    )


def _shorter(words: Column) -> Column:
    """Each word without each one of its letters."""
    less = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
    return F.array_distinct(F.flatten(F.transform(words, less)))


def similar_pairs(words: DataFrame, script: Script = HEBREW) -> DataFrame:
    """All pairs a < b of the distinct column word that are similar at all: a, b, sim. Candidates have the stem, its skeleton, or a stem less one or two letters in common, which similarity above 0 implies."""
    v = words.where("word != ''").select("word").distinct().withColumn("stem", stem(F.col("word"), script))
    n, itself = F.length("stem"), F.array("stem")
    none = F.array().cast("array<string>")
    one = _shorter(itself)
    # one letter is allowed from four letters on, two from seven
    left = F.when(n >= 7, F.concat(itself, one, _shorter(one))).when(n >= 4, F.concat(itself, one)).otherwise(itself)
    x = skeleton(F.col("stem"), script)
    keys = F.concat(F.transform(F.array_distinct(left), lambda k: F.concat(F.lit("stem "), k)), F.when(F.length(x) >= 2, F.array(F.concat(F.lit("skeleton "), x))).otherwise(none))
    v = v.select("word", F.explode(keys).alias("key"))
    pairs = v.withColumnRenamed("word", "a").join(v.withColumnRenamed("word", "b"), "key").where("a < b").select("a", "b").distinct()
    return pairs.select("a", "b", similarity(F.col("a"), F.col("b"), script).alias("sim")).where("sim > 0")


def word_weight(word: Column, script: Script = HEBREW) -> Column:
    """Stop words and very short words say little, long words much."""
    bare = F.trim(F.regexp_replace(word, f"[{script.marks}\"'״׳]", ""))
    return F.when(bare == "", 1.0).when(bare.isin(*script.stop_words), STOP_WEIGHT).when(F.length(bare) <= 2, SHORT_WEIGHT).when(F.length(bare) >= 6, LONG_WEIGHT).otherwise(1.0)


def idf_factor(ratio: Column) -> Column:
    """Of the share of lines that hold the word."""
    return F.when(ratio > IDF_COMMON, F.greatest(F.lit(0.35), 1 - 2 * ratio)).when(ratio < IDF_RARE, 1.5).otherwise(1.0)


def combined_weight(weight: Column, factor: Column) -> Column:
    low, high = WEIGHT_RANGE
    return F.least(F.lit(high), F.greatest(F.lit(low), weight * F.coalesce(factor, F.lit(1.0))))


class Words:
    """The same for Python values, with what was worked out kept for a bounded number of words."""

    def __init__(self, script: Script = HEBREW):
        import re

        self._prefix, self._silent = re.compile(f"^[{script.prefixes}]+"), re.compile(f"[{script.silent}]")
        self._bare = re.compile(f"[{script.marks}\"'״׳]")
        self.script, self._stops = script, frozenset(script.stop_words)
        self.stem = lru_cache(200_000)(self._stem)
        self.similarity = lru_cache(200_000)(self._similarity)
        self.keys = lru_cache(20_000)(self._keys)

    def _stem(self, word: str) -> str:
        rest = self._prefix.sub("", word)
        return rest if len(rest) >= 3 else word

    def skeleton(self, word: str) -> str:
        out = self._silent.sub("", word)
        if len(out) >= 3:
            for a, b in self.script.finals:
                out = out[:-1] + b if out.endswith(a) else out
        return out

    def _similarity(self, a: str, b: str) -> float:
        if a == b:
            return 1.0
        s, t = self.stem(a), self.stem(b)
        if s == t and (s != a or t != b):
            return STEM_SIM
        short, long = sorted((len(s), len(t)))
        if long - short > 2:
            return 0.0
        x, y = self.skeleton(s), self.skeleton(t)
        if s != t and len(x) >= 2 and x == y:
            return SPELLING_SIM
        if short <= 3:
            return 0.0
        away = edit_distance(s, t, 2 if short >= 7 else 1)
        near = 1 - away / long
        return near if away <= (2 if short >= 7 else 1) and near >= LEAST_SIM else 0.0

    def _keys(self, word: str) -> tuple[str, ...]:
        """What similar words have at least one of in common, unless both stems are long."""
        s = self.stem(word)
        left, n = {s}, len(s)
        if 4 <= n <= Vocabulary.LONG:
            one = {s[:i] + s[i + 1 :] for i in range(n)}
            left |= one
            if n >= 7:
                left |= {x[:i] + x[i + 1 :] for x in one for i in range(n - 1)}
        x = self.skeleton(s)
        return (*left, *(("skeleton " + x,) if len(x) >= 2 else ()))

    def weight(self, word: str) -> float:
        bare = self._bare.sub("", word).strip()
        if not bare:
            return 1.0
        if bare in self._stops:
            return STOP_WEIGHT
        return SHORT_WEIGHT if len(bare) <= 2 else LONG_WEIGHT if len(bare) >= 6 else 1.0

    def combined(self, word: str, idf: dict[str, float] | None) -> float:
        low, high = WEIGHT_RANGE
        return min(high, max(low, self.weight(word) * (idf or {}).get(word, 1.0))) if word else 1.0


class Vocabulary:
    """Words of a document, found by how they are spelled: near gives all that are similar to a word without a look at the others.

    As in similar_pairs, what is similar shares its stem, the stem's skeleton, or
    the stem less one or two letters. Long stems have many of these and few
    neighbours of their length; they are compared by length.
    """

    LONG, KEPT = 16, 20_000

    def __init__(self, say: Words, words):
        self.say, self.known = say, frozenset(words)
        self._by_key: dict[str, list[str]] = {}
        self._by_length: dict[int, list[str]] = {}
        self._near: dict[str, dict[str, float]] = {}
        self._learned = False

    def _learn(self):
        self._learned = True
        for word in self.known:
            for key in self.say.keys(word):
                self._by_key.setdefault(key, []).append(word)
            n = len(self.say.stem(word))
            if n > self.LONG - 2:
                self._by_length.setdefault(n, []).append(word)

    def near(self, word: str) -> dict[str, float]:
        """The similar words with their similarity."""
        found = self._near.get(word)
        if found is None:
            if not self._learned:
                self._learn()
            others = {b for key in self.say.keys(word) for b in self._by_key.get(key, ())}
            n = len(self.say.stem(word))
            for m in range(n - 2 if n > self.LONG else self.LONG + 1, n + 3):
                others.update(self._by_length.get(m, ()))
            found = {b: sim for b in others if (sim := self.say.similarity(word, b)) > 0}
            if len(self._near) >= self.KEPT:
                self._near.clear()
            self._near[word] = found
        return found

    def similarity(self, a: str, b: str) -> float:
        return self.near(a).get(b, 0.0) if b in self.known else self.say.similarity(a, b)


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or most + 1 if it is more; only cells near the diagonal are filled."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    row = {j: j for j in range(min(most, len(b)) + 1)}
    for i, ca in enumerate(a, 1):
        now = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            if j == 0:
                now[j] = i
                continue
            now[j] = min(row.get(j, far) + 1, now.get(j - 1, far) + 1, row.get(j - 1, far) + (ca != b[j - 1]))
        row = now
    return min(far, row.get(len(b), far))

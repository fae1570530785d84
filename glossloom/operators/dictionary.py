"""Abbreviation dictionaries: reading them, and writing abbreviations out where the context has the words."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossloom.operators.normal import normal
from glossloom.profiles import EXPANSION_TOKENS, HEBREW_MARKS

_QUOTES = re.compile(f"[{HEBREW_MARKS}״\"׳'’‘´]")
_MARKS = re.compile(f"[{HEBREW_MARKS}]")
_STOPS = re.compile(r"[.,:;?!()\[\]\"'׳״’‘´]")


def clean_key(key: str) -> str:
    return _QUOTES.sub("", key).strip()


def clean_key_column(key: Column) -> Column:
    return F.trim(F.regexp_replace(key, f"[{HEBREW_MARKS}״\"׳'’‘´]", ""))


def entries(raw: DataFrame, column: str = "value") -> DataFrame:
    """key, options of dictionaries in JSON text (an object of strings or arrays of strings); blank options and empty keys go."""
    pairs = raw.select(F.explode(F.from_json(F.col(column), "map<string,string>")).alias("key", "value"))
    many = F.from_json("value", "array<string>")
    options = F.when(F.ltrim("value").startswith("["), many).otherwise(F.array("value"))
    kept = F.filter(F.transform(options, lambda o: F.trim(o)), lambda o: o != "")
    return pairs.select("key", kept.alias("options")).where((F.col("key") != "") & (F.size("options") > 0))


def merged(table: DataFrame) -> DataFrame:
    """By cleaned key, the distinct options of all entries: in their order, entries in that of their keys. The first that fits is taken, so order counts."""
    flat = table.select(F.col("key").alias("entry"), F.posexplode("options").alias("at", "option"))
    flat = flat.select(clean_key_column(F.col("entry")).alias("key"), F.struct("entry", "at").alias("place"), "option")
    return _in_order(flat)


def _in_order(flat: DataFrame) -> DataFrame:
    """flat: key, place, option. Each option where it comes first."""
    first = flat.groupBy("key", "option").agg(F.min("place").alias("place"))
    return first.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "option"))), lambda x: x["option"]).alias("options"))


class Abbreviation(NamedTuple):
    """An abbreviation and the words that it stands for."""

    own: str
    words: tuple[str, ...]


class Expander:
    """Writes abbreviations out. Dictionary first, longest phrase first; letters that a dictionary does not know may stand for words of the context that begin so."""

    def __init__(self, *dictionaries: dict[str, list[str]]):
        self.options: dict[str, list[str]] = {}
        for d in dictionaries:
            for key, options in d.items():
                own = self.options.setdefault(key, [])
                own += [o for o in options if o not in own]
        for key in list(self.options):
            clean = clean_key(key)
            if clean and clean not in self.options:
                self.options[clean] = self.options[key]
        self.longest = max((len(k.split()) for k in self.options), default=0)

    def _lookup(self, tokens: list[str]) -> list[str] | None:
        joined = " ".join(tokens)
        clean = clean_key(joined)
        for key in (joined, clean, clean.replace(" ", ""), " ".join(map(clean_key, tokens))):
            if key and self.options.get(key):
                return self.options[key]
        return None

    def _by_initials(self, token: str, words: list[str]) -> str | None:
        letters = clean_key(token).replace(" ", "")
        if len(letters) < 2:
            return None
        for i in range(len(words) - len(letters) + 1):
            if all(w.startswith(c) for w, c in zip(words[i : i + len(letters)], letters, strict=True)):
                return " ".join(words[i : i + len(letters)])
        return None

    def _written(self, text: str, context: str, limit: int) -> list[tuple[str, str | None]]:
        """The tokens of text, some taken together, and what is written for them, if anything."""
        if not context.strip():
            return [(token, None) for token in text.split()]
        plain = _MARKS.sub("", context)
        words = [w for w in map(clean_key, _STOPS.sub(" ", plain).split()) if w]
        tokens, out, i = text.split(), [], 0
        while i < len(tokens):
            taken, new = 1, None
            for n in range(min(3, len(tokens) - i), 0, -1) if i < limit else ():
                options = self._lookup(tokens[i : i + n])
                found = next((o for o in options or () if _MARKS.sub("", o) in plain), None)
                if found is None and options is None:
                    found = self._by_initials("".join(tokens[i : i + n]), words)
                if found is not None:
                    new, taken = found, n
                    break
            out.append((" ".join(tokens[i : i + taken]), new))
            i += taken
        return out

    def expand(self, text: str, context: str, limit: int = EXPANSION_TOKENS) -> str:
        out = self._written(text, context, limit)
        joined = " ".join(filter(None, (own if new is None else new for own, new in out)))
        return text if joined == " ".join(text.split()) else joined

    def units(self, text: str, context: str, limit: int = EXPANSION_TOKENS) -> list[str | Abbreviation]:
        """The normal words of text; an abbreviation that is written out stays one unit."""
        out: list[str | Abbreviation] = []
        for own, new in self._written(text, context, limit):
            if new is None or new == own:
                out += normal(own).split()
            else:
                out.append(Abbreviation(normal(own), tuple(normal(new).split())))
        return out


def with_option(table: DataFrame, key: str, option: str) -> DataFrame:
    """The dictionary with one more option; a key it had not is added, a blank option changes nothing."""
    if not key.strip() or not option.strip():
        return table
    new = table.sparkSession.createDataFrame([(key.strip(), option.strip())], "key string, option string").select("key", F.lit((1 << 31) - 1).alias("place"), "option")
    return _in_order(table.select("key", F.posexplode("options").alias("place", "option")).unionByName(new))


def without_option(table: DataFrame, key: str, option: str) -> DataFrame:
    """The dictionary without the option, and without the key if it was its last one."""
    left = F.when(F.col("key") == key, F.array_remove("options", option)).otherwise(F.col("options"))
    return table.select("key", left.alias("options")).where(F.size("options") > 0)


def without_key(table: DataFrame, key: str) -> DataFrame:
    return table.where(F.col("key") != key)


def to_json(table: DataFrame) -> DataFrame:
    """value: the dictionary as one JSON object, keys in order. A dictionary is small; texts are not kept in one."""
    pairs = F.array_sort(F.collect_list(F.struct("key", "options")))
    return table.agg(F.to_json(F.map_from_entries(pairs)).alias("value"))

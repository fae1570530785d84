"""Text normalisation as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossloom.profiles import DASHES, GEMARA_NAMES, HEBREW, IBID, LEMMA_MARKS, MISHNA_NAMES, NUMERALS, RASHI_NAMES, SPACES, TOSAFOT_NAMES, VOWEL_CLASSES, Script

_S = f"[{SPACES}]"
HEADER = r"(?i)<h[1-6][^>]*>.*</h[1-6]>"
HASHES = rf"^#{{1,6}}{_S}+"


def _each(char_class: str) -> str:
    """The characters of a class of ranges and single ones."""
    parts = re.findall("(.)-(.)|(.)", char_class, re.S)
    return "".join("".join(map(chr, range(ord(a), ord(b) + 1))) if a else one for a, b, one in parts)


_ALL_SPACES = _each(SPACES)


def _once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), with c worked out once however often it is used."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(_ALL_SPACES))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", " ")


def strip_markup(c: Column) -> Column:
    """Tags vanish, but a run of them with a line break leaves a space; only texts that have tags change."""
    out = F.regexp_replace(c, r"(?i)(?:<[^>]*>)*<\s*br\b[^>]*>(?:<[^>]*>)*", " ")
    out = F.regexp_replace(F.regexp_replace(out, "<[^>]*>", ""), f"[{SPACES.replace(chr(10), '')}]{{2,}}", " ")
    return F.when(c.contains("<"), trimmed(out)).otherwise(c)


_SINGLE, _DOUBLE = "׳’‘´", "״“”″‟„"


def _replaced(c: Column, chars: str, new: str) -> Column:
    return reduce(lambda x, ch: F.replace(x, F.lit(ch), F.lit(new)), chars, c)


def plain_quotes(c: Column) -> Column:
    """Quotes of all kinds as ' and "; two single ones are a double one."""
    return _replaced(F.replace(_replaced(c, _SINGLE, "'"), F.lit("''"), F.lit('"')), _DOUBLE, '"')


def strip_edge_quotes(c: Column) -> Column:
    """Quotes that open a word, and double quotes that close one, also before points."""
    return F.regexp_replace(c, f"(?<![^{SPACES}])[\"']+|\"+(?=[.:]*(?:{_S}|$))", "")


def _listed(char_class: str) -> str:
    """A class with its ranges of ASCII characters written out, which Java then looks up in a table and not range by range."""
    return re.sub("[ -,.-~]-[ -,.-~]", lambda m: _each(m[0]), char_class)


#: Latin-1 without tags and quotes, each character listed as in _listed.
_EVEN = "".join(f"\\x{i:02x}" for i in range(256) if chr(i) not in f"<'\"{_SINGLE}{_DOUBLE}")


def normalized(c: Column, script: Script = HEBREW, keep_points: bool = False) -> Column:
    """Letters, digits and quotes inside words, with single spaces between words. Every line passes here, so each step looks first whether there is anything to do."""
    plain = lambda x: F.when(F.octet_length(x) == F.length(x), F.replace(x, F.lit("''"), F.lit('"'))).otherwise(plain_quotes(x))
    marks = lambda x: F.when(F.octet_length(x) == F.length(x), x).otherwise(F.regexp_replace(x, f"[{script.marks}]", ""))
    quoted = lambda x: F.when(x.contains("'") | x.contains('"'), F.regexp_replace(strip_edge_quotes(x), " {2,}", " ")).otherwise(x)
    cased = lambda x: F.lower(x) if script.lower else x
    whole = lambda x: _once(cased(_once(F.when(x.contains("<"), strip_tags(x)).otherwise(x), plain)), marks)
    # one look tells that a line has no tags, quotes or marks; else these are a dozen searches through it
    out = _once(F.coalesce(c, F.lit("")), lambda x: F.when(x.rlike(f"[^{_EVEN}]"), whole(x)).otherwise(cased(x)))
    letters = _listed(f"{script.letters}0-9")
    out = F.regexp_replace(out, f"[^{letters}'\"{'.:' if keep_points else ''}]+", " ")
    return F.trim(_once(out, quoted))


def words(norm: Column) -> Column:
    return F.array_remove(F.split(norm, " "), "")


def is_header(raw: Column) -> Column:
    return raw.contains("<") & raw.rlike(HEADER) | raw.rlike(rf"^{_S}*#{{1,6}}{_S}+[^{SPACES}]")


def header_title(raw: Column) -> Column:
    line = trimmed(raw)
    inner = F.when(line.rlike(HEADER), F.regexp_extract(line, r"(?i)<h[1-6][^>]*>(.*?)</h[1-6]>", 1)).when(line.rlike(HASHES), F.regexp_replace(line, HASHES, "")).otherwise(line)
    return strip_markup(inner)


def header_key(title: Column, script: Script = HEBREW) -> Column:
    """A title in the form that titles are compared in; page marks are written out."""
    out = plain_quotes(header_title(title))
    leaf = f"דף{_S}+([א-ת]+){_S}*"
    for mark, side in ((r"\.", "א"), (":", "ב"), ('ע"?א', "א"), ('ע"?ב', "ב")):
        out = F.regexp_replace(out, leaf + mark, f"דף $1 עמוד {side}")
    return normalized(out, script)


def holds_words(hay: Column, needle: Column) -> Column:
    return F.concat(F.lit(" "), hay, F.lit(" ")).contains(F.concat(F.lit(" "), needle, F.lit(" ")))


def headers_match(a: Column, b: Column) -> Column:
    """Of header keys: equal, or one holds the other's words. Empty ones match nothing."""
    return (a != "") & (b != "") & ((a == b) | holds_words(a, b) | holds_words(b, a))


def _any_of(names) -> str:
    return "|".join(n.replace(" ", f"{_S}+") for n in sorted(names, key=len, reverse=True))


_END = "(?![א-ת])"
_TAIL = f"{_END}{_S}*[:.\\-]?{_S}*"
_LEMMA = f"(?:{_any_of(LEMMA_MARKS)})"


def names_source(norm: Column, names) -> Column:
    """Does a normalised line begin with one of the names, as a whole word?"""
    return norm.rlike(f"^(?:{_any_of(names)}){_END}")


def names_rashi(norm: Column) -> Column:
    return names_source(norm, RASHI_NAMES)


def names_tosafot(norm: Column) -> Column:
    return names_source(norm, TOSAFOT_NAMES)


def names_primary(norm: Column) -> Column:
    return names_source(norm, GEMARA_NAMES + MISHNA_NAMES)


def strip_leading_marks(c: Column) -> Column:
    """Numbers, bullets, brackets, names of the primary source and a bare ibid at the start, four layers deep at most."""
    bullet = rf"^(?:\d+[.)]|[ א-ת][.)]|\([^)]+\)|\[[^\]]+\]|[•\-*]){_S}*"
    context = f"^(?:{_any_of(GEMARA_NAMES + MISHNA_NAMES)}){_TAIL}"
    ibid = f"^שם{_S}*[:.\\-]?{_S}*(?!{_any_of(LEMMA_MARKS + IBID)})"
    layer = lambda x: trimmed(reduce(lambda y, p: F.regexp_replace(y, p, ""), (bullet, context, ibid), x))
    return reduce(lambda x, _: layer(x), range(4), c)


def strip_source_prefix(c: Column) -> Column:
    """The line without what names its source."""
    out = F.regexp_replace(trimmed(plain_quotes(strip_tags(trimmed(c)))), f"[{HEBREW.marks}]", "")
    out = strip_leading_marks(out)
    secondary = _any_of(RASHI_NAMES + TOSAFOT_NAMES)
    out = F.regexp_replace(out, f"^(?:(?:{secondary})(?:{_S}+{_LEMMA})?|שם{_S}+ד\"ה|{_any_of(IBID)}|בד\"ה|בדה){_TAIL}", "")
    out = F.regexp_replace(out, f'^ב?ד"ה{_S}*[:.\\-]?{_S}*', "")
    return trimmed(F.regexp_replace(out, f"^ב?דה{_S}+", ""))


def is_ibid(raw: Column) -> Column:
    """Does the line only continue what the line above quotes?"""
    return normalized(raw).rlike(f"^(?:שם )?(?:{_any_of(IBID)})(?: |$|[:.\\-])")


def number_letters(raw: Column) -> Column:
    """The letters of a leading (א) [א] {א} א) א] א. - or nothing."""
    letters = "[א-ת]{1,3}(?:[\"'׳״][א-ת]{1,2})?"
    lead = f"(?:{_S}|#{{1,6}}{_S}|<[^>]*>)*"
    found = F.regexp_extract(raw, rf"^{lead}(?:[(\[{{]{_S}*({letters}){_S}*[)\]}}]|({letters}){_S}*[)\]}}.])", 0)
    return F.regexp_replace(F.regexp_replace(found, "<[^>]*>", ""), "[^א-ת]", "")


def is_numeral(letters: Column) -> Column:
    """Are the letters a number, each worth less than the one before?"""
    value = "".join(chr(97 + i) for i in range(len(NUMERALS)))
    ranked = F.translate(letters, "".join(NUMERALS), value)
    places = F.sequence(F.lit(1), F.length(letters))
    falls = F.forall(places, lambda i: (i == 1) | (F.substring(ranked, i, F.lit(1)) < F.substring(ranked, i - 1, F.lit(1))))
    return F.when(letters.rlike("^[אבגדהוזחטיכלמנסעפצקרשת]+$"), falls).otherwise(False)


def numbering(raw: Column) -> Column:
    """The letters of a leading number if they are a descending numeral, else null."""
    letters = number_letters(raw)
    return F.when(is_numeral(letters), letters)


def lemma_points(line: Column) -> Column:
    """Place (from 1; 0: nowhere) of the first dash with a space at its side, or points before a space."""
    return F.regexp_instr(line, F.lit(f"{_S}[{DASHES}]|[{DASHES}]{_S}|[.:;\u05c3]+(?={_S}|$)"))


def lemma_dots(line: Column) -> Column:
    """Place of the first ellipsis word, counted alike."""
    return F.regexp_instr(line, F.lit(f"(?:^|{_S})(?:ו?כו['׳]|וגו['׳]|וגומר|וכולי)(?:{_S}|$|[.,:;])"))


def lemma_end(line: Column) -> Column:
    """Characters before whichever comes first; null if it is at the start, after blanks only, or absent."""
    first = F.least(F.nullif(lemma_points(line), F.lit(0)), F.nullif(lemma_dots(line), F.lit(0))) - 1
    return F.when((first > 0) & (trimmed(F.substring(line, F.lit(1), first)) != ""), first)


def vowel_print(word: Column) -> Column:
    """Vowel classes of a pointed word, one letter each."""
    marks = "".join(VOWEL_CLASSES.values())
    classes = "".join(k * len(v) for k, v in VOWEL_CLASSES.items())
    return F.translate(F.regexp_replace(word, f"[^{marks}]", ""), marks, classes)


def safe_file_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, '"', ""), r"[/\\?%*:|<>]", "_"))

"""The ordered part of linking: one commentary's lines in turn, each with what came before it.

Documents are independent, so this is a grouped map with one task for each
commentary and no more state than that one document. Scores are worked out when
a line asks for them; a match near the last one spares the rest of its segment.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from glossloom.functions.similarity import Vocabulary, Words
from glossloom.operators.dictionary import Abbreviation, Expander
from glossloom.operators.normal import normal
from glossloom.profiles import (
    ABBREVIATION_DAMP,
    ANCHOR_MIN_LETTERS,
    CONFIDENCE,
    CONTINUATION_WORDS,
    GAP_LIMIT,
    GAP_PENALTY,
    NEAR_LINES,
    TOP_K,
    WEIGHT_RANGE,
    Book,
    Pass,
)

LABELS = {"rashi": 'רש"י', "tosafot": "תוספות"}


@dataclass
class Evidence:
    matched: float = 0.0
    window: float = 0.0
    n_words: int = 0
    similarity: float = 0.0
    score: float = 0.0
    rival: float = 0.0
    exact: bool = False


@dataclass
class Found:
    line: int
    n_words: int
    top: list[tuple[int, float]]
    evidence: Evidence
    rung: str | None = None


@dataclass
class Link:
    line: int
    target: int
    secondary: str | None
    ref: str
    path: str
    secondary_ref: str | None
    inherited: bool
    lemma: str
    confidence: int
    match: dict | None = None
    candidates: list[tuple[int, float, int]] = field(default_factory=list)

    @property
    def key(self):
        return self.target, self.secondary


@dataclass
class Target:
    """A document that links point at: rows of features.target in order of lines, and its word factors."""

    name: str
    rows: list[dict]
    idf: dict[str, float]

    def __post_init__(self):
        self.segments = segments_of(self.rows)

    def segment_for(self, key: str):
        """First segment of an equal title, else of one that holds it or is held."""
        pad = lambda s: f" {s} "
        same = (s for s in self.segments if s.key == key)
        held = (s for s in self.segments if key and s.key and (pad(s.key) in pad(key) or pad(key) in pad(s.key)))
        return next(same, None) or next(held, None)


@dataclass
class Segment:
    title: str
    key: str
    header: int
    first: int
    last: int


MAIN_TITLE, MAIN_KEY = "תוכן ראשי", "תוכן ראשי"


def segments_of(rows: list[dict]) -> list[Segment]:
    heads = [r for r in rows if r["breaks"]]
    if not heads:
        return [Segment(MAIN_TITLE, MAIN_KEY, 0, 1, len(rows))] if rows else []
    ends = [h["line_no"] - 1 for h in heads[1:]] + [len(rows)]
    return [Segment(h["title"], h["title_key"], h["line_no"], h["line_no"] + 1, end) for h, end in zip(heads, ends, strict=True)]


def _unit(x: float) -> float:
    return min(1.0, max(0.0, x))


def _percent(p: float) -> int:
    return max(CONFIDENCE.least, min(CONFIDENCE.most, math.floor(100 * p + 0.5)))


def confidence(e: Evidence | None, explicit: bool, rung: str | None, pass_no: int, width: int | None) -> int:
    c = CONFIDENCE
    z = c.base
    if e and e.n_words > 0 and e.window > 0:
        margin = _unit((e.score - e.rival) / e.score) if e.score > 0 else 0.0
        features = ((c.coverage, _unit(e.matched / e.window)), (c.run, 1 - math.exp(-e.n_words / c.run_scale)), (c.similarity, _unit(e.similarity / e.n_words)), (c.information, _unit(e.matched / e.n_words / WEIGHT_RANGE[1])), (c.margin, margin))
        z += sum(w * (x - centre) for (w, centre), x in features) + c.exact * e.exact + c.explicit * explicit
    z -= c.rungs.get(rung, 0.0)
    if pass_no > 0:
        credit = 0.0 if width is None else c.credit * (1 - _unit((width - 1) / c.credit_lines))
        z -= max(0.0, c.step * pass_no - credit)
    return _percent(1 / (1 + math.exp(-(c.slope * z + c.offset))))


def inherited_confidence(parent: int | None, depth: int) -> int:
    return _percent((parent or CONFIDENCE.fallback) / 100 * CONFIDENCE.retention ** max(1, depth))


def threshold(expected: float, n: int, explicit: bool, multiplier: float, spec: Pass) -> float:
    share, floor = (0.55, 0.4) if n <= 2 else (0.60, 0.55) if n <= 4 else (0.65, 0.7)
    share += 0 if explicit else 0.05
    out = min(spec.score_cap, max(floor, expected * share * (multiplier / 0.65)))
    return out if spec.min_score is None else max(out, spec.min_score)


class Resolver:
    """Links one commentary. rows: features.commentary in order of lines."""

    def __init__(self, rows: list[dict], targets: dict[str, Target], book: Book, passes: list[Pass], *, title: str, weighted: bool = True, expander: Expander | None = None, inherit_on_bare: bool = False, say: Words | None = None):
        self.rows, self.targets, self.book, self.passes, self.title = rows, targets, book, passes, title
        self.weighted, self.expander, self.inherit_on_bare = weighted, expander, inherit_on_bare
        self.say = say or Words()
        self.vocabulary = Vocabulary(self.say, (w for t in targets.values() for r in t.rows for w in r["words"]))
        self.segments = segments_of(rows)
        content = [r for r in rows if not r["blank"] and not r["breaks"]]
        self.openers: dict[str, int] = {}
        for r in content:
            if r["opens"]:
                self.openers[r["opens"]] = self.openers.get(r["opens"], 0) + 1
        self.n_content = len(content)
        self.links: dict[int, Link] = {}
        self.highlights: dict[int, tuple[int, int]] = {}

    # --- scores of one line against another ---------------------------------------------------------------------------

    def _weights(self, words, idf) -> list[float]:
        return [self.say.combined(w, idf) if self.weighted else 1.0 for w in words]

    def _sim(self, a: str, b: str) -> float:
        return self.vocabulary.similarity(a, b) if self.spec.fuzzy else float(a == b)

    def _near(self, word: str) -> dict[str, float]:
        """Words of the targets' lines that are similar to the word."""
        return self.vocabulary.near(word) if self.spec.fuzzy else {word: 1.0}

    def _unit(self, unit: Abbreviation, line: list[str], at: int, idf) -> tuple[float, float]:
        """Score and similarity of an abbreviation whose words all stand at a place of the line; 0 if they do not."""
        there = line[at : at + len(unit.words)]
        sims = [self._sim(a, b) for a, b in zip(unit.words, there, strict=False)]
        if not unit.words or len(there) < len(unit.words) or min(sims) <= 0:
            return 0.0, 0.0
        written = sum(s * w for s, w in zip(sims, self._weights(unit.words, idf), strict=True))
        return max(self._weights([unit.own], idf)[0], ABBREVIATION_DAMP * written), sum(sims) / len(sims)

    def _run(self, words: list[str | Abbreviation], weights: list[float], line: list[str], pinned: bool, idf=None, known: bool = False) -> tuple[float, int, float]:
        """Best run of words that follow each other in both: score, length, sum of similarities. An abbreviation is one word, but goes over all that it stands for in the line. known: the line's words are a target's as they are."""
        best = (0.0, 0, 0.0)
        for s in range(min(self.spec.start_words, len(words))):
            places = range(min(1, len(line)) if pinned else len(line))
            if known and not isinstance(words[s], Abbreviation):
                first = self._near(words[s])
                places = [d for d in places if line[d] in first] if first else ()
            for d in places:
                n, at, score, sims = 0, d, 0.0, 0.0
                while s + n < len(words) and at < len(line):
                    word, step = words[s + n], 1
                    if isinstance(word, Abbreviation):
                        gain, sim = self._unit(word, line, at, idf)
                        step = len(word.words)
                    else:
                        sim = self._sim(word, line[at])
                        gain = sim * weights[s + n]
                    if sim <= 0:
                        break
                    score, sims, n, at = score + gain, sims + sim, n + 1, at + step
                if n and score > best[0] and (d < self.spec.shallow or n >= self.spec.deep_run):
                    best = (score, n, sims)
        return best

    def _phrase_in(self, phrase: str, norm: str) -> bool:
        """Does the phrase stand early in the line, or is it long enough to stand anywhere?"""
        if not phrase:
            return bool(norm)
        long = len(phrase.split()) >= self.spec.deep_run
        at = norm.find(phrase)
        while at != -1:
            if long or len(norm[:at].split()) <= self.spec.shallow:
                return True
            at = norm.find(phrase, at + 1)
        return False

    def _gapped(self, words: list[str], weights: list[float], norm: str, line: list[str]) -> float:
        """Best run that may leave out a word here or there."""
        if not words:
            return 0.0
        if " ".join(words) in norm:
            return 5 + 1.5 * sum(weights)
        best = 0.0
        for s in range(len(words)):
            for d in range(len(line)):
                i, j, gaps, score, n = s, d, 0, 0.0, 0
                while i < len(words) and j < len(line):
                    sim = self._sim(words[i], line[j])
                    if sim > 0:
                        score, n, i, j = score + sim * weights[i], n + 1, i + 1, j + 1
                        if n >= 2:
                            best = max(best, score)
                        continue
                    if gaps == GAP_LIMIT:
                        break
                    more, on = i + 1 < len(words), j + 1 < len(line)
                    # both words skipped is tried before the quoted one alone, and that before the line's
                    ways = ((self._sim(words[i + 1], line[j + 1]) if more and on else 0.0, 1, 1), (self._sim(words[i + 1], line[j]) if more else 0.0, 1, 0), (self._sim(words[i], line[j + 1]) if on else 0.0, 0, 1))
                    way = max(ways, key=lambda w: w[0])
                    if way[0] <= 0:
                        break
                    gaps, score, i, j = gaps + 1, score - GAP_PENALTY, i + way[1], j + way[2]
        return best

    def _bag(self, words: list[str], weights: list[float], norm: str, line: list[str]) -> float:
        if not words:
            return 0.0
        if " ".join(words) in norm:
            return 5 + 1.5 * sum(weights)
        near = map(self._near, words)
        return sum(w * max((a[b] for b in line if b in a), default=0.0) for a, w in zip(near, weights, strict=True))

    # --- searches -----------------------------------------------------------------------------------------------------

    def _search(self, t: Target, lo: int, hi: int, row: dict, lemma: dict, prev: int | None, *, pinned=False, cap=12, multiplier=0.65, idf=True, exclude=frozenset(), explicit: bool | None = None, words: list[str] | None = None) -> Found | None:
        explicit = lemma["explicit"] if explicit is None else explicit
        phrase = " ".join(lemma["words"] if words is None else words)
        full = phrase.split() if explicit else row["words"]
        factors = t.idf if idf else None
        weights = self._weights(full, factors)
        expected, window = sum(weights), sum(weights[:cap])
        bar = threshold(expected, len(full), explicit, multiplier, self.spec)
        n = len(t.rows)
        lo = max(1, min(lo, n))
        hi = max(lo, min(hi, n))
        ranges = [(lo, hi)]
        if prev:
            near = max(lo, prev - NEAR_LINES), min(hi, prev + NEAR_LINES)
            if near[0] <= near[1] and near != (lo, hi):
                ranges.insert(0, near)
        for a, b in ranges:
            hits = []
            for k in range(a, b + 1):
                line = t.rows[k - 1]
                if k in exclude or not line["words"]:
                    continue
                hit = self._score(phrase, full, weights, line, row, explicit, pinned, cap, factors)
                score, n_words, sims, matched, exact = hit
                if exact:
                    score, matched, sims = expected + 10, window, float(n_words)
                elif not explicit and prev:
                    away = k - prev
                    score *= max(0.93, 1 - 0.005 * -away) if away < 0 else max(0.95, 1 - 0.002 * (away - 5)) if away > 5 else 1.0
                if score >= bar and (self.spec.min_score is None or matched >= self.spec.min_score):
                    hits.append((-score, k, n_words, sims, matched, exact))
            if hits:
                hits.sort()
                top = [(k, -s) for s, k, *_ in hits[:TOP_K]]
                s, k, n_words, sims, matched, exact = hits[0]
                return Found(k, n_words, top, Evidence(matched, window, n_words, sims, -s, top[1][1] if len(top) > 1 else 0.0, exact))
        return None

    def _score(self, phrase, full, weights, line, row, explicit, pinned, cap, factors):
        """score, words, similarity, matched weight, exact."""
        norm, words = line["norm"], line["words"]
        shapes = [(full[:cap], weights[:cap], words, True)]
        texts = [(phrase, norm)]
        if self.expander is not None:
            own = phrase if explicit else row["body"]
            written, there = self.expander.expand(own, norm), self.expander.expand(norm, row["body"])
            if written != own or there != norm:
                new = self.expander.units(own, norm) if written != own else full
                new_weights = [0.0 if isinstance(w, Abbreviation) else self._weights([w], factors)[0] for w in new[:cap]]
                shapes += [(new[:cap], new_weights, there.split(), False), (full[:cap], weights[:cap], there.split(), False), (new[:cap], new_weights, words, True)]
                texts.append((written if explicit else phrase, there))
        if explicit and any((n.startswith(p) if pinned else self._phrase_in(p, n)) for p, n in texts):
            return 0.0, len(phrase.split()), 0.0, 0.0, True
        best = (0.0, 0, 0.0)
        for a, w, b, known in shapes:
            run = self._run(a, w, b, pinned, factors, known)
            best = run if run[0] > best[0] else best
        return best[0], best[1], best[2], best[0], False

    def _search_pieces(self, t: Target, lo: int, hi: int, row: dict, lemma: dict, prev: int | None, *, pinned=False, cap=12, exclude=frozenset()) -> Found | None:
        """A lemma in pieces: its first piece chooses the line, the others are looked for soon after."""
        whole = lambda: self._search(t, lo, hi, row, lemma, prev, pinned=pinned, cap=cap, exclude=exclude, explicit=True, words=row["words"])
        if len(row["pieces"]) <= 1:
            return whole()
        first, *more = row["pieces"]
        first = first[:cap]
        more = [p[:CONTINUATION_WORDS] for p in more[:2]]
        w1, ws = self._weights(first, t.idf), [self._weights(p, t.idf) for p in more]
        lo = max(1, min(lo, len(t.rows)))
        hi = max(lo, min(hi, len(t.rows)))
        kept: dict[tuple[int, int], float] = {}

        def ahead(piece: int, k: int, reach: int) -> float:
            out = 0.0
            for m in range(k, min(len(t.rows), k + reach) + 1):
                if (piece, m) not in kept:
                    line = t.rows[m - 1]
                    kept[piece, m] = self._gapped(more[piece], ws[piece], line["norm"], line["words"]) if line["raw"] else 0.0
                out = max(out, kept[piece, m])
            return out

        hits = []
        for k in range(lo, hi + 1):
            line = t.rows[k - 1]
            if k in exclude or not line["words"]:
                continue
            s1 = self._bag(first, w1, line["norm"], line["words"])
            if s1 < max(0.4, 0.4 * sum(w1)):
                continue
            s2 = ahead(0, k, 10) if more[0] else 0.0
            found2 = not more[0] or s2 >= 0.4
            third = len(more) > 1 and more[1]
            s3 = ahead(1, k, 15) if third and found2 else 0.0
            found3 = not third or s3 >= 0.4
            score = 2.5 * s1 + 1.2 * s2 + s3
            if prev:
                score -= 0.08 * (prev - k) if k < prev else 0.03 * (k - prev - 5) if k - prev > 5 else 0.0
            n = len(first) + (len(more[0]) if found2 else 0) + (len(more[1]) if third and found3 else 0)
            matched = s1 + (s2 if found2 else 0) + (s3 if found3 else 0)
            window = sum(w1) + (sum(ws[0]) if found2 else 0) + (sum(ws[1]) if third and found3 else 0)
            hits.append((score, -k, n, matched, window, " ".join(first) in line["norm"]))
        if not hits:
            return whole()
        best = max(hits, key=lambda h: h[:2])
        rest = [h[0] for h in hits if h is not best]
        score, k, n, matched, window, exact = best
        return Found(-k, n, [(-k, score)], Evidence(matched, window, n, 0.92 * n, score, max(0.0, max(rest, default=0.0)), exact))

    def _ladder(self, t: Target, lo: int, hi: int, row: dict, lemma: dict, prev: int | None, cap: int, exclude=frozenset()) -> Found | None:
        """For lines that name their source and found nothing: unpinned, without factors, one segment wider, at a lower bar."""
        wide = lo, hi
        at = next((i for i, s in enumerate(t.segments) if (s.first, s.last) == (lo, hi)), None)
        if at is not None:
            wide = t.segments[max(0, at - 1)].first if at else lo, t.segments[min(len(t.segments) - 1, at + 1)].last
        rungs = [("A", (lo, hi), True, 0.65), ("B", (lo, hi), False, 0.65)] + [("C", wide, False, 0.65)] * (wide != (lo, hi)) + [("D", wide, False, 0.4)]
        for rung, (a, b), idf, multiplier in rungs:
            if found := self._search(t, a, b, row, lemma, prev, cap=cap, multiplier=multiplier, idf=idf, exclude=exclude):
                found.rung = rung
                return found
        return None

    def _unique(self, t: Target, lo: int, hi: int, row: dict, lemma: dict, cap: int, primary: bool) -> Found | None:
        """First words that a single line of the range has."""
        words = lemma["words"] or row["words"]
        for n in range(min(self.spec.unique_words, len(words)), 0, -1):
            anchor = " ".join(words[:n])
            letters = "".join(c for c in anchor if "א" <= c <= "ת")
            share = self.openers.get(anchor, 0) / self.n_content if self.n_content else 1.0
            if len(letters) < ANCHOR_MIN_LETTERS or n == 1 and (letters in self.say._stops or share > self.book.opening_ratio):
                continue
            hits = [k for k in range(lo, min(hi, len(t.rows)) + 1) if t.rows[k - 1]["words"] and ((f" {anchor} " in f" {t.rows[k - 1]['norm']} ") if primary else f"{t.rows[k - 1]['norm']} ".startswith(f"{anchor} "))]
            if len(hits) == 1:
                weight, window = sum(self._weights(words[:n], t.idf)), sum(self._weights(words[:cap], t.idf))
                return Found(hits[0], n, [(hits[0], weight)], Evidence(weight, window or weight, n, float(n), weight, 0.0, n > 1))
        return None

    # --- the walk over the lines --------------------------------------------------------------------------------------

    def run(self) -> Resolver:
        source = self.targets["source"]
        self.first_segment = next((i for i, s in enumerate(self.segments) if any(t.segment_for(s.key) for t in self.targets.values())), 0)
        for self.pass_no, self.spec in enumerate(self.passes):
            if self.pass_no:
                self.links = {k: x for k, x in self.links.items() if not x.inherited}
            if self.spec.prunes:
                prune(self.links, self._units())
            self.windows = windows(self._units(), self.links) if self.spec.windowed else {}
            self.carried, self.carried_depth, self.secondary = None, 0, None
            for segment in self.segments[self.first_segment :]:
                self._segment(segment, source)
        if self.book.fills_gaps:
            self._fill_gaps()
        return self

    def _units(self) -> list[tuple[int, int]]:
        """(line, segment number) of lines that can be linked."""
        out, segment = [], 0
        for r in self.rows:
            segment += r["breaks"]
            if self._linkable(r):
                out.append((r["line_no"], segment))
        return out

    def _linkable(self, r: dict) -> bool:
        return not r["blank"] and not r["breaks"] and not (self.book.numbering_links and r["marker"]) and not (self.book.strips_numbering and not r["line"])

    def _segment(self, segment: Segment, source: Target):
        own = [r for r in self.rows[segment.first - 1 : segment.last] if not r["blank"] and not r["breaks"]]
        after = [r for r in self.rows[segment.first - 1 :] if not r["blank"] and not r["breaks"]]
        carries = self.book.inherits and bool(after) and (not after[0]["numbered"] if self.book.numbering_links else after[0]["ibid"])
        self.before, self.depth = (self.carried, self.carried_depth) if carries else (None, 0)
        self.claimed = {"rashi": set(), "tosafot": set()}
        self.here = {name: t.segment_for(segment.key) for name, t in self.targets.items()}
        place = self.here["source"]
        self.last = place.first if place else 1
        self.floor, self.awaits = None, False
        for r in own:
            self._line(r, source)
        if own:
            self.carried, self.carried_depth = self.before, self.depth

    def _range(self, name: str) -> tuple[int, int]:
        s = self.here.get(name)
        return (s.first, s.last) if s else (1, len(self.targets[name].rows))

    def _line(self, r: dict, source: Target):
        book, spec = self.book, self.spec
        if book.numbering_links and r["marker"]:
            self.awaits = True
            return
        if book.strips_numbering and not r["line"]:
            return
        opener = book.numbering_links and (r["numbered"] or self.awaits)
        self.awaits = False
        if (known := self.links.get(r["line_no"])) and not known.inherited:
            self.before, self.depth, self.secondary = known, 0, known.secondary
            if not known.secondary:
                self.last = self.floor = known.target
            return
        lo, hi = self._range("source")
        bounds = self.windows.get(r["line_no"], (None, None)) if spec.windowed else (None, None)
        lo = max(x for x in (lo, bounds[0], self.floor if spec.windowed else None) if x is not None)
        hi = max(lo, min(hi, bounds[1]) if bounds[1] is not None else hi)
        width = hi - lo + 1
        too_wide = spec.max_width is not None and width > spec.max_width

        side, named = None, False
        if book.secondaries:
            side = "rashi" if r["rashi"] else "tosafot" if r["tosafot"] else self.secondary if r["again"] else None
            named = side is not None
        primary_named = side is None and r["primary"]
        takes_over = book.inherits and (not opener if book.numbering_links else r["ibid"] or (r["bare"] and self.inherit_on_bare))
        if named and r["label_only"]:
            return
        lemma = r["short_lemma"] if side == "tosafot" else r["lemma"]
        cap = 7 if side == "tosafot" else book.lemma_words
        found_side = found = None
        if not takes_over and named and side in self.targets:
            t, (a, b) = self.targets[side], self._range(side)
            prev = self.before.target if self.before and self.before.secondary == side else None
            search = self._search_pieces if r["continued"] else self._search
            side_cap = 7 if side == "tosafot" else 12
            found_side = search(t, a, b, r, lemma, prev, pinned=True, cap=side_cap, exclude=self.claimed[side]) or self._ladder(t, a, b, r, lemma, prev, side_cap, self.claimed[side])
            if found_side:
                self.claimed[side].add(found_side.line)
        if not named and not takes_over and not too_wide and not spec.unique:
            prev = self.before.target if self.before and not self.before.secondary else self.last
            search = self._search_pieces if r["continued"] else self._search
            found = search(source, lo, hi, r, lemma, prev, cap=cap)
            if found is None and primary_named:
                found = self._ladder(source, lo, hi, r, lemma, prev, cap)
        if not found and not found_side and not takes_over and not too_wide:
            t = self.targets.get(side) if side else source
            if t is not None and self.here.get(side or "source"):
                a, b = self._range(side) if side else (lo, hi)
                hit = self._unique(t, a, b, r, lemma, cap, side is None)
                found, found_side = (None, hit) if side else (hit, None)
        hit = found_side or found
        # without a match of its own a line may take the one above over
        may = book.inherits and not opener and not named and not primary_named and not (r["bare"] and not self.inherit_on_bare)
        if self.before is not None and (takes_over or (hit is None and may)):
            b = self.before
            self._keep(Link(r["line_no"], b.target, b.secondary, b.ref, b.path, b.secondary_ref, True, lemma["text"] or " ".join(lemma["words"]), inherited_confidence(b.confidence, self.depth + 1)), r, lemma, None)
            if not b.secondary:
                self.last = b.target
        elif hit is not None:
            self._keep(self._own(r, lemma, hit, side, width), r, lemma, hit)
            if not side:
                self.last = self.floor = hit.line
        elif not book.numbering_links:
            self.before, self.depth = None, 0
        n = len(lemma["text"].split()) if lemma["explicit"] and lemma["text"] else hit.n_words if hit and hit.n_words else min(4, r["n_line"])
        offset = max(0, r["n_raw"] - r["n_line"]) if book.strips_numbering or book.strips_gloss else 0
        self.highlights[r["line_no"]] = (offset, max(1, min(n, r["n_line"])))

    def _keep(self, link: Link, r: dict, lemma: dict, hit: Found | None):
        t = self.targets[link.secondary or "source"]
        text = t.rows[link.target - 1]["raw"] if link.target <= len(t.rows) else ""
        link.match = match_range(self.vocabulary, text, link.lemma)
        self.links[link.line] = link
        self.before, self.secondary = link, link.secondary
        self.depth = self.depth + 1 if link.inherited else 0

    def _own(self, r: dict, lemma: dict, hit: Found, side: str | None, width: int) -> Link:
        place = self.here.get(side or "source")
        head = (place.title if place else None) or self.title
        label = LABELS.get(side)
        ref = f"{label or self.title} - {head}"
        path = f"{label} על {self.title}.txt" if side else f"{self.title}.txt"
        sure = confidence(hit.evidence, lemma["explicit"], hit.rung, self.pass_no, width)
        ranked = []
        for i, (line, score) in enumerate(hit.top):
            e = hit.evidence
            ratio = max(0.0, score / e.score) if e.score > 0 else 1.0
            n = max(1, math.floor(e.n_words * ratio + 0.5))
            rival = max([0.0] + [s for j, (_, s) in enumerate(hit.top) if j != i])
            own = Evidence(e.matched * ratio, e.window, n, e.similarity / e.n_words * n if e.n_words else 0.0, score, rival, e.exact and score >= e.score)
            ranked.append((line, score, confidence(own, lemma["explicit"], hit.rung, self.pass_no, width)))
        return Link(r["line_no"], hit.line, side, ref, path, f"{label} ({head})" if side else None, False, lemma["text"] or " ".join(lemma["words"]), sure, None, ranked)

    def _fill_gaps(self):
        """Lines between two own links to one place get it too."""
        for segment in self.segments[self.first_segment :]:
            anchor, pending = None, []
            for r in self.rows[segment.first - 1 : segment.last]:
                if not self._linkable(r):
                    continue
                link = self.links.get(r["line_no"])
                if link is None:
                    pending.append(r)
                elif not link.inherited:
                    if anchor is not None and link.key == anchor.key:
                        for gap in pending:
                            at, n = self.highlights.get(gap["line_no"], (0, 0))
                            lemma = " ".join(gap["raw"].split()[at : at + n])
                            filled = Link(gap["line_no"], anchor.target, anchor.secondary, anchor.ref, anchor.path, anchor.secondary_ref, True, lemma, inherited_confidence(anchor.confidence, 1))
                            filled.match = None if anchor.secondary else match_range(self.vocabulary, self.targets["source"].rows[anchor.target - 1]["raw"], lemma)
                            self.links[filled.line] = filled
                    anchor, pending = link, []


def windows(units: list[tuple[int, int]], links: dict[int, Link]) -> dict[int, tuple[int | None, int | None]]:
    """For each line without an own link, the targets of the own ones nearest above and below in its segment."""
    own = {line: links[line].target for line, _ in units if line in links and not links[line].inherited}
    above, seen = {}, {}
    for line, segment in units:
        above[line] = seen.get(segment)
        if line in own:
            seen[segment] = own[line]
    out, seen = {}, {}
    for line, segment in reversed(units):
        if line in own:
            seen[segment] = own[line]
        elif above[line] is not None or seen.get(segment) is not None:
            out[line] = above[line], seen.get(segment)
    return out


def prune(links: dict[int, Link], units: list[tuple[int, int]]) -> list[Link]:
    """Drop own links that go back in order: in each segment the heaviest sequence that never does stays."""
    by_segment: dict[int, list[Link]] = {}
    for line, segment in units:
        if line in links and not links[line].inherited:
            by_segment.setdefault(segment, []).append(links[line])
    dropped = []
    for own in by_segment.values():
        total, come_from = [], []
        for i, link in enumerate(own):
            weight = next((s for line, s, _ in link.candidates if line == link.target), max((s for _, s, _ in link.candidates), default=1.0) or 1.0)
            before = max((j for j in range(i) if own[j].target <= link.target), key=lambda j: (total[j], -j), default=None)
            total.append(weight + (total[before] if before is not None else 0.0))
            come_from.append(before)
        at = max(range(len(own)), key=lambda i: (total[i], -i))
        stay = set()
        while at is not None:
            stay.add(at)
            at = come_from[at]
        for i, link in enumerate(own):
            if i not in stay:
                dropped.append(links.pop(link.line))
    return dropped


def match_range(say: Words | Vocabulary, line: str, lemma: str) -> dict | None:
    """Which words of a line a lemma's words answer to: first word, number of words, and the runs between."""
    bare = lambda w: w.replace("'", "").replace('"', "")
    there = [(w, bare(w), i) for i, token in enumerate(line.split()) for w in normal(token).split() if any("א" <= c <= "ת" or c.isdigit() for c in w)]
    sought = normal(lemma).split()
    hits = set()
    for word in sought:
        best, place, a = 0.4, None, bare(word)
        for w, b, i in there:
            sim = 1.0 if w == word else say.similarity(word, w)
            if sim <= 0.4:
                sim = 0.6 if a and b and (a.startswith(b) or b.startswith(a)) else sim
            if sim > best:
                best, place = sim, i
                if sim >= 1.0:
                    break
        if place is not None:
            hits.add(place)
    if not hits:
        return None
    at = sorted(hits)
    runs = []
    for i in at:
        if runs and runs[-1][0] + runs[-1][1] == i:
            runs[-1][1] += 1
        else:
            runs.append([i, 1])
    span = at[-1] - at[0] + 1
    first, n = (runs[0][0], runs[0][1]) if span > len(sought) + 5 and len(at) < len(sought) / 2 else (at[0], span)
    return {"word_start": first, "word_count": n, "segments": [{"word_start": a, "word_count": b} for a, b in runs]}

"""What a script and a kind of book ask of the engine: fixed values, and the settings made of them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# --- fixed values -----------------------------------------------------------------------------------------------------
HEBREW_LETTERS = "\u05d0-\u05ea"
HEBREW_MARKS = "\u0591-\u05c7"
HEBREW_STOP_WORDS = (
    "של על את אל מן עם בי לי לו לה לנו להם להן בו בה בנו בהם עליו עליה עליהם עלינו אצלו אצלה בתוך מתוך מאחר אחר לפני אחרי בין כמו כפי לפי מפני עקב בגלל "
    "למען בעבור אם כי זה זו אלה אלו אשר כל מה מי הוא היא הם הן אלא אפילו עד אבל כך כאן הכא התם היה היו יהיה יהיו אמר אמרו אמרת אמרתי נאמר אומר אומרים שם "
    "כו וכו וגו וגומר דהיינו פירוש פירש רב רבי בן בר בת לא כן גם אי או אינו אינה אינם יש אין הנה כבר עוד שוב רק אולי ממש כמעט"
).split()
RASHI_NAMES = ('פירש"י', 'פרש"י', 'בפירש"י', 'בפרש"י', 'רש"י', 'ברש"י', "רשי", "ברשי", 'רשד"ה', 'ברשד"ה', "רשדה", "ברשדה", "בפי' רש\"י", "פי' רש\"י", 'בפירוש רש"י', 'פירוש רש"י', "בפי' רשי", "פי' רשי")
TOSAFOT_NAMES = ("בתוספות", "תוספות", "בתוספת", "תוספת", "בתוסות", "תוסות", "בתוס'", "תוס'", "בתוס", "תוס", "בתו'", "תו'", "בתו", "תו", 'בתוד"ה', 'תוד"ה')
GEMARA_NAMES = ("בגמרא", "בגמ'", "גמ'", "גמרא", "פיסקא", "בפיסקא")
MISHNA_NAMES = ("מתני'", "מתניתין", "מתניתן", "במשנה", "משנה")
IBID = ('או"ד', 'באו"ד', 'א"ד', 'בא"ד', "אד", "באד", "אוד", "באוד")
LEMMA_MARKS = ('ד"ה', 'בד"ה', "דה", "בדה")
NUMERALS = dict(zip("אבגדהוזחטיכלמנסעפצקרשת", [*range(1, 10), *range(10, 100, 10), 100, 200, 300, 400], strict=True))
VOWEL_CLASSES = {"a": "\u05b7\u05b8", "s": "\u05b0\u05b1\u05b2\u05b3", "i": "\u05b4", "e": "\u05b5\u05b6", "o": "\u05b9\u05ba\u05bb"}
DASHES = "\\-\u05be\u2010-\u2015"
#: What JavaScript's \s takes for white space; Java's does not take all of it.
SPACES = "\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

STOP_WEIGHT, SHORT_WEIGHT, LONG_WEIGHT = 0.35, 0.45, 1.25
WEIGHT_RANGE = (0.25, 1.30)
IDF_COMMON, IDF_RARE = 0.08, 0.01
NEAR_LINES, TOP_K, CONTINUATION_WORDS, EXPANSION_TOKENS = 12, 3, 12, 64
GAP_LIMIT, GAP_PENALTY, ABBREVIATION_DAMP, ANCHOR_MIN_LETTERS = 2, 0.5, 0.6, 3
APPROVED_AT, BULK_APPROVED_AT = 85, 80


@dataclass(frozen=True)
class Script:
    """Letters and spelling habits of a script."""

    name: str
    letters: str  # of a character class
    marks: str  # ignored inside words
    prefixes: str  # letters that may stand before a stem
    silent: str  # letters that spelling adds or drops
    finals: tuple[tuple[str, str], ...]  # last letters taken for each other
    stop_words: tuple[str, ...]
    lower: bool = False


HEBREW = Script("hebrew", HEBREW_LETTERS, HEBREW_MARKS, "ובלמשכה", "וי", (("א", "ה"), ("ן", "ם")), tuple(HEBREW_STOP_WORDS))
#: For tables of Latin text: the same rules over other letters.
LATIN = Script("latin", "a-z", "\u0300-\u036f", "aeo", "iu", (("e", "a"), ("n", "m")), ("the", "of", "and", "to", "in", "a", "is", "la", "de", "el", "die", "der", "und", "que"), lower=True)


@dataclass(frozen=True)
class Confidence:
    """Of the log-odds model: weight and centre of each feature, penalties, calibration."""

    base: float = 0.35
    coverage: tuple[float, float] = (3.20, 0.50)
    run: tuple[float, float] = (2.40, 0.55)
    similarity: tuple[float, float] = (2.60, 0.90)
    information: tuple[float, float] = (1.10, 0.55)
    margin: tuple[float, float] = (1.70, 0.35)
    exact: float = 1.15
    explicit: float = 0.45
    run_scale: float = 3.5
    rungs: dict = field(default_factory=lambda: {"A": 0.45, "B": 0.80, "C": 1.25, "D": 1.85})
    slope: float = 0.5163
    offset: float = 0.1358
    retention: float = 0.80
    fallback: int = 70
    step: float = 0.18
    credit: float = 0.9
    credit_lines: int = 8
    least: int = 5
    most: int = 99


CONFIDENCE = Confidence()


@dataclass(frozen=True)
class Book:
    """How a kind of commentary is read."""

    kind: str = "shas"
    lemma_words: int = 12
    start_words: int = 3  # a match may begin at one of so many first words
    opening_ratio: float = 0.008
    numbering_links: bool = False
    numbered_headers_are_content: bool = False
    secondaries: bool = True
    strips_numbering: bool = False
    strips_gloss: bool = False
    inherits: bool = True
    fills_gaps: bool = False
    ends_at_punctuation: bool = False
    continuations: bool = True
    min_score: float | None = None


SHAS = Book()


def halacha(multi_line: bool = True, numbered: bool = True) -> Book:
    """Codes of law: short lemmas, no secondaries, windows narrowed in passes."""
    return Book("halacha", 5, 2, 0.02, numbered and multi_line, True, False, True, True, multi_line, True, True, False, 1.5)


def book_for(category: str, multi_line: bool = True, numbered: bool = True) -> Book:
    return halacha(multi_line, numbered) if category == "halacha" else SHAS


@dataclass(frozen=True)
class Pass:
    """One round of matching; later rounds are looser and look between what earlier ones found."""

    name: str = "base"
    windowed: bool = False
    min_score: float | None = None
    fuzzy: bool = True
    unique: bool = False  # only words that occur once in the window
    unique_words: int = 1
    shallow: int = 3
    deep_run: int = 3
    start_words: int = 3
    prunes: bool = False
    max_width: int | None = None
    score_cap: float = 1.5


def passes_for(book: Book, fuzzy: bool = True) -> list[Pass]:
    base = Pass(min_score=book.min_score, fuzzy=fuzzy, start_words=book.start_words)
    if book.kind != "halacha":
        return [base]
    exact = replace(base, fuzzy=False, unique_words=0)
    loose = replace(base, unique_words=0)
    window, loose_window = replace(exact, windowed=True), replace(loose, windowed=True)
    unique = replace(base, windowed=True, unique=True, fuzzy=False, min_score=None)
    return [
        replace(exact, name="long exact", min_score=3.6),
        replace(loose, name="long fuzzy", min_score=3.0),
        replace(exact, name="three words exact", min_score=2.4),
        replace(loose, name="three words fuzzy", min_score=2.0),
        replace(window, name="two words exact", min_score=1.7, deep_run=2, prunes=True),
        replace(unique, name="unique phrase", unique_words=3),
        replace(base, name="base in window", windowed=True),
        replace(loose_window, name="two words fuzzy", min_score=1.4, deep_run=2),
        replace(unique, name="unique word", unique_words=1),
        replace(window, name="one word exact", min_score=1.15, deep_run=1),
        replace(loose_window, name="one word fuzzy", min_score=1.0, deep_run=1),
        replace(loose_window, name="late start", min_score=0.9, deep_run=1, start_words=4),
        replace(loose_window, name="narrow window", min_score=0.6, deep_run=1, max_width=3, prunes=True),
    ]

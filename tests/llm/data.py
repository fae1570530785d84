"""Small tables with everything that tables may hold."""

import random

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lambda mu nu xi omi pi rho sigma tau ups phi chi psi omega the of and to été straße 日本 naïve".split()

#: Names that operators use inside, and others.
EXTRA = "unit string, level int, part long, flags string, blob string, fp long, node long, __node long, __noise double, n_words string, n_lines int, kept boolean, id long, noise string"
N_EXTRA = 14


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + (rng.choice("....,;!") if rng.random() < 0.1 else "") + ("\n" if rng.random() < 0.05 else "") for _ in range(n))


def documents() -> list[tuple]:
    """(doc_id, text): nulls, empty and blank texts, copies, near copies, shared passages and lines, equal rows, one long text."""
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(1, 160))) for i in range(40)]
    shared, line = prose(rng, 60), "  A Shared LINE of text\t"
    rows += [(100 + i, f"{prose(rng, 30)} {shared} {prose(rng, 20)}") for i in range(4)]
    rows += [(200 + i, f"{prose(rng, 12)}\n{line}\n{prose(rng, 9)}\n\na shared line OF text") for i in range(12)]
    base = prose(rng, 150).split(" ")
    for i in range(5):
        edited = list(base)
        edited[rng.randrange(len(base))] = "changed"
        rows.append((300 + i, " ".join(edited)))
    rows += [(400, rows[3][1]), (400, rows[3][1]), (401, rows[3][1]), (500, None), (501, ""), (502, " \n\t \r\n"), (503, None), (None, "null id text"), (None, None), (600, "one"), (601, "one two"), (602, "\x1c a b c\x85d \x0b e")]
    rows += [(700, prose(rng, 20_000)), (701, "same word " * 3000), (702, "x" * 5000)]
    return rows


def frame(spark, rows, schema="doc_id long, text string", parts=3):
    """With columns of clashing names beside."""
    wide = [(*r, "u", 1, 2, "f", "b", 3, 4, 5, 0.5, "w", 7, True, 8, "n") for r in rows]
    return spark.createDataFrame(wide, f"{schema}, {EXTRA}").repartition(parts)


def plain(spark, rows, schema="doc_id long, text string", parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)

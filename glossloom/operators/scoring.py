"""Thresholds and confidence as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossloom.profiles import CONFIDENCE, WEIGHT_RANGE


def threshold(expected: Column, n_words: Column, explicit: Column, multiplier: float = 0.65, least: float | None = None, cap: float = 1.5) -> Column:
    """Score that a match of an expected weight must reach."""
    share = F.when(n_words <= 2, 0.55).when(n_words <= 4, 0.60).otherwise(0.65) + F.when(explicit, 0.0).otherwise(0.05)
    floor = F.when(n_words <= 2, 0.4).when(n_words <= 4, 0.55).otherwise(0.7)
    out = F.least(F.lit(cap), F.greatest(floor, expected * share * (multiplier / 0.65)))
    return out if least is None else F.greatest(out, F.lit(least))


def _unit(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def percent(p: Column) -> Column:
    """Half up, as JavaScript rounds, within the bounds."""
    return F.greatest(F.lit(CONFIDENCE.least), F.least(F.lit(CONFIDENCE.most), F.floor(100 * p + 0.5).cast("int")))


def pass_penalty(pass_no: Column, width: Column) -> Column:
    credit = F.when(width.isNull(), 0.0).otherwise(CONFIDENCE.credit * (1 - _unit((width - 1) / CONFIDENCE.credit_lines)))
    return F.when(pass_no <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), CONFIDENCE.step * pass_no - credit))


def confidence(matched: Column, window: Column, n_words: Column, similarity: Column, score: Column, rival: Column, exact: Column, explicit: Column) -> Column:
    """Calibrated percentage of a link by its own evidence."""
    c = CONFIDENCE
    features = (
        (c.coverage, _unit(matched / window)),
        (c.run, 1 - F.exp(-n_words / c.run_scale)),
        (c.similarity, _unit(similarity / n_words)),
        (c.information, _unit(matched / n_words / WEIGHT_RANGE[1])),
        (c.margin, F.when(score > 0, _unit((score - rival) / score)).otherwise(0.0)),
    )
    z = sum((w * (x - centre) for (w, centre), x in features), F.lit(c.base))
    z = z + F.when(exact, c.exact).otherwise(0.0) + F.when(explicit, c.explicit).otherwise(0.0)
    z = F.when((n_words <= 0) | (window <= 0), c.base).otherwise(z)
    return percent(1 / (1 + F.exp(-(c.slope * z + c.offset))))


def inherited_confidence(parent: Column, depth: Column) -> Column:
    own = F.when(parent > 0, parent).otherwise(CONFIDENCE.fallback)
    return percent(own / 100 * F.pow(F.lit(CONFIDENCE.retention), F.greatest(F.lit(1), depth)))

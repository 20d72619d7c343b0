"""Scalar functions on page-speed metrics: ratings, health, tiers, deltas and scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .rules import first_match

#: Metric, good bound, needs-improvement bound (milliseconds; layout shift has no unit).
THRESHOLDS = [
    ("LCP", 2500.0, 4000.0),
    ("CLS", 0.1, 0.25),
    ("FID", 100.0, 300.0),
    ("INP", 200.0, 500.0),
    ("TTFB", 800.0, 1800.0),
    ("FCP", 1800.0, 3000.0),
]


def rating(metric: Column, value: Column) -> Column:
    """Good up to the good bound, Needs Improvement up to the next, Poor beyond; NaN is Poor, other metrics Unknown."""
    out = None
    for name, good, fair in THRESHOLDS:
        own = F.when(value <= good, "Good").when(value <= fair, "Needs Improvement").otherwise("Poor")
        out = F.when(metric == name, own) if out is None else out.when(metric == name, own)
    return out.otherwise("Unknown")


def health_score(v: Column, good: Column, fair: Column) -> Column:
    """100 up to good, falling to 50 at fair and on to 0 at twice fair; null stays null."""
    beyond = 50.0 * (1.0 - (v - fair) / fair)
    return F.when(v.isNull(), None).when(v <= good, 100.0).when(v <= fair, 100.0 - 50.0 * (v - good) / (fair - good)).otherwise(F.greatest(F.lit(0.0), beyond))


def tier(v: Column, good: Column, fair: Column) -> Column:
    """2 good, 1 fair, 0 poor; null stays null."""
    return F.when(v.isNull(), None).when(v <= good, 2).when(v <= fair, 1).otherwise(0)


def clamped_delta(baseline: Column, result: Column, floor: float) -> Column:
    """(baseline - result) over the baseline, at least floor, held in -1..1; a missing result is -1."""
    base = F.coalesce(baseline, F.lit(0.0))
    return F.when(result.isNull(), -1.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (base - result) / F.greatest(base, F.lit(floor)))))


def composite_score(lcp: Column, inp: Column, cls: Column, regression: Column) -> Column:
    """Weighted deltas, less 1 for a regression, held in -1..1."""
    score = 0.50 * lcp + 0.35 * inp + 0.15 * cls - F.when(regression, 1.0).otherwise(0.0)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score))


def improvement_pct(base: Column, new: Column) -> Column:
    """Percentage by which new is below base, two decimals; null unless base is positive."""
    return F.when(base > 0, F.round((base - new) / base * 100, 2))


def change_class(pct: Column) -> Column:
    return first_match([(pct > 5, "improved"), (pct < -5, "regressed")], "no_change")


def improved(before: Column, after: Column, meaningful: Column) -> Column:
    return F.coalesce(before - after >= meaningful, F.lit(False))


def degraded(before: Column, after: Column, noise: Column) -> Column:
    return F.coalesce(after - before > noise, F.lit(False))


def log_size(c: Column) -> Column:
    """log10 of positive numbers, null for others."""
    return F.when(c > 0, F.log10(c))


def yes_no(v: Column) -> Column:
    return F.when(v, "YES").when(~v, "NO").otherwise("ERR")


def token_split(completion: Column, reasoning: Column) -> Column:
    """Completion tokens without the reasoning ones, where both are known."""
    return F.when(completion.isNotNull() & (F.coalesce(reasoning, F.lit(0)) != 0), completion - reasoning).otherwise(completion)


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def box_area(w: Column, h: Column) -> Column:
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def box_iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Overlap over union of two boxes (x, y, width, height); 0 where the union is empty."""
    w = F.greatest(F.lit(0.0), F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1]))
    union = box_area(a[2], a[3]) + box_area(b[2], b[3]) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)

"""Sizes, positions, ticks and labels of the map and the time axis as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Range of the axis, segments and eras of the ruler, steps of ticks, opacity by role.
FIRST, LAST, LOG = -10000, 2000, 20
SEGMENTS = [(-10000, -5000, 1000), (-5000, -3200, 500), (-3200, -1200, 100), (-1200, 1500, 50), (1500, 1800, 50), (1800, 2000, 10)]
ERAS = [
    ("Paleolithic", -10000, -3500), ("Neolithic", -3500, -2200), ("Bronze Age", -2200, -1200), ("Iron Age", -1200, -500),
    ("Antiquity", -500, 500), ("Medieval", 500, 1500), ("Modern", 1500, 2000),
]
TICKS = [1, 2, 5, 10, 20, 25, 50, 100, 200, 500, 1000, 2000, 5000, 10000]
OPACITY = {"state": 0.3, "major": 0.24, "minor": 0.17, "minority": 0.12}


def to_scale(year: Column, mode: str, first: int = FIRST, last: int = LAST) -> Column:
    """The place of a year on the axis, 0 to 1."""
    x = (year - first) / float(last - first)
    return {"linear": x, "sqrt": 1 - F.sqrt(1 - x), "log": 1 - F.log1p((1 - x) * LOG) / F.log1p(F.lit(float(LOG)))}[mode]


def from_scale(place: Column, mode: str, first: int = FIRST, last: int = LAST) -> Column:
    """The year at a place of the axis, halves upwards."""
    x = {"linear": place, "sqrt": 1 - (1 - place) * (1 - place), "log": 1 - (F.exp((1 - place) * F.log1p(F.lit(float(LOG)))) - 1) / LOG}[mode]
    return F.floor(first + x * (last - first) + 0.5).cast("int")


def play_step(year: Column) -> Column:
    """The step of the segment a year lies in, outside that of the last."""
    step = F.lit(SEGMENTS[-1][2])
    for a, b, size in reversed(SEGMENTS):
        step = F.when((year >= a) & (year < b), size).otherwise(step)
    return step


def era(year: Column) -> Column:
    """The era that begins in a year."""
    name = F.lit(None).cast("string")
    for label, a, _ in ERAS:
        name = F.when(year == a, label).otherwise(name)
    return name


def marker_size(score: Column, zoom: float) -> Column:
    """Pixels of a marker: by the root of its score, within a range that widens with the zoom."""
    t = (min(10.0, max(2.0, zoom)) - 2) / 8
    low, high = 6 + t * 8, 14 + t * 26
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), score / 170.0))
    return F.floor(low + (high - low) * F.sqrt(share) + 0.5).cast("int")


def tick_step(span: Column, width: int) -> Column:
    """The finest step that leaves 70 pixels between ticks."""
    fits = F.filter(F.array(*[F.lit(s) for s in TICKS]), lambda s: F.lit(float(width)) * s / span >= 70)
    return F.coalesce(F.try_element_at(fits, F.lit(1)), F.lit(TICKS[-1]))


def tick_label(year: Column) -> Column:
    size = F.abs(year)
    short = F.floor(size / 100.0 + 0.5) / 10
    text = F.when(short == F.floor(short), F.floor(short).cast("string")).otherwise(short.cast("string"))
    return F.when(year >= 0, F.concat(year.cast("string"), F.lit(" AD"))).when(size >= 1000, F.concat(text, F.lit("k BC"))).otherwise(F.concat(size.cast("string"), F.lit(" BC")))


def year_shown(year: Column) -> Column:
    """A year with its era; 0 is shown as 1 BC."""
    return F.concat(F.format_number(F.greatest(F.abs(year), F.lit(1)), 0), F.when(year <= 0, " BC").otherwise(" AD"))


def role_opacity(role: Column) -> Column:
    out = F.lit(0.26)
    for name, value in OPACITY.items():
        out = F.when(role == name, value).otherwise(out)
    return out

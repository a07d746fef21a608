"""Scores, thresholds, years and colours as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Score of each type of site, thresholds by zoom, segments of the time scale.
TYPE_SCORE = {
    "capital": 100, "capital_city": 100, "metropolis": 90, "city": 75, "religious_site": 65, "fortress": 60, "port": 60, "town": 50,
    "colony": 45, "administrative": 40, "village": 30, "settlement": 20, "ruins": 35, "campsite": 10, "abandoned": 15,
}
ZOOM = {2: 70, 3: 62, 4: 56, 5: 50, 6: 45, 7: 40, 8: 35, 9: 31, 10: 27, 11: 24, 12: 21}
BASE_ZOOM = {2: 49, 3: 47, 4: 45, 5: 44, 6: 43, 7: 42, 8: 41, 9: 35, 10: 28, 11: 20, 12: 0}


def _int(c: Column) -> Column:
    return F.rint(c).cast("int")


def base_importance(sitelinks: Column, article: Column) -> Column:
    """0 without sitelinks and article, else by sitelinks on a log scale and 8 more for an article, 100 at most."""
    n = F.coalesce(sitelinks, F.lit(0))
    has = article.isNotNull()
    score = _int(20 * F.log10(n + 1)) + F.when(has, 8).otherwise(0)
    return F.when((n == 0) & ~has, 0).otherwise(F.least(F.lit(100), score))


def importance(site_type: Column, population: Column, timeline: Column) -> Column:
    """Type, population on a log scale and 10 for a timeline, 100 at most."""
    score = F.lit(20)
    for name, value in TYPE_SCORE.items():
        score = F.when(site_type == name, value).otherwise(score)
    people = F.when(population > 0, F.least(F.lit(30), _int(F.log10(population.cast("double")) * 8))).otherwise(0)
    return F.least(F.lit(100), score + people + F.when(timeline, 10).otherwise(0))


def importance_shown(site_type: Column, population: Column, timeline: Column, events: Column) -> Column:
    """The score that a viewer works out: as ``importance``, but the population's share is cut to a whole number instead of rounded, and
    events add 5. A population that is null counts nothing, one below 1 as 1."""
    score = F.lit(20)
    for name, value in TYPE_SCORE.items():
        score = F.when(site_type == name, value).otherwise(score)
    people = F.when(population.isNotNull(), F.least(F.lit(30), F.floor(F.log10(F.greatest(population, F.lit(1)).cast("double")) * 8))).otherwise(0)
    return F.least(F.lit(100), score + people + F.when(timeline, 10).otherwise(0) + F.when(F.coalesce(events, F.lit(False)), 5).otherwise(0)).cast("int")


def at_zoom(table: dict[int, int], zoom: float) -> int:
    return table[min(12, max(2, int(zoom // 1)))]


def wikidata_year(text: Column) -> Column:
    """The year of a timestamp text in historical count, so without a year 0; null outside −200000..2100."""
    sign = F.when(text.startswith("-"), -1).otherwise(1)
    year = F.try_cast(F.regexp_extract(text, r"^[+-]?(\d+)-", 1), "bigint") * sign if hasattr(F, "try_cast") else F.regexp_extract(text, r"^[+-]?(\d+)-", 1).try_cast("bigint") * sign
    return F.when(year.between(-200000, 2100), F.when(year <= 0, year - 1).otherwise(year)).cast("int")


def year_text(year: Column, precision: Column, circa: Column) -> Column:
    """A year as it is shown: by millennium, century, decade or itself."""
    size = F.abs(year)
    era = F.when(year < 0, " BC").otherwise(" AD")
    body = (
        F.when(precision <= 6, F.concat(F.ceil(size / 1000).cast("string"), F.lit("th mill.")))
        .when(precision == 7, F.concat(F.ceil(size / 100).cast("string"), F.lit("th c.")))
        .when(precision == 8, F.concat((F.floor(size / 10) * 10).cast("string"), F.lit("s")))
        .otherwise(size.cast("string"))
    )
    return F.concat(F.when(circa, "c. ").otherwise(""), body, era)


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of a text's code points."""
    return F.aggregate(
        F.filter(F.split(text, ""), lambda c: c != ""),
        F.lit(2166136261).cast("bigint"),
        lambda h, c: h.bitwiseXOR(F.ascii(c).cast("bigint")) * 16777619 % 4294967296,
    )


# Ladders of the colours of entities, and the golden ratio's share of the circle of hues.
SATURATIONS, LIGHTNESSES, GOLDEN = (62, 48, 74, 38), (52, 42, 62, 34, 70), 0.618033988749895


def entity_color(qid: Column, family: Column) -> tuple[Column, Column, Column]:
    """(hue, saturation, lightness) of an entity: its family, if it has one, gives the hue, which its own hash then moves by 12 degrees at
    most; its hash also picks from the ladders. Never stored, always the same."""
    related = F.coalesce(family != "", F.lit(False))
    seed, own = fnv1a(F.when(related, family).otherwise(qid)), fnv1a(qid)
    nudge = F.when(related, own % 25 - 12).otherwise(F.lit(0))
    hue = F.round((((seed / 4294967295.0 + GOLDEN) % 1) * 360 + nudge) % 360, 1)
    saturation = F.element_at(F.array(*[F.lit(x) for x in SATURATIONS]), (1 + own % 4).cast("int"))
    lightness = F.element_at(F.array(*[F.lit(x) for x in LIGHTNESSES]), (1 + F.floor(own / 4) % 5).cast("int"))
    return hue, saturation, lightness


def stroke(saturation: Column, lightness: Column) -> tuple[Column, Column]:
    """Saturation and lightness of the outline: the darkened fill."""
    return F.least(F.lit(100), saturation + 12), F.greatest(F.lit(12), lightness - 24)

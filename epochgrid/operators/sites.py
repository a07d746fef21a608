"""Sites as the map shows them at a year: scored, filtered, ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochgrid.functions.numbers import BASE_ZOOM, ZOOM, at_zoom, base_importance, importance
from epochgrid.operators.temporal import latest_entry

MOST, FEWEST = 500, 40


def scored(sites: DataFrame, entries: DataFrame, year: int) -> DataFrame:
    """Sites with their state at a year: type, polity, culture, both scores, and whether they are occupied."""
    now = latest_entry(entries.filter(F.col("track").isin("site_type", "polity", "culture", "population")), year, ["site_id", "track"])
    state = now.groupBy("site_id").agg(
        *[F.max(F.when(F.col("track") == k, F.col("label"))).alias(f"now_{k}") for k in ("site_type", "polity", "culture", "population")],
        F.max(F.when(F.col("track") == "site_type", F.col("to_year"))).alias("closed"),
    )
    rows = sites.join(state, sites.id == state.site_id, "left").drop("site_id")
    told = F.col("timeline").isNotNull()
    people = F.col("now_population").try_cast("bigint")
    base = base_importance(F.col("sitelinks_count"), F.col("wikipedia_page_en_url"))
    return rows.select(
        "id", F.col("title_en").alias("title"), "lon", "lat", "inception_year", "dissolution_year", told.alias("has_timeline"),
        F.coalesce("now_site_type", "site_type", F.lit("settlement")).alias("site_type"), F.col("now_polity").alias("polity"), F.col("now_culture").alias("culture"),
        base.alias("base_importance"), (base + importance(F.col("now_site_type"), people, told)).alias("computed_importance"),
        F.coalesce(F.col("closed") >= year, F.lit(True)).alias("occupied"),
    )


def alive(year: int) -> Column:
    yes = F.lit(True)
    return F.coalesce(F.col("inception_year") <= year, yes) & F.coalesce(F.col("dissolution_year") >= year, yes)


def within(west: float, south: float, east: float, north: float) -> Column:
    """Inside a box; its border doesn't belong to it."""
    return (F.col("lon") > west) & (F.col("lon") < east) & (F.col("lat") > south) & (F.col("lat") < north)


def markers(
    sites: DataFrame, entries: DataFrame, year: int, zoom: float, box: tuple[float, float, float, float], timeline: str = "all", fewest: int = FEWEST, most: int = MOST
) -> DataFrame:
    """The sites to show: those over both thresholds of the zoom, the best ``most`` of them. Where fewer than ``fewest`` pass, the
    best ``fewest`` of all with a base score; the order stays the same."""
    rows = scored(sites.filter(within(*box)), entries, year).filter(alive(year) & F.col("occupied"))
    if timeline != "all":
        rows = rows.filter(F.col("has_timeline") == (timeline == "timeline_only"))
    base = at_zoom(BASE_ZOOM, zoom)
    order = [F.col("base_importance").desc()] if base > 0 else []
    order += [F.col("computed_importance").desc(), F.col("id")]
    passes = (F.col("computed_importance") >= at_zoom(ZOOM, zoom)) & (F.col("base_importance") >= base)
    strict = rows.filter(passes).orderBy(*order).limit(most)
    if fewest <= 0:
        return strict
    relaxed = rows.filter("base_importance >= 1").orderBy(*order).limit(fewest)
    enough = strict.agg((F.count("*") >= fewest).alias("enough"))  # one row
    both = strict.withColumn("strict", F.lit(True)).unionByName(relaxed.withColumn("strict", F.lit(False)))
    return both.crossJoin(F.broadcast(enough)).filter("strict = enough").drop("strict", "enough")

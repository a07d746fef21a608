"""Reads of timelines at a year, and what their entries close.

All take entries (site_id, track, ordinal, from_year, to_year, label, qid, role, confidence, entity). An entry without a start is never
read. Of entries that start in one year the one later in its list counts. ``keys`` let a frame of years be joined first,
so that many years are read in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochgrid.functions.text import role_rank

# How each track is read, and the tracks whose entries may be closed.
STEP, COOCCURRENT, OCCUPATION = ["polity", "culture", "name", "population"], ["religion", "language"], ["site_type"]
CLOSABLE = ["polity", "culture", "religion", "language"]
TERMINAL_TYPES, TERMINAL_EVENTS = ["abandoned", "ruins"], ["abandonment", "expulsion", "depopulation"]


def _last() -> list[Column]:
    return [F.col("from_year").desc(), F.col("ordinal").desc()]


def _first() -> list[Column]:
    return [F.col("from_year").asc(), F.col("ordinal").asc()]


def started(entries: DataFrame, year: Column | int) -> DataFrame:
    return entries.filter(F.col("from_year") <= (F.lit(year) if isinstance(year, int) else year))


def latest_entry(entries: DataFrame, year: Column | int, keys: list[str]) -> DataFrame:
    """The entry that started last up to a year, per keys. Ranked before the shuffle too."""
    best = Window.partitionBy(*keys).orderBy(*_last())
    return started(entries, year).withColumn("rank", F.row_number().over(best)).filter("rank = 1").drop("rank")


def as_of(entries: DataFrame, year: int, honor_to: bool | None = False) -> DataFrame:
    """The entry of each site and track at a year. With ``honor_to`` a closed one is none; None: only on closable tracks."""
    now = latest_entry(entries, year, ["site_id", "track"])
    if honor_to is False:
        return now
    closed = F.col("to_year") < year
    if honor_to is None:
        closed = closed & F.col("track").isin(CLOSABLE)
    return now.filter(~F.coalesce(closed, F.lit(False)))


def active(entries: DataFrame, year: int) -> DataFrame:
    """All entries alive at a year: the last one of a step track, the last one of each entity of a co-occurrent track; those
    closed before are dropped. Occupation tracks have none."""
    step = latest_entry(entries.filter(F.col("track").isin(STEP)), year, ["site_id", "track"])
    shared = latest_entry(entries.filter(F.col("track").isin(COOCCURRENT) & F.col("entity").isNotNull()), year, ["site_id", "track", "entity"])
    return step.unionByName(shared).filter(F.coalesce(F.col("to_year") >= year, F.lit(True)))


def ranked(found: DataFrame) -> DataFrame:
    """With ``position``: by role, then by start."""
    order = Window.partitionBy("site_id", "track").orderBy(role_rank(F.col("role")), "from_year", "ordinal")
    return found.withColumn("position", F.row_number().over(order))


def sovereign(entries: DataFrame, entities: DataFrame, year: int) -> DataFrame:
    """The last polity at a year that isn't known to be subordinate, unless it or its entity has ended."""
    known = entities.select("qid", "subordinate", "dissolution")
    candidates = entries.filter("track = 'polity'").join(known, "qid", "left").filter(~F.coalesce("subordinate", F.lit(False)))
    now = latest_entry(candidates, year, ["site_id"])
    return now.filter(F.coalesce(F.col("to_year") >= year, F.lit(True)) & F.coalesce(F.col("dissolution") >= year, F.lit(True)))


def occupied(sites: DataFrame, entries: DataFrame, year: int) -> DataFrame:
    """(site_id, occupied): false only after the explicit end of the type read at the year."""
    now = latest_entry(entries.filter("track = 'site_type'"), year, ["site_id"]).select("site_id", "to_year")
    return sites.select(F.col("id").alias("site_id")).join(now, "site_id", "left").select("site_id", F.coalesce(F.col("to_year") >= year, F.lit(True)).alias("occupied"))


def occupation_gaps(entries: DataFrame) -> DataFrame:
    """(site_id, from_year, to_year) between the end of a type and the start of the next."""
    order = Window.partitionBy("site_id").orderBy(*_first())
    types = entries.filter("track = 'site_type' and from_year is not null").withColumn("next", F.lead("from_year").over(order))
    return types.filter("to_year < next").select("site_id", F.col("to_year").alias("from_year"), F.col("next").alias("to_year"))


def segments(entries: DataFrame, end_year: int) -> DataFrame:
    """Entries of co-occurrent tracks closed per entity: by their end, else by the entity's next entry, else open."""
    order = Window.partitionBy("site_id", "track", "entity").orderBy(*_first())
    rows = entries.filter(F.col("track").isin(COOCCURRENT) & F.col("entity").isNotNull() & F.col("from_year").isNotNull())
    rows = rows.withColumn("next", F.lead("from_year").over(order))
    return rows.withColumn("open", F.col("to_year").isNull() & F.col("next").isNull()).withColumn(
        "to_year", F.greatest(F.coalesce("to_year", "next", F.lit(end_year)), F.col("from_year"))
    )


def lanes(entries: DataFrame, end_year: int) -> DataFrame:
    """One row for each entity: its label, best role, segments as text, and its place among the site's lanes."""
    made = segments(entries, end_year).groupBy("site_id", "track", "entity").agg(
        F.min_by("label", F.struct("from_year", "ordinal")).alias("label"),
        F.min(role_rank(F.col("role"))).cast("int").alias("role_rank"),
        F.min(F.struct("from_year", "ordinal")).alias("first"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("from_year", "ordinal", "to_year", "open"))),
                lambda s: F.concat(s["from_year"].cast("string"), F.lit(":"), s["to_year"].cast("string"), F.when(s["open"], "+").otherwise("")),
            ),
            " ",
        ).alias("segments"),
    )
    order = Window.partitionBy("site_id", "track").orderBy("role_rank", "first.from_year", "first.ordinal", "entity")
    return made.withColumn("lane", F.row_number().over(order)).withColumn("from_year", F.col("first.from_year")).drop("first")


def polity_lanes(entries: DataFrame, entities: DataFrame, end_year: int) -> DataFrame:
    """Polities in two tiers: a subordinate one is closed by the next entry, a sovereign one by the next sovereign."""
    known = entities.filter("subordinate").select("qid", F.lit(True).alias("sub"))
    rows = entries.filter("track = 'polity' and from_year is not null").join(known, "qid", "left").withColumn("sub", F.coalesce("sub", F.lit(False)))
    order = Window.partitionBy("site_id").orderBy(*_first())
    later = order.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("next", F.when(F.col("sub"), F.lead("from_year").over(order)).otherwise(F.first(F.when(~F.col("sub"), F.col("from_year")), ignorenulls=True).over(later)))
    return rows.select(
        "site_id", F.when(F.col("sub"), "subordinate").otherwise("sovereign").alias("tier"), "from_year", "ordinal",
        F.greatest(F.coalesce("to_year", "next", F.lit(end_year)), F.col("from_year")).alias("to_year"),
        (F.col("to_year").isNull() & F.col("next").isNull()).alias("open"), "label",
    )


def occupation_end(entries: DataFrame) -> DataFrame:
    """(site_id, occupation_end): the end of the last type, or its start if it is a terminal one."""
    last = Window.partitionBy("site_id").orderBy(*_last())
    types = entries.filter("track = 'site_type' and from_year is not null").withColumn("rank", F.row_number().over(last)).filter("rank = 1")
    return types.select("site_id", F.coalesce("to_year", F.when(F.col("label").isin(TERMINAL_TYPES), F.col("from_year"))).alias("occupation_end"))


def dissolution(entries: DataFrame, events: DataFrame) -> DataFrame:
    """(site_id, dissolution): the occupation's end, else the last terminal event if no entry starts after it. Sites without
    a type have none."""
    end = occupation_end(entries)
    terminal = events.filter(F.col("type").isin(TERMINAL_EVENTS)).groupBy("site_id").agg(F.max("year").alias("event"))
    last = entries.groupBy("site_id").agg(F.max("from_year").alias("last"))
    return end.join(terminal, "site_id", "left").join(last, "site_id", "left").select(
        "site_id", F.coalesce("occupation_end", F.when(F.col("last") <= F.col("event"), F.col("event"))).alias("dissolution")
    )


def step_blocks(entries: DataFrame, track_end: int) -> DataFrame:
    """Blocks of a step track as they are drawn: up to the end, the next entry or the track's end, and the gaps that ends leave."""
    order = Window.partitionBy("site_id", "track").orderBy(*_first())
    rows = entries.filter(F.col("track").isin(STEP) & F.col("from_year").isNotNull()).withColumn("next", F.lead("from_year").over(order))
    blocks = rows.select("site_id", "track", F.lit("block").alias("what"), "from_year", F.coalesce("to_year", "next", F.lit(track_end)).alias("to_year"), "label")
    gaps = rows.filter("to_year < next").select("site_id", "track", F.lit("gap").alias("what"), F.col("to_year").alias("from_year"), F.col("next").alias("to_year"), F.lit(None).cast("string").alias("label"))
    return blocks.unionByName(gaps).filter("to_year > from_year")


def years_of(entries: DataFrame, events: DataFrame) -> DataFrame:
    """(site_id, year, start): all years of a timeline; start for those that begin something."""
    return (
        entries.select("site_id", F.col("from_year").alias("year"), F.lit(True).alias("start"))
        .unionByName(entries.select("site_id", F.col("to_year").alias("year"), F.lit(False).alias("start")))
        .unionByName(events.select("site_id", "year", F.lit(True).alias("start")))
        .filter("year is not null")
    )


def visible(sites: DataFrame, entries: DataFrame, events: DataFrame, year: int, show_undated: bool = False) -> DataFrame:
    """(site_id, visible) at a year. Without a timeline a site needs a start and shows through its life."""
    bounds = years_of(entries, events).groupBy("site_id").agg(F.min("year").alias("first"))
    now = latest_entry(entries.filter("track = 'site_type'"), year, ["site_id"]).select("site_id", F.col("label").alias("now"), F.col("to_year").alias("closed"))
    rows = sites.select(F.col("id").alias("site_id"), "site_type", "inception_year", "dissolution_year", "has_timeline").join(bounds, "site_id", "left").join(now, "site_id", "left")
    yes = F.lit(True)
    told = (
        F.coalesce(F.col("first") <= year, yes)
        & F.coalesce(F.col("closed") >= year, yes)
        & (F.coalesce("now", "site_type", F.lit("settlement")) != "abandoned")
        & F.coalesce(F.col("dissolution_year") >= year, yes)
    )
    plain = F.when(F.col("inception_year").isNull(), F.lit(show_undated)).otherwise((F.col("inception_year") <= year) & F.coalesce(F.col("dissolution_year") >= year, yes))
    return rows.select("site_id", F.when(F.col("has_timeline"), told).otherwise(plain).alias("visible"))

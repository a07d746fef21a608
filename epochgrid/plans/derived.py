"""Queries that derive facts from whole timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochgrid.operators import temporal as t
from epochgrid.operators.timelines import SECTIONS
from epochgrid.plans.registry import query
from epochgrid.sources import silver


@query("SELECT site_id, string_agg(track, ',' ORDER BY track) AS tracks, CAST(sum(n) AS BIGINT) AS entries FROM (SELECT site_id, track, count(*) AS n FROM e GROUP BY 1, 2) GROUP BY site_id", "e")
def present_tracks(spark, d):
    n = silver.entries(spark, d).groupBy("site_id", "track").count()
    return n.groupBy("site_id").agg(F.array_join(F.array_sort(F.collect_list("track")), ",").alias("tracks"), F.sum("count").alias("entries"))


@query(
    """SELECT site_id, min(year) AS first_year, max(year) AS last_year, min(CASE WHEN start THEN year END) AS inception FROM (
         SELECT site_id, from_year AS year, true AS start FROM e UNION ALL SELECT site_id, to_year, false FROM e UNION ALL SELECT site_id, year, true FROM v)
       WHERE year IS NOT NULL GROUP BY site_id""",
    "e v",
)
def timeline_bounds(spark, d):
    years = t.years_of(silver.entries(spark, d), silver.events(spark, d))
    return years.groupBy("site_id").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.min(F.when(F.col("start"), F.col("year"))).alias("inception"))


@query(
    """WITH l AS (SELECT * FROM e WHERE track = 'site_type' AND from_year IS NOT NULL QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY from_year DESC, ordinal DESC) = 1),
       x AS (SELECT site_id, max(year) AS event FROM v WHERE type IN ('abandonment', 'expulsion', 'depopulation') GROUP BY site_id),
       a AS (SELECT site_id, max(from_year) AS last FROM e GROUP BY site_id)
       SELECT l.site_id, coalesce(to_year, CASE WHEN label IN ('abandoned', 'ruins') THEN from_year END) AS occupation_end,
         coalesce(to_year, CASE WHEN label IN ('abandoned', 'ruins') THEN from_year END, CASE WHEN last <= event THEN event END) AS dissolution
       FROM l LEFT JOIN x ON x.site_id = l.site_id LEFT JOIN a ON a.site_id = l.site_id""",
    "e v",
)
def timeline_dissolution(spark, d):
    entries = silver.entries(spark, d)
    return t.occupation_end(entries).join(t.dissolution(entries, silver.events(spark, d)), "site_id")


@query(
    "SELECT site_id, " + ", ".join(f"CAST(count(*) FILTER (WHERE section = '{s}') AS BIGINT) AS {s}" for s in SECTIONS) + " FROM it GROUP BY site_id",
    "it",
)
def track_count_pivot(spark, d):
    from epochgrid.operators.timelines import timeline_items

    items = timeline_items(silver.sites(spark, d).filter("timeline is not null"), "id", "timeline", ["record_id", "section"])
    return items.groupBy(F.col("record_id").alias("site_id")).pivot("section", SECTIONS).count().na.fill(0)


@query(
    """SELECT site_id, what, year, label, CAST(row_number() OVER (PARTITION BY site_id ORDER BY year, what, ordinal) AS INTEGER) AS position FROM (
         SELECT site_id, track AS what, from_year AS year, label, ordinal FROM e UNION ALL SELECT site_id, 'event', year, type, ordinal FROM v) WHERE year IS NOT NULL""",
    "e v",
)
def chronological_list(spark, d):
    from pyspark.sql import Window

    rows = silver.entries(spark, d).select("site_id", F.col("track").alias("what"), F.col("from_year").alias("year"), "label", "ordinal")
    rows = rows.unionByName(silver.events(spark, d).select("site_id", F.lit("event").alias("what"), "year", F.col("type").alias("label"), "ordinal"))
    order = Window.partitionBy("site_id").orderBy("year", "what", "ordinal")
    return rows.filter("year is not null").withColumn("position", F.row_number().over(order)).drop("ordinal")

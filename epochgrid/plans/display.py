"""Queries for what is drawn, and the board of entities by what is left to do."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochgrid.functions import display as s
from epochgrid.functions.numbers import base_importance
from epochgrid.plans.atlas import BASE
from epochgrid.plans.registry import query
from epochgrid.sources import silver
from epochgrid.sources.tables import table


@query(f"SELECT id, CAST(floor(8 + (20.5 - 8) * sqrt(least(1.0, greatest(0.0, ({BASE}) / 170.0))) + 0.5) AS INTEGER) AS pixels FROM s", "s")
def marker_sizes(spark, d):
    score = base_importance(F.col("sitelinks_count"), F.col("wikipedia_page_en_url"))
    return silver.sites(spark, d).select("id", s.marker_size(score, 4).alias("pixels"))


_ERAS = " ".join(f"WHEN {a} THEN '{label}'" for label, a, _ in s.ERAS)


@query(
    "SELECT CAST(y AS BIGINT) AS year, CAST(y + s AS BIGINT) AS until, abs(y) || CASE WHEN y < 0 THEN ' BC' ELSE ' AD' END AS label, CASE y "
    + _ERAS
    + " END AS era FROM (SELECT unnest(generate_series(f, t - 1, s)) AS y, s FROM (VALUES "
    + ", ".join(map(str, s.SEGMENTS))
    + ") v(f, t, s))"
)
def ruler_with_eras(spark, d):
    rows = spark.createDataFrame(s.SEGMENTS, "f bigint, t bigint, s bigint").select(F.explode(F.sequence("f", F.col("t") - 1, F.col("s"))).alias("year"), "s")
    label = F.concat(F.abs("year").cast("string"), F.when(F.col("year") < 0, " BC").otherwise(" AD"))
    return rows.select("year", (F.col("year") + F.col("s")).alias("until"), label.alias("label"), s.era(F.col("year")).alias("era"))


@query(
    """WITH b AS (SELECT site_id, min(y) AS a, max(y) AS b FROM (SELECT site_id, from_year AS y FROM e UNION ALL SELECT site_id, to_year FROM e) WHERE y IS NOT NULL GROUP BY site_id HAVING max(y) > min(y)),
       t AS (SELECT *, coalesce(list_filter(["""
    + ", ".join(map(str, s.TICKS))
    + """], lambda x: 900.0 * x / (b - a) >= 70)[1], 10000) AS step FROM b),
       u AS (SELECT site_id, step, unnest(generate_series(CAST(ceil(a / step) * step AS BIGINT), b, step)) AS year FROM t)
       SELECT site_id, CAST(step AS INTEGER) AS step, year, CASE WHEN year >= 0 THEN year || ' AD' WHEN -year >= 1000 THEN CASE WHEN floor(-year / 100.0 + 0.5) % 10 = 0 THEN CAST(CAST(floor(-year / 100.0 + 0.5) / 10 AS BIGINT) AS VARCHAR)
         ELSE CAST(floor(-year / 100.0 + 0.5) / 10 AS VARCHAR) END || 'k BC' ELSE -year || ' BC' END AS label FROM u""",
    "e",
)
def axis_ticks(spark, d):
    e = silver.entries(spark, d)
    years = e.select("site_id", F.col("from_year").alias("y")).unionByName(e.select("site_id", F.col("to_year").alias("y"))).filter("y is not null")
    rows = years.groupBy("site_id").agg(F.min("y").alias("a"), F.max("y").alias("b")).filter("b > a")
    rows = rows.withColumn("step", s.tick_step(F.col("b") - F.col("a"), 900))
    start = (F.ceil(F.col("a") / F.col("step")) * F.col("step")).cast("bigint")
    # an axis without a tick is a step shorter than its start
    ticks = F.when(start <= F.col("b"), F.sequence(start, F.col("b"), F.col("step").cast("bigint")))
    return rows.select("site_id", "step", F.explode(ticks).alias("year")).withColumn("label", s.tick_label(F.col("year")))


@query(
    """SELECT DISTINCT from_year AS year, format('{:,}', greatest(abs(from_year), 1)) || CASE WHEN from_year <= 0 THEN ' BC' ELSE ' AD' END AS shown FROM e WHERE from_year IS NOT NULL""", "e"
)
def years_shown(spark, d):
    return silver.entries(spark, d).select(F.col("from_year").alias("year")).filter("year is not null").distinct().withColumn("shown", s.year_shown(F.col("year")))


@query(
    """WITH g AS (SELECT e.qid, e.track AS kind, w.label_en AS label, CAST(count(DISTINCT s.id) AS BIGINT) AS sites, CAST(count(DISTINCT s.id) FILTER (WHERE coalesce(enrichment_level, 'indexed') = 'indexed') AS BIGINT) AS indexed,
         CAST(count(DISTINCT s.id) FILTER (WHERE enrichment_level = 'extracted') AS BIGINT) AS extracted FROM e JOIN s ON s.id = e.site_id JOIN wikidata_entities w ON w.qid = e.qid WHERE e.track IN ('polity', 'culture') GROUP BY 1, 2, 3)
       SELECT *, CAST(row_number() OVER (ORDER BY indexed DESC, sites DESC, label, qid, kind) AS INTEGER) AS position FROM g WHERE extracted > 0 ORDER BY indexed DESC, sites DESC, label, qid, kind""",
    "e",
)
def attribution_board(spark, d):
    from pyspark.sql import Window

    names = table(spark, d, "wikidata_entities").select("qid", F.col("label_en").alias("label"))
    e = silver.entries(spark, d, ["polity", "culture"], ["enrichment_level"]).drop("label").join(names, "qid")
    level = F.coalesce("enrichment_level", F.lit("indexed"))
    board = e.groupBy("qid", F.col("track").alias("kind"), "label").agg(
        F.countDistinct("site_id").alias("sites"), F.countDistinct(F.when(level == "indexed", F.col("site_id"))).alias("indexed"), F.countDistinct(F.when(level == "extracted", F.col("site_id"))).alias("extracted")
    )
    order = [F.col("indexed").desc(), F.col("sites").desc(), "label", "qid", "kind"]
    return board.filter("extracted > 0").withColumn("position", F.row_number().over(Window.orderBy(*order)))


@query(
    """SELECT id, CASE WHEN title_en = wikidata_id AND names IS NOT NULL AND cardinality(names) > 0 THEN names[list_sort(map_keys(names))[1]] ELSE title_en END AS title_en,
       CASE WHEN title_en = wikidata_id AND names IS NOT NULL AND cardinality(names) > 0 THEN 'names' END AS title_source FROM s""",
    "s",
)
def guarded_patch(spark, d):
    fits = (F.col("title_en") == F.col("wikidata_id")) & (F.size("names") > 0)
    first = F.try_element_at("names", F.array_min(F.map_keys("names")))
    return silver.sites(spark, d).select("id", F.when(fits, first).otherwise(F.col("title_en")).alias("title_en"), F.when(fits, "names").alias("title_source"))


@query(
    """WITH n AS (SELECT qid, max(label_en) AS label, max(inception) AS inception FROM (SELECT qid, label_en, inception FROM wikidata_entities UNION ALL SELECT qid, resolved_label, NULL FROM languages_resolved WHERE qid <> 'NOT_FOUND') GROUP BY qid),
       o AS (SELECT qid FROM wikidata_entities WHERE active)
       SELECT CASE WHEN o.qid IS NULL THEN 'inserted' ELSE 'updated' END AS change, CAST(count(*) AS BIGINT) AS entities FROM n LEFT JOIN o ON o.qid = n.qid GROUP BY 1"""
)
def upsert_counts(spark, d):
    from epochgrid.operators.merge import merged

    w = table(spark, d, "wikidata_entities")
    listed = table(spark, d, "languages_resolved").filter("qid <> 'NOT_FOUND'").select("qid", F.col("resolved_label").alias("label_en"))
    new = w.select("qid", "label_en").unionByName(listed).groupBy("qid").agg(F.max("label_en").alias("label_en"))
    old = w.filter("active").select("qid", "label_en")
    return merged(old, new, "qid", {"label_en": "fill"}).groupBy("change").agg(F.count("*").alias("entities"))

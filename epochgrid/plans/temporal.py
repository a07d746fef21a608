"""Queries that read timelines at a year."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochgrid.operators import temporal as t
from epochgrid.plans.registry import query
from epochgrid.sources import silver
from epochgrid.sources.tables import table

YEAR = 1000
#: The entity key in SQL, and the rank of roles.
KEY = "CASE WHEN qid IS NOT NULL THEN 'qid:' || qid WHEN trim(label) <> '' THEN 'name:' || trim(regexp_replace(strip_accents(lower(label)), '\\s+', ' ', 'g')) END"
RANK = "CASE role WHEN 'state' THEN 0 WHEN 'major' THEN 1 WHEN 'minor' THEN 2 WHEN 'minority' THEN 3 ELSE 9 END"
LAST = "row_number() OVER (PARTITION BY {} ORDER BY from_year DESC, ordinal DESC) = 1"


@query(f"SELECT site_id, track, label AS value FROM e WHERE from_year <= {YEAR} QUALIFY {LAST.format('site_id, track')}", "e")
def asof_value(spark, d):
    return t.as_of(silver.entries(spark, d), YEAR).select("site_id", "track", F.col("label").alias("value"))


@query(
    f"""SELECT site_id, track, ordinal, from_year, label FROM (SELECT * FROM e WHERE from_year <= {YEAR} QUALIFY {LAST.format('site_id, track')})
        WHERE NOT (coalesce(to_year < {YEAR}, false) AND track IN ('polity', 'culture', 'religion', 'language'))""",
    "e",
)
def asof_entry_honor_to(spark, d):
    return t.as_of(silver.entries(spark, d), YEAR, None).select("site_id", "track", "ordinal", "from_year", "label")


_ACTIVE = f"""SELECT * FROM (
    SELECT * FROM e WHERE from_year <= {YEAR} AND track IN ('polity', 'culture', 'name', 'population') QUALIFY {LAST.format('site_id, track')}
    UNION ALL
    SELECT * FROM e WHERE from_year <= {YEAR} AND track IN ('religion', 'language') AND {KEY} IS NOT NULL QUALIFY {LAST.format('site_id, track, ' + KEY)})
    WHERE coalesce(to_year >= {YEAR}, true)"""


@query(f"SELECT site_id, track, ordinal, from_year, to_year, label, role FROM ({_ACTIVE})", "e")
def active_entries(spark, d):
    return t.active(silver.entries(spark, d), YEAR).select("site_id", "track", "ordinal", "from_year", "to_year", "label", "role")


@query(
    f"""SELECT site_id, track, CAST(row_number() OVER (PARTITION BY site_id, track ORDER BY {RANK}, from_year, ordinal) AS INTEGER) AS position, label, role
        FROM ({_ACTIVE}) WHERE track IN ('religion', 'language')""",
    "e",
)
def active_by_role(spark, d):
    found = t.active(silver.entries(spark, d, t.COOCCURRENT), YEAR)
    return t.ranked(found).select("site_id", "track", "position", "label", "role")


@query(
    f"""SELECT site_id, from_year, to_year, label, qid FROM (
          SELECT e.*, w.dissolution FROM e LEFT JOIN wikidata_entities w ON w.qid = e.qid
          WHERE track = 'polity' AND NOT coalesce(w.subordinate, false) AND from_year <= {YEAR} QUALIFY {LAST.format('site_id')})
        WHERE coalesce(to_year >= {YEAR}, true) AND coalesce(dissolution >= {YEAR}, true)""",
    "e",
)
def sovereign_asof(spark, d):
    found = t.sovereign(silver.entries(spark, d, ["polity"]), table(spark, d, "wikidata_entities"), YEAR)
    return found.select("site_id", "from_year", "to_year", "label", "qid")


@query(
    f"""SELECT s.id AS site_id, coalesce(n.to_year >= {YEAR}, true) AS occupied FROM s
        LEFT JOIN (SELECT * FROM e WHERE track = 'site_type' AND from_year <= {YEAR} QUALIFY {LAST.format('site_id')}) n ON n.site_id = s.id""",
    "e",
)
def occupied_at(spark, d):
    return t.occupied(silver.sites(spark, d), silver.entries(spark, d, ["site_type"]), YEAR)


@query(
    """SELECT site_id, to_year AS from_year, next AS to_year FROM (SELECT site_id, to_year, lead(from_year) OVER (PARTITION BY site_id ORDER BY from_year, ordinal) AS next
       FROM e WHERE track = 'site_type' AND from_year IS NOT NULL) WHERE to_year < next""",
    "e",
)
def occupation_gaps(spark, d):
    return t.occupation_gaps(silver.entries(spark, d, ["site_type"]))


_SEGMENTS = f"""SELECT site_id, track, {KEY} AS entity, label, role, ordinal, from_year, lead(from_year) OVER w AS next, to_year AS own FROM e
    WHERE track IN ('religion', 'language') AND {KEY} IS NOT NULL AND from_year IS NOT NULL WINDOW w AS (PARTITION BY site_id, track, {KEY} ORDER BY from_year, ordinal)"""


@query(
    f"""WITH g AS ({_SEGMENTS}), l AS (
          SELECT site_id, track, entity, arg_min(label, struct_pack(a := from_year, b := ordinal)) AS label, CAST(min({RANK}) AS INTEGER) AS role_rank,
            min(struct_pack(a := from_year, b := ordinal)) AS f,
            string_agg(from_year || ':' || greatest(coalesce(own, next, 2025), from_year) || CASE WHEN own IS NULL AND next IS NULL THEN '+' ELSE '' END, ' ' ORDER BY from_year, ordinal) AS segments
          FROM g GROUP BY site_id, track, entity)
        SELECT site_id, track, entity, label, role_rank, segments, f.a AS from_year,
          CAST(row_number() OVER (PARTITION BY site_id, track ORDER BY role_rank, f.a, f.b, entity) AS INTEGER) AS lane FROM l""",
    "e",
)
def entity_lanes(spark, d):
    return t.lanes(silver.entries(spark, d, t.COOCCURRENT), 2025)


@query(
    """WITH p AS (SELECT e.*, coalesce(w.subordinate, false) AS sub FROM e LEFT JOIN wikidata_entities w ON w.qid = e.qid WHERE track = 'polity' AND from_year IS NOT NULL),
       n AS (SELECT *, CASE WHEN sub THEN lead(from_year) OVER (PARTITION BY site_id ORDER BY from_year, ordinal)
         ELSE min(CASE WHEN NOT sub THEN from_year END) OVER (PARTITION BY site_id ORDER BY from_year, ordinal ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) END AS next FROM p)
       SELECT site_id, CASE WHEN sub THEN 'subordinate' ELSE 'sovereign' END AS tier, from_year, ordinal, greatest(coalesce(to_year, next, 2025), from_year) AS to_year,
         to_year IS NULL AND next IS NULL AS open, label FROM n""",
    "e",
)
def polity_lanes(spark, d):
    return t.polity_lanes(silver.entries(spark, d, ["polity"]), table(spark, d, "wikidata_entities"), 2025)


@query(f"SELECT site_id, track, ordinal, from_year, label FROM e WHERE from_year <= {YEAR}", "e")
def entries_in_range(spark, d):
    return t.started(silver.entries(spark, d), YEAR).select("site_id", "track", "ordinal", "from_year", "label")


@query(
    """WITH n AS (SELECT *, lead(from_year) OVER (PARTITION BY site_id, track ORDER BY from_year, ordinal) AS next FROM e
         WHERE track IN ('polity', 'culture', 'name', 'population') AND from_year IS NOT NULL)
       SELECT * FROM (SELECT site_id, track, 'block' AS what, from_year, coalesce(to_year, next, 2025) AS to_year, label FROM n
         UNION ALL SELECT site_id, track, 'gap', to_year, next, NULL FROM n WHERE to_year < next) WHERE to_year > from_year""",
    "e",
)
def step_blocks(spark, d):
    return t.step_blocks(silver.entries(spark, d, t.STEP), 2025)


_NOW = f"(SELECT * FROM e WHERE from_year <= {YEAR} QUALIFY {LAST.format('site_id, track')})"


@query(
    f"""SELECT site_id, max(CASE WHEN track = 'site_type' THEN label END) AS site_type, max(CASE WHEN track = 'polity' THEN label END) AS polity,
          max(CASE WHEN track = 'culture' THEN label END) AS culture, max(CASE WHEN track = 'name' THEN label END) AS name, max(from_year) AS since
        FROM {_NOW} WHERE track IN ('site_type', 'polity', 'culture', 'name') AND NOT (coalesce(to_year < {YEAR}, false) AND track IN ('polity', 'culture')) GROUP BY site_id""",
    "e",
)
def current_state(spark, d):
    tracks = ["site_type", "polity", "culture", "name"]
    now = t.as_of(silver.entries(spark, d, tracks), YEAR, None)
    return now.groupBy("site_id").agg(*[F.max(F.when(F.col("track") == k, F.col("label"))).alias(k) for k in tracks], F.max("from_year").alias("since"))


@query(
    f"""WITH y AS (SELECT site_id, min(year) AS first FROM (SELECT site_id, from_year AS year FROM e UNION ALL SELECT site_id, to_year FROM e UNION ALL SELECT site_id, year FROM v) WHERE year IS NOT NULL GROUP BY 1),
        n AS (SELECT site_id, label, to_year FROM e WHERE track = 'site_type' AND from_year <= {YEAR} QUALIFY {LAST.format('site_id')})
        SELECT s.id AS site_id, CASE WHEN j.id IS NOT NULL THEN coalesce(first <= {YEAR}, true) AND coalesce(n.to_year >= {YEAR}, true)
            AND coalesce(n.label, s.site_type, 'settlement') <> 'abandoned' AND coalesce(s.dissolution_year >= {YEAR}, true)
          WHEN s.inception_year IS NULL THEN false ELSE s.inception_year <= {YEAR} AND coalesce(s.dissolution_year >= {YEAR}, true) END AS visible
        FROM s LEFT JOIN (SELECT DISTINCT site_id AS id FROM e UNION SELECT site_id FROM v) j ON j.id = s.id LEFT JOIN y ON y.site_id = s.id LEFT JOIN n ON n.site_id = s.id""",
    "e v",
)
def site_visible(spark, d):
    entries, events = silver.entries(spark, d), silver.events(spark, d)
    told = entries.select("site_id").unionByName(events.select("site_id")).distinct().select(F.col("site_id").alias("id"), F.lit(True).alias("has_timeline"))
    sites = silver.sites(spark, d).join(told, "id", "left").withColumn("has_timeline", F.coalesce("has_timeline", F.lit(False)))
    return t.visible(sites, entries, events, YEAR)


@query(
    f"""SELECT s.id AS site_id, coalesce(n.label, s.site_type, 'settlement') AS site_type FROM s
        LEFT JOIN (SELECT * FROM e WHERE track = 'site_type' AND from_year <= {YEAR} QUALIFY {LAST.format('site_id')}) n ON n.site_id = s.id""",
    "e",
)
def effective_site_type(spark, d):
    now = t.latest_entry(silver.entries(spark, d, ["site_type"]), YEAR, ["site_id"]).select("site_id", "label")
    sites = silver.sites(spark, d).select(F.col("id").alias("site_id"), F.col("site_type").alias("own"))
    return sites.join(now, "site_id", "left").select("site_id", F.coalesce("label", "own", F.lit("settlement")).alias("site_type"))


@query("SELECT qid, kind, label_en FROM wikidata_entities WHERE coalesce(dissolution >= 500, true) AND coalesce(inception <= 1500, true) AND (inception IS NOT NULL OR dissolution IS NOT NULL)")
def entity_interval_overlap(spark, d):
    yes = F.lit(True)
    e = table(spark, d, "wikidata_entities")
    dated = F.col("inception").isNotNull() | F.col("dissolution").isNotNull()
    return e.filter(F.coalesce(F.col("dissolution") >= 500, yes) & F.coalesce(F.col("inception") <= 1500, yes) & dated).select("qid", "kind", "label_en")


@query(f"SELECT id FROM s WHERE coalesce(inception_year <= {YEAR}, true) AND coalesce(dissolution_year >= {YEAR}, true)", "s")
def site_life_filter(spark, d):
    yes = F.lit(True)
    return silver.sites(spark, d).filter(F.coalesce(F.col("inception_year") <= YEAR, yes) & F.coalesce(F.col("dissolution_year") >= YEAR, yes)).select("id")


@query(
    f"""WITH y AS (SELECT CAST(unnest(generate_series(-500, 2000, 500)) AS BIGINT) AS year)
        SELECT year, track, CAST(count(*) AS BIGINT) AS sites, CAST(count(DISTINCT label) AS BIGINT) AS labels FROM (
          SELECT y.year, e.* FROM e JOIN y ON e.from_year <= y.year WHERE track IN ('site_type', 'polity', 'culture')
          QUALIFY row_number() OVER (PARTITION BY y.year, site_id, track ORDER BY from_year DESC, ordinal DESC) = 1) GROUP BY year, track""",
    "e",
)
def animation_years(spark, d):
    years = spark.range(-500, 2001, 500).withColumnRenamed("id", "year")
    entries = silver.entries(spark, d, ["site_type", "polity", "culture"])
    now = t.latest_entry(entries.join(F.broadcast(years), F.col("from_year") <= F.col("year")), F.col("year"), ["year", "site_id", "track"])
    return now.groupBy("year", "track").agg(F.count("*").alias("sites"), F.countDistinct("label").alias("labels"))

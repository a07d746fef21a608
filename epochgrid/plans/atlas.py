"""Queries behind the map, the search, the boards and the ingestion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from epochgrid.functions import numbers
from epochgrid.functions.display import SEGMENTS
from epochgrid.functions.text import CLEANED, cleaned, entity_key, plain_name, role_rank, unaccent
from epochgrid.operators import geo, merge, search
from epochgrid.operators import sites as on_map
from epochgrid.operators import temporal as t
from epochgrid.plans.registry import query
from epochgrid.plans.temporal import KEY, LAST, RANK, YEAR
from epochgrid.sources import silver
from epochgrid.sources.tables import table

TYPES = ", ".join(f"WHEN '{k}' THEN {v}" for k, v in numbers.TYPE_SCORE.items())
BASE = """CASE WHEN coalesce(sitelinks_count, 0) = 0 AND wikipedia_page_en_url IS NULL THEN 0
    ELSE least(100, CAST(round_even(20 * log10(coalesce(sitelinks_count, 0) + 1), 0) AS INTEGER) + CASE WHEN wikipedia_page_en_url IS NOT NULL THEN 8 ELSE 0 END) END"""
SCORED = f"""n AS (SELECT * FROM e WHERE from_year <= {YEAR} AND track IN ('site_type', 'polity', 'culture', 'population') QUALIFY {LAST.format('site_id, track')}),
    p AS (SELECT site_id, max(label) FILTER (WHERE track = 'site_type') AS nt, max(label) FILTER (WHERE track = 'polity') AS polity, max(label) FILTER (WHERE track = 'culture') AS culture,
        TRY_CAST(max(label) FILTER (WHERE track = 'population') AS BIGINT) AS pop, max(to_year) FILTER (WHERE track = 'site_type') AS closed FROM n GROUP BY site_id),
    b AS (SELECT s.*, p.*, timeline IS NOT NULL AS has_timeline, {BASE} AS base_importance FROM s LEFT JOIN p ON p.site_id = s.id),
    x AS (SELECT *, base_importance + least(100, CASE nt {TYPES.replace(', ', ' ')} ELSE 20 END + CASE WHEN pop > 0 THEN least(30, CAST(round_even(log10(CAST(pop AS DOUBLE)) * 8, 0) AS INTEGER)) ELSE 0 END
        + CASE WHEN has_timeline THEN 10 ELSE 0 END) AS computed_importance FROM b),
    w AS (SELECT *, coalesce(nt, x.site_type, 'settlement') AS now_type FROM x WHERE coalesce(inception_year <= {YEAR}, true) AND coalesce(dissolution_year >= {YEAR}, true) AND coalesce(closed >= {YEAR}, true))"""
_COLUMNS = ["id", "title", "lon", "lat", "site_type", "polity", "culture", "base_importance", "computed_importance", "has_timeline"]
_PICKED = "id, title_en AS title, lon, lat, now_type AS site_type, polity, culture, CAST(base_importance AS INTEGER) AS base_importance, CAST(computed_importance AS INTEGER) AS computed_importance, has_timeline"


def _map(spark, d, **more):
    tracks = ["site_type", "polity", "culture", "population"]
    return on_map.markers(silver.sites(spark, d), silver.entries(spark, d, tracks), YEAR, **more).select(_COLUMNS)


@query(
    f"WITH {SCORED} SELECT {_PICKED} FROM w WHERE lon > -180 AND lon < 180 AND lat > -60 AND lat < 75 AND computed_importance >= 31 AND base_importance >= 35 ORDER BY w.base_importance DESC, w.computed_importance DESC, id LIMIT 500",
    "e",
)
def markers_topk(spark, d):
    return _map(spark, d, zoom=9.7, box=(-180, -60, 180, 75), fewest=0)


@query(
    f"WITH {SCORED} SELECT {_PICKED} FROM w WHERE lon > -60 AND lon < 60 AND lat > -60 AND lat < 75 AND base_importance >= 1 ORDER BY w.base_importance DESC, w.computed_importance DESC, id LIMIT 40",
    "e",
)
def markers_fallback(spark, d):
    return _map(spark, d, zoom=2, box=(-60, -60, 60, 75))


@query(
    f"WITH {SCORED} SELECT {_PICKED} FROM w WHERE lon > -180 AND lon < 180 AND lat > -60 AND lat < 75 AND has_timeline AND computed_importance >= 21 ORDER BY w.computed_importance DESC, id LIMIT 500",
    "e",
)
def markers_with_timeline(spark, d):
    return _map(spark, d, zoom=12, box=(-180, -60, 180, 75), timeline="timeline_only", fewest=0)


@query(
    """SELECT qid, track, CAST(count(DISTINCT site_id) AS BIGINT) AS sites, CAST(count(*) AS BIGINT) AS entries FROM e JOIN s ON s.id = e.site_id
       WHERE qid IS NOT NULL AND track IN ('polity', 'culture', 'religion', 'language') AND s.enrichment_level = 'extracted' GROUP BY qid, track""",
    "e",
)
def entity_usage(spark, d):
    e = silver.entries(spark, d, ["polity", "culture", "religion", "language"], ["enrichment_level"]).filter("qid is not null and enrichment_level = 'extracted'")
    return e.groupBy("qid", "track").agg(F.countDistinct("site_id").alias("sites"), F.count("*").alias("entries"))


@query(
    """SELECT w.qid, w.kind, w.label_en, coalesce(u.sites, 0) AS sites FROM wikidata_entities w LEFT JOIN (SELECT qid, CAST(count(DISTINCT site_id) AS BIGINT) AS sites FROM e
       WHERE qid IS NOT NULL AND track IN ('polity', 'culture', 'religion', 'language') GROUP BY qid) u ON u.qid = w.qid WHERE w.active""",
    "e",
)
def referential_usage(spark, d):
    used = silver.entries(spark, d, ["polity", "culture", "religion", "language"]).filter("qid is not null").groupBy("qid").agg(F.countDistinct("site_id").alias("sites"))
    rows = table(spark, d, "wikidata_entities").filter("active").join(used, "qid", "left")
    return rows.select("qid", "kind", "label_en", F.coalesce("sites", F.lit(0)).alias("sites"))


@query(
    """SELECT qid, label_en FROM wikidata_entities w WHERE active AND (kind IN ('religion', 'language') OR sitelinks_count >= 10 OR sitelinks_count IS NULL
       OR qid IN (SELECT qid FROM e WHERE qid IS NOT NULL))""",
    "e",
)
def referential_kept(spark, d):
    used = silver.entries(spark, d, ["polity", "culture", "religion", "language"]).select("qid").filter("qid is not null").distinct().withColumn("used", F.lit(True))
    rows = table(spark, d, "wikidata_entities").filter("active").join(used, "qid", "left")
    return rows.filter(F.col("kind").isin("religion", "language") | (F.col("sitelinks_count") >= 10) | F.col("sitelinks_count").isNull() | F.col("used")).select("qid", "label_en")


@query(
    """SELECT site_id, CAST(count(*) AS BIGINT) AS entries, string_agg(track || ':' || coalesce(label, ''), '; ' ORDER BY track, ordinal) AS names FROM e
       WHERE qid IS NULL AND track IN ('polity', 'culture', 'religion', 'language') GROUP BY site_id ORDER BY count(*) DESC, site_id LIMIT 101""",
    "e",
)
def no_qid_entries(spark, d):
    e = silver.entries(spark, d, ["polity", "culture", "religion", "language"]).filter("qid is null")
    names = F.transform(F.array_sort(F.collect_list(F.struct("track", "ordinal", F.coalesce("label", F.lit("")).alias("label")))), lambda x: F.concat_ws(":", x["track"], x["label"]))
    found = e.groupBy("site_id").agg(F.count("*").alias("entries"), F.array_join(names, "; ").alias("names"))
    return found.orderBy(F.col("entries").desc(), "site_id").limit(101)  # one more than shown, to tell whether there are more


@query(
    """SELECT c.name AS country, CAST(count(*) AS BIGINT) AS sites, CAST(count(*) FILTER (WHERE enrichment_level = 'indexed') AS BIGINT) AS indexed, CAST(count(*) FILTER (WHERE enrichment_level = 'extracted') AS BIGINT) AS extracted,
       CAST(count(*) FILTER (WHERE lon IS NULL) AS BIGINT) AS unplaced, round(avg(sitelinks_count), 6) AS sitelinks FROM s JOIN countries c ON c.qid = s.country_qid GROUP BY c.name HAVING count(*) >= 2""",
    "s",
)
def country_board(spark, d):
    level = F.col("enrichment_level")
    rows = silver.sites(spark, d).join(table(spark, d, "countries").select(F.col("qid").alias("country_qid"), F.col("name").alias("country_name")), "country_qid")
    board = rows.groupBy(F.col("country_name").alias("country")).agg(
        F.count("*").alias("sites"), F.count_if(level == "indexed").alias("indexed"), F.count_if(level == "extracted").alias("extracted"),
        F.count_if(F.col("lon").isNull()).alias("unplaced"), F.round(F.avg("sitelinks_count"), 6).alias("sitelinks"),
    )
    return board.filter("sites >= 2")


@query(
    """SELECT CAST(count(*) AS BIGINT) AS sites, CAST(count(*) FILTER (WHERE timeline IS NOT NULL) AS BIGINT) AS with_timeline, CAST(count(*) FILTER (WHERE enrichment_level = 'queued') AS BIGINT) AS queued,
       CAST(count(DISTINCT country_qid) AS BIGINT) AS countries, CAST(count(*) FILTER (WHERE title_en = wikidata_id) AS BIGINT) AS titled_by_qid FROM s""",
    "s",
)
def dashboard_counts(spark, d):
    return silver.sites(spark, d).agg(
        F.count("*").alias("sites"), F.count_if(F.col("timeline").isNotNull()).alias("with_timeline"), F.count_if(F.col("enrichment_level") == "queued").alias("queued"),
        F.countDistinct("country_qid").alias("countries"), F.count_if(F.col("title_en") == F.col("wikidata_id")).alias("titled_by_qid"),
    )


@query("SELECT kind, active, coalesce(subordinate, false) AS subordinate, CAST(count(*) AS BIGINT) AS entities FROM wikidata_entities GROUP BY 1, 2, 3")
def entity_group_counts(spark, d):
    return table(spark, d, "wikidata_entities").groupBy("kind", "active", F.coalesce("subordinate", F.lit(False)).alias("subordinate")).agg(F.count("*").alias("entities"))


@query(
    "SELECT qid, label_en FROM wikidata_entities WHERE active AND label_en ILIKE '%of%' ORDER BY sitelinks_count DESC NULLS LAST, qid LIMIT 25 OFFSET 25"
)
def entity_page(spark, d):
    rows = table(spark, d, "wikidata_entities").filter("active").filter(F.col("label_en").ilike("%of%"))
    return rows.orderBy(F.col("sitelinks_count").desc_nulls_last(), "qid").offset(25).limit(25).select("qid", "label_en")


@query(
    f"""SELECT id, title_en, CAST(CASE WHEN lower(title_en) = 'vel' THEN 0 WHEN starts_with(lower(title_en), 'vel') THEN 1 ELSE 2 END AS INTEGER) AS relevance FROM s WHERE title_en ILIKE '%vel%'
        ORDER BY 3, {BASE} DESC, id LIMIT 50""",
    "s",
)
def curation_relevance(spark, d):
    low = F.lower("title_en")
    rows = silver.sites(spark, d).filter(F.col("title_en").ilike("%vel%"))
    rows = rows.withColumn("relevance", F.when(low == "vel", 0).when(low.startswith("vel"), 1).otherwise(2))
    base = numbers.base_importance(F.col("sitelinks_count"), F.col("wikipedia_page_en_url"))
    return rows.orderBy("relevance", base.desc(), "id").limit(50).select("id", "title_en", "relevance")


@query("SELECT lon_min, lat_min FROM tiles WHERE status = 'pending' ORDER BY lat_min DESC, lon_min LIMIT 10")
def next_tiles(spark, d):
    return table(spark, d, "tiles").filter("status = 'pending'").orderBy(F.col("lat_min").desc(), "lon_min").limit(10).select("lon_min", "lat_min")


@query(
    """SELECT t.lon_min, t.lat_min, CAST(count(s.id) AS BIGINT) AS sites FROM (SELECT DISTINCT lon_min, lat_min FROM tiles) t LEFT JOIN s ON floor(s.lon) = t.lon_min AND floor(s.lat) = t.lat_min GROUP BY 1, 2""",
    "s",
)
def tile_counts(spark, d):
    tiles = table(spark, d, "tiles").select("lon_min", "lat_min").distinct()
    per = silver.sites(spark, d).groupBy(F.floor("lon").cast("int").alias("lon_min"), F.floor("lat").cast("int").alias("lat_min")).agg(F.count("*").alias("sites"))
    return tiles.join(per, ["lon_min", "lat_min"], "left").select("lon_min", "lat_min", F.coalesce("sites", F.lit(0)).alias("sites"))


@query(
    """WITH g AS (SELECT CAST(x AS INTEGER) AS lon_min, CAST(y AS INTEGER) AS lat_min FROM range(-180, 180) r(x), range(-60, 75) q(y))
       SELECT g.lon_min, g.lat_min FROM g WHERE EXISTS (SELECT 1 FROM tiles t WHERE t.lon_min < g.lon_min + 1.1 AND t.lon_min + 1 > g.lon_min - 0.1 AND t.lat_min < g.lat_min + 1.1 AND t.lat_min + 1 > g.lat_min - 0.1)"""
)
def tile_grid(spark, d):
    """Grid cells that a tile touches when widened by 0.1°: each tile names its nine neighbours, so no pair is compared."""
    step = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    near = table(spark, d, "tiles").select(F.col("lon_min").alias("x"), F.col("lat_min").alias("y")).withColumn("dx", step).withColumn("dy", step)
    cells = near.select((F.col("x") + F.col("dx")).alias("lon_min"), (F.col("y") + F.col("dy")).alias("lat_min")).distinct()
    grid = spark.range(-180, 180).select(F.col("id").cast("int").alias("lon_min"), F.explode(F.sequence(F.lit(-60), F.lit(74))).alias("lat_min"))
    return grid.join(cells, ["lon_min", "lat_min"], "left_semi")


@query(
    """SELECT id, arg_min(title_en, struct_pack(a := last_updated, b := source)) FILTER (WHERE title_en IS NOT NULL) AS title_en, arg_min(country, struct_pack(a := last_updated, b := source)) FILTER (WHERE country IS NOT NULL) AS country
       FROM (SELECT DISTINCT id, title_en, country, last_updated, source FROM sites WHERE id IS NOT NULL) GROUP BY id"""
)
def first_filled(spark, d):
    rows = table(spark, d, "sites").filter("id is not null").select("id", "title_en", "country", "last_updated", "source").distinct()
    return merge.first_filled(rows, "id", ["last_updated", "source"], ["title_en", "country"])


@query(
    """WITH o AS (SELECT id, inception_year, dissolution_year, sitelinks_count, title_en FROM s), n AS (SELECT id, max(inception_year) AS inception_year, max(dissolution_year) AS dissolution_year, max(sitelinks_count) AS sitelinks_count, max(title_en) AS title_en
         FROM timeline_dump WHERE id IS NOT NULL GROUP BY id)
       SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN o.inception_year ELSE n.inception_year END AS inception_year, CASE WHEN n.id IS NULL THEN o.dissolution_year ELSE n.dissolution_year END AS dissolution_year,
         coalesce(n.sitelinks_count, o.sitelinks_count) AS sitelinks_count, coalesce(o.title_en, n.title_en) AS title_en,
         CASE WHEN o.id IS NULL THEN 'inserted' WHEN n.id IS NULL THEN 'same' ELSE 'updated' END AS change FROM o FULL JOIN n ON o.id = n.id""",
    "s",
)
def upsert_merge(spark, d):
    new = table(spark, d, "timeline_dump").groupBy("id").agg(*[F.max(c).alias(c) for c in ("inception_year", "dissolution_year", "sitelinks_count", "title_en")])
    policy = {"inception_year": "new", "dissolution_year": "new", "sitelinks_count": "fill", "title_en": "keep"}
    return merge.merged(silver.sites(spark, d), new, "id", policy)


@query("SELECT DISTINCT site_id FROM site_extractions x WHERE site_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM timeline_dump d WHERE d.id = x.site_id)")
def anti_new_rows(spark, d):
    known = table(spark, d, "timeline_dump").select(F.col("id").alias("site_id"))
    return table(spark, d, "site_extractions").select("site_id").filter("site_id is not null").distinct().join(known, "site_id", "left_anti")


@query(
    """SELECT lower(trim(kind)) AS kind, name, CAST(count(DISTINCT site_id) AS BIGINT) AS sites, arg_min(context, struct_pack(a := site_id, b := ordinal)) FILTER (WHERE context IS NOT NULL) AS context,
         arg_min(proposed_qid, struct_pack(a := site_id, b := ordinal)) FILTER (WHERE proposed_qid IS NOT NULL) AS proposed_qid, min(site_id) AS first_site, max(site_id) AS last_site
       FROM dm WHERE trim(name) <> '' GROUP BY 1, 2""",
    "dm",
)
def gap_merge(spark, d):
    m = silver.missing(spark, d, "timeline_dump").filter(F.trim("name") != "")
    at = F.struct("site_id", "ordinal")
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in ("context", "proposed_qid")]
    return m.groupBy(F.lower(F.trim("kind")).alias("kind"), "name").agg(F.countDistinct("site_id").alias("sites"), *first, F.min("site_id").alias("first_site"), F.max("site_id").alias("last_site"))


_PARTED = "CAST(CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT) % CAST(ceil({1} / 1000.0) AS BIGINT) AS INTEGER)"


@query(
    f"""WITH g AS (SELECT DISTINCT lower(trim(kind)) AS kind, name, site_id FROM dm WHERE trim(name) <> ''), n AS (SELECT *, count(*) OVER (PARTITION BY kind, name) AS n FROM g)
       SELECT kind, name, {_PARTED.format('site_id', 'n')} AS part, CAST(count(*) AS BIGINT) AS members, string_agg(site_id, ',' ORDER BY site_id) AS site_ids FROM n GROUP BY 1, 2, 3""",
    "dm",
)
def gap_sites(spark, d):
    """The set of sites of each gap, in parts, so that none grows with the data."""
    m = silver.missing(spark, d, "timeline_dump").filter(F.trim("name") != "").withColumn("kind", F.lower(F.trim("kind")))
    return merge.listed(m, ["kind", "name"], "site_id").withColumnRenamed("list", "site_ids")


_PLAIN_KEY = "trim(regexp_replace(lower(regexp_replace({}, '\\([^)]*\\)', ' ', 'g')), '[^a-z0-9]+', ' ', 'g'))"


@query(
    f"""WITH g AS (SELECT DISTINCT site_id, kind, name, {_PLAIN_KEY.format('name')} AS key FROM m WHERE kind IN ('polity', 'culture', 'religion', 'language') AND trim(name) <> ''),
       h AS (SELECT site_id, track AS kind, {_PLAIN_KEY.format('label')} AS key, arg_min(struct_pack(f := from_year, t := to_year, r := role, c := confidence), ordinal) AS hit FROM e WHERE label IS NOT NULL GROUP BY 1, 2, 3)
       SELECT g.kind, g.name, g.site_id, hit.f AS from_year, hit.t AS to_year, hit.r AS role, hit.c AS confidence FROM g LEFT JOIN h ON h.site_id = g.site_id AND h.kind = g.kind AND h.key = g.key AND g.key <> ''
       WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.site_id = g.site_id AND e.track = g.kind AND e.qid IS NOT NULL AND {_PLAIN_KEY.format('e.label')} = g.key AND g.key <> '')""",
    "e m",
)
def gap_occurrences(spark, d):
    """One row for each gap and site, with the entry of the site that it is about; a site's row replaces the one it had."""
    from epochgrid.operators.quality import occurrences

    return occurrences(silver.missing(spark, d), silver.entries(spark, d, ["polity", "culture", "religion", "language"]))


@query(
    """SELECT proposed_qid, CAST(count(*) AS BIGINT) AS gaps FROM (SELECT DISTINCT lower(trim(kind)) AS kind, name, proposed_qid FROM dm WHERE proposed_qid IS NOT NULL AND trim(name) <> '') GROUP BY proposed_qid HAVING count(*) > 1""",
    "dm",
)
def proposal_reuse(spark, d):
    m = silver.missing(spark, d, "timeline_dump").filter("proposed_qid is not null and trim(name) <> ''")
    return m.select(F.lower(F.trim("kind")).alias("kind"), "name", "proposed_qid").distinct().groupBy("proposed_qid").agg(F.count("*").alias("gaps")).filter("gaps > 1")


@query(
    """SELECT site_id, CAST(count(*) AS BIGINT) AS runs, CAST(count(*) FILTER (WHERE rejected) AS BIGINT) AS rejected, CAST(count(DISTINCT prompt_hash) AS BIGINT) AS prompts, max(run_at) AS last_run, arg_max(model, struct_pack(a := run_at, b := run_id)) AS last_model
       FROM (SELECT DISTINCT * FROM site_extractions) WHERE site_id IS NOT NULL AND run_at IS NOT NULL AND model IS NOT NULL GROUP BY site_id HAVING count(*) >= 2"""
)
def run_history(spark, d):
    runs = table(spark, d, "site_extractions").distinct().filter("site_id is not null and run_at is not null and model is not null")
    last = F.max_by("model", F.struct("run_at", "run_id")).alias("last_model")
    found = runs.groupBy("site_id").agg(F.count("*").alias("runs"), F.count_if("rejected").alias("rejected"), F.countDistinct("prompt_hash").alias("prompts"), F.max("run_at").alias("last_run"), last)
    return found.filter("runs >= 2")


@query(
    """SELECT prompt_hash, CAST(count(DISTINCT run_id) AS BIGINT) AS runs, min(run_at) AS first_seen, max(run_at) AS last_seen FROM site_extractions WHERE prompt_hash IS NOT NULL GROUP BY prompt_hash"""
)
def prompt_versions(spark, d):
    rows = table(spark, d, "site_extractions").filter("prompt_hash is not null")
    return rows.groupBy("prompt_hash").agg(F.countDistinct("run_id").alias("runs"), F.min("run_at").alias("first_seen"), F.max("run_at").alias("last_seen"))


@query(
    """SELECT id, CASE WHEN enrichment_level = 'indexed' AND sitelinks_count >= 5 THEN 'queued' WHEN enrichment_level = 'extracted' AND timeline IS NULL THEN 'queued' ELSE enrichment_level END AS enrichment_level FROM s""",
    "s",
)
def guarded_transitions(spark, d):
    level = F.col("enrichment_level")
    again = ((level == "indexed") & (F.col("sitelinks_count") >= 5)) | ((level == "extracted") & F.col("timeline").isNull())
    return silver.sites(spark, d).select("id", F.when(again, "queued").otherwise(level).alias("enrichment_level"))


@query(
    """SELECT id, string_agg(DISTINCT term, ' ' ORDER BY term) AS search_text FROM (
         SELECT id, title_en AS term FROM s UNION ALL SELECT id, unnest(map_values(names)) FROM s
         UNION ALL SELECT id, CASE WHEN json_type(CAST(meta AS JSON)) = 'VARCHAR' THEN CAST(CAST(meta AS JSON)->>'$' AS JSON)->>'native_label' ELSE CAST(meta AS JSON)->>'native_label' END FROM s WHERE json_valid(meta)
         UNION ALL SELECT site_id, label FROM e WHERE track = 'name') WHERE term <> '' GROUP BY id""",
    "e",
)
def search_text(spark, d):
    names = silver.entries(spark, d, ["name"]).select("site_id", F.col("label").alias("name")).filter("name is not null")
    return search.search_text(silver.sites(spark, d), names).filter("search_text is not null")


@query(
    """SELECT id, CAST(CASE WHEN starts_with(k, 'velo') THEN 1.0 ELSE 0.8 END AS DOUBLE) AS score FROM (SELECT id, trim(regexp_replace(strip_accents(lower(title_en)), '\\s+', ' ', 'g')) AS k FROM s) WHERE contains(k, 'velo')""",
    "s",
)
def search_exact(spark, d):
    return search.found(silver.sites(spark, d).select("id", "title_en"), "title_en", " Velo ", fuzzy=False).select("id", "score")


@query()
def search_fuzzy(spark, d):
    names = silver.entries(spark, d, ["name"]).select("site_id", F.col("label").alias("name")).filter("name is not null")
    return search.found_sites(silver.sites(spark, d), names, "Velothburg", 20)


#: Degrees within which sites of an entity belong together; the test data hold too few for the usual five.
LATER, REACH = 1800, 40.0
_ROLES = ["state", "major", "minor"]
_TERRITORY = f"""a AS (SELECT e.qid AS entity, s.id, s.lon, s.lat FROM (SELECT * FROM e WHERE from_year <= {LATER} AND track = 'language' AND {KEY} IS NOT NULL QUALIFY {LAST.format('site_id, ' + KEY)}) e
    JOIN s ON s.id = e.site_id WHERE qid IS NOT NULL AND NOT starts_with(qid, 'local_') AND coalesce(e.to_year >= {LATER}, true) AND coalesce(role IN ('state', 'major', 'minor'), true)
    AND lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90)"""


def _territory(spark, d):
    now = t.active(silver.entries(spark, d, ["language"]), LATER)
    now = now.filter(F.col("qid").isNotNull() & ~F.col("qid").startswith("local_") & F.coalesce(F.col("role").isin(_ROLES), F.lit(True)))
    placed = silver.sites(spark, d).select("id", "lon", "lat").filter("lon between -180 and 180 and lat between -90 and 90")
    return geo.clusters(now.select(F.col("qid").alias("entity"), F.col("site_id").alias("id")).join(placed, "id"), REACH)


@query(
    f"""WITH RECURSIVE {_TERRITORY}, g AS (SELECT x.entity, x.id, y.id AS other FROM a x JOIN a y ON x.entity = y.entity AND pow(x.lon - y.lon, 2) + pow(x.lat - y.lat, 2) <= {REACH * REACH}),
        r AS (SELECT entity, id, id AS other FROM a UNION SELECT r.entity, r.id, g.other FROM r JOIN g ON g.entity = r.entity AND g.id = r.other)
        SELECT entity, id, min(other) AS cluster FROM r GROUP BY entity, id""",
    "e",
)
def territory_clusters(spark, d):
    return _territory(spark, d).select("entity", "id", "cluster")


_BY_COUNTRY = "a AS (SELECT country_qid AS entity, id, lon, lat FROM s WHERE country_qid IS NOT NULL AND lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 AND timeline IS NOT NULL)"


def _by_country(spark, d):
    placed = silver.sites(spark, d).filter("country_qid is not null and lon between -180 and 180 and lat between -90 and 90 and timeline is not null")
    return geo.clusters(placed.select(F.col("country_qid").alias("entity"), "id", "lon", "lat"))


@query(
    f"""WITH RECURSIVE {_BY_COUNTRY}, g AS (SELECT x.entity, x.id, y.id AS other FROM a x JOIN a y ON x.entity = y.entity AND pow(x.lon - y.lon, 2) + pow(x.lat - y.lat, 2) <= 25),
        r AS (SELECT entity, id, id AS other FROM a UNION SELECT r.entity, r.id, g.other FROM r JOIN g ON g.entity = r.entity AND g.id = r.other)
        SELECT entity, id, min(other) AS cluster FROM r GROUP BY entity, id""",
    "s",
)
def country_clusters(spark, d):
    return _by_country(spark, d).select("entity", "id", "cluster")


@query()
def country_hulls(spark, d):
    return geo.outlines(_by_country(spark, d))


@query(
    """WITH RECURSIVE g AS (SELECT 'nation ' || n_nationkey AS child, 'region ' || n_regionkey AS parent FROM nation UNION SELECT 'supplier ' || s_suppkey, 'nation ' || s_nationkey FROM supplier
         UNION SELECT 'customer ' || c_custkey, 'nation ' || c_nationkey FROM customer UNION SELECT 'order ' || o_orderkey, 'customer ' || o_custkey FROM orders),
       r AS (SELECT parent AS node, parent AS root FROM g WHERE starts_with(parent, 'region') UNION SELECT g.child, r.root FROM g JOIN r ON g.parent = r.node)
       SELECT DISTINCT node, root FROM r"""
)
def class_closure(spark, d):
    """All below each region, by whatever number of steps."""
    from epochgrid.operators.curation import closure

    def edges(name: str, child: str, key: str, parent: str, up: str):
        return table(spark, d, name).select(F.concat_ws(" ", F.lit(child), key).alias("child"), F.concat_ws(" ", F.lit(parent), up).alias("parent"))

    levels = [("nation", "nation", "n_nationkey", "region", "n_regionkey"), ("supplier", "supplier", "s_suppkey", "nation", "s_nationkey"), ("customer", "customer", "c_custkey", "nation", "c_nationkey"), ("orders", "order", "o_orderkey", "customer", "o_custkey")]
    g = edges(*levels[0])
    for level in levels[1:]:
        g = g.unionByName(edges(*level))
    return closure(g, g.filter(F.col("parent").startswith("region")).select(F.col("parent").alias("node")).distinct())


_STAMP = "CASE WHEN inception < 0 THEN '-' ELSE '' END || lpad(CAST(abs(inception) AS VARCHAR), 4, '0') || '-01-01T00:00:00Z'"


@query(
    f"""WITH x AS (SELECT qid, inception, coalesce(inception_precision, 9) AS p, {_STAMP} AS stamp FROM wikidata_entities WHERE inception IS NOT NULL AND abs(inception) <= 9999),
        y AS (SELECT *, CASE WHEN starts_with(stamp, '-') THEN -1 ELSE 1 END * CAST(regexp_extract(stamp, '^[+-]?(\\d+)-', 1) AS BIGINT) AS v FROM x)
        SELECT qid, stamp, CAST(CASE WHEN v BETWEEN -200000 AND 2100 THEN CASE WHEN v <= 0 THEN v - 1 ELSE v END END AS INTEGER) AS year,
        CASE WHEN p <= 6 THEN CAST(CAST(ceil(abs(inception) / 1000) AS BIGINT) AS VARCHAR) || 'th mill.' WHEN p = 7 THEN CAST(CAST(ceil(abs(inception) / 100) AS BIGINT) AS VARCHAR) || 'th c.'
          WHEN p = 8 THEN CAST(CAST(floor(abs(inception) / 10) * 10 AS BIGINT) AS VARCHAR) || 's' ELSE CAST(abs(inception) AS VARCHAR) END || CASE WHEN inception < 0 THEN ' BC' ELSE ' AD' END AS shown FROM y"""
)
def year_parse_format(spark, d):
    i = F.col("inception")
    rows = table(spark, d, "wikidata_entities").filter(i.isNotNull() & (F.abs(i) <= 9999))
    size = F.abs(i).cast("string")
    stamp = F.concat(F.when(i < 0, "-").otherwise(""), F.lpad(size, 4, "0"), F.lit("-01-01T00:00:00Z"))
    shown = numbers.year_text(i, F.coalesce("inception_precision", F.lit(9)), F.lit(False))
    return rows.select("qid", stamp.alias("stamp"), shown.alias("shown")).withColumn("year", numbers.wikidata_year(F.col("stamp")))


@query(
    """SELECT year, round((year + 10000) / 12000.0, 6) AS linear, round(1 - sqrt(1 - (year + 10000) / 12000.0), 6) AS root, round(1 - ln(1 + (1 - (year + 10000) / 12000.0) * 20) / ln(21), 6) AS logarithmic
       FROM (SELECT DISTINCT from_year AS year FROM e WHERE from_year BETWEEN -10000 AND 2000)""",
    "e",
)
def time_scale(spark, d):
    years = silver.entries(spark, d).filter("from_year between -10000 and 2000").select(F.col("from_year").alias("year")).distinct()
    x = (F.col("year") + 10000) / 12000.0
    return years.select("year", F.round(x, 6).alias("linear"), F.round(1 - F.sqrt(1 - x), 6).alias("root"), F.round(1 - F.log1p((1 - x) * 20) / F.log1p(F.lit(20.0)), 6).alias("logarithmic"))


@query("SELECT CAST(unnest(generate_series(f, t - 1, s)) AS BIGINT) AS from_year, CAST(s AS BIGINT) AS step FROM (VALUES " + ", ".join(map(str, SEGMENTS)) + ") v(f, t, s)")
def ruler_cells(spark, d):
    rows = spark.createDataFrame(SEGMENTS, "f bigint, t bigint, s bigint")
    return rows.select(F.explode(F.sequence("f", F.col("t") - 1, F.col("s"))).alias("from_year"), F.col("s").alias("step"))


_HASH = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split({}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: (xor(a, b) * 16777619) % 4294967296)"


@query(
    f"""WITH h AS (SELECT qid, {_HASH.format('qid')} AS h, {_HASH.format("CASE WHEN family_label <> '' THEN family_label ELSE qid END")} AS seed, coalesce(family_label <> '', false) AS related
         FROM wikidata_entities WHERE qid IS NOT NULL),
       c AS (SELECT qid, round((((seed / 4294967295.0 + 0.618033988749895) % 1) * 360 + CASE WHEN related THEN h % 25 - 12 ELSE 0 END) % 360, 1) AS hue,
         CAST([62, 48, 74, 38][1 + h % 4] AS INTEGER) AS saturation, CAST([52, 42, 62, 34, 70][1 + (h // 4) % 5] AS INTEGER) AS lightness FROM h)
       SELECT *, least(100, saturation + 12) AS stroke_saturation, greatest(12, lightness - 24) AS stroke_lightness FROM c"""
)
def hull_color(spark, d):
    hue, saturation, lightness = numbers.entity_color(F.col("qid"), F.col("family_label"))
    rows = table(spark, d, "wikidata_entities").filter("qid is not null").select("qid", hue.alias("hue"), saturation.alias("saturation"), lightness.alias("lightness"))
    border = numbers.stroke(F.col("saturation"), F.col("lightness"))
    return rows.select("*", border[0].alias("stroke_saturation"), border[1].alias("stroke_lightness"))


_CLEAN = "text"
for _pattern, _by in CLEANED:
    _CLEAN = f"regexp_replace({_CLEAN}, '{_pattern}', '{_by.replace('$2', chr(92) + '2')}', 'g')"


@query(f"SELECT doc_id, md5(trim({_CLEAN}, E' \\n\\r\\t')) AS cleaned FROM documents WHERE text IS NOT NULL")
def clean_wikitext(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(cleaned(F.col("text"))).alias("cleaned"))


@query(
    """SELECT split_part(t, ' ', 2) AS type, CAST(count(*) AS BIGINT) AS sites FROM (SELECT CASE WHEN json_type(CAST(meta AS JSON)) = 'VARCHAR' THEN CAST(CAST(meta AS JSON)->>'$' AS JSON)->>'wikidata_description' ELSE CAST(meta AS JSON)->>'wikidata_description' END AS t
       FROM s WHERE json_valid(meta)) WHERE t IS NOT NULL GROUP BY 1""",
    "s",
)
def meta_types(spark, d):
    kind = F.split_part(search.meta_text(F.col("meta"), "$.wikidata_description"), F.lit(" "), F.lit(2))
    return silver.sites(spark, d).select(kind.alias("type")).filter("type is not null").groupBy("type").agg(F.count("*").alias("sites"))


@query(
    """SELECT event_type, CAST(count(*) AS BIGINT) AS events, round(sum(value), 4) AS value, CAST(sum(CAST(CAST(props AS JSON)->>'k' AS BIGINT)) AS BIGINT) AS k FROM events WHERE json_valid(props) GROUP BY event_type"""
)
def json_properties(spark, d):
    k = F.expr("variant_get(try_parse_json(props), '$.k', 'bigint')")
    rows = table(spark, d, "events").filter(F.expr("try_parse_json(props) is not null"))
    return rows.groupBy("event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value"), F.sum(k).alias("k"))


@query(
    """SELECT qid FROM wikidata_entities WHERE kind = 'polity' AND active EXCEPT SELECT qid FROM e WHERE track = 'polity' AND qid IS NOT NULL UNION SELECT qid FROM wikidata_entities WHERE kind = 'religion'""",
    "e",
)
def unused_polities(spark, d):
    w = table(spark, d, "wikidata_entities")
    used = silver.entries(spark, d, ["polity"]).select("qid").filter("qid is not null")
    unused = w.filter("kind = 'polity' and active").select("qid").distinct().join(used, "qid", "left_anti")
    return unused.unionByName(w.filter("kind = 'religion'").select("qid")).distinct()


@query(
    """SELECT prompt_hash, substr(sha256(prompt_hash || ':' || coalesce(referential_hash, '')), 1, 16) AS short_hash, CAST(count(*) AS BIGINT) AS runs FROM site_extractions WHERE prompt_hash IS NOT NULL GROUP BY prompt_hash, referential_hash"""
)
def short_hashes(spark, d):
    rows = table(spark, d, "site_extractions").filter("prompt_hash is not null").groupBy("prompt_hash", "referential_hash").agg(F.count("*").alias("runs"))
    return rows.select("prompt_hash", F.substring(F.sha2(F.concat_ws(":", "prompt_hash", F.coalesce("referential_hash", F.lit(""))), 256), 1, 16).alias("short_hash"), "runs")


@query(
    f"""SELECT site_id, track, ordinal, {KEY} AS entity, CAST({RANK} AS INTEGER) AS rank FROM e WHERE track IN ('religion', 'language')""",
    "e",
)
def entity_keys(spark, d):
    e = silver.entries(spark, d, ["religion", "language"])
    return e.select("site_id", "track", "ordinal", entity_key(F.col("qid"), F.col("label")).alias("entity"), role_rank(F.col("role")).cast("int").alias("rank"))


@query("SELECT qid, strip_accents(lower(label_en)) AS plain, trim(regexp_replace(lower(regexp_replace(label_en, '\\([^)]*\\)', ' ', 'g')), '[^a-z0-9]+', ' ', 'g')) AS key FROM wikidata_entities")
def name_keys(spark, d):
    return table(spark, d, "wikidata_entities").select("qid", unaccent(F.lower("label_en")).alias("plain"), plain_name(F.col("label_en")).alias("key"))


@query(
    f"""WITH n AS (SELECT * FROM e WHERE from_year <= {YEAR} AND track IN ('site_type', 'population') QUALIFY {LAST.format('site_id, track')}),
       p AS (SELECT site_id, max(label) FILTER (WHERE track = 'site_type') AS nt, TRY_CAST(max(label) FILTER (WHERE track = 'population') AS BIGINT) AS pop FROM n GROUP BY site_id),
       v1 AS (SELECT DISTINCT site_id FROM v)
       SELECT s.id, CAST(least(100, CASE coalesce(nt, site_type) {TYPES.replace(', ', ' ')} ELSE 20 END + CASE WHEN pop IS NOT NULL THEN least(30, floor(log10(CAST(greatest(pop, 1) AS DOUBLE)) * 8)) ELSE 0 END
         + 10 + CASE WHEN v1.site_id IS NOT NULL THEN 5 ELSE 0 END) AS INTEGER) AS importance
       FROM s LEFT JOIN p ON p.site_id = s.id LEFT JOIN v1 ON v1.site_id = s.id WHERE s.timeline IS NOT NULL""",
    "e v",
)
def importance_shown(spark, d):
    now = t.latest_entry(silver.entries(spark, d, ["site_type", "population"]), YEAR, ["site_id", "track"])
    state = now.groupBy("site_id").agg(*[F.max(F.when(F.col("track") == k, F.col("label"))).alias(f"now_{k}") for k in ("site_type", "population")])
    told = silver.events(spark, d).select("site_id").distinct().withColumn("told", F.lit(True))
    rows = silver.sites(spark, d).filter("timeline is not null").withColumnRenamed("id", "site_id").join(state, "site_id", "left").join(told, "site_id", "left")
    score = numbers.importance_shown(F.coalesce("now_site_type", "site_type"), F.col("now_population").try_cast("bigint"), F.lit(True), F.col("told"))
    return rows.select(F.col("site_id").alias("id"), score.alias("importance"))


@query(
    """WITH a AS (SELECT e.site_id, 'culture' AS kind, e.qid AS entity_qid, 'timeline' AS source, any_value(w.inception) AS from_year, any_value(w.dissolution) AS to_year, max(s.timeline_extracted_at) AS seen, bool_or(e.confidence = 'high') AS sure
         FROM e JOIN wikidata_entities w ON w.qid = e.qid AND w.kind = 'culture' JOIN s ON s.id = e.site_id WHERE e.track = 'culture' GROUP BY 1, 3)
       SELECT site_id, kind, entity_qid, source, CASE WHEN sure THEN from_year END AS from_year, CASE WHEN sure THEN to_year END AS to_year, CASE WHEN sure THEN seen ELSE TIMESTAMP '2000-01-01' END AS last_seen_at FROM a""",
    "e",
)
def attribution_upsert(spark, d):
    """Attributions of sites to cultures, known ones without years, after a pass that found those of sure entries."""
    listed = table(spark, d, "wikidata_entities").filter("kind = 'culture'").select("qid", "inception", "dissolution")
    e = silver.entries(spark, d, ["culture"], ["timeline_extracted_at"]).join(listed, "qid")
    rows = e.select(
        "site_id", F.col("track").alias("kind"), F.col("qid").alias("entity_qid"), F.lit("timeline").alias("source"), F.col("inception").alias("from_year"),
        F.col("dissolution").alias("to_year"), F.col("timeline_extracted_at").alias("last_seen_at"), "confidence",
    )
    keys, none = ["site_id", "kind", "entity_qid", "source"], F.lit(None).cast("int")
    old = rows.select(*keys, none.alias("from_year"), none.alias("to_year"), F.lit("2000-01-01").cast(rows.schema["last_seen_at"].dataType).alias("last_seen_at")).distinct()
    return merge.stamped(old, rows.filter("confidence = 'high'").drop("confidence"), keys, ["from_year", "to_year"], "last_seen_at")


@query(f"SELECT id, CAST({BASE} AS INTEGER) AS base_importance FROM s", "s")
def base_importance(spark, d):
    return silver.sites(spark, d).select("id", numbers.base_importance(F.col("sitelinks_count"), F.col("wikipedia_page_en_url")).alias("base_importance"))


@query(
    """SELECT country_qid, id, CAST(rank AS INTEGER) AS rank FROM (SELECT country_qid, id, row_number() OVER (PARTITION BY country_qid ORDER BY sitelinks_count DESC NULLS LAST, id) AS rank FROM s WHERE country_qid IS NOT NULL) WHERE rank <= 3""",
    "s",
)
def top_sites_by_country(spark, d):
    best = Window.partitionBy("country_qid").orderBy(F.col("sitelinks_count").desc_nulls_last(), "id")
    rows = silver.sites(spark, d).filter("country_qid is not null").withColumn("rank", F.row_number().over(best)).filter("rank <= 3")
    return rows.select("country_qid", "id", "rank")


@query("SELECT qid, label_en, search_text FROM wikidata_entities WHERE active AND contains(lower(search_text), 'gun') ORDER BY length(label_en), qid LIMIT 25")
def search_entities(spark, d):
    rows = table(spark, d, "wikidata_entities").filter("active").filter(F.lower("search_text").contains("gun"))
    return rows.orderBy(F.length("label_en"), "qid").limit(25).select("qid", "label_en", "search_text")



"""Queries that check and repair timelines and the list of entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochgrid.operators import quality as q
from epochgrid.operators.merge import listed, replaced
from epochgrid.operators.timelines import timeline_items
from epochgrid.plans.atlas import _PARTED
from epochgrid.plans.registry import query
from epochgrid.sources import silver
from epochgrid.sources.tables import table

KEY4 = "('polity', 'culture', 'religion', 'language')"
NORM = "trim(regexp_replace(strip_accents(lower({})), '\\s+', ' ', 'g'))"
PLAIN = "trim(regexp_replace(lower(regexp_replace({}, '\\([^)]*\\)', ' ', 'g')), '[^a-z0-9]+', ' ', 'g'))"
_STOP = "[" + ", ".join(f"'{w}'" for w in q.STOPWORDS) + "]"
WORDS = "list_filter(regexp_split_to_array(regexp_replace(" + NORM + ", '[()\\[\\],.;:''\"–—-]', ' ', 'g'), '\\s+'), lambda w: len(w) > 2 AND NOT list_contains(" + _STOP + ", w))"


def _entities(spark, d):
    return table(spark, d, "wikidata_entities")


_HELD = f"""k AS (SELECT *, coalesce(qid, label) AS key FROM e WHERE track IN {KEY4} AND from_year IS NOT NULL),
    n AS (SELECT *, coalesce(to_year, CASE WHEN track IN ('polity', 'culture') THEN lead(from_year) OVER (PARTITION BY site_id, track ORDER BY from_year, ordinal)
        ELSE lead(from_year) OVER (PARTITION BY site_id, track, key ORDER BY from_year, ordinal) END) AS ends FROM k),
    b AS (SELECT n.*, w.inception, w.dissolution, w.inception_precision, coalesce(from_year > dissolution, false) OR coalesce(ends < inception, false) AS apart
        FROM n JOIN wikidata_entities w ON w.qid = n.qid AND w.active AND (w.inception IS NOT NULL OR w.dissolution IS NOT NULL)),
    c AS (SELECT *, NOT apart AND coalesce(from_year < inception, false) AND (ends IS NULL OR coalesce(inception < ends, false)) AS shorten FROM b),
    h AS (SELECT *, CASE WHEN shorten THEN CAST(inception AS BIGINT) ELSE from_year END AS new_from,
        NOT apart AND dissolution IS NOT NULL AND (ends IS NULL OR coalesce(ends > dissolution, false)) AND dissolution >= CASE WHEN shorten THEN inception ELSE from_year END AS closes FROM c)"""


@query(
    f"""WITH {_HELD} SELECT site_id, track, ordinal, qid, new_from, CASE WHEN closes THEN CAST(dissolution AS BIGINT) ELSE to_year END AS new_to,
        shorten AND coalesce(inception_precision < 9, false) AS from_circa, CASE WHEN shorten AND inception_precision < 9 THEN inception_precision END AS from_precision,
        concat_ws(',', CASE WHEN apart THEN 'incompatible' END, CASE WHEN shorten THEN 'shorten' END, CASE WHEN closes THEN 'close' END) AS actions FROM h""",
    "e",
)
def entity_bounds_applied(spark, d):
    held = q.bounded(silver.entries(spark, d, q.ENTITY_TRACKS), _entities(spark, d))
    return held.select("site_id", "track", "ordinal", "qid", "new_from", "new_to", "from_circa", "from_precision", F.array_join("actions", ",").alias("actions"))


@query(
    f"""WITH {_HELD}, a AS (SELECT *, unnest(list_filter([CASE WHEN apart THEN 'incompatible' END, CASE WHEN shorten THEN 'shorten' END, CASE WHEN closes THEN 'close' END], lambda x: x IS NOT NULL)) AS action FROM h)
        , rn AS (SELECT *, site_id || '/' || track || '/' || from_year || '/' || action || '/' || ordinal AS row FROM a), cn AS (SELECT *, count(*) OVER (PARTITION BY qid, track) AS n FROM rn)
        SELECT qid AS entity_qid, track, {_PARTED.format('row', 'n')} AS part, CAST(count(*) AS BIGINT) AS conflicts, string_agg(row, ',' ORDER BY row) AS rows FROM cn GROUP BY 1, 2, 3""",
    "e",
)
def bounds_conflicts_grouped(spark, d):
    """The conflicts of each entity, in parts of about a thousand."""
    held = q.bounded(silver.entries(spark, d, q.ENTITY_TRACKS), _entities(spark, d))
    rows = held.select("site_id", "track", F.col("qid").alias("entity_qid"), F.explode("actions").alias("action"), "from_year", "ordinal")
    rows = rows.withColumn("row", F.concat_ws("/", "site_id", "track", "from_year", "action", "ordinal"))
    return listed(rows, ["entity_qid", "track"], "row").withColumnsRenamed({"members": "conflicts", "list": "rows"})


@query(
    f"""WITH {_HELD}, a AS (SELECT site_id, track, ordinal, qid AS entity_qid, from_year, to_year FROM h WHERE apart),
        t AS (SELECT DISTINCT site_id FROM site_extractions WHERE confirmed)
        SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.site_id = a.site_id) UNION ALL SELECT * FROM a WHERE track IN ('polity', 'culture') AND EXISTS (SELECT 1 FROM t WHERE t.site_id = a.site_id)""",
    "e",
)
def bounds_conflicts_state(spark, d):
    """What is kept of conflicts a human must decide: those of confirmed sites are taken anew, of their step tracks only."""
    held = q.bounded(silver.entries(spark, d, q.ENTITY_TRACKS), _entities(spark, d)).filter(F.array_contains("actions", "incompatible"))
    hard = held.select("site_id", "track", "ordinal", F.col("qid").alias("entity_qid"), "from_year", "to_year")
    again = table(spark, d, "site_extractions").filter("confirmed").select("site_id")
    return replaced(hard, hard.filter(F.col("track").isin("polity", "culture")), again, "site_id")


@query(
    """WITH n AS (SELECT qid, min(from_year) AS i, max(to_year) AS x FROM e WHERE qid IS NOT NULL AND confidence = 'high' GROUP BY qid)
       SELECT w.qid, coalesce(w.inception, CAST(i AS INTEGER)) AS inception, coalesce(w.dissolution, CAST(x AS INTEGER)) AS dissolution,
         CASE WHEN (w.inception IS NULL AND i IS NOT NULL) OR (w.dissolution IS NULL AND x IS NOT NULL) THEN 'timelines' ELSE bounds_source END AS bounds_source
       FROM wikidata_entities w LEFT JOIN n ON n.qid = w.qid""",
    "e",
)
def bounds_provenance(spark, d):
    """Bounds that the list lacks, filled from sure entries of the timelines, and where they come from."""
    e = silver.entries(spark, d, q.ENTITY_TRACKS).filter("qid is not null and confidence = 'high'")
    found = e.groupBy("qid").agg(F.min("from_year").try_cast("int").alias("first"), F.max("to_year").try_cast("int").alias("last"))
    return q.filled_bounds(_entities(spark, d), found, "timelines").select("qid", "inception", "dissolution", "bounds_source")


@query("SELECT qid, label_en, inception, inception_precision, dissolution FROM wikidata_entities WHERE active AND (inception IS NOT NULL OR dissolution IS NOT NULL)")
def bounds_referential(spark, d):
    return q.known_bounds(_entities(spark, d))


_PATTERN = "|".join(f"(?:{p})" for p in q.CONFESSIONS)


@query(
    f"""WITH x AS (SELECT site_id, section AS track, ordinal, i->>'notes' AS notes, e.label, e.qid FROM it JOIN e USING (site_id, ordinal) WHERE section = e.track AND section IN {KEY4} AND e.qid IS NOT NULL),
        r AS (SELECT x.*, coalesce(regexp_matches(lower(notes), '{_PATTERN}'), false) AS confessed, w.kind AS listed, w.label_en AS listed_label,
            nullif({NORM.format('x.label')}, '') AS nk FROM x LEFT JOIN wikidata_entities w ON w.qid = x.qid AND w.active),
        f AS (SELECT *, CASE WHEN confessed THEN 'confessed' WHEN listed IS NOT NULL AND track <> listed THEN 'wrong_track'
            WHEN listed IS NOT NULL AND nk IS NOT NULL AND len({WORDS.format("coalesce(label, '')")}) > 0 AND len({WORDS.format("coalesce(listed_label, '')")}) > 0
              AND NOT list_has_any({WORDS.format("coalesce(label, '')")}, {WORDS.format("coalesce(listed_label, '')")}) THEN 'wrong_name' END AS first FROM r),
        g AS (SELECT site_id, qid, count(DISTINCT CASE WHEN first IS NULL THEN nk END) AS left_names, count(DISTINCT CASE WHEN NOT confessed THEN track END) AS tracks,
            count(DISTINCT CASE WHEN NOT confessed THEN nk END) AS names FROM f GROUP BY site_id, qid)
        SELECT site_id, track, ordinal, f.qid, coalesce(first, CASE WHEN listed IS NOT NULL THEN CASE WHEN left_names > 1 THEN 'several_names' END
            WHEN track IN ('religion', 'language') THEN 'not_listed' WHEN tracks > 1 THEN 'several_tracks' WHEN names > 1 THEN 'several_names' END) AS reason
        FROM f JOIN g USING (site_id, qid)""",
    "e",
)
def qid_validation(spark, d):
    items = timeline_items(silver.sites(spark, d).filter("timeline is not null"), "id", "timeline", ["record_id", "section", "ordinal", "label", "qid", "notes"], q.ENTITY_TRACKS)
    rows = items.select(F.col("record_id").alias("site_id"), F.col("section").alias("track"), "ordinal", "label", F.when(F.trim("qid") != "", F.trim("qid")).alias("qid"), "notes")
    return q.checked_qids(rows, _entities(spark, d)).select("site_id", "track", "ordinal", "qid", "reason")


@query(
    """SELECT site_id, ordinal, from_year, CASE WHEN to_year < coalesce(lead(from_year) OVER (PARTITION BY site_id ORDER BY from_year, ordinal), to_year + 1) THEN to_year END AS to_year, label
       FROM e WHERE track = 'site_type' AND from_year IS NOT NULL UNION ALL SELECT site_id, ordinal, from_year, to_year, label FROM e WHERE track = 'site_type' AND from_year IS NULL""",
    "e",
)
def site_type_ends(spark, d):
    return q.without_redundant_ends(silver.entries(spark, d, ["site_type"])).select("site_id", "ordinal", "from_year", "to_year", "label")


@query()
def cooccurrent_fold(spark, d):
    return q.folded(silver.entries(spark, d, q.LISTED_ONLY))


@query(
    """WITH n AS (SELECT *, CASE WHEN role = 'state' THEN lead(from_year) OVER (PARTITION BY site_id, track, role = 'state' ORDER BY from_year, ordinal) END AS next
         FROM e WHERE track IN ('religion', 'language') AND from_year IS NOT NULL)
       SELECT site_id, track, ordinal, from_year, CASE WHEN coalesce((to_year IS NULL OR to_year >= next) AND next > from_year, false) THEN next ELSE to_year END AS to_year FROM n
       UNION ALL SELECT site_id, track, ordinal, from_year, to_year FROM e WHERE track IN ('religion', 'language') AND from_year IS NULL""",
    "e",
)
def state_exclusivity(spark, d):
    return q.exclusive_state(silver.entries(spark, d, q.LISTED_ONLY)).select("site_id", "track", "ordinal", "from_year", "to_year")


@query("SELECT site_id, track, ordinal, CASE WHEN track NOT IN ('name', 'population') THEN to_year END AS to_year FROM e", "e")
def ends_stripped(spark, d):
    keep = F.when(~F.col("track").isin("name", "population"), F.col("to_year"))
    return silver.entries(spark, d).select("site_id", "track", "ordinal", keep.alias("to_year"))


@query("SELECT site_id, ordinal, year, type FROM v WHERE type IN (" + ", ".join(f"'{t}'" for t in q.EVENT_TYPES) + ")", "v")
def events_of_known_type(spark, d):
    return silver.events(spark, d).filter(F.col("type").isin(q.EVENT_TYPES))


@query(
    f"""SELECT site_id, ordinal, kind, name FROM m WHERE kind IN {KEY4} AND trim(name) <> '' AND NOT EXISTS (
          SELECT 1 FROM e WHERE e.site_id = m.site_id AND e.track = m.kind AND e.qid IS NOT NULL AND {PLAIN.format('e.label')} <> '' AND {PLAIN.format('e.label')} = {PLAIN.format('m.name')})""",
    "e m",
)
def missing_unresolved(spark, d):
    return q.unresolved(silver.missing(spark, d), silver.entries(spark, d, q.ENTITY_TRACKS)).select("site_id", "ordinal", "kind", "name")


@query(
    """SELECT status, CAST(count(*) AS BIGINT) AS records FROM (SELECT CASE WHEN timeline IS NULL THEN 'none' WHEN j.id IS NULL THEN 'unreadable or rejected' WHEN i.site_id IS NULL THEN 'empty' ELSE 'filled' END AS status
       FROM s LEFT JOIN j ON j.id = s.id LEFT JOIN (SELECT DISTINCT site_id FROM it) i ON i.site_id = s.id) GROUP BY status""",
    "it",
)
def timeline_status(spark, d):
    sites = silver.sites(spark, d).select("id", "timeline")
    items = timeline_items(sites.filter("timeline is not null"), "id", "timeline", ["record_id"]).distinct()
    text = F.col("timeline")
    once = F.expr("try_parse_json(timeline)")
    sites = sites.withColumn("v", once).withColumn("w", F.expr("case when schema_of_variant(v) = 'STRING' then try_parse_json(variant_get(v, '$', 'string')) else v end"))
    kind = F.expr("schema_of_variant(w)")
    usable = kind.startswith("OBJECT") & F.expr("coalesce(schema_of_variant(variant_get(w, '$.rejection')), 'VOID') = 'VOID'")
    joined = sites.join(items, sites.id == items.record_id, "left")
    status = (
        F.when(text.isNull(), "none").when(F.col("record_id").isNotNull(), "filled").when(F.coalesce(usable, F.lit(False)), "empty").otherwise("unreadable or rejected")
    )
    return joined.groupBy(status.alias("status")).agg(F.count("*").alias("records"))


_TESTS = [
    ("inception out of range", "inception NOT BETWEEN -200000 AND 2100"), ("dissolution out of range", "dissolution NOT BETWEEN -200000 AND 2100"),
    ("inception after dissolution", "inception >= dissolution"), ("span too short", "dissolution - inception > 0 AND dissolution - inception < 10"),
    ("span too long", "dissolution - inception > 20000"), ("inception too precise", "inception_precision = 9 AND inception < -1000"),
    ("dissolution too precise", "dissolution_precision = 9 AND dissolution < -1000"), ("inception without precision", "inception IS NOT NULL AND inception_precision IS NULL"),
    ("dissolution without precision", "dissolution IS NOT NULL AND dissolution_precision IS NULL"),
    ("precision without inception", "inception IS NULL AND inception_precision IS NOT NULL"),
    ("precision without dissolution", "dissolution IS NULL AND dissolution_precision IS NOT NULL"), ("no bound", "inception IS NULL AND dissolution IS NULL"),
]


@query("SELECT * FROM (SELECT qid, concat_ws('; ', " + ", ".join(f"CASE WHEN {test} THEN '{text}' END" for text, test in _TESTS) + ") AS anomalies FROM wikidata_entities) WHERE anomalies <> ''")
def bound_anomalies(spark, d):
    return q.bound_anomalies(_entities(spark, d)).select("qid", F.array_join("anomalies", "; ").alias("anomalies"))


@query(
    """SELECT qid, min(from_year) AS inception, arg_min(confidence, struct_pack(a := from_year, b := site_id, c := track, d := ordinal)) FILTER (WHERE from_year IS NOT NULL) AS inception_confidence, max(to_year) AS dissolution
       FROM e WHERE qid IS NOT NULL GROUP BY qid""",
    "e",
)
def widest_window(spark, d):
    e = silver.entries(spark, d, q.ENTITY_TRACKS).filter("qid is not null")
    first = F.struct("from_year", "site_id", "track", "ordinal")
    by = F.when(F.col("from_year").isNotNull() & F.col("confidence").isNotNull(), first)
    return e.groupBy("qid").agg(F.min("from_year").alias("inception"), F.min_by("confidence", by).alias("inception_confidence"), F.max("to_year").alias("dissolution"))


@query(
    f"""SELECT site_id, ordinal, m.proposed_qid, CASE WHEN NOT regexp_full_match(m.proposed_qid, 'Q[0-9]+') THEN 'malformed' WHEN w.kind IS NULL THEN 'unknown'
          WHEN w.kind <> lower(trim(m.kind)) THEN 'wrong_kind' WHEN NOT list_has_any(list_filter(string_split({PLAIN.format("coalesce(m.name, '')")}, ' '), lambda x: len(x) >= 4),
            list_filter(string_split({PLAIN.format("coalesce(w.label_en, '')")}, ' '), lambda x: len(x) >= 4)) THEN 'wrong_name' ELSE 'fine' END AS verdict
        FROM dm AS m LEFT JOIN wikidata_entities w ON w.qid = m.proposed_qid WHERE m.proposed_qid IS NOT NULL""",
    "dm",
)
def gap_verification(spark, d):
    return q.proposals(silver.missing(spark, d, "timeline_dump"), _entities(spark, d)).select("site_id", "ordinal", "proposed_qid", "verdict")


#: Rows of the report of gaps to resolve first.
RESOLVED_FIRST = 200


@query(
    f"""SELECT kind, name, sites, first_seen, CAST(row_number() OVER (ORDER BY sites DESC, first_seen NULLS LAST, kind, name) AS INTEGER) AS position FROM (
         SELECT lower(trim(kind)) AS kind, name, CAST(count(DISTINCT site_id) AS BIGINT) AS sites, min(timeline_extracted_at) AS first_seen FROM m JOIN s ON s.id = m.site_id WHERE trim(name) <> '' GROUP BY 1, 2)
       ORDER BY sites DESC, first_seen NULLS LAST, kind, name LIMIT {RESOLVED_FIRST}""",
    "m",
)
def gap_resolution_order(spark, d, limit: int = RESOLVED_FIRST):
    """The gaps to resolve first: of most sites, then the oldest; a top-k report."""
    from pyspark.sql import Window

    seen = silver.sites(spark, d).select(F.col("id").alias("site_id"), F.col("timeline_extracted_at").alias("seen"))
    m = silver.missing(spark, d).filter(F.trim("name") != "").join(seen, "site_id")
    gaps = m.groupBy(F.lower(F.trim("kind")).alias("kind"), "name").agg(F.countDistinct("site_id").alias("sites"), F.min("seen").alias("first_seen"))
    order = [F.col("sites").desc(), F.col("first_seen").asc_nulls_last(), "kind", "name"]
    top = gaps.orderBy(*order).limit(limit)  # the window runs over those only
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order)))


@query(
    f"""WITH k AS (SELECT kind, {PLAIN.format('label_en')} AS key, min(qid) AS found FROM wikidata_entities WHERE active GROUP BY 1, 2 HAVING count(*) = 1)
        SELECT site_id, track, ordinal, label, found FROM e JOIN k ON k.kind = e.track AND k.key = {PLAIN.format('label')} WHERE qid IS NULL AND key <> '' AND track IN {KEY4}""",
    "e",
)
def qid_backfill(spark, d):
    return q.backfilled(silver.entries(spark, d, q.ENTITY_TRACKS), _entities(spark, d)).select("site_id", "track", "ordinal", "label", "found")


@query(
    f"""SELECT qid, label_en, CASE WHEN qid IN ({", ".join(f"'{x}'" for x in q.NOT_TODAY)}) THEN 'known' ELSE 'description' END AS skipped FROM wikidata_entities
        WHERE qid IN ({", ".join(f"'{x}'" for x in q.NOT_TODAY)}) OR (regexp_matches(lower(description_en), '{q.HISTORICAL}') AND NOT regexp_matches(lower(description_en), '{q.CURRENT}'))"""
)
def historical_by_description(spark, d):
    return q.historical(_entities(spark, d)).filter("skipped is not null").select("qid", "label_en", "skipped")


@query(
    """SELECT kind, tier, CAST(count(*) AS BIGINT) AS entities FROM (SELECT kind, CASE WHEN list_has_any(t, ['kingdom', 'empire']) THEN 'sovereign' WHEN list_has_any(t, ['county', 'duchy', 'bishopric']) THEN 'subordinate' ELSE 'default' END AS tier
       FROM (SELECT kind, string_split(lower(coalesce(label_en, '')), ' ') AS t FROM wikidata_entities)) GROUP BY kind, tier"""
)
def polity_tiers(spark, d):
    types = F.split(F.lower(F.coalesce("label_en", F.lit(""))), " ")
    rows = _entities(spark, d).select("kind", q.tier(types, ["kingdom", "empire"], ["county", "duchy", "bishopric"]).alias("tier"))
    return rows.groupBy("kind", "tier").agg(F.count("*").alias("entities"))

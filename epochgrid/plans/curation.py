"""Queries of curators: titles, labels, reliable entities, provenance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from epochgrid.functions.display import SEGMENTS
from epochgrid.functions.text import entity_key
from epochgrid.operators import curation as c
from epochgrid.operators import quality as q
from epochgrid.operators.timelines import TRACKS, timeline_items
from epochgrid.plans.registry import query
from epochgrid.session import checkpoint
from epochgrid.sources import silver
from epochgrid.sources.tables import table


@query(
    """WITH l AS (SELECT s.id, s.wikipedia_page_en_url AS url, c.lang_code AS own, s.names FROM s LEFT JOIN countries c ON c.qid = s.country_qid),
       p AS (SELECT id, k AS lang, trim(names[k]) AS v FROM (SELECT id, names, unnest(map_keys(names)) AS k FROM l) WHERE trim(names[k]) <> ''),
       r AS (SELECT id, lang, v, regexp_full_match(v, '[^\\p{L}]*(\\p{Latin}[^\\p{L}]*)+') AS latin FROM p),
       t AS (SELECT l.id, nullif(trim(replace(url_decode(regexp_replace(regexp_extract(url, 'https?://[^/]+(/[^?#]*)', 1), '^/(wiki|en)/', '')), '_', ' ')), '') AS article, own FROM l),
       x AS (SELECT id, v AS title, 'label:' || lang AS source, CASE WHEN lang = 'en' THEN 0 WHEN list_contains("""
    + str(c.ENGLISH)
    + """, lang) THEN list_position("""
    + str(c.ENGLISH)
    + """, lang) WHEN latin AND lang = own THEN 20 WHEN latin AND list_contains("""
    + str(c.LATIN)
    + """, lang) THEN 30 + list_position("""
    + str(c.LATIN)
    + """, lang) WHEN latin THEN 100 WHEN lang = own THEN 200 ELSE 300 END AS rank, lang FROM r JOIN t USING (id)
         UNION ALL SELECT id, article, 'article', 10, '' FROM t WHERE article IS NOT NULL)
       SELECT id, title AS best_title, source AS title_source FROM x QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, lang) = 1""",
    "s",
)
def title_chain(spark, d):
    own = table(spark, d, "countries").select(F.col("qid").alias("country_qid"), "lang_code")
    rows = silver.sites(spark, d).join(own, "country_qid", "left")
    return c.titles(rows, "names", "wikipedia_page_en_url", "lang_code").select("id", "best_title", "title_source").filter("best_title is not null")


@query("SELECT lang, CAST(count(*) AS BIGINT) AS sites FROM (SELECT unnest(map_keys(names)) AS lang FROM s) GROUP BY lang", "s")
def names_by_language(spark, d):
    return silver.sites(spark, d).select(F.explode("names").alias("lang", "name")).groupBy("lang").agg(F.count("*").alias("sites"))


@query(
    "SELECT source, sites, round(100.0 * sites / sum(sites) OVER (), 4) AS percent FROM (SELECT coalesce(source, 'none') AS source, CAST(count(*) AS BIGINT) AS sites FROM s GROUP BY 1)",
    "s",
)
def source_provenance(spark, d):
    per = silver.sites(spark, d).groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("*").alias("sites"))
    whole = per.agg(F.sum("sites").alias("whole"))  # one row
    return per.crossJoin(F.broadcast(whole)).select("source", "sites", F.round(100.0 * F.col("sites") / F.col("whole"), 4).alias("percent"))


@query(
    """SELECT track, qid, arg_max(label, struct_pack(a := site_id, b := ordinal)) AS label, NOT EXISTS (SELECT 1 FROM wikidata_entities w WHERE w.qid = e.qid) AS fresh
       FROM e WHERE track IN ('polity', 'culture') AND confidence = 'high' AND regexp_full_match(qid, 'Q[0-9]+') AND label IS NOT NULL GROUP BY track, qid""",
    "e",
)
def reliable_new_entities(spark, d):
    """Entities that sure entries name; those not in the list at all are fresh and would be inserted, the others change nothing."""
    e = silver.entries(spark, d, ["polity", "culture"]).filter((F.col("confidence") == "high") & F.col("qid").rlike(r"^Q\d+$") & F.col("label").isNotNull())
    named = e.groupBy("track", "qid").agg(F.max_by("label", F.struct("site_id", "ordinal")).alias("label"))
    listed = table(spark, d, "wikidata_entities").select("qid", F.lit(False).alias("fresh")).distinct()
    return named.join(listed, "qid", "left").select("track", "qid", "label", F.coalesce("fresh", F.lit(True)).alias("fresh"))


@query(
    """SELECT site_id, string_agg(DISTINCT e.qid, ',' ORDER BY e.qid) AS subordinate_qids FROM e JOIN wikidata_entities w ON w.qid = e.qid WHERE track = 'polity' AND w.subordinate GROUP BY site_id""",
    "e",
)
def subordinate_qids(spark, d):
    e = silver.entries(spark, d, ["polity"]).join(table(spark, d, "wikidata_entities").filter("subordinate").select("qid"), "qid", "left_semi")
    return e.groupBy("site_id").agg(F.array_join(F.array_sort(F.collect_set("qid")), ",").alias("subordinate_qids"))


@query("SELECT id FROM s WHERE title_en = wikidata_id AND sitelinks_count > 0 AND wikidata_enriched_at IS NULL", "s")
def backfill_candidates(spark, d):
    return silver.sites(spark, d).filter("title_en = wikidata_id and sitelinks_count > 0 and wikidata_enriched_at is null").select("id")


@query(
    """SELECT qid, '  ' || qid || ' | ' || label_en || CASE WHEN family_label <> '' THEN ' [' || family_label || ']' ELSE '' END || CASE WHEN inception IS NOT NULL OR dissolution IS NOT NULL
         THEN ' (' || coalesce(CAST(inception AS VARCHAR), '?') || '→' || coalesce(CAST(dissolution AS VARCHAR), '') || ')' WHEN description_en <> '' THEN ' — ' || description_en ELSE '' END AS line
       FROM wikidata_entities WHERE label_en IS NOT NULL"""
)
def referential_lines(spark, d):
    dated = F.col("inception").isNotNull() | F.col("dissolution").isNotNull()
    life = F.concat(F.lit(" ("), F.coalesce(F.col("inception").cast("string"), F.lit("?")), F.lit("→"), F.coalesce(F.col("dissolution").cast("string"), F.lit("")), F.lit(")"))
    rest = F.when(dated, life).when(F.col("description_en") != "", F.concat(F.lit(" — "), "description_en")).otherwise("")
    family = F.when(F.col("family_label") != "", F.concat(F.lit(" ["), "family_label", F.lit("]"))).otherwise("")
    return table(spark, d, "wikidata_entities").filter("label_en is not null").select("qid", F.concat(F.lit("  "), "qid", F.lit(" | "), "label_en", family, rest).alias("line"))


@query(
    """SELECT site_id, track, ordinal, CASE WHEN track = 'site_type' THEN replace(label, '_', ' ') WHEN track = 'population' THEN format('{:,}', TRY_CAST(label AS BIGINT)) WHEN track = 'name' AND lang <> '' THEN label || ' (' || lang || ')' ELSE label END
         || CASE WHEN track IN ('religion', 'language') AND role IS NOT NULL THEN ' · ' || role ELSE '' END AS shown FROM (SELECT e.*, it.i->'value'->>'lang' AS lang FROM e JOIN it ON it.site_id = e.site_id AND it.section = e.track AND it.ordinal = e.ordinal) WHERE label IS NOT NULL""",
    "e",
)
def entries_as_text(spark, d):
    number = F.format_number(F.col("label").try_cast("bigint"), 0)
    tongue = F.when((F.col("track") == "name") & (F.col("lang") != ""), F.concat("label", F.lit(" ("), "lang", F.lit(")")))
    base = F.when(F.col("track") == "site_type", F.replace("label", F.lit("_"), F.lit(" "))).when(F.col("track") == "population", number).otherwise(F.coalesce(tongue, "label"))
    role = F.when(F.col("track").isin("religion", "language") & F.col("role").isNotNull(), F.concat(F.lit(" · "), "role")).otherwise("")
    items = timeline_items(silver.sites(spark, d).filter("timeline is not null"), "id", "timeline", ["record_id", "section", "ordinal", "label", "role", "lang"], TRACKS)
    rows = items.withColumnsRenamed({"record_id": "site_id", "section": "track"}).filter("label is not null")
    return rows.select("site_id", "track", "ordinal", F.concat(base, role).alias("shown"))


@query(
    """SELECT id, CAST(regexp_extract(wkt, 'Point\\(([^ ]+) ([^ ]+)\\)', 1) AS DOUBLE) AS lon, CAST(regexp_extract(wkt, 'Point\\(([^ ]+) ([^ ]+)\\)', 2) AS DOUBLE) AS lat, string_split(uri, '/')[-1] AS qid
       FROM (SELECT id, 'Point(' || CAST(CAST(lon * 100 AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(lat * 100 AS BIGINT) AS VARCHAR) || ')' AS wkt, 'http://www.example.org/entity/' || id AS uri FROM s WHERE lon IS NOT NULL AND lat IS NOT NULL)""",
    "s",
)
def bindings_parsed(spark, d):
    rows = silver.sites(spark, d).filter("lon is not null and lat is not null")
    wkt = F.concat(F.lit("Point("), F.rint(F.col("lon") * 100).cast("bigint").cast("string"), F.lit(" "), F.rint(F.col("lat") * 100).cast("bigint").cast("string"), F.lit(")"))
    rows = rows.select("id", wkt.alias("wkt"), F.concat(F.lit("http://www.example.org/entity/"), "id").alias("uri"))
    part = lambda k: F.regexp_extract("wkt", r"Point\(([^ ]+) ([^ ]+)\)", k).try_cast("double")
    return rows.select("id", part(1).alias("lon"), part(2).alias("lat"), F.substring_index("uri", "/", -1).alias("qid"))


@query(
    """SELECT year, CAST(CASE WHEN year >= -10000 AND year < -5000 THEN 1000 WHEN year >= -5000 AND year < -3200 THEN 500 WHEN year >= -3200 AND year < -1200 THEN 100 WHEN year >= -1200 AND year < 1800 THEN 50 ELSE 10 END AS INTEGER) AS step
       FROM (SELECT DISTINCT from_year AS year FROM e WHERE from_year IS NOT NULL)""",
    "e",
)
def play_steps(spark, d):
    step = F.lit(10)
    for low, high, size in SEGMENTS:
        step = F.when((F.col("year") >= low) & (F.col("year") < high), size).otherwise(step)
    return silver.entries(spark, d).select(F.col("from_year").alias("year")).filter("year is not null").distinct().withColumn("step", step)


@query(
    """SELECT qid, CAST(abs(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(qid, ''), lambda c: CAST(ascii(c) AS BIGINT))),
         lambda a, b: ((a * 31 + b + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)) % 360 AS INTEGER) AS hue FROM wikidata_entities WHERE qid IS NOT NULL"""
)
def name_hues(spark, d):
    codes = F.filter(F.split("qid", ""), lambda x: x != "")
    hashed = F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, x: F.pmod(h * 31 + F.ascii(x).cast("bigint") + 2147483648, F.lit(4294967296)) - 2147483648)
    return table(spark, d, "wikidata_entities").filter("qid is not null").select("qid", (F.abs(hashed) % 360).cast("int").alias("hue"))


@query("SELECT id, floor(lat * 1000 + 0.5) / 1000 AS lat, floor(lon * 1000 + 0.5) / 1000 AS lon, floor(lon * 10) / 10 AS cell FROM s WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90", "s")
def rounded_places(spark, d):
    rows = silver.sites(spark, d).filter("lon between -180 and 180 and lat between -90 and 90")
    return rows.select("id", (F.floor(F.col("lat") * 1000 + 0.5) / 1000).alias("lat"), (F.floor(F.col("lon") * 1000 + 0.5) / 1000).alias("lon"), (F.floor(F.col("lon") * 10) / 10).alias("cell"))


@query(
    """SELECT kind, word, CAST(count(*) AS BIGINT) AS entities, CAST(rank() OVER (PARTITION BY kind ORDER BY count(*) DESC) AS INTEGER) AS rank FROM (SELECT DISTINCT qid, kind, unnest(string_split(lower(description_en), ' ')) AS word
       FROM wikidata_entities WHERE description_en IS NOT NULL) GROUP BY kind, word"""
)
def class_frequency(spark, d):
    words = table(spark, d, "wikidata_entities").filter("description_en is not null").select("qid", "kind", F.explode(F.split(F.lower("description_en"), " ")).alias("word")).distinct()
    per = words.groupBy("kind", "word").agg(F.count("*").alias("entities"))
    return per.withColumn("rank", F.rank().over(Window.partitionBy("kind").orderBy(F.col("entities").desc())))


@query("SELECT qid, label_en FROM wikidata_entities WHERE active AND label_en ILIKE '%gif%' OR active AND qid = 'gif' ORDER BY CASE WHEN lower(label_en) = 'gif' THEN 0 WHEN starts_with(lower(label_en), 'gif') THEN 1 ELSE 2 END, qid LIMIT 20")
def referential_search(spark, d):
    low = F.lower("label_en")
    rows = table(spark, d, "wikidata_entities").filter("active").filter(F.col("label_en").ilike("%gif%") | (F.col("qid") == "gif"))
    return rows.orderBy(F.when(low == "gif", 0).when(low.startswith("gif"), 1).otherwise(2), "qid").limit(20).select("qid", "label_en")


@query()
def extraction_pipeline(spark, d):
    """Whole timelines normalised, then their QIDs checked, then the bounds of the entities, in this order."""
    columns = ["record_id", "section", "ordinal", "year", "to_year", "label", "qid", "role", "notes", "kind", "proposed_qid"]
    items = checkpoint(timeline_items(silver.sites(spark, d).filter("timeline is not null"), "id", "timeline", columns).withColumnRenamed("record_id", "site_id"))
    qid, proposed = (F.when(F.trim(c) != "", F.trim(c)) for c in ("qid", "proposed_qid"))
    rows = items.filter(F.col("section").isin(TRACKS))
    entries = rows.select("site_id", F.col("section").alias("track"), "ordinal", F.col("year").alias("from_year"), "to_year", "label", qid.alias("qid"), "role", "notes", entity_key(qid, F.col("label")).alias("entity"))
    events = items.filter("section = 'events'").select("site_id", "ordinal", "year", F.col("label").alias("type"))
    missing = items.filter("section = 'missing_entities'").select("site_id", "ordinal", "kind", F.col("label").alias("name"), proposed.alias("proposed_qid"))
    done = q.processed(entries, events, missing, table(spark, d, "wikidata_entities"))
    return done.withColumn("actions", F.array_join("actions", ","))


@query("SELECT CAST(time_bucket(INTERVAL 1 day, ts) AS TIMESTAMP) AS start, event_type, CAST(count(*) AS BIGINT) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_event_windows(spark, d):
    """The stream of events by day and type, worked off to its end."""
    import os

    from epochgrid.streaming import queue

    schema = table(spark, d, "events").schema
    single = os.path.isfile(f"{d}/events.parquet")
    stream = queue.landed(spark, d if single else f"{d}/events.parquet", schema, pattern="events.parquet" if single else None)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    folder = queue.scratch(spark)
    found = queue.windowed(stream, "ts", "event_type", "value", "1 day", "1 hour")
    done = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append")
    done.trigger(availableNow=True).start().awaitTermination()
    closed = spark.read.schema(found.schema).parquet(f"{folder}/out")
    # the windows that the watermark hasn't closed when the stream ends: those of its last events, worked out from the landed rows
    rows = spark.read.schema(schema).parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    seen = closed.agg(F.max("start").alias("last"))
    rest = rows.crossJoin(F.broadcast(seen)).filter(F.col("last").isNull() | (F.col("ts") >= F.col("last") + F.expr("interval 1 day")))
    rest = rest.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "events", "total")
    return closed.unionByName(rest).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events", F.round("total", 4).alias("total"))

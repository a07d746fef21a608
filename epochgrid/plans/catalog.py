"""The queries of the core and the SQL that gives the same rows."""

from __future__ import annotations

from epochgrid.operators.intervals import p4_found
from epochgrid.operators.spatial import p2_found
from epochgrid.operators.timelines import p3_found
from epochgrid.plans import registry
from epochgrid.plans.registry import ORACLE, QUERIES, query

query(
    """WITH p AS (SELECT id, min(struct_pack(lon := lon, lat := lat)).lon AS lon, min(struct_pack(lon := lon, lat := lat)).lat AS lat FROM sites
         WHERE id IS NOT NULL AND lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 AND NOT (lon = 0 AND lat = 0) GROUP BY id),
       q AS (SELECT *, CAST(floor(lat * 100) AS BIGINT) AS cy, CAST(floor((lon + 180) * 20) AS BIGINT) AS cx FROM p),
       g AS (SELECT id, lon, lat, cy + dy AS cy, cx + dx AS cx FROM q, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx))
       SELECT 'tile' AS rel, p.id AS key_a, t.lon_min || ':' || t.lat_min AS key_b FROM p
       JOIN (SELECT DISTINCT lon_min, lat_min FROM tiles) t ON t.lon_min = floor(p.lon) AND t.lat_min = floor(p.lat)
       UNION ALL
       SELECT 'near', a.id, b.id FROM g a JOIN q b ON a.cx = b.cx AND a.cy = b.cy AND a.id < b.id
       AND 2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2)
           + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 0.5""",
    name="p2_found",
)(p2_found)

query(
    """WITH d AS (SELECT id, any_value(timeline) AS timeline FROM timeline_dump WHERE id IS NOT NULL AND timeline IS NOT NULL GROUP BY id),
       k0 AS (SELECT id, CASE WHEN json_valid(timeline) THEN CAST(timeline AS JSON) END AS j FROM d),
       k1 AS (SELECT id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j->>'$') THEN CAST(j->>'$' AS JSON) END ELSE j END AS j FROM k0),
       k AS (SELECT id, CASE WHEN json_type(j->'tracks') = 'OBJECT' THEN j->'tracks' ELSE j END AS t FROM k1
             WHERE json_type(j) = 'OBJECT' AND coalesce(json_type(j->'rejection'), 'NULL') = 'NULL'),
       """
    + registry.SHARED["it"].replace("sec AS", "ksec AS").replace("FROM j)", "FROM k)").replace("it AS", "kit AS").replace("FROM sec", "FROM ksec")
    + """ SELECT origin, site_id AS record_id, section, ordinal,
       CAST(coalesce(TRY_CAST(CASE WHEN section = 'events' THEN i->>'year' ELSE i->>'from' END AS BIGINT), 0) AS INTEGER) AS year,
       coalesce(CASE WHEN section = 'events' THEN i->>'type' WHEN section = 'missing_entities' THEN i->>'name'
         WHEN json_type(i->'value') = 'OBJECT' THEN CASE WHEN section = 'name' THEN i->'value'->>'text' ELSE i->'value'->>'name' END ELSE i->>'value' END, '') AS label
       FROM (SELECT 'sites' AS origin, * FROM it UNION ALL SELECT 'timeline_dump', * FROM kit)""",
    uses="it",
    name="p3_found",
)(p3_found)

query(
    """WITH x AS (SELECT e.site_id, e.track, e.qid AS entity_qid, coalesce(e.from_year, s.inception_year) AS a, coalesce(e.to_year, s.dissolution_year, 9999) AS b
         FROM e JOIN s ON s.id = e.site_id WHERE e.track IN ('polity', 'culture', 'religion', 'language') AND e.qid IS NOT NULL),
       o AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY site_id, track, entity_qid ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh
         FROM x WHERE a <= b),
       n AS (SELECT *, sum(fresh) OVER (PARTITION BY site_id, track, entity_qid ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM o),
       p AS (SELECT site_id, track, entity_qid, min(a) AS a, max(b) AS b FROM n GROUP BY site_id, track, entity_qid, k),
       g AS (SELECT site_id, track, entity_qid, b AS a, lead(a) OVER (PARTITION BY site_id, track, entity_qid ORDER BY a) AS b FROM p)
       SELECT site_id, track, entity_qid, 'period' AS rel, CAST(a AS INTEGER) AS from_year, CAST(b AS INTEGER) AS to_year FROM p
       UNION ALL SELECT site_id, track, entity_qid, 'gap', CAST(a AS INTEGER), CAST(b AS INTEGER) FROM g WHERE b IS NOT NULL""",
    uses="e",
    name="p4_found",
)(p4_found)

from epochgrid.plans import atlas, curation, derived, display, quality, temporal  # noqa: E402, F401  (each registers its queries)

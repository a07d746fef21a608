"""Where queries and their SQL are written down side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: What the SQL texts share: sites once each (s), their timelines read from all outer forms (j), items (it), track entries (e),
#: events (v) and missing entities (m).
_NAMES = ["site_type", "polity", "culture", "religion", "language", "name", "population", "events", "missing_entities"]
SHARED = {
    "s": """s AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_updated DESC NULLS LAST,
        title_en NULLS LAST, sitelinks_count NULLS LAST, source NULLS LAST) AS rn FROM sites WHERE id IS NOT NULL) WHERE rn = 1)""",
    "j": """j0 AS (SELECT id, CASE WHEN json_valid(timeline) THEN CAST(timeline AS JSON) END AS j FROM s WHERE timeline IS NOT NULL),
        j1 AS (SELECT id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j->>'$') THEN CAST(j->>'$' AS JSON) END ELSE j END AS j FROM j0),
        j AS (SELECT id, CASE WHEN json_type(j->'tracks') = 'OBJECT' THEN j->'tracks' ELSE j END AS t FROM j1
              WHERE json_type(j) = 'OBJECT' AND coalesce(json_type(j->'rejection'), 'NULL') = 'NULL')""",
    "it": "sec AS (SELECT id, section, CASE WHEN json_type(x) = 'OBJECT' THEN x->'entries' ELSE x END AS x FROM (SELECT id, unnest(["
    + ", ".join(f"'{n}'" for n in _NAMES)
    + "]) AS section, unnest(["
    + ", ".join(f"t->'{n}'" for n in _NAMES)
    + """]) AS x FROM j)),
        it AS (SELECT * FROM (SELECT id AS site_id, section, unnest(CAST(x AS JSON[])) AS i, CAST(generate_subscripts(CAST(x AS JSON[]), 1) - 1 AS INTEGER) AS ordinal
               FROM sec WHERE json_type(x) = 'ARRAY') WHERE json_type(i) = 'OBJECT')""",
    "e": """e AS (SELECT site_id, section AS track, ordinal, TRY_CAST(i->>'from' AS BIGINT) AS from_year, TRY_CAST(i->>'to' AS BIGINT) AS to_year,
        CASE WHEN json_type(i->'value') = 'OBJECT' THEN CASE WHEN section = 'name' THEN i->'value'->>'text' ELSE i->'value'->>'name' END ELSE i->>'value' END AS label,
        nullif(trim(CASE WHEN json_type(i->'value') = 'OBJECT' THEN i->'value'->>'wikidata' WHEN json_type(i->'value') = 'VARCHAR' THEN i->>'wikidata' END), '') AS qid,
        i->>'role' AS role, i->>'confidence' AS confidence
        FROM it WHERE section NOT IN ('events', 'missing_entities'))""",
    "v": "v AS (SELECT site_id, ordinal, TRY_CAST(i->>'year' AS BIGINT) AS year, i->>'type' AS type FROM it WHERE section = 'events')",
    "m": "m AS (SELECT site_id, ordinal, i->>'kind' AS kind, i->>'name' AS name, nullif(trim(i->>'proposed_qid'), '') AS proposed_qid FROM it WHERE section = 'missing_entities')",
}
SHARED["dm"] = (
    """dj0 AS (SELECT id, CASE WHEN json_valid(t) THEN CAST(t AS JSON) END AS j FROM (SELECT id, any_value(timeline) AS t FROM timeline_dump WHERE id IS NOT NULL AND timeline IS NOT NULL GROUP BY id)),
        dj1 AS (SELECT id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j->>'$') THEN CAST(j->>'$' AS JSON) END ELSE j END AS j FROM dj0),
        dj AS (SELECT id, CASE WHEN json_type(j->'tracks') = 'OBJECT' THEN j->'tracks' ELSE j END AS t FROM dj1
              WHERE json_type(j) = 'OBJECT' AND coalesce(json_type(j->'rejection'), 'NULL') = 'NULL'),
        """
    + SHARED["it"].replace("sec AS", "dsec AS").replace("FROM j)", "FROM dj)").replace("it AS", "dit AS").replace("FROM sec", "FROM dsec")
    + """, dm AS (SELECT site_id, ordinal, i->>'kind' AS kind, i->>'name' AS name, i->>'context' AS context, nullif(trim(i->>'proposed_qid'), '') AS proposed_qid FROM dit WHERE section = 'missing_entities')"""
)
_NEEDS = {"s": "s", "j": "s j", "it": "s j it", "e": "s j it e", "v": "s j it v", "m": "s j it m", "dm": "dm"}


def with_shared(sql: str, uses: str) -> str:
    """The SQL with the named shared parts, and what they need, in front."""
    parts: list[str] = []
    for name in uses.split():
        parts += [p for p in _NEEDS[name].split() if p not in parts]
    head = ",\n".join(SHARED[p] for p in parts)
    sql = sql.strip()
    if not parts:
        return sql
    for start in ("WITH RECURSIVE ", "WITH "):
        if sql.upper().startswith(start):
            return f"{start}{head}, {sql[len(start) :]}"
    return f"WITH {head} {sql}"


def query(sql: str | None = None, uses: str = "", name: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE[key] = with_shared(sql, uses)
        return f

    return keep

"""The scalar functions for SQL users, as SQL functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from epochgrid.functions.numbers import TYPE_SCORE
from epochgrid.functions.text import _FROM, _TO

_ENTRIES = "ARRAY<STRUCT<`from`: BIGINT, ordinal: INT, `to`: BIGINT, value: STRING>>"
_SCORES = " ".join(f"WHEN '{k}' THEN {v}" for k, v in TYPE_SCORE.items())

FUNCTIONS = {
    "f_unaccent(term STRING)": ("STRING", f"translate(regexp_replace(term, '[\\u0300-\\u036F]', ''), '{_FROM}', '{_TO}')"),
    "sites_build_search_text(title STRING, names MAP<STRING, STRING>, native STRING, told ARRAY<STRING>)": (
        "STRING",
        "nullif(array_join(array_sort(array_distinct(filter(concat(array(title, native), coalesce(map_values(names), array()), coalesce(told, array())), t -> t <> ''))), ' '), '')",
    ),
    "role_rank(role STRING)": ("INT", "CASE role WHEN 'state' THEN 0 WHEN 'major' THEN 1 WHEN 'minor' THEN 2 WHEN 'minority' THEN 3 ELSE 9 END"),
    "base_importance(sitelinks INT, article STRING)": (
        "INT",
        "CASE WHEN coalesce(sitelinks, 0) = 0 AND article IS NULL THEN 0 ELSE least(100, CAST(rint(20 * log10(coalesce(sitelinks, 0) + 1)) AS INT) + IF(article IS NULL, 0, 8)) END",
    ),
    "compute_importance(site_type STRING, population BIGINT, told BOOLEAN)": (
        "INT",
        f"least(100, CASE site_type {_SCORES} ELSE 20 END + IF(coalesce(population, 0) > 0, least(30, CAST(rint(log10(population) * 8) AS INT)), 0) + IF(told, 10, 0))",
    ),
    "entity_key(qid STRING, label STRING)": ("STRING", "coalesce('qid:' || nullif(trim(qid), ''), 'name:' || nullif(trim(regexp_replace(lower(label), '\\\\s+', ' ')), ''))"),
    f"track_value_at(entries {_ENTRIES}, year BIGINT)": ("STRING", "array_max(filter(entries, e -> e.`from` <= year)).value"),
    f"site_occupied_at(entries {_ENTRIES}, year BIGINT)": ("BOOLEAN", "coalesce(array_max(filter(entries, e -> e.`from` <= year)).`to` >= year, true)"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session; entries are structs that begin with (from, ordinal), so the latest is the greatest."""
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]

"""Sites once each, and their timelines as flat tables.

``write`` makes the flat tables once, entries in folders by track and in order of site; each reader here takes them from the
folder where ``write`` put them (``stored``) instead of parsing the JSON again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochgrid.functions.text import entity_key
from epochgrid.operators.timelines import TRACKS, latest, timeline_items
from epochgrid.sources.tables import table


def sites(spark: SparkSession, sf_dir: str, key: str | None = None) -> DataFrame:
    """Each site's last row; with ``key`` that of one id, which the scan looks for."""
    c = F.col
    rows = table(spark, sf_dir, "sites")
    return latest(
        rows if key is None else rows.filter(c("id") == key), "id", c("last_updated").desc_nulls_last(), c("title_en").asc_nulls_last(),
        c("sitelinks_count").asc_nulls_last(), c("source").asc_nulls_last(),
    )


_ENTRIES = ["site_id", "track", "ordinal", "from_year", "to_year", "label", "qid", "role", "confidence", "entity"]
#: Columns of sites that the stored tables keep beside each entry, so that a map's box needs no join.
PLACED = ["lon", "lat", "enrichment_level"]


def write(spark: SparkSession, sf_dir: str, out: str) -> None:
    """Writes ``sites``, ``entries``, ``events`` and ``missing`` below ``out``; rows with one site lie together."""
    sites(spark, sf_dir).repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{out}/sites")
    made = entries(spark, sf_dir, keep=PLACED).repartitionByRange("track", "site_id").sortWithinPartitions("track", "site_id", "ordinal")
    made.write.mode("overwrite").partitionBy("track").parquet(f"{out}/entries")
    for name, rows in (("events", events(spark, sf_dir)), ("missing", missing(spark, sf_dir))):
        rows.repartitionByRange("site_id").sortWithinPartitions("site_id").write.mode("overwrite").parquet(f"{out}/{name}")


def stored(spark: SparkSession, out: str, name: str, tracks: list[str] | None = None) -> DataFrame:
    """A table that ``write`` wrote; of entries only the folders of the tracks are read."""
    rows = spark.read.parquet(f"{out}/{name}")
    return rows.filter(F.col("track").isin(tracks)) if tracks else rows


def entries(
    spark: SparkSession, sf_dir: str, tracks: list[str] | None = None, keep: list[str] | None = None, key: str | None = None, where: Column | None = None
) -> DataFrame:
    """(site_id, track, ordinal, from_year, to_year, label, qid, role, confidence, entity) of all track entries.

    ``key`` reads the site of that id only, ``where`` the sites that fulfil it; both act before any JSON is parsed."""
    records = sites(spark, sf_dir, key).filter("timeline is not null")
    out = timeline_items(
        records if where is None else records.filter(where), "id", "timeline",
        ["record_id", "section", "ordinal", "year", "to_year", "label", "qid", "role", "confidence"], tracks or TRACKS, keep,
    )
    qid = F.when(F.trim("qid") != "", F.trim("qid"))
    return out.select(
        F.col("record_id").alias("site_id"), F.col("section").alias("track"), "ordinal", F.col("year").alias("from_year"), "to_year", "label",
        qid.alias("qid"), "role", "confidence", entity_key(qid, F.col("label")).alias("entity"), *(keep or []),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site_id, ordinal, year, type)"""
    out = timeline_items(sites(spark, sf_dir).filter("timeline is not null"), "id", "timeline", ["record_id", "ordinal", "year", "label"], ["events"])
    return out.select(F.col("record_id").alias("site_id"), "ordinal", "year", F.col("label").alias("type"))


def missing(spark: SparkSession, sf_dir: str, source: str = "sites") -> DataFrame:
    """(site_id, ordinal, kind, name, context, proposed_qid) of the missing entities in a table's timelines."""
    if source == "sites":
        records = sites(spark, sf_dir)
    else:
        records = latest(table(spark, sf_dir, source).filter("timeline is not null"), "id", F.col("extracted_at").desc_nulls_last())
    out = timeline_items(
        records.filter("timeline is not null"), "id", "timeline", ["record_id", "ordinal", "kind", "label", "context", "proposed_qid"], ["missing_entities"]
    )
    proposed = F.when(F.trim("proposed_qid") != "", F.trim("proposed_qid"))
    return out.select(F.col("record_id").alias("site_id"), "ordinal", "kind", F.col("label").alias("name"), "context", proposed.alias("proposed_qid"))

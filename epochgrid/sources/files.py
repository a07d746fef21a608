"""Files that other systems leave: query results as JSON, reviewed lists, plain lists of QIDs; and what is written for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochgrid.functions.numbers import wikidata_year
from epochgrid.operators.merge import first_filled


def qid_list(spark: SparkSession, path: str) -> DataFrame:
    """(qid) of the lines that begin with a Q."""
    return spark.read.text(path).select(F.trim("value").alias("qid")).filter(F.col("qid").startswith("Q")).distinct()


def reviewed(spark: SparkSession, path: str) -> DataFrame:
    """Reviewed rows (name, family, qid, resolved_label, ...) of a JSON list, without those that have no match."""
    schema = "name string, family string, qid string, resolved_label string, resolved_description string, notes string, ok string"
    return spark.read.schema(schema).option("multiLine", True).json(path).filter("qid is not null and qid <> 'NOT_FOUND'")


def site_bindings(bindings: DataFrame) -> DataFrame:
    """One row for each site of query results in JSON: structs with a value each, several rows a site, in the order of ``row``.

    Of each column the first value counts; type and its QID come from one row, and a label that is only the QID gives way to a real
    one. A place that can't be read is null.
    """
    v = lambda c: F.col(f"{c}.value")
    tail = lambda c: F.substring_index(v(c), "/", -1)
    place = lambda k: F.regexp_extract(v("coord"), r"Point\(([^ ]+) ([^ ]+)\)", k).try_cast("double")
    rows = bindings.select(
        "row", tail("site").alias("qid"), v("siteLabel").alias("label"), v("d").alias("description"),
        F.when(v("typeLabel").isNotNull(), F.struct(v("typeLabel").alias("type"), tail("type").alias("type_qid"))).alias("kind"),
        place(1).alias("lon"), place(2).alias("lat"), tail("country").alias("country_qid"), v("sl").try_cast("int").alias("sitelinks_count"),
        v("pop").try_cast("bigint").alias("population"), wikidata_year(v("inception")).alias("inception_year"), v("enwiki").alias("wikipedia_page_en_url"),
    ).filter(F.col("qid").startswith("Q"))
    rows = rows.withColumn("label", F.when(F.col("label") != F.col("qid"), F.col("label")))
    out = first_filled(rows, "qid", ["row"], [c for c in rows.columns if c not in ("row", "qid")])
    return out.withColumn("label", F.coalesce("label", "qid")).select("*", "kind.type", "kind.type_qid").drop("kind")


def entity_bounds(bindings: DataFrame) -> DataFrame:
    """(qid, inception, inception_precision, dissolution, dissolution_precision): the widest window of rows (e, kind, time,
    precision), each bound with the precision of the row it comes from."""
    v = lambda c: F.col(f"{c}.value")
    rows = bindings.select(F.substring_index(v("e"), "/", -1).alias("qid"), v("kind").alias("kind"), wikidata_year(v("time")).alias("year"), v("precision").try_cast("int").alias("precision"))
    first, last = (F.when((F.col("kind") == k) & F.col("year").isNotNull(), F.struct("year", "precision")) for k in ("inception", "dissolution"))
    out = rows.groupBy("qid").agg(F.min(first).alias("i"), F.max(last).alias("d"))
    return out.select("qid", F.col("i.year").alias("inception"), F.col("i.precision").alias("inception_precision"), F.col("d.year").alias("dissolution"), F.col("d.precision").alias("dissolution_precision"))


def entity_aliases(bindings: DataFrame) -> DataFrame:
    """(qid, label_en, label_fr, description_en, country_qid, aliases): one row for each entity of query results (row, e, enLabel, frLabel,
    desc, country, alias), of each column the first value, the different aliases joined by `` | ``; without an English label none."""
    v = lambda c: F.col(f"{c}.value")
    rows = bindings.select(
        "row", F.substring_index(v("e"), "/", -1).alias("qid"), v("enLabel").alias("label_en"), v("frLabel").alias("label_fr"), v("desc").alias("description_en"),
        F.substring_index(v("country"), "/", -1).alias("country_qid"), v("alias").alias("alias"),
    ).filter(F.col("qid").startswith("Q"))
    one = first_filled(rows, "qid", ["row"], ["label_en", "label_fr", "description_en", "country_qid"]).filter("label_en is not null")
    also = rows.filter("alias <> ''").groupBy("qid").agg(F.array_join(F.array_sort(F.collect_set("alias")), " | ").alias("aliases"))
    return one.join(also, "qid", "left")


def sitelinks(bindings: DataFrame) -> DataFrame:
    """(qid, sitelinks_count) of query results (e, links); what isn't a number is left out, of several the greatest counts."""
    rows = bindings.select(F.substring_index(F.col("e.value"), "/", -1).alias("qid"), F.col("links.value").try_cast("int").alias("n"))
    return rows.filter("qid like 'Q%' and n is not null").groupBy("qid").agg(F.max("n").alias("sitelinks_count"))


def attributions(bindings: DataFrame) -> DataFrame:
    """(entity_qid, site_qid), each once, of query results (c, site): the culture and the site attributed to it."""
    tail = lambda c: F.regexp_replace(F.col(f"{c}.value"), "^.*/entity/", "")
    return bindings.select(tail("c").alias("entity_qid"), tail("site").alias("site_qid")).filter("entity_qid like 'Q%' and site_qid like 'Q%'").distinct()


_TEXT = "MAP<STRING, STRUCT<value: STRING>>"
_CLAIMS = f"entities MAP<STRING, STRUCT<missing: STRING, labels: {_TEXT}, descriptions: {_TEXT}, sitelinks: MAP<STRING, STRUCT<title: STRING>>, claims: MAP<STRING, ARRAY<STRUCT<mainsnak: STRUCT<datavalue: STRUCT<value: STRING>>>>>>>"


def entity_claims(spark: SparkSession, path: str, claim: str = "P31") -> DataFrame:
    """(qid, label_en, description_en, types) of landed answers about entities, one answer a file; ``types`` are the QIDs of a claim, in
    order. Missing entities are left out, one without the claim has an empty list."""
    rows = spark.read.schema(_CLAIMS).option("multiLine", True).json(path).select(F.explode("entities").alias("qid", "x")).filter("x.missing is null")
    ids = F.transform(F.try_element_at("x.claims", F.lit(claim)), lambda c: F.get_json_object(c["mainsnak"]["datavalue"]["value"], "$.id"))
    text = lambda c: F.try_element_at(f"x.{c}", F.lit("en"))["value"]
    types = F.coalesce(F.filter(ids, lambda i: i.isNotNull()), F.array().cast("array<string>"))
    return rows.select("qid", text("labels").alias("label_en"), text("descriptions").alias("description_en"), types.alias("types"))


def article_links(spark: SparkSession, path: str) -> DataFrame:
    """(qid, lang, title) of the articles that landed answers about entities link to; other wikis than those of a language are left out."""
    rows = spark.read.schema(_CLAIMS).option("multiLine", True).json(path).select(F.explode("entities").alias("qid", "x"))
    links = rows.select("qid", F.explode("x.sitelinks").alias("wiki", "link")).select("qid", F.regexp_extract("wiki", "^([a-z_-]+)wiki$", 1).alias("lang"), F.col("link.title").alias("title"))
    return links.filter("lang not in ('', 'commons', 'species', 'wikidata', 'meta')")


def article_sections(spark: SparkSession, path: str) -> DataFrame:
    """(title, position, index, level, line) of landed section lists, in order; an answer without sections gives no rows."""
    schema = "parse STRUCT<title: STRING, sections: ARRAY<STRUCT<index: STRING, level: STRING, line: STRING>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select("parse.title", F.posexplode("parse.sections").alias("position", "s")).select("title", "position", "s.index", F.col("s.level").try_cast("int").alias("level"), "s.line")


def append(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Adds rows to a log, in folders by a column of few values if one is named."""
    writer = rows.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def replace(rows: DataFrame, path: str) -> None:
    """Writes the state anew."""
    rows.write.mode("overwrite").parquet(path)


def dump_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def features(shapes: DataFrame, properties: list[str], geometry: str = "geometry") -> DataFrame:
    """(feature): GeoJSON features, whose shapes are JSON already."""
    told = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"})
    return shapes.select(F.concat(F.lit('{"type":"Feature","properties":'), told, F.lit(',"geometry":'), F.coalesce(F.col(geometry), F.lit("null")), F.lit("}")).alias("feature"))

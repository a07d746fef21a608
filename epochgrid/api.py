"""What a caller can ask for, over one data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochgrid.functions.numbers import BASE_ZOOM, ZOOM, entity_color
from epochgrid.functions.text import by_locale, role_rank
from epochgrid.operators import curation, geo, quality, search, temporal
from epochgrid.operators.sites import markers as markers_of
from epochgrid.operators.sites import within
from epochgrid.sources import silver
from epochgrid.sources.files import features
from epochgrid.sources.tables import table

ROLES = ["state", "major", "minor", "minority"]
KINDS = ["polity", "culture", "religion", "language"]


class Atlas:
    """Sites, their timelines and the entities in them. All answers are lazy frames."""

    def __init__(self, spark: SparkSession, folder: str, stored: str | None = None):
        """``stored`` is where ``silver.write`` put the flat tables; without it each answer parses the timelines it needs."""
        self.spark, self.folder, self.stored = spark, folder, stored

    @property
    def sites(self) -> DataFrame:
        return silver.stored(self.spark, self.stored, "sites") if self.stored else silver.sites(self.spark, self.folder)

    @property
    def entities(self) -> DataFrame:
        return table(self.spark, self.folder, "wikidata_entities")

    def entries(self, tracks: list[str] | None = None, key: str | None = None, where: Column | None = None) -> DataFrame:
        """Track entries, of one site or of the sites that fulfil a condition on their place or level."""
        if not self.stored:
            return silver.entries(self.spark, self.folder, tracks, key=key, where=where)
        rows = silver.stored(self.spark, self.stored, "entries", tracks)
        rows = rows if key is None else rows.filter(F.col("site_id") == key)
        return (rows if where is None else rows.filter(where)).drop(*silver.PLACED)

    def sites_at(self, year: int, zoom: float = 3, box: tuple[float, float, float, float] = (-180, -90, 180, 90), timeline: str = "timeline_only") -> DataFrame:
        """Markers of a map at a year; ``timeline`` is timeline_only, no_timeline or all."""
        if timeline not in ("timeline_only", "no_timeline", "all"):
            raise ValueError(timeline)
        return markers_of(self.sites, self.entries(["site_type", "polity", "culture", "population"], where=within(*box)), year, zoom, box, timeline)

    def search(self, text: str, limit: int = 8) -> DataFrame:
        names = self.entries(["name"]).select("site_id", F.col("label").alias("name")).filter("name is not null")
        texts = search.search_text(self.sites, names)
        found = search.found(texts, "search_text", text)
        return found.orderBy(F.col("score").desc(), "id").limit(min(20, max(1, limit)))

    def search_entities(self, text: str, kind: str | None = None, limit: int = 25) -> DataFrame:
        rows = self.entities.filter("active") if kind is None else self.entities.filter(F.col("active") & (F.col("kind") == kind))
        found = search.found(rows, "search_text", text)
        return found.orderBy(F.col("score").desc(), F.length("label_en"), "qid").limit(min(25, max(1, limit)))

    def site(self, key: str) -> DataFrame:
        """The site of an id, also while it lies empty, with its subordinate polities."""
        known = self.entities.filter("subordinate").select("qid")
        below = self.entries(["polity"], key).join(known, "qid", "left_semi").groupBy("site_id").agg(F.array_sort(F.collect_set("qid")).alias("subordinate_qids"))
        own = self.sites.filter(F.col("id") == key) if self.stored else silver.sites(self.spark, self.folder, key)
        rows = own.join(below, F.col("id") == F.col("site_id"), "left").drop("site_id")
        return rows.withColumn("subordinate_qids", F.coalesce("subordinate_qids", F.array().cast("array<string>")))

    def entity(self, qid: str) -> DataFrame:
        """What is known of a QID, with the number of sites that use it; an unknown one gives a row of nulls."""
        if not (qid.startswith("Q") and qid[1:].isdigit()):
            raise ValueError(qid)
        used = self.entries(KINDS).filter(F.col("qid") == qid).agg(F.countDistinct("site_id").alias("sites"))
        return used.select(F.lit(qid).alias("qid"), "sites").join(self.entities, "qid", "left")

    def hulls(self, year: int, kind: str, least_role: str = "major", radius: float = geo.RADIUS) -> DataFrame:
        """(feature): territories of the entities of a kind at a year as GeoJSON features."""
        if kind not in KINDS or least_role not in ROLES:
            raise ValueError((kind, least_role))
        level = F.col("enrichment_level") == "extracted"
        entries = self.entries([kind], where=level)
        now = temporal.sovereign(entries, self.entities, year) if kind == "polity" else temporal.active(entries, year)
        if kind in temporal.COOCCURRENT:
            now = now.filter(F.col("role").isin(ROLES[: ROLES.index(least_role) + 1]))
        yes = F.lit(True)
        alive = F.coalesce(F.col("inception_year") <= year, yes) & F.coalesce(F.col("dissolution_year") >= year, yes)
        placed = self.sites.filter(level & alive).filter("lon between -180 and 180 and lat between -90 and 90")
        lived = temporal.occupied(self.sites.filter(level), self.entries(["site_type"], where=level), year).filter("occupied").select(F.col("site_id").alias("id"))
        placed = placed.select("id", "lon", "lat").join(lived, "id", "left_semi")
        named = now.filter(F.col("qid").isNotNull() & ~F.col("qid").startswith("local_")).select("qid", F.col("label").alias("name"), role_rank(F.col("role")).alias("rank"), F.col("site_id").alias("id"))
        shapes = geo.territories(named.join(placed, "id"), radius).select("qid", "name", "sites", "top_rank", "geometry")
        known = self.entities.select("qid", "family_label").dropDuplicates(["qid"])
        hue, saturation, lightness = entity_color(F.col("qid"), F.col("family_label"))
        shapes = shapes.join(known, "qid", "left").withColumns({"hue": hue, "saturation": saturation, "lightness": lightness})
        return features(shapes, ["qid", "name", "family_label", "sites", "top_rank", "hue", "saturation", "lightness"])

    def listed(self, kind: str, text: str = "", limit: int = 50, offset: int = 0) -> DataFrame:
        """A page of the polities, cultures, religions or languages, by label as people sort it."""
        rows = self.entities.filter(F.col("active") & (F.col("kind") == kind))
        if text:
            rows = rows.filter(F.lower("label_en").contains(text.lower()))
        return rows.orderBy(by_locale(F.col("label_en")), "qid").offset(offset).limit(min(200, max(1, limit))).select("qid", "label_en", "description_en", "family_label", "inception", "dissolution")

    def edited(self, edits: DataFrame) -> DataFrame:
        """The next snapshot of the entries of the edited sites."""
        known = self.entries().join(edits.select("site_id").distinct(), "site_id", "left_semi")
        return curation.edited(known, edits)

    def conflicts(self) -> DataFrame:
        return quality.conflicts(quality.bounded(self.entries(KINDS), self.entities))

    def gaps(self, source: str = "sites") -> DataFrame:
        """Missing entities by kind and name, those of most sites first."""
        m = silver.missing(self.spark, self.folder, source).filter(F.trim("name") != "")
        board = m.groupBy(F.lower(F.trim("kind")).alias("kind"), "name").agg(F.countDistinct("site_id").alias("sites"))
        return board.orderBy(F.col("sites").desc(), "kind", "name")

    @staticmethod
    def thresholds(zoom: float) -> tuple[int, int]:
        z = min(12, max(2, int(zoom // 1)))
        return ZOOM[z], BASE_ZOOM[z]

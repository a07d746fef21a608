"""Titles, sections, classes and coverage: what curators look at, and edits of single entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochgrid.session import written

# English variants, and languages in Latin script in order of preference.
ENGLISH = "en-gb en-ca en-us en-au en-nz en-simple".split()
LATIN = "fr de es it pt nl ca gl eu pl cs sk sl hr sh bs ro hu sv da nb nn fi et lv lt tr az id ms vi af sq cy ga eo ceb war la".split()


def is_latin(c: Column) -> Column:
    """Whether a text has letters and all are Latin."""
    return c.rlike(r"^[^\p{L}]*(\p{IsLatin}[^\p{L}]*)+$")


def article_title(url: Column) -> Column:
    """The title in an article's address; null if there is none."""
    slug = F.regexp_replace(F.parse_url(url, F.lit("PATH")), "^/(?:(?:wiki|en)/)?", "")
    title = F.trim(F.replace(F.try_url_decode(slug), F.lit("_"), F.lit(" ")))
    return F.when(title != "", title)


def titles(rows: DataFrame, labels: str, url: str, language: str) -> DataFrame:
    """``rows`` with ``best_title`` and ``title_source``: English, its variants, the article's title, the country's language if
    Latin, Latin languages by preference, any Latin label, the country's own, any. Blank labels don't count; of several the one whose
    language comes first in the alphabet."""
    kept = F.map_filter(F.col(labels), lambda k, v: F.trim(v) != "")
    rows = rows.withColumn("__labels", kept)
    given = F.col("__labels")

    def of(language: Column | str) -> Column:
        return F.trim(F.try_element_at(given, language if isinstance(language, Column) else F.lit(language)))

    def tagged(title: Column, source: Column) -> Column:
        return F.when(title.isNotNull(), F.struct(title.alias("title"), source.alias("source")))

    def label(language: Column, ok: Column | None = None) -> Column:
        title = of(language)
        return tagged(title if ok is None else F.when(ok, title), F.concat(F.lit("label:"), language))

    own = F.col(language)
    pairs = F.array_sort(F.map_entries(given))
    latin = F.filter(pairs, lambda p: is_latin(p["value"]))
    preferred = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), of(k).alias("value")) for k in LATIN]), lambda p: p["value"].isNotNull() & is_latin(p["value"]))

    def first(array: Column) -> Column:
        p = F.try_element_at(array, F.lit(1))
        return tagged(F.trim(p["value"]), F.concat(F.lit("label:"), p["key"]))

    chain = [label(F.lit(k)) for k in ["en", *ENGLISH]] + [
        tagged(article_title(F.col(url)), F.lit("article")), label(own, is_latin(of(own))), first(preferred), first(latin), label(own), first(pairs),
    ]
    best = F.coalesce(*chain)
    return rows.withColumn("__best", best).withColumns({"best_title": F.col("__best.title"), "title_source": F.col("__best.source")}).drop("__best", "__labels")


def sections_selected(sections: DataFrame, include: str, exclude: str) -> DataFrame:
    """Rows (page, position, level, title) whose title fits ``include`` and not ``exclude``, and all deeper ones that follow one
    until a section of its level or above."""
    fits = F.col("title").rlike(f"(?i){include}") & ~F.col("title").rlike(f"(?i){exclude}")
    rows = sections.withColumn("fits", F.coalesce(fits, F.lit(False)))
    before = Window.partitionBy("page").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    # by level, the last chosen and the last ending position: a section is under a chosen one of a level if nothing of that level or above came since
    chosen = F.array(*[F.max(F.when(F.col("fits") & (F.col("level") == k), F.col("position"))).over(before) for k in range(1, 7)])
    ended = F.array(*[F.max(F.when(F.col("level") <= k, F.col("position"))).over(before) for k in range(1, 7)])
    rows = rows.withColumn("chosen", chosen).withColumn("ended", ended)
    under = F.exists(
        F.sequence(F.lit(1), F.lit(6)),
        lambda k: (k < F.col("level")) & (F.element_at("chosen", k) >= F.element_at("ended", k)),
    )
    return rows.filter(F.col("fits") | F.coalesce(under, F.lit(False))).drop("fits", "chosen", "ended")


def tolerant_json(text: Column) -> Column:
    """JSON in an answer: the whole, else the last fenced block, else from the first brace to the last; null if none can be read."""
    fence = F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(text, F.lit(r"(?s)```(?:json)?\s*(.*?)```"), F.lit(1))), -1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(fence), F.try_parse_json(F.when(braces != "", braces)))


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root) of all nodes under each root, by rounds of (child, parent) edges; cycles end, the lineage is cut each round."""
    found = roots.select(F.col("node"), F.col("node").alias("root")).distinct()
    fresh = found
    while True:
        step = fresh.join(edges, fresh.node == edges.parent).select(F.col("child").alias("node"), "root").distinct()
        fresh = written(step.join(found, ["node", "root"], "left_anti"))
        if fresh.isEmpty():
            return found
        found = written(found.unionByName(fresh))


def whitelist(closures: DataFrame, excluded: DataFrame, order: list[str], partial: str, words: str) -> DataFrame:
    """(node, root) of accepted classes: those under the roots in ``order`` without excluded ones; under ``partial`` only if the
    label fits ``words``. The first root wins. ``closures`` are (node, root, label)."""
    rank = F.array_position(F.array(*[F.lit(r) for r in [*order, partial]]), F.col("root"))
    kept = closures.withColumn("rank", rank).filter("rank > 0").filter((F.col("root") != partial) | F.col("label").rlike(f"(?i){words}"))
    kept = kept.join(excluded.select("node"), "node", "left_anti")
    return kept.groupBy("node").agg(F.min_by("root", "rank").alias("root"))


def triage(types: Column, excluded: list[str], excluded_alone: list[str], wanted: list[str], signals: list[str], doubts: Column) -> Column:
    """exclude, signal, check or keep, in this order: by exact class, by a class that only excludes without a wanted one, by
    signalling class, by doubt or for want of a wanted class."""
    low = F.transform(F.coalesce(types, F.array().cast("array<string>")), F.lower)

    def among(names: list[str]) -> Column:
        return F.arrays_overlap(low, F.array(*[F.lit(n.lower()) for n in names])) if names else F.lit(False)

    good = F.exists(low, lambda x: x.rlike("|".join(wanted)))
    return F.when(among(excluded) | (~good & among(excluded_alone)), "exclude").when(among(signals), "signal").when(doubts | ~good, "check").otherwise("keep")


def coverage(attributions: DataFrame, types: DataFrame, accepted: DataFrame, sites: DataFrame) -> DataFrame:
    """By entity: attributed sites in scope, out of scope and of unknown type, those indexed and extracted, and the gain.

    ``attributions`` are (entity, site), ``types`` (site, class), ``accepted`` (class), ``sites`` (site, extracted, attributed)."""
    typed = types.join(accepted.select("class", F.lit(True).alias("ok")), "class", "left").groupBy("site").agg(F.max(F.coalesce("ok", F.lit(False))).alias("ok"))
    rows = attributions.select("entity", "site").distinct().join(typed, "site", "left").join(sites, "site", "left")
    scope = F.coalesce("ok", F.lit(False))
    held = scope & F.col("extracted").isNotNull()
    out = rows.groupBy("entity").agg(
        F.count("*").alias("sites"), F.count_if(scope).alias("in_scope"), F.count_if(~F.coalesce("ok", F.lit(True))).alias("out_of_scope"),
        F.count_if(F.col("ok").isNull()).alias("unknown"), F.count_if(held).alias("indexed"), F.count_if(held & F.col("extracted")).alias("extracted"),
        F.count_if(F.coalesce("attributed", F.lit(False))).alias("attributed"),
    )
    return out.withColumn("gain", F.greatest(F.lit(0), F.col("indexed") - F.col("attributed")))


def edited(entries: DataFrame, edits: DataFrame) -> DataFrame:
    """The next snapshot of entries after edits (site_id, track, ordinal, expected, action, qid, from_year, label): ``delete`` and
    ``set_qid`` act if the entry still has the expected label, ``add`` puts a new entry in order of start. Ordinals are counted anew."""
    change = edits.filter("action <> 'add'").select("site_id", "track", "ordinal", "expected", "action", F.col("qid").alias("new_qid"))
    rows = entries.join(change, ["site_id", "track", "ordinal"], "left")
    hit = F.col("action").isNotNull() & F.col("label").eqNullSafe(F.col("expected"))
    rows = rows.filter(~(hit & (F.col("action") == "delete"))).withColumn("qid", F.when(hit & (F.col("action") == "set_qid"), F.col("new_qid")).otherwise(F.col("qid")))
    rows = rows.select("site_id", "track", "ordinal", "from_year", "label", "qid")
    added = edits.filter("action = 'add'").select("site_id", "track", F.lit(2**31 - 1).alias("ordinal"), "from_year", "label", "qid")
    order = Window.partitionBy("site_id", "track").orderBy("from_year", "ordinal")
    return rows.unionByName(added).withColumn("ordinal", F.row_number().over(order) - 1)

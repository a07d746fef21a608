"""Search by name: all names of a site as one text, found by prefix, part or similar trigrams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochgrid.functions.numbers import base_importance
from epochgrid.functions.text import normalised

LEAST = 0.3


def meta_text(meta: Column, path: str) -> Column:
    """A field of JSON that may be encoded twice."""
    twice = meta.startswith('"')
    inner = F.when(twice, F.expr("1").cast("string")).otherwise(meta)
    inner = F.when(twice, F.get_json_object(F.concat(F.lit('{"x":'), meta, F.lit("}")), "$.x")).otherwise(meta)
    return F.get_json_object(inner, path)


def search_text(sites: DataFrame, names: DataFrame) -> DataFrame:
    """(id, search_text): the different names of each site in binary order; null without any. ``names`` are (site_id, name) of
    the timelines."""
    told = names.groupBy("site_id").agg(F.collect_set("name").alias("told"))
    rows = sites.join(told, sites.id == told.site_id, "left")
    none = F.array().cast("array<string>")
    terms = F.concat(
        F.array("title_en"), F.coalesce(F.map_values("names"), none), F.array(meta_text(F.col("meta"), "$.native_label")), F.coalesce("told", none)
    )
    text = F.array_join(F.array_sort(F.array_distinct(F.filter(terms, lambda x: x.isNotNull() & (x != "")))), " ")
    return rows.select("id", F.when(text != "", text).alias("search_text"))


def _trigrams(word: str) -> list[str]:
    padded = f"  {word} "
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def word_similarity(needle: str, text: str) -> float:
    """The best share of the needle's trigrams in a continuous stretch of the text's: |shared| / |either|, over all stretches."""
    want: set[str] = set()
    for w in _words(needle):
        want.update(_trigrams(w))
    have = [t for w in _words(text) for t in _trigrams(w)]
    if not want or not have:
        return 0.0
    places = [i for i, t in enumerate(have) if t in want]
    best = 0.0
    for k, first in enumerate(places):
        seen: set[str] = set()
        shared: set[str] = set()
        at = first
        for last in places[k:]:
            seen.update(have[at : last + 1])
            at = last + 1
            shared.add(have[last])
            best = max(best, len(shared) / (len(want) + len(seen) - len(shared)))
    return best


def _words(text: str) -> list[str]:
    return [w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split() if w]


def found(texts: DataFrame, text: str, needle: str, fuzzy: bool = True) -> DataFrame:
    """Rows whose text begins with the needle (score 1), holds it (0.8), or has words like it (their similarity, 0.3 at least).

    Case and accents don't matter; signs have no special meaning. A needle under two letters finds nothing.
    """
    key = needle.strip()
    if len(key) < 2:
        return texts.withColumn("score", F.lit(0.0)).filter(F.lit(False))
    have, want = normalised(F.col(text)), normalised(F.lit(key))
    exact = F.when(have.startswith(want), 1.0).when(have.contains(want), 0.8).otherwise(0.0)
    rows = texts.withColumn("__have", have).withColumn("score", exact)
    if not fuzzy:
        return rows.filter("score > 0").drop("__have")
    @F.pandas_udf("double")
    def similarity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: word_similarity(key, x) if x else 0.0)

    # so many of the needle's trigrams, ends of words included, a text must hold to be similar enough at best
    wanted = sorted({t for w in _words(key) for t in _trigrams(w)})
    padded = F.concat(F.lit("  "), F.regexp_replace(F.lower("__have"), r"[^\p{L}\p{N}]+", "   "), F.lit(" "))
    held = F.lit(0)
    for gram in wanted:
        held = held + F.col("__padded").contains(gram).cast("int")
    rows = rows.withColumn("__padded", padded).filter((F.col("score") > 0) | (held >= math.ceil(LEAST * len(wanted)))).drop("__padded")
    rows = rows.withColumn("score", F.greatest("score", F.when(F.col("score") < 1, similarity("__have")).otherwise(F.lit(0.0))))
    return rows.filter(F.col("score") >= LEAST).drop("__have")


def found_sites(sites: DataFrame, names: DataFrame, needle: str, limit: int) -> DataFrame:
    """(id, title_en, score) of the sites any of whose names is found: the best score first, then the most important, then by id."""
    hits = found(search_text(sites, names), "search_text", needle).select("id", "score")
    base = base_importance(F.col("sitelinks_count"), F.col("wikipedia_page_en_url")).alias("base")
    rows = hits.join(sites.select("id", "title_en", base), "id")
    return rows.orderBy(F.col("score").desc(), F.col("base").desc(), "id").limit(limit).select("id", "title_en", "score")

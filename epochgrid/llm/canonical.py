"""Freely typed values mapped to the entries of a reference list, or reported as unmatched.

Each distinct token of the values is repaired: joined by edit distance to the tokens of the reference list. The repaired
tokens then rank the entries by soft TF-IDF, each token with the weight of its rarity and the closeness of its repair.
Tokens that many values share but no entry has ("language", "tongue", "spoken") weigh little, as their weight comes from
the corpus. Tokens that many entries share (stages such as Old or Middle) set entries apart: an entry only counts if the
value has exactly the same ones. A typed token with several equally close repairs may mean any of them, and so may an
abbreviation that fits several tokens: each set of tokens that the list has and the value may mean is ranked.

All weights are counted over the whole list and all values. The repair meets each distinct token once with the vocabulary of
lengths that can fit, in blocks; a block's size changes no result. Only entries that share a repaired token and the tokens that
set entries apart with a value are ranked, by expressions of the engine; an entry that has only such tokens is ranked for values
in which they outweigh all others. Frequent tokens and values are salted by their counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochgrid.llm.names import allowed, fold, near, sounded, tokens
from epochgrid.operators.arrow import by_group
from epochgrid.operators.skew import hot_keys, salted_join

NOT_FOUND = "NOT_FOUND"
#: Vocabulary tokens, and forms of typed tokens, that one task compares at once.
BLOCK, FORMS = 4_000, 20_000
#: Least score; share of entries that must have a token, and of tokens it must stand beside, to set entries apart; their least number.
SCORE, SHARED, PARTNERS = 0.5, 0.03, 8
#: Edits a repair may have at most.
EDITS = allowed(99)
#: Digits of a score: equal ones stay equal however they are summed.
DIGITS = 10
# Endings of other languages for the same ending.
_ENDINGS = [("isch", ["ish", "i", "e", "ic", "ian"]), ("ique", ["ic"]), ("ien", ["ian"])]


def endings(token: str) -> list[str]:
    return [token] + [token[: -len(a)] + b for a, bs in _ENDINGS if token.endswith(a) for b in bs]


def shortens(short: str, word: str) -> bool:
    """Whether a word may be abbreviated so: its first letter and some later ones, in order."""
    rest = iter(word)
    return word[:1] == short[:1] and all(c in rest for c in short)


#: The same as an expression over ``short`` and ``entry`` with equal first letters: where the next letter may stand, 0 if one is missing.
_SHORTENS = "aggregate(split(short, ''), 1, (at, c) -> if(at = 0 or locate(c, entry, at) = 0, 0, locate(c, entry, at) + 1)) > 0"

_CUT = pa.schema([("value", pa.string()), ("count", pa.int64()), ("tokens", pa.list_(pa.string()))])
_ENTRY = pa.schema([("key", pa.string()), ("tokens", pa.list_(pa.string()))])
_FORM = pa.schema([("token", pa.string()), ("form", pa.string())])
_REPAIR = pa.schema([("token", pa.string()), ("entry", pa.string()), ("edits", pa.int32())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [list(dict.fromkeys(tokens(fold(v)))) for v in batch.column("value").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("value"), batch.column("count"), pa.array(found, _CUT.field("tokens").type)], schema=_CUT)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted({sounded(t) for t in tokens(fold(v))} - {""}) for v in batch.column("label").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, _ENTRY.field("tokens").type)], schema=_ENTRY)


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [(t, f) for t in batch.column("token").to_pylist() for f in endings(sounded(t))]
        yield pa.RecordBatch.from_pydict({"token": [t for t, _ in made], "form": [f for _, f in made]}, schema=_FORM)


def _shorts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [sounded(t) for t in batch.column("token").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("token"), pa.array(made, pa.string())], names=["token", "short"])


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in by_group(batches, ["length", "chunk", "part"]):
        typed = pc.is_valid(group.column("token"))
        forms, listed = group.filter(typed), group.filter(pc.invert(typed)).column("form").to_pylist()
        if not forms.num_rows or not listed:
            continue
        i, j, d = near(forms.column("form").to_pylist(), listed)
        yield pa.RecordBatch.from_arrays(
            [forms.column("token").combine_chunks().take(pa.array(i)), pa.array([listed[x] for x in j], pa.string()), pa.array(d, pa.int32())], schema=_REPAIR
        )


def _repaired(typed: DataFrame, vocabulary: DataFrame, block: int) -> DataFrame:
    """(token, entry, edits): vocabulary tokens within the allowed edits of a typed token or one of its endings.

    Tokens meet the vocabulary of each length that can fit; a length is cut into chunks of about ``block`` tokens.
    """
    lengths = vocabulary.groupBy(F.length("entry").alias("length")).agg(F.ceil(F.count("*") / block).cast("int").alias("chunks"))
    forms = typed.mapInArrow(_forms, "token string, form string").distinct()
    parts = forms.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / FORMS).cast("int")).alias("parts"))
    asked = (
        forms.withColumn("length", F.explode(F.sequence(F.length("form") - EDITS, F.length("form") + EDITS)))
        .join(lengths, "length")
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .crossJoin(F.broadcast(parts))
        .select("length", "chunk", F.pmod(F.xxhash64("token"), F.col("parts")).cast("int").alias("part"), "token", "form")
    )
    listed = (
        vocabulary.select(F.length("entry").alias("length"), F.col("entry").alias("form"))
        .join(lengths, "length")
        .withColumn("chunk", F.pmod(F.xxhash64("form"), F.col("chunks")).cast("int"))
        .crossJoin(F.broadcast(parts))
        .select("length", "chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("string").alias("token"), "form")
    )
    both = asked.unionByName(listed).repartition("length", "chunk", "part").sortWithinPartitions("length", "chunk", "part")
    return both.mapInArrow(_repairs, "token string, entry string, edits int").groupBy("token", "entry").agg(F.min("edits").alias("edits"))


def _meant(asks: DataFrame, sets: DataFrame) -> DataFrame:
    """(asked, sure): the sets of tokens that the list has and a value may mean.

    Such a set has one token at least of each ask, unless that is free to mean another token, and none that isn't asked for.
    """
    fits = F.forall("asked", lambda a: a["free"] | F.arrays_overlap(a["sure"], F.col("sure"))) & (F.size(F.array_except("sure", F.flatten("asked.sure"))) == 0)
    some = (
        asks.select("asked", F.explode(F.array_distinct(F.flatten("asked.sure"))).alias("token"))
        .join(sets.select("sure", F.explode("sure").alias("token")), "token")
        .filter(fits)
        .select("asked", "sure")
        .distinct()
    )
    return some.unionByName(asks.filter(F.forall("asked", lambda a: a["free"])).select("asked", F.array().cast("array<string>").alias("sure")))


def matched(values: DataFrame, text: str, reference: DataFrame, key: str, label: str, block: int = BLOCK) -> DataFrame:
    """``values`` with the columns ``match`` (a key of the reference, or NOT_FOUND) and ``score``.

    Several rows of ``reference`` may name one key. Null and blank values are NOT_FOUND with score 0; of entries with equal
    score the smallest key is taken. Columns of ``values`` named ``match`` or ``score`` are replaced. An empty reference matches
    nothing.
    """
    from epochgrid.session import checkpoint

    values = values.drop("match", "score")
    cut = checkpoint(
        values.groupBy(F.col(text).cast("string").alias("value")).agg(F.count("*").alias("count")).filter("value is not null").mapInArrow(_cut, "value string, count bigint, tokens array<string>")
    )
    named = reference.select(F.col(key).cast("string").alias("key"), F.col(label).cast("string").alias("label")).dropna().distinct()
    entries = checkpoint(named.mapInArrow(_entries, "key string, tokens array<string>"))

    # the list: weights by rarity, and which tokens set entries apart
    size = entries.agg(F.greatest(F.lit(1), F.count("*")).alias("size"))
    least = F.greatest(F.lit(PARTNERS), SHARED * F.col("size"))
    sets = entries.select("tokens", F.size("tokens").alias("n")).distinct().crossJoin(F.broadcast(size))
    beside = sets.filter("n > 1").select("tokens", "n", "size", F.explode("tokens").alias("entry"))
    # many entries share it: one long entry alone gives its tokens enough partners, but they set nothing apart
    shared = beside.groupBy("entry", "size").count().filter(F.col("count") >= least).select("entry")
    beside = beside.join(shared, "entry")
    # an entry with so many tokens gives each of them enough partners, so only shorter ones are paired with themselves
    long_ = beside.filter(F.col("n") - 1 >= least).select("entry").distinct()
    short = beside.filter(F.col("n") - 1 < least).select("entry", "size", F.explode("tokens").alias("other"))
    paired = short.filter("other <> entry").distinct().groupBy("entry", "size").count()
    apart = long_.unionByName(paired.filter(F.col("count") >= least).select("entry")).distinct().withColumn("apart", F.lit(True))
    vocabulary = checkpoint(
        entries.select(F.explode("tokens").alias("entry"))
        .groupBy("entry")
        .count()
        .crossJoin(F.broadcast(size))
        .join(apart, "entry", "left")
        .select("entry", F.log(1 + F.col("size") / F.col("count")).alias("weight"), F.coalesce("apart", F.lit(False)).alias("apart"))
    )
    top = vocabulary.agg(F.coalesce(F.max("weight"), F.lit(1.0)).alias("top"))

    # the typed tokens: their repairs, and how rare they are
    many = cut.agg(F.greatest(F.lit(2), F.count("*")).alias("many"))
    typed = cut.select("value", F.explode("tokens").alias("token"))
    counts = typed.groupBy("token").count()
    bare = typed.select("value", F.regexp_replace("token", r"\.$", "").alias("bare")).distinct().groupBy("bare").agg(F.count("*").alias("seen"))
    distinct = checkpoint(counts.withColumn("bare", F.regexp_replace("token", r"\.$", "")).join(bare, "bare").crossJoin(F.broadcast(many)))
    closeness = 1 - F.col("edits") / F.greatest(F.length("entry"), F.length("token"), F.lit(1))
    repairs = _repaired(distinct.select("token"), vocabulary.select("entry"), block).withColumn("close", closeness)
    # an abbreviation may mean any token that sets entries apart and fits, but a whole one is itself
    abbreviated = (
        distinct.filter(F.col("token").endswith("."))
        .select("token")
        .mapInArrow(_shorts, "token string, short string")
        .join(vocabulary.filter("apart"), F.substring("short", 1, 1) == F.substring("entry", 1, 1))
        .filter(F.expr(_SHORTENS))
        .groupBy("token", "short")
        .agg(F.collect_set("entry").alias("fits"))
        .select("token", F.explode(F.when(F.array_contains("fits", F.col("short")), F.array("short")).otherwise(F.col("fits"))).alias("entry"), F.lit(1.0).alias("close"))
    )
    repairs = repairs.select("token", "entry", "close").unionByName(abbreviated).groupBy("token", "entry").agg(F.max("close").alias("close"))
    found = (
        repairs.join(vocabulary, "entry")
        .groupBy("token")
        .agg(F.collect_list(F.struct("entry", "close", "weight", "apart")).alias("near"), F.max("close").alias("most"))
        .withColumn("best", F.filter("near", lambda n: n["close"] == F.col("most")))
        .select(
            "token", "near", F.array_max(F.transform("best", lambda n: n["weight"])).alias("weight"),
            F.array_sort(F.transform(F.filter("best", lambda n: n["apart"]), lambda n: n["entry"])).alias("sure"),
            F.exists("best", lambda n: ~n["apart"]).alias("free"),
        )
    )
    unknown = F.col("top") * F.log(F.col("many") / F.least("seen", "many")) / F.log(F.col("many").cast("double"))
    weighed = (
        distinct.join(found, "token", "left")
        .crossJoin(F.broadcast(top))
        .select("token", "near", F.when(F.size("sure") > 0, F.struct("sure", "free")).alias("ask"), F.coalesce("weight", unknown).alias("weight"))
    )

    # the values: their repaired tokens, and what entries must agree on
    square = F.col("weight") * F.col("weight")
    seen = checkpoint(
        salted_join(typed, weighed, "token", hot_keys(counts, "token", "count"), by=F.col("value"))
        .groupBy("value")
        .agg(
            F.sqrt(F.sum(square)).alias("length"),
            F.array_sort(F.collect_set("ask")).alias("asked"),
            F.collect_list(F.when(F.col("near").isNotNull(), F.struct("weight", "near"))).alias("found"),
            # what sets entries apart isn't enough by itself, unless it is most of the value
            (F.round(F.sum(F.when(F.col("ask").isNotNull(), square)) * 2 - F.sum(square), DIGITS) > 0).alias("alone"),
        )
        .withColumn("sure", F.array_sort(F.array_distinct(F.flatten("asked.sure"))))
    )
    ranked = entries.groupBy("tokens").agg(F.min("key").alias("key")).withColumn("at", F.xxhash64("tokens"))
    whole = (
        ranked.select("at", "key", F.explode("tokens").alias("entry"))
        .join(vocabulary, "entry")
        .groupBy("at", "key")
        .agg(
            F.collect_list("entry").alias("own"), F.sqrt(F.sum(square)).alias("norm"),
            F.array_sort(F.collect_list(F.when(F.col("apart"), F.col("entry")))).alias("sure"),
            F.collect_list(F.when(~F.col("apart"), F.col("entry"))).alias("plain"),
        )
    )
    meet = F.concat_ws("\x00", "entry", F.array_join("sure", " ")).alias("meet")
    alone = F.array(F.lit(""))  # stands for the tokens of an entry that has only such that set entries apart
    own = whole.withColumn("entry", F.explode(F.when(F.size("plain") > 0, F.col("plain")).otherwise(alone))).select("key", "own", "norm", meet)
    open_ = F.exists("asked", lambda a: a["free"] | (F.size(a["sure"]) > 1))
    unsure = seen.filter(open_).drop("sure")
    meant = _meant(unsure.select("asked").distinct(), whole.select("sure").distinct())
    seen = seen.filter(~open_).unionByName(salted_join(unsure, meant, "asked", hot_keys(unsure.groupBy("asked").count(), "asked", "count"), by=F.col("value")))
    plain = F.array_distinct(F.flatten(F.transform("found", lambda t: F.transform(F.filter(t["near"], lambda n: ~n["apart"]), lambda n: n["entry"]))))
    candidates = checkpoint(
        seen.withColumn("entry", F.explode(F.when(F.col("alone"), F.concat(plain, alone)).otherwise(plain))).select("value", "length", "found", meet)
    )
    hot = hot_keys(candidates.groupBy("meet").count(), "meet", "count")
    part = lambda t: F.coalesce(
        F.array_max(F.transform(F.filter(t["near"], lambda n: F.array_contains("own", n["entry"])), lambda n: n["close"] * t["weight"] * n["weight"])), F.lit(0.0)
    )
    best = (
        salted_join(candidates, own, "meet", hot, by=F.col("value"))
        .select("value", "key", F.round(F.aggregate("found", F.lit(0.0), lambda a, t: a + part(t)) / (F.col("norm") * F.col("length")), DIGITS).alias("score"))
        .groupBy("value")
        .agg(F.min(F.struct((-F.col("score")).alias("far"), "key")).alias("best"))
        .select("value", F.when(-F.col("best.far") >= SCORE, F.col("best.key")).alias("match"), (-F.col("best.far")).alias("score"))
    )
    result = salted_join(values.withColumn("value", F.col(text).cast("string")), best, "value", hot_keys(cut, "value", "count"), "left")
    return result.select(
        *[F.col(f"`{c}`") for c in values.columns], F.coalesce("match", F.lit(NOT_FOUND)).alias("match"), F.coalesce("score", F.lit(0.0)).alias("score")
    )


def other_names(reference: DataFrame, key: str, label: str, notes: str) -> DataFrame:
    """(key, label) of each entry and of each other name its notes give: a run of words that begin with capitals."""
    own = reference.select(F.col(key).alias("key"), F.col(label).alias("label"))
    more = reference.select(F.col(key).alias("key"), F.explode(F.regexp_extract_all(F.col(notes), F.lit(r"(\p{Lu}[\p{L}'’-]{3,}(?: \p{Lu}[\p{L}'’-]+)*)"), 1)).alias("label"))
    return own.unionByName(more).filter("key is not null and trim(label) <> ''").distinct()


def missing_names(dump: DataFrame) -> DataFrame:
    """(site_id, ordinal, kind, name) of the missing entities with a name, each record once."""
    from epochgrid.operators.timelines import latest, timeline_items

    records = latest(dump.select("id", "timeline", "extracted_at").filter(F.col("timeline").isNotNull()), "id", F.col("extracted_at").desc_nulls_last())
    items = timeline_items(records, "id", "timeline", ["record_id", "ordinal", "kind", "label"], ["missing_entities"])
    return items.select(
        F.col("record_id").alias("site_id"), "ordinal", F.lower(F.regexp_replace("kind", r"^\s+|\s+$", "")).alias("kind"), F.col("label").alias("name")
    ).filter(F.col("name").isNotNull() & F.col("name").rlike(r"\S"))


def p1_found(spark, sf_dir: str) -> DataFrame:
    from epochgrid.sources.tables import table

    from epochgrid.session import checkpoint

    typed = checkpoint(missing_names(table(spark, sf_dir, "timeline_dump")).filter("kind = 'language'"))  # read twice
    listed = other_names(table(spark, sf_dir, "languages_resolved"), "qid", "resolved_label", "notes")
    return matched(typed, "name", listed, "key", "label").select("site_id", "ordinal", F.col("match").alias("qid"))

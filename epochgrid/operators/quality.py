"""Checks and repairs of timelines: bounds of entities, doubtful QIDs, ends that say too much."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochgrid.functions.text import normalised, plain_name, significant
from epochgrid.operators.arrow import by_group
from epochgrid.session import checkpoint

ENTITY_TRACKS, LISTED_ONLY = ["polity", "culture", "religion", "language"], ["religion", "language"]
# The types of events; words that say nothing about a name; notes that own a QID to be wrong.
EVENT_TYPES = (
    "destruction fire earthquake flood plague siege conquest massacre founding refounding abandonment expulsion depopulation "
    "revolution annexation discovery"
).split()
STOPWORDS = "the of de la le and et a an kingdom empire republic state dynasty period era".split()
CONFESSIONS = [
    r"omitting\s+(the\s+)?wikidata",
    r"omit(ting)?\s+(the\s+)?qid",
    r"without\s+(a\s+)?(specific\s+)?qid",
    r"no\s+(specific|exact|precise)\s+(wikidata\s+)?qid",
    r"\bqid\b[^.]{0,60}\bis wrong\b",
    r"\bis wrong\b[^.]{0,40}\bomit",
    r"(as|using)[^.]{0,40}\b(closest|broad|approximate|placeholder|generic)\b[^.]{0,40}\bqid\b",
    r"\bqid\b[^.]{0,40}\b(closest|broad|approximate|placeholder)\b",
    r"to avoid (a )?wrong (mapping|match|qid)",
]


# Descriptions of what isn't a country of today, of what is, and QIDs known not to be.
HISTORICAL = "historical|former|ancient|medieval|dynasty|empire|kingdom|caliphate|occupation|colony|soviet"
CURRENT = "^country|^sovereign|^state in"
NOT_TODAY = (
    "Q28513 Q131964 Q15180 Q193714 Q1747689 Q34266 Q7318 Q12544 Q2277 Q83286 Q15102440 Q191077 Q13426199 Q12560 Q83891 Q93180 Q8575586 "
    "Q12536 Q207272 Q174193"
).split()


def historical(entities: DataFrame, qid: str = "qid", description: str = "description_en") -> DataFrame:
    """Entities with ``skipped``: why one isn't a country of today (``known``, ``description``), null if nothing says so."""
    text = F.lower(F.coalesce(description, F.lit("")))
    return entities.withColumn("skipped", F.when(F.col(qid).isin(NOT_TODAY), "known").when(text.rlike(HISTORICAL) & ~text.rlike(CURRENT), "description"))


def _in_order(*keys: str):
    return Window.partitionBy(*keys).orderBy("from_year", "ordinal")


def known_bounds(entities: DataFrame) -> DataFrame:
    """Active entities with at least one bound."""
    return entities.filter(F.col("active") & (F.col("inception").isNotNull() | F.col("dissolution").isNotNull())).select(
        "qid", "label_en", "inception", "inception_precision", "dissolution"
    )


def bounded(entries: DataFrame, entities: DataFrame, how: str = "inner") -> DataFrame:
    """Entries of entity tracks held against the bounds of their entities, with ``actions``.

    An entry apart from its entity's life is incompatible and stays as it is; one that begins before is shortened, one that
    runs on is closed, an entry may be both. Its end is its own, else that of the next entry (step tracks) or of the entity's next.
    ``new_from`` and ``new_to`` hold the result, ``from_circa`` whether a rough bound made the start rough, ``from_precision`` how rough. With ``how`` left,
    entries without a known bound stay, as they are.
    """
    rows = entries.filter(F.col("track").isin(ENTITY_TRACKS) & F.col("from_year").isNotNull()).withColumn("key", F.coalesce("qid", "label"))
    step = F.col("track").isin("polity", "culture")
    after = F.when(step, F.lead("from_year").over(_in_order("site_id", "track"))).otherwise(F.lead("from_year").over(_in_order("site_id", "track", "key")))
    rows = rows.withColumn("end", F.coalesce("to_year", after)).join(known_bounds(entities), "qid", how)
    born, died, end = F.col("inception"), F.col("dissolution"), F.col("end")
    false = F.lit(False)
    apart = F.coalesce(F.col("from_year") > died, false) | F.coalesce(end < born, false)
    shorten = ~apart & F.coalesce(F.col("from_year") < born, false) & (end.isNull() | F.coalesce(born < end, false))
    rows = rows.withColumn("new_from", F.when(shorten, born.cast("bigint")).otherwise(F.col("from_year")))
    close = ~apart & died.isNotNull() & (end.isNull() | F.coalesce(end > died, false)) & (died >= F.col("new_from"))
    return rows.withColumns(
        {
            "new_to": F.when(close, died.cast("bigint")).otherwise(F.col("to_year")),
            "from_circa": shorten & F.coalesce(F.col("inception_precision") < 9, false),
            "from_precision": F.when(shorten & (F.col("inception_precision") < 9), F.col("inception_precision")),
            "actions": F.array_compact(F.array(F.when(apart, "incompatible"), F.when(shorten, "shorten"), F.when(close, "close"))),
        }
    )


def conflicts(held: DataFrame) -> DataFrame:
    """One row for each action, with the years before it."""
    return held.select("site_id", "track", F.col("qid").alias("entity_qid"), F.explode("actions").alias("action"), "from_year", "to_year", "inception", "dissolution")


def name_words(c: Column) -> Column:
    """The words of a name that say something about it."""
    words = F.split(F.regexp_replace(normalised(c), r"""[()\[\],.;:'"–—-]""", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS))


def plausible(a: Column, b: Column) -> Column:
    """Whether two names may mean the same: they share a word, or one has none to judge by."""
    x, y = name_words(F.coalesce(a, F.lit(""))), name_words(F.coalesce(b, F.lit("")))
    return (F.size(x) == 0) | (F.size(y) == 0) | F.arrays_overlap(x, y)


def checked_qids(entries: DataFrame, entities: DataFrame) -> DataFrame:
    """Entries with a QID on entity tracks, with ``reason`` if the QID must go: ``confessed``, ``wrong_track``, ``wrong_name``,
    ``several_names``, ``not_listed`` or ``several_tracks``. Needs the column ``notes``."""
    rows = entries.filter(F.col("track").isin(ENTITY_TRACKS) & F.col("qid").isNotNull())
    rows = rows.withColumn("confessed", F.coalesce(F.lower("notes").rlike("|".join(f"(?:{p})" for p in CONFESSIONS)), F.lit(False)))
    known = entities.filter("active").select("qid", F.col("kind").alias("listed_kind"), F.col("label_en").alias("listed_label"))
    rows = rows.join(known, "qid", "left").withColumn("name_key", F.when(normalised(F.col("label")) != "", normalised(F.col("label"))))
    listed = F.col("listed_kind").isNotNull()
    first = (
        F.when(F.col("confessed"), "confessed")
        .when(listed & (F.col("track") != F.col("listed_kind")), "wrong_track")
        .when(listed & F.col("name_key").isNotNull() & ~plausible(F.col("label"), F.col("listed_label")), "wrong_name")
    )
    rows = rows.withColumn("first", first)
    own = Window.partitionBy("site_id", "qid")

    def several(c: Column) -> Column:
        return F.size(F.collect_set(c).over(own)) > 1

    left = F.when(F.col("first").isNull(), F.col("name_key"))
    used = ~F.col("confessed")
    second = (
        F.when(listed, F.when(several(left), "several_names"))
        .when(F.col("track").isin(LISTED_ONLY), "not_listed")
        .when(several(F.when(used, F.col("track"))), "several_tracks")
        .when(several(F.when(used, F.col("name_key"))), "several_names")
    )
    return rows.withColumn("reason", F.coalesce("first", F.when(F.col("first").isNull(), second))).drop("first", "confessed", "name_key")


def without_redundant_ends(entries: DataFrame) -> DataFrame:
    """Types of sites without an end that the next type's start already says; those without a start stay as they are."""
    rows = entries.filter("track = 'site_type'")
    order = Window.partitionBy("site_id", F.col("from_year").isNull()).orderBy("from_year", "ordinal")
    after = F.coalesce(F.lead("from_year").over(order), F.col("to_year") + 1)
    return rows.withColumn("to_year", F.when(F.col("from_year").isNull() | (F.col("to_year") < after), F.col("to_year")))


def exclusive_state(entries: DataFrame) -> DataFrame:
    """Co-occurrent entries of which only one at a time is the state's: the older is closed where the newer starts. Entries without a
    start stay as they are."""
    rows = entries.filter(F.col("track").isin(LISTED_ONLY))
    states = F.coalesce((F.col("role") == "state") & F.col("from_year").isNotNull(), F.lit(False))
    order = Window.partitionBy("site_id", "track", states).orderBy("from_year", "ordinal")
    after = F.when(states, F.lead("from_year").over(order))
    over = (F.col("to_year").isNull() | (F.col("to_year") >= after)) & (after > F.col("from_year"))
    return rows.withColumn("to_year", F.when(F.coalesce(over, F.lit(False)), after).otherwise(F.col("to_year")))


def fold(rows: list[tuple[int, int | None, int]]) -> list[tuple[int, int | None, int]]:
    """Of one entity's (from, to, position), in order: entries that end where they start, or before, close the latest open
    entry that starts earlier, and go."""
    rows = sorted(rows, key=lambda r: (r[0], r[2]))
    kept = [[a, b, k] for a, b, k in rows if b is None or b > a]
    for a, b, _ in rows:
        if b is not None and b <= a:
            for e in reversed(kept):
                if e[0] < a and e[1] is None:
                    best = next(x for x in kept if x[0] == e[0] and x[1] is None)
                    best[1] = a
                    break
    return [(a, b, k) for a, b, k in kept]


def folded(entries: DataFrame, tracks: list[str] = LISTED_ONLY) -> DataFrame:
    """(site_id, track, entity, ordinal, from_year, to_year) of co-occurrent entries after closing instructions are carried out.

    Instructions match open entries like brackets, which no window can tell; only entities that have one go to Python. Then an
    open twin of a closed entry goes, and so do ends that the entity's next entry makes redundant.
    """
    rows = entries.filter(F.col("track").isin(tracks) & F.col("entity").isNotNull() & F.col("from_year").isNotNull())
    rows = rows.select("site_id", "track", "entity", "ordinal", "from_year", "to_year")
    keys = ["site_id", "track", "entity"]
    told = F.max(F.coalesce(F.col("to_year") <= F.col("from_year"), F.lit(False))).over(Window.partitionBy(*keys))
    marked = rows.withColumn("told", told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, keys):
            head = [group.column(k)[0].as_py() for k in keys]
            done = fold(list(zip(group.column("from_year").to_pylist(), group.column("to_year").to_pylist(), group.column("ordinal").to_pylist())))
            if done:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h] * len(done), pa.string()) for h in head]
                    + [pa.array([r[2] for r in done], pa.int32()), pa.array([r[0] for r in done], pa.int64()), pa.array([r[1] for r in done], pa.int64())],
                    names=[*keys, "ordinal", "from_year", "to_year"],
                )

    worked = marked.filter("told").drop("told").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, rows.schema)
    both = marked.filter("not told").drop("told").unionByName(worked)
    twin = Window.partitionBy(*keys, "from_year")
    both = both.withColumn("closed", F.max(F.col("to_year").isNotNull()).over(twin)).filter("to_year is not null or not closed").drop("closed")
    after = F.lead("from_year").over(Window.partitionBy(*keys).orderBy("from_year", "ordinal"))
    drop = (F.col("to_year") <= F.col("from_year")) | F.coalesce(F.col("to_year") >= F.col("after"), F.lit(False))
    return both.withColumn("after", after).withColumn("to_year", F.when(~drop, F.col("to_year"))).drop("after")


def unresolved(missing: DataFrame, entries: DataFrame) -> DataFrame:
    """Missing entities of entity kinds with a name that no entry of their site has with a QID."""
    named = entries.filter(F.col("qid").isNotNull()).select("site_id", F.col("track").alias("kind"), plain_name(F.col("label")).alias("key"))
    wanted = missing.filter(F.col("kind").isin(ENTITY_TRACKS) & (F.trim("name") != "")).withColumn("key", plain_name(F.col("name")))
    return wanted.join(named.filter("key <> ''"), ["site_id", "kind", "key"], "left_anti").drop("key")


def occurrences(missing: DataFrame, entries: DataFrame) -> DataFrame:
    """(kind, name, site_id, from_year, to_year, role, confidence) of each gap at each site: the first entry of its track with its
    plain name, nulls if there is none. Gaps that an entry of the site resolves with a QID are left out."""
    open_ = unresolved(missing, entries).select("kind", "name", "site_id").distinct().withColumn("key", plain_name(F.col("name")))
    told = entries.filter("label is not null").select("site_id", F.col("track").alias("kind"), plain_name(F.col("label")).alias("key"), "ordinal", "from_year", "to_year", "role", "confidence")
    first = told.filter("key <> ''").groupBy("site_id", "kind", "key").agg(F.min_by(F.struct("from_year", "to_year", "role", "confidence"), "ordinal").alias("hit"))
    return open_.join(first, ["site_id", "kind", "key"], "left").select("kind", "name", "site_id", "hit.from_year", "hit.to_year", "hit.role", "hit.confidence")


def normalised_entries(entries: DataFrame) -> DataFrame:
    """All entries after the policy of their track: closing instructions of entity tracks are carried out, one state at a time,
    redundant ends of site types and all ends of names and populations go. Entries without a start stay as they are."""
    entries = entries.withColumn("entity", F.coalesce("entity", F.lit("")))
    started = F.col("from_year").isNotNull()
    done = folded(entries, ENTITY_TRACKS).join(entries.drop("from_year", "to_year"), ["site_id", "track", "entity", "ordinal"]).select(entries.columns)
    rest = entries.filter(~(started & F.col("track").isin("site_type", *ENTITY_TRACKS)))
    rest = rest.withColumn("to_year", F.when(~F.col("track").isin("name", "population"), F.col("to_year")))
    return (
        exclusive_state(done)
        .unionByName(done.filter(~F.col("track").isin(LISTED_ONLY)))
        .unionByName(without_redundant_ends(entries.filter(started)).select(entries.columns))
        .unionByName(rest)
    )


def processed(entries: DataFrame, events: DataFrame, missing: DataFrame, entities: DataFrame) -> DataFrame:
    """Whole timelines normalised, then their QIDs checked, then held against the bounds of entities, in this order:
    (site_id, track, ordinal, kind, label, qid, role, reason, new_from, new_to, from_circa, actions).

    ``entries`` need ``notes``. ``qid`` is what the check leaves, ``reason`` why it took one away; each name it was taken from is
    a missing entity, if it isn't already. Events of unknown types go, and so do missing entities without a name or with that
    of an entry with a QID. For events ``label`` is the type, for missing entities ``qid`` the proposed one.
    """
    rows = checkpoint(normalised_entries(entries))
    key = normalised(F.col("label"))
    resolved = rows.filter((F.trim("qid") != "") & (F.col("label") != "")).select("site_id", key.alias("key")).distinct()
    open_ = missing.filter(F.trim("name") != "").withColumn("key", normalised(F.col("name"))).join(resolved, ["site_id", "key"], "left_anti")
    told = checked_qids(rows, entities).select(*rows.columns, "reason").drop("notes")
    silent = rows.filter(~(F.col("track").isin(ENTITY_TRACKS) & F.col("qid").isNotNull())).drop("notes")
    checked = checkpoint(told.unionByName(silent, allowMissingColumns=True))
    taken = checked.filter(F.col("reason").isNotNull() & (F.col("label") != "")).select("site_id", F.col("track").alias("kind"), key.alias("key"), "label", "ordinal", "reason")
    taken = taken.groupBy("site_id", "kind", "key").agg(F.min_by(F.struct("label", "reason"), F.struct(F.col("reason") != "confessed", "ordinal")).alias("first"))
    taken = taken.join(open_.select("site_id", "kind", "key").distinct(), ["site_id", "kind", "key"], "left_anti")
    last = open_.groupBy("site_id").agg(F.max("ordinal").alias("last"))
    position = F.row_number().over(Window.partitionBy("site_id").orderBy("kind", "key"))
    added = taken.join(last, "site_id", "left").select("site_id", (F.coalesce("last", F.lit(-1)) + position).alias("ordinal"), "kind", F.col("first.label").alias("label"), F.col("first.reason").alias("reason"))
    known = checked.withColumn("qid", F.when(F.col("reason").isNull(), F.col("qid")))
    on_entities = F.col("track").isin(ENTITY_TRACKS) & F.col("from_year").isNotNull()
    held = bounded(known, entities, "left")
    others = known.filter(~on_entities).withColumnsRenamed({"from_year": "new_from", "to_year": "new_to"})
    happened = events.filter(F.col("type").isin(EVENT_TYPES)).select("site_id", F.lit("events").alias("track"), "ordinal", F.col("type").alias("label"), F.col("year").alias("new_from"))
    lacking = open_.select("site_id", "ordinal", "kind", F.col("name").alias("label"), F.col("proposed_qid").alias("qid")).unionByName(added, allowMissingColumns=True)
    out = held.select("site_id", "track", "ordinal", "label", "qid", "role", "reason", "new_from", "new_to", "from_circa", "actions")
    for part in (others, happened, lacking.withColumn("track", F.lit("missing_entities"))):
        out = out.unionByName(part.select(*[c for c in [*out.columns, "kind"] if c in part.columns]), allowMissingColumns=True)
    return out.select(
        "site_id", "track", "ordinal", "kind", "label", "qid", "role", "reason", "new_from", "new_to",
        F.coalesce("from_circa", F.lit(False)).alias("from_circa"), F.coalesce("actions", F.array().cast("array<string>")).alias("actions"),
    )


def backfilled(entries: DataFrame, entities: DataFrame) -> DataFrame:
    """Entries of entity tracks without a QID, with ``found``: that of the one active entity of their kind and normalised name."""
    known = entities.filter("active").select(F.col("kind").alias("track"), plain_name(F.col("label_en")).alias("key"), "qid").filter("key <> ''")
    known = known.groupBy("track", "key").agg(F.min("qid").alias("found"), F.count("*").alias("n")).filter("n = 1").drop("n")
    rows = entries.filter(F.col("track").isin(ENTITY_TRACKS) & F.col("qid").isNull()).withColumn("key", plain_name(F.col("label")))
    return rows.join(known, ["track", "key"]).drop("key")


def proposals(missing: DataFrame, entities: DataFrame) -> DataFrame:
    """Missing entities with a proposed QID and ``verdict``: ``malformed``, ``unknown``, ``wrong_kind``, ``wrong_name`` or ``fine``."""
    known = entities.select(F.col("qid").alias("proposed_qid"), F.col("kind").alias("known_kind"), "label_en")
    rows = missing.filter(F.col("proposed_qid").isNotNull()).join(known, "proposed_qid", "left")
    share = F.arrays_overlap(significant(F.coalesce("name", F.lit("")), 4), significant(F.coalesce("label_en", F.lit("")), 4))
    verdict = (
        F.when(~F.col("proposed_qid").rlike(r"^Q\d+$"), "malformed")
        .when(F.col("known_kind").isNull(), "unknown")
        .when(F.col("known_kind") != F.lower(F.trim("kind")), "wrong_kind")
        .when(~share, "wrong_name")
        .otherwise("fine")
    )
    return rows.withColumn("verdict", verdict)


def bound_anomalies(entities: DataFrame) -> DataFrame:
    """Entities with ``anomalies``: contradictions in their bounds that need no knowledge of history."""
    i, d, pi, pd = (F.col(c) for c in ("inception", "dissolution", "inception_precision", "dissolution_precision"))
    span = d - i
    tests = [
        ("inception out of range", ~i.between(-200000, 2100)), ("dissolution out of range", ~d.between(-200000, 2100)),
        ("inception after dissolution", i >= d), ("span too short", (span > 0) & (span < 10)), ("span too long", span > 20000),
        ("inception too precise", (pi == 9) & (i < -1000)), ("dissolution too precise", (pd == 9) & (d < -1000)),
        ("inception without precision", i.isNotNull() & pi.isNull()), ("dissolution without precision", d.isNotNull() & pd.isNull()),
        ("precision without inception", i.isNull() & pi.isNotNull()), ("precision without dissolution", d.isNull() & pd.isNotNull()),
        ("no bound", i.isNull() & d.isNull()),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), text) for text, test in tests]))
    return entities.withColumn("anomalies", found).filter(F.size("anomalies") > 0)


def filled_bounds(entities: DataFrame, found: DataFrame, source: str) -> DataFrame:
    """Entities whose missing bounds are filled from ``found`` (qid, first, last), with ``bounds_source`` named where one was. Bounds
    that are there stay. ``found`` has each QID once."""
    rows = entities.join(found, "qid", "left")
    more = (F.col("inception").isNull() & F.col("first").isNotNull()) | (F.col("dissolution").isNull() & F.col("last").isNotNull())
    rows = rows.withColumn("bounds_source", F.when(more, source).otherwise(F.col("bounds_source")))
    return rows.withColumns({"inception": F.coalesce("inception", "first"), "dissolution": F.coalesce("dissolution", "last")}).drop("first", "last")


def tier(types: Column, override: list[str], subordinate: list[str]) -> Column:
    """sovereign by an overriding class, else subordinate by class, else sovereign by default."""

    def among(names: list[str]) -> Column:
        return F.arrays_overlap(types, F.array(*[F.lit(n) for n in names]))

    return F.when(among(override), "sovereign").when(among(subordinate), "subordinate").otherwise("default")

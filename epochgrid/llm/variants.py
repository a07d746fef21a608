"""Spellings of one name, typed by many hands, linked.

A name is folded and parted into its core and what sets entities of one core apart: the kind (kingdom, duchy) and a stage or
side (upper, lower). Cores become vectors of character trigrams weighted by rarity. A distributed sparse join finds all pairs of
cores with a cosine of at least ``COSINE``: a core is posted under the rarest trigrams that hold all but COSINE² of its
squared length, so any such pair meets under one of them. No number of partners is fixed, as a top n would lose links;
a trigram of many cores is cut into chunks, each task taking two. A pair that an exact check of edits refuses has no similarity.
Average-linkage clustering over this sparse similarity parts chains of spellings: the mean over all pairs of names of two clusters
must reach ``LINKAGE``, pairs without similarity included. The names of a cluster with the same kind and side are one entity. A name
without a kind, or with an abbreviation of several, takes that of its cluster if it has only one that fits.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochgrid.llm.canonical import missing_names, shortens
from epochgrid.llm.names import edit_distances, fold, sounded, tokens
from epochgrid.operators.arrow import by_group
from epochgrid.operators.graph import components
from epochgrid.operators.skew import hot_keys, salted_join
from epochgrid.session import checkpoint, written

#: Least cosine of a pair, least average similarity of a cluster, cores of a chunk, edits by the length of the shorter core.
COSINE, LINKAGE, CHUNK, EDITS = 0.3, 0.12, 1000, (0, 0, 0, 0, 0, 1, 1, 1, 2, 2, 2, 3)
#: Pairs of a component that one task clusters; a component with more is clustered by all tasks, with the same result.
PAIRS = 200_000
#: Similarities are whole numbers of this fraction, so that sums are the same in any order.
UNIT = 1_000_000

# Words for kinds of entities, by class, and words that set entities of one name and kind apart.
KINDS = {
    "polity": "kingdom duchy county league confederation federation emirate sultanate margraviate principality republic empire khanate dynasty".split(),
    "culture": "culture tribe horizon".split(),
    "religion": "church rite cult".split(),
}
SIDES = "upper lower eastern western northern southern central early middle late old new greater lesser".split()
_CUSTOMARY = {"c": "county", "co": "county", "cty": "county"}
_GENERIC = {"state", "people", "realm", "land", "religion", "faith"}
_SMALL = {"of", "the", "and", "de", "von"}
_ALL = [k for kinds in KINDS.values() for k in kinds]
_BRACKETS = re.compile(r"[(\[]([^)\]]*)[)\]]")
_ABBREVIATED = re.compile(r"[bcdfghjklmnpqrstvwxz]{2,4}y?$")


def _kinds(token: str, kind: str | None) -> set[str]:
    """The kinds a token may stand for."""
    if token in _ALL:
        return {token}
    word = token.rstrip(".")
    if kind == "polity" and word in _CUSTOMARY and (token.endswith(".") or len(word) > 2):
        return {_CUSTOMARY[word]}
    if not (token.endswith(".") or _ABBREVIATED.fullmatch(word)) or len(word) > 8:
        return {word} if word in _ALL else set()
    found = {k for k in _ALL if shortens(word, k)}
    starts = {k for k in found if k.startswith(word)}
    found = starts if len(word) > 2 and starts else found
    return found & set(KINDS.get(kind or "", _ALL)) or found


def _sides(token: str) -> set[str]:
    word = token.rstrip(".")
    if word in SIDES:
        return {word}
    return {s for s in SIDES if s.startswith(word)} if token.endswith(".") and len(word) < 5 else set()


def parsed(name: str, kind: str | None = None) -> tuple[list[str], list[str], str]:
    """(kinds the name may be of, sides, core) of a name; parts of a compound core are in order of the alphabet."""
    text = fold(name)
    kinds: set[str] = set()
    sides: set[str] = set()
    for inner in _BRACKETS.findall(text):
        words = tokens(inner)
        if words and all(_kinds(w, kind) for w in words):
            kinds |= set().union(*(_kinds(w, kind) for w in words))
    words = tokens(_BRACKETS.sub(" ", text))
    core: list[str] = []
    for i, w in enumerate(words):
        plain = w.rstrip(".")
        if plain in _SMALL or plain in _GENERIC:
            continue
        as_kind, as_side = _kinds(w, kind), _sides(w)
        if as_kind and as_side:  # "E. of X", "X E." and "E. X"
            if (i + 1 < len(words) and words[i + 1] == "of") or i == len(words) - 1:
                as_side = set()
            else:
                as_kind = set()
        if as_kind:
            kinds = kinds & as_kind or kinds | as_kind
        elif as_side:
            sides.add(min(as_side, key=SIDES.index))
        else:
            core.append(sounded(w))
    if not core:
        core, kinds, sides = [sounded(w) for w in words] or [text], set(), set()
    if len(core) == 1 and not kinds and words[:1] == ["the"] and core[0].endswith("ans") and len(core[0]) > 7:
        core = [core[0][:-3]]  # the people of X
    return sorted(kinds), sorted(sides), " ".join(sorted(core))


def trigrams(core: str) -> list[str]:
    return sorted({f"^{w}$"[i : i + 3] for w in core.split(" ") for i in range(max(1, len(w)))})


def latinised(core: str) -> list[str]:
    """What a core with a Latin ending may have been shortened to, the longer first."""
    if " " in core:
        return []
    return [core[: -len(e)] for e in ("e", "ia", "ania") if core.endswith(e) and len(core) - len(e) >= 6]


def alike(left: list[str], right: list[str]) -> np.ndarray:
    """0: different; 1: the same core with few edits; 2: one is the other with a Latin ending for its last syllable."""
    out = np.zeros(len(left), np.int8)
    parts = [(a.split(" "), b.split(" ")) for a, b in zip(left, right)]
    same = [k for k, (a, b) in enumerate(parts) if len(a) == len(b)]
    # compound cores: in either order
    tries = [(k, x, y) for k in same for order in ([0, 1], [1, 0]) if len(parts[k][0]) == 2 or order[0] == 0
             for x, y in zip(parts[k][0], [parts[k][1][o] for o in order] if len(parts[k][0]) == 2 else parts[k][1])]
    d = edit_distances([x for _, x, _ in tries], [y for _, _, y in tries])
    fits = [n <= EDITS[min(len(x), len(y), len(EDITS) - 1)] for n, (_, x, y) in zip(d, tries)]
    at = 0
    for k in same:
        n = len(parts[k][0])
        if n == 2:
            out[k] = all(fits[at : at + 2]) or all(fits[at + 2 : at + 4])
            at += 4
        else:
            out[k] = all(fits[at : at + n])
            at += n
    for k, (a, b) in enumerate(zip(left, right)):
        if not out[k] and " " not in a and " " not in b:
            for x, y in ((a, b), (b, a)):
                if not latinised(y) and any(y.startswith(s) and 1 < len(y) - len(s) < 8 for s in latinised(x)):
                    out[k] = 2
    return out


def average_linkage(pairs: list[tuple[str, str, int]], size: dict[str, int], least: float) -> dict[str, str]:
    """The cluster of each core, named by its smallest: the two clusters with the greatest mean similarity are joined while that
    is enough, of equal ones those of the smaller names. ``pairs``: (a, b, similarity in ``UNIT``); all others have none."""
    size = dict(size)
    sums: dict[str, dict[str, int]] = {c: {} for c in size}
    for a, b, s in pairs:
        s *= size[a] * size[b]
        sums[a][b] = sums[b][a] = sums[a].get(b, 0) + s

    def entry(a: str, b: str) -> tuple[float, str, str]:
        return (-sums[a][b] / (size[a] * size[b] * UNIT), min(a, b), max(a, b))

    heap = [entry(a, b) for a in sums for b in sums[a] if a < b]
    heapq.heapify(heap)
    into: dict[str, str] = {}
    while heap:
        far, low, high = heapq.heappop(heap)
        if -far < least:
            break
        if low not in sums or high not in sums[low] or (far, low, high) != entry(low, high):
            continue  # of a cluster that has changed since
        into[high] = low
        del sums[low][high]
        for other, s in sums.pop(high).items():
            if other != low:
                del sums[other][high]
                sums[low][other] = sums[other][low] = sums[low].get(other, 0) + s
        size[low] += size.pop(high)
        for other in sums[low]:
            heapq.heappush(heap, entry(low, other))

    def head(c: str) -> str:
        while c in into:
            c = into[c]
        return c

    return {c: head(c) for c in [*size, *into]}


def _weights(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Posts each core under its rarest trigrams, in each chunk pair it may meet others in."""
    for batch in batches:
        rows: dict[str, list] = {"gram": [], "block": [], "core": [], "chunk": [], "grams": [], "weights": []}
        for r in batch.to_pylist():
            grams = sorted(r["grams"], key=lambda g: (g["df"], g["gram"]))
            w = np.array([math.log(1 + r["total"] / (g["df"] + 0.002 * r["total"])) for g in grams])
            w /= math.sqrt(float((w * w).sum()))
            left = 1 - np.cumsum(w * w)
            last = int(np.argmax(left < COSINE * COSINE))
            for g in grams[: last + 1]:
                chunks = -(-g["df"] // chunk)
                own = hash_of(r["core"]) % chunks
                for other in range(chunks):
                    rows["gram"].append(g["gram"])
                    rows["block"].append(min(own, other) * 100_000 + max(own, other))
                    rows["core"].append(r["core"])
                    rows["chunk"].append(own)
                    rows["grams"].append([x["gram"] for x in grams])
                    rows["weights"].append(w)
        yield pa.RecordBatch.from_pydict(rows, schema=_POSTED)


def hash_of(text: str) -> int:
    from xxhash import xxh32_intdigest

    return xxh32_intdigest(text)


_POSTED = pa.schema(
    [("gram", pa.string()), ("block", pa.int64()), ("core", pa.string()), ("chunk", pa.int64()), ("grams", pa.list_(pa.string())), ("weights", pa.list_(pa.float64()))]
)


def _vectors(group: pa.Table, kind: type = np.float32) -> np.ndarray:
    rows = group.column("grams").to_pylist()
    dims = {g: i for i, g in enumerate(sorted({g for r in rows for g in r}))}
    out = np.zeros((len(rows), len(dims)), kind)
    for i, (r, w) in enumerate(zip(rows, group.column("weights").to_pylist())):
        out[i, [dims[g] for g in r]] = w
    return out


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in by_group(batches, ["gram", "block"]):
        if group.num_rows < 2:
            continue
        block = group.column("block")[0].as_py()
        vectors = _vectors(group)
        cosine = vectors @ vectors.T
        i, j = np.nonzero(np.triu(cosine >= COSINE, 1))
        chunk = group.column("chunk").to_numpy()
        if block // 100_000 != block % 100_000:
            i, j = i[chunk[i] != chunk[j]], j[chunk[i] != chunk[j]]
        cores = group.column("core").to_pylist()
        how = alike([cores[x] for x in i], [cores[x] for x in j])
        keep = np.flatnonzero(how)
        a, b = [cores[x] for x in i[keep]], [cores[x] for x in j[keep]]
        yield pa.RecordBatch.from_pydict(
            {"a": [min(x, y) for x, y in zip(a, b)], "b": [max(x, y) for x, y in zip(a, b)], "how": how[keep].astype(np.int32), "cosine": np.round(cosine[i[keep], j[keep]].astype(float), 5)},
            schema=pa.schema([("a", pa.string()), ("b", pa.string()), ("how", pa.int32()), ("cosine", pa.float64())]),
        )


_LINKED = pa.schema([("core", pa.string()), ("cluster", pa.string())])


def _clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in by_group(batches, ["component"]):
        a, b = group.column("a").to_pylist(), group.column("b").to_pylist()
        size = dict(zip(a, group.column("size_a").to_pylist())) | dict(zip(b, group.column("size_b").to_pylist()))
        found = average_linkage(list(zip(a, b, group.column("similar").to_pylist())), size, LINKAGE)
        yield pa.RecordBatch.from_pydict({"core": list(found), "cluster": list(found.values())}, schema=_LINKED)


def parted(pairs: DataFrame) -> DataFrame:
    """(core, cluster) of components with too many pairs for one task: average linkage in rounds over the pairs
    (a, b, size_a, size_b, similar).

    Each round joins all clusters that are each other's nearest; joining others never brings a cluster nearer than its nearest
    was, so the result is that of one join at a time. A cluster with none near enough is done for the same reason. Each core
    is in one join a round, so the pairs are joined with the moves without skew but for a cluster's pairs, which the engine splits.
    """
    cores = pairs.select(F.col("a").alias("core")).unionByName(pairs.select(F.col("b").alias("core"))).distinct()
    area = F.col("size_a") * F.col("size_b")
    now = written(pairs.select("a", "b", "size_a", "size_b", (F.col("similar") * area).alias("sum")))
    moves = None
    while True:
        near = now.withColumn("mean", F.col("sum") / (area * UNIT)).filter(F.col("mean") >= LINKAGE)
        order = F.struct((-F.col("mean")).alias("far"), F.col("a").alias("low"), F.col("b").alias("high"))
        ends = near.select(F.col("a").alias("cluster"), order.alias("o")).unionByName(near.select(F.col("b").alias("cluster"), order.alias("o")))
        best = ends.groupBy("cluster").agg(F.min("o").alias("best"))
        joined = written(best.groupBy("best.low", "best.high").count().filter("count = 2").select("low", "high"))
        if joined.isEmpty():
            break
        moves = joined if moves is None else moves.unionByName(joined)
        sizes = now.select(F.col("a").alias("c"), F.col("size_a").alias("n")).unionByName(now.select(F.col("b").alias("c"), F.col("size_b").alias("n"))).distinct()
        grown = joined.join(sizes.select(F.col("c").alias("low"), F.col("n").alias("n1")), "low").join(sizes.select(F.col("c").alias("high"), F.col("n").alias("n2")), "high")
        grown = grown.select("low", "high", (F.col("n1") + F.col("n2")).alias("n"))
        moved = grown.select(F.explode(F.array("low", "high")).alias("c"), F.col("low").alias("to"), "n")
        for side in "ab":
            now = now.join(moved.select(F.col("c").alias(side), F.col("to").alias("to"), F.col("n").alias("n")), side, "left")
            now = now.withColumn(f"size_{side}", F.coalesce("n", f"size_{side}")).withColumn(side, F.coalesce("to", side)).drop("to", "n")
        turned = F.col("a") > F.col("b")
        now = written(
            now.filter("a <> b")
            .select(
                F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(turned, F.col("size_b")).otherwise(F.col("size_a")).alias("size_a"),
                F.when(turned, F.col("size_a")).otherwise(F.col("size_b")).alias("size_b"), "sum",
            )
            .groupBy("a", "b", "size_a", "size_b")
            .agg(F.sum("sum").alias("sum")),
        )
    if moves is None:
        return cores.withColumn("cluster", F.col("core"))
    named = components(moves, "low", "high").select(F.col("node").alias("core"), F.col("component").alias("cluster"))
    return cores.join(named, "core", "left").select("core", F.coalesce("cluster", "core").alias("cluster"))


def entities(names: DataFrame, name: str, kind: str, chunk: int = CHUNK, most: int = PAIRS) -> DataFrame:
    """(name, entity) of each different name: names with one entity mean the same.

    ``kind`` is the class each row gives the name; the most frequent one helps to read abbreviations. Null and blank names
    are left out; a name is compared exactly as it is stored. ``chunk`` (cores of a trigram in one task) and ``most`` (pairs that one
    task clusters) change no result.
    """
    best = (
        names.select(F.col(name).alias("name"), F.col(kind).alias("kind"))
        .filter(F.col("name").rlike(r"\S"))
        .groupBy("name", "kind")
        .count()
        .groupBy("name")
        .agg(F.max_by("kind", F.struct("count", "kind")).alias("kind"))
    )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("name").to_pylist()
            found = [parsed(n, k) for n, k in zip(texts, batch.column("kind").to_pylist())]
            yield pa.RecordBatch.from_pydict(
                {"name": texts, "kinds": [f[0] for f in found], "side": [" ".join(f[1]) for f in found], "core": [f[2] for f in found], "grams": [trigrams(f[2]) for f in found]},
                schema=pa.schema([("name", pa.string()), ("kinds", pa.list_(pa.string())), ("side", pa.string()), ("core", pa.string()), ("grams", pa.list_(pa.string()))]),
            )

    read = checkpoint(best.mapInArrow(parse, "name string, kinds array<string>, side string, core string, grams array<string>"))
    cores = checkpoint(read.groupBy("core").agg(F.count("*").alias("names"), F.first("grams").alias("grams")))
    total = cores.agg(F.count("*").alias("total"))
    posted = cores.select("core", F.explode("grams").alias("gram"))
    df = posted.groupBy("gram").agg(F.count("*").alias("df"))
    vectors = (
        salted_join(posted, df, "gram", hot_keys(df, "gram", "df"), by=F.col("core"))
        .groupBy("core")
        .agg(F.array_sort(F.collect_list(F.struct("gram", "df"))).alias("grams"))
        .crossJoin(F.broadcast(total))
    )
    postings = vectors.mapInArrow(partial(_weights, chunk=chunk), "gram string, block bigint, core string, chunk bigint, grams array<string>, weights array<double>")
    pairs = checkpoint(
        postings.repartition("gram", "block").sortWithinPartitions("gram", "block").mapInArrow(_pairs, "a string, b string, how int, cosine double").distinct()
    )
    alike_ = pairs.filter("how = 1").select("a", "b", F.round(F.col("cosine") * UNIT).cast("bigint").alias("similar"))
    linked = components(alike_, "a", "b")
    sized = cores.select("core", "names")
    whole = checkpoint(
        alike_.join(linked, alike_.a == linked.node)
        .drop("node")
        .join(sized.select(F.col("core").alias("a"), F.col("names").alias("size_a")), "a")
        .join(sized.select(F.col("core").alias("b"), F.col("names").alias("size_b")), "b")
    )
    vast = checkpoint(whole.groupBy("component").count().filter(F.col("count") > most).select("component"))
    small = whole.join(vast, "component", "left_anti")
    clusters = small.repartition("component").sortWithinPartitions("component", "a", "b").mapInArrow(_clusters, "core string, cluster string")
    if not vast.isEmpty():
        clusters = clusters.unionByName(parted(whole.join(vast, "component", "left_semi")))
    placed = checkpoint(
        read.join(clusters, "core", "left").select("name", "kinds", "side", "core", F.coalesce("cluster", "core").alias("cluster"))
    )
    # which kinds a cluster has for sure, by side
    sure = placed.filter(F.size("kinds") == 1).groupBy("cluster", "side").agg(F.collect_set(F.col("kinds")[0]).alias("sure"))
    # a Latin form belongs to the one cluster it may shorten that has its side and kind
    shortened = pairs.filter("how = 2").select(F.explode(F.array(F.struct(F.col("a").alias("latin"), F.col("b").alias("full")), F.struct(F.col("b").alias("latin"), F.col("a").alias("full")))).alias("p")).select("p.*")
    latin = placed.filter(F.col("core").rlike("(ia|e)$")).select("name", "kinds", "side", F.col("core").alias("latin"), F.col("cluster").alias("own"))
    targets = placed.select(F.col("core").alias("full"), "cluster").distinct()
    moved = (
        latin.join(shortened, "latin")
        .join(targets, "full")
        .join(sure, ["cluster", "side"])
        .filter((F.size("kinds") == 0) | F.arrays_overlap("kinds", "sure"))
        .filter("cluster <> own")
        .groupBy("name")
        .agg(F.collect_set("cluster").alias("to"))
        .filter(F.size("to") == 1)
        .select("name", F.col("to")[0].alias("to"))
    )
    placed = placed.join(moved, "name", "left").withColumn("cluster", F.coalesce("to", "cluster"))
    fits = F.when(F.size("kinds") == 0, F.coalesce("sure", F.array().cast("array<string>"))).otherwise(F.array_intersect("kinds", F.coalesce("sure", F.array().cast("array<string>"))))
    settled = placed.join(sure, ["cluster", "side"], "left").withColumn("fits", fits)
    own = F.when(F.size("kinds") == 1, F.col("kinds")[0]).when(F.size("fits") == 1, F.col("fits")[0]).otherwise(F.array_join("kinds", "|"))
    return settled.select("name", F.concat_ws("\x00", "cluster", "side", own).alias("entity"))


def linked_names(names: DataFrame, name: str, kind: str, chunk: int = CHUNK, most: int = PAIRS) -> DataFrame:
    """(name_a, name_b) of each two different names of one entity, the smaller by UTF-8 bytes first.

    ``entities`` gives the same as membership; this spells it out, an entity with many names being cut by their number.
    """
    found = checkpoint(entities(names, name, kind, chunk, most))
    right = found.select("entity", F.col("name").alias("name_b"))
    hot = hot_keys(found.groupBy("entity").count(), "entity", "count")
    return salted_join(found.withColumnRenamed("name", "name_a"), right, "entity", hot, by=F.col("name_a")).filter("name_a < name_b").select("name_a", "name_b")


def p5_found(spark, sf_dir: str) -> DataFrame:
    from epochgrid.sources.tables import table

    typed = missing_names(table(spark, sf_dir, "timeline_dump")).filter("kind is null or kind <> 'language'")
    return linked_names(typed, "name", "kind")

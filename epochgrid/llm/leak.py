"""Held-out test items that leaked into a corpus.

Both sides become words without case, accents, punctuation, spacing and markup. Winnowing keeps the smallest hash of each
window of ``WINDOW`` k-grams of ``GRAM`` words, so every shared run of GRAM + WINDOW - 1 = 6 words shares a fingerprint. A
span of at least 20 words with at most one word in eight changed always has such a run (n words with n // 8 changes leave a
run of 6 or more for each n from 20 on). Documents that share a fingerprint with an item are extended: first by the q-gram
lemma (n words with e edits keep at least n - k + 1 - k e of their k-grams, 9 or more), then exactly, from each shared run
to both sides by the furthest place reached with each number of edits.

Up to ``ITEMS`` characters of items their fingerprints are what each task joins its documents with, so the documents are never
shuffled. Beyond it the fingerprints of both sides meet in one join, hot ones salted by their counts, and the pairs that share one
are extended by the same code; both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochgrid.llm.words import words
from epochgrid.operators.arrow import sliced

GRAM, WINDOW, SPAN, ONE_IN = 4, 3, 20, 8
#: Characters of items that go to each task; there they take some twenty times as much.
ITEMS = 4_000_000
BLOCK = 8 << 20
_NONE = np.uint64(2**64 - 1)


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k-gram of word numbers; that of a k-gram with the unknown word 0 is the largest number."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    known = np.ones(n, bool)
    with np.errstate(over="ignore"):
        for i in range(k):
            part = ids[i : i + n]
            known &= part > 0
            h = (h ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return np.where(known, h & np.uint64(2**63 - 1), _NONE)


def winnowed(h: np.ndarray, w: int) -> np.ndarray:
    """The places of the smallest hash of each w neighbours, the last of equal ones; of fewer than w all."""
    n = len(h)
    if n <= w:
        return np.arange(n)
    best = np.arange(n - w + 1)
    for i in range(1, w):
        here = np.arange(i, n - w + 1 + i)
        best = np.where(h[here] <= h[best], here, best)
    return np.unique(best)


def longest_span(item: list[int], text: list[int], at: int, to: int, length: int, one_in: int = ONE_IN) -> int:
    """The most item words in a span through the run item[at:at+length] == text[to:to+length] that begins and ends with a
    shared word and has at most one edit for each ``one_in`` of its words."""
    most = len(item) // one_in
    right = _reached(item, text, at + length, to + length, 1, most)
    left = _reached(item, text, at - 1, to - 1, -1, most)
    best = 0
    for i, a in enumerate(left):
        for j, b in enumerate(right[: most - i + 1]):
            span = length + a + b
            if i + j <= span // one_in:
                best = max(best, span)
    return best


def _reached(item: list[int], text: list[int], at: int, to: int, way: int, most: int) -> list[int]:
    """By number of edits: the most item words from (at, to) on, the last one shared."""
    ends = (len(item), len(text)) if way > 0 else (-1, -1)
    out: list[int] = []
    far: dict[int, int] = {0: 0}
    best = 0
    for edits in range(most + 1):
        if edits:
            new: dict[int, int] = {}
            for d, x in far.items():
                for e, y in ((d, x + 1), (d + 1, x), (d - 1, x + 1)):
                    if y > new.get(e, -1):
                        new[e] = y
            far = new
        for d, x in far.items():
            i, j = at + way * x, to + way * (x + d)
            n = 0
            while i != ends[0] and j != ends[1] and 0 <= j < len(text) and 0 <= i < len(item) and item[i] == text[j]:
                i, j, n = i + way, j + way, n + 1
            if n:
                far[d] = x + n
                best = max(best, x + n)
        out.append(best)
    return out


class Items:
    """Items ready to be looked for: their words as numbers, all k-grams and the winnowed ones."""

    def __init__(self, ids: list, texts: list[str]):
        self.names = ids
        self.numbers: dict[str, int] = {}
        self.words = [[self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(t)] for t in texts]
        # items of fewer words than a k-gram are looked for by shorter ones
        self.tables = {}
        for k in range(1, GRAM + 1):
            grams, owners, kept, whole = [], [], [], []
            for i, w in enumerate(self.words):
                if min(len(w), GRAM) != k:
                    continue
                h = gram_hashes(np.array(w, np.int64), k)
                grams.append(h)
                owners.append(np.full(len(h), i))
                # only spans of SPAN words are sure to share a winnowed fingerprint
                (kept if len(w) >= SPAN else whole).append(h[winnowed(h, WINDOW)] if len(w) >= SPAN else h)
            if grams:
                h, o = np.concatenate(grams), np.concatenate(owners)
                order = np.lexsort((o, h))
                h, o = h[order], o[order]
                fresh = np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])]
                prints, short = (np.unique(np.concatenate([np.zeros(0, np.uint64), *x])) for x in (kept, whole))
                self.tables[k] = (h[fresh], o[fresh], prints, short)

    def found(self, texts: list[str | None]) -> tuple[list[int], list]:
        """(text, item) for each item a text gives away."""
        get = self.numbers.get
        split = [words(t) if t else [] for t in texts]
        length = np.array([len(w) for w in split])
        ids = np.fromiter((get(w, 0) for ws in split for w in (*ws, "")), np.int64, int(length.sum()) + len(split))
        starts = np.cumsum(length + 1) - length - 1
        rows: list[int] = []
        out: list = []
        for k, (grams, owners, prints, short) in self.tables.items():
            h = gram_hashes(ids, k)
            live = np.flatnonzero(h != _NONE)
            if not live.size:
                continue
            chosen = winnowed(h, WINDOW) if len(prints) else live[:0]
            chosen = chosen[h[chosen] != _NONE]
            hit = np.r_[chosen[np.isin(h[chosen], prints)], live[np.isin(h[live], short)] if len(short) else live[:0]]
            docs = np.unique(np.searchsorted(starts, hit, "right") - 1)
            marked = np.zeros(len(split), bool)
            marked[docs] = True
            where = live[marked[np.searchsorted(starts, live, "right") - 1]]
            low, high = np.searchsorted(grams, h[where]), np.searchsorted(grams, h[where], "right")
            count = high - low
            at = np.repeat(where, count)
            owner = owners[np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())]
            doc = np.searchsorted(starts, at, "right") - 1
            pair = doc * len(self.words) + owner
            order = np.lexsort((at, pair))
            pair, at = pair[order], at[order]
            uniq, first, n = np.unique(pair, return_index=True, return_counts=True)
            text: list[int] = []
            held = -1
            for p, f, c in zip(uniq.tolist(), first.tolist(), n.tolist()):
                d, i = divmod(p, len(self.words))
                item = self.words[i]
                need = min(SPAN, len(item))
                if c < max(1, need - k + 1 - k * (need // ONE_IN)):
                    continue
                if d != held:
                    held, text = d, ids[starts[d] : starts[d] + length[d]].tolist()
                if self._given(item, text, (at[f : f + c] - starts[d]).tolist(), k, need):
                    rows.append(d)
                    out.append(self.names[i])
        return rows, out

    def _given(self, item: list[int], text: list[int], places: list[int], k: int, need: int) -> bool:
        """Whether a span long enough runs through one of the places of the text whose k words the item has."""
        known: dict[tuple[int, ...], list[int]] = {}
        for i in range(len(item) - k + 1):
            known.setdefault(tuple(item[i : i + k]), []).append(i)
        seen: set[tuple[int, int]] = set()
        for j in dict.fromkeys(places):
            for i in known.get(tuple(text[j : j + k]), ()):
                inside = (i - 1, j - 1) in seen  # of a run that has been tried
                seen.add((i, j))
                if inside:
                    continue
                n = k
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n]:
                    n += 1
                if longest_span(item, text, i, j, n) >= need:
                    return True
        return False


def _prints(text: str, kinds: tuple[int, ...]) -> set[tuple[int, int]]:
    """(kind, fingerprint) of a text: of kind 0 the winnowed k-grams, of kind k all k-grams, by hashes of words."""
    from xxhash import xxh32_intdigest

    ids = np.array([xxh32_intdigest(w) + 1 for w in words(text)], np.int64)
    out: set[tuple[int, int]] = set()
    for kind in kinds:
        h = gram_hashes(ids, kind or GRAM)
        out |= {(kind, x) for x in (h if kind else h[winnowed(h, WINDOW)]).astype(np.int64).tolist()}
    return out


def _joined(source: DataFrame, held: DataFrame) -> DataFrame:
    """(__key, __item) by one join of fingerprints. Equal texts are looked at once."""
    from epochgrid.operators.skew import hot_keys, salted_join
    from epochgrid.session import checkpoint

    def kind_of(text: str) -> tuple[int, ...]:
        n = len(words(text))
        return (0,) if n >= SPAN else (min(n, GRAM),) if n else ()

    def printed(batches: Iterator[pa.RecordBatch], kinds: tuple[int, ...] | None) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text", BLOCK):
                ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
                rows = [(i, k, h) for i, t in zip(ids, texts) for k, h in sorted(_prints(t, kind_of(t) if kinds is None else kinds))]
                columns = [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.int32(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "kind", "print"])

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [bool(Items([0], [b]).found([t])[0]) for t, b in zip(batch.column("text").to_pylist(), batch.column("body").to_pylist())]
            yield batch.select(["id", "item_id"]).filter(pa.array(keep, pa.bool_()))

    schema = "id string, kind int, print bigint"
    bodies = held.select(F.md5("body").alias("id"), F.col("body").alias("text")).dropDuplicates(["id"])
    wanted = checkpoint(bodies.mapInArrow(lambda b: printed(b, None), schema).withColumnRenamed("id", "item_id").withColumn("at", F.xxhash64("kind", "print")).select("item_id", "at", "kind"))
    kinds = tuple(sorted(r["kind"] for r in wanted.select("kind").distinct().collect()))  # five at most
    texts = source.select(F.md5("__text").alias("id"), F.col("__text").alias("text"))
    have = texts.mapInArrow(lambda b: printed(b, kinds), schema).select("id", F.xxhash64("kind", "print").alias("at"))
    have = checkpoint(have.join(wanted.select("at").distinct(), "at", "left_semi").distinct())
    pairs = checkpoint(salted_join(have, wanted.drop("kind"), "at", hot_keys(have.groupBy("at").count(), "at", "count"), by=F.col("id")).select("id", "item_id").distinct())
    some = texts.join(pairs.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    both = pairs.join(some, "id").join(bodies.select(F.col("id").alias("item_id"), F.col("text").alias("body")), "item_id")
    sure = checkpoint(both.select("id", "item_id", "text", "body").mapInArrow(given, "id string, item_id string"))
    docs = source.select("__key", F.md5("__text").alias("id"))
    found = salted_join(docs, sure, "id", hot_keys(docs.groupBy("id").count(), "id", "count"))
    return found.join(held.select("item", F.md5("body").alias("item_id")), "item_id").select("__key", F.col("item").alias("__item"))


def leaked(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, most: int = ITEMS) -> DataFrame:
    """(key, item_key) for each document that holds an item, or at least ``SPAN`` consecutive words of it, with at most one
    word in eight changed, added or missing; spans begin and end with a shared word.

    Null and empty texts and items without words give nothing; an item shorter than ``SPAN`` words must be there as a
    whole. Rows that repeat a document repeat its result. A null key stays null; if both keys have one name the item's gets
    ``_item`` at its end. Other columns aren't read. ``most`` characters of items are sent to the tasks, more are joined.
    """
    spark = docs.sparkSession
    held = items.select(F.col(item_key).alias("item"), F.col(item_text).cast("string").alias("body")).filter(F.length("body") > 0)
    size = int(held.agg(F.coalesce(F.sum(F.length("body")), F.lit(0))).first()[0])
    kind = dict(items.dtypes)[item_key]
    source = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text")).filter(F.length("__text") > 0)
    named = item_key if item_key != key else f"{item_key}_item"
    if size > most:
        return _joined(source, held).select(F.col("__key").alias(key), F.col("__item").alias(named))
    rows = held.toArrow()  # of a size that has been checked
    shared = spark.sparkContext.broadcast((rows.column("item").to_pylist(), rows.column("body").to_pylist()))
    kept_type = rows.schema.field("item").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Items(*shared.value)
        for whole in batches:
            for batch in sliced(whole, "__text", BLOCK):
                at, item = made.found(batch.column("__text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("__key").take(pa.array(at, pa.int64())), pa.array(item, kept_type)], names=["__key", "__item"])

    out = source.mapInArrow(run, f"__key {dict(docs.dtypes)[key]}, __item {kind}")
    return out.select(F.col("__key").alias(key), F.col("__item").alias(named))


def p7_found(spark, sf_dir: str) -> DataFrame:
    from epochgrid.sources.tables import table

    return leaked(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "item_text")

"""Overlapping intervals into continuous periods and the gaps between them.

Integer intervals are taken apart into canonical dyadic blocks [k 2^l, (k + 1) 2^l). Of one key's blocks those covered
by an ancestor go, sibling pairs merge upwards, and the blocks that then touch are joined to periods. Years are doubled
first (year y is the point 2 y, and an interval holds the odd points between its years), so that intervals that only
follow each other (…5, 6…) don't touch while those that share a year do.

Union is associative and idempotent: each task first merges what it has, so a key with a third of all rows crosses the
network as few periods per task, and a long group is folded batch by batch, never held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochgrid.operators.arrow import changes, flat, held_back

#: Ends of intervals lie within ± ``FURTHEST``; the shift makes all doubled points positive.
FURTHEST = 1 << 59
_SHIFT = 1 << 61


def dyadic_blocks(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The canonical dyadic blocks (group, level, number) of intervals with both ends included."""
    g, a, b, level = group, start + _SHIFT, end + _SHIFT + 1, 0
    out = []
    while g.size:
        odd = (a & 1) == 1
        out.append((g[odd], np.full(odd.sum(), level), a[odd]))
        a = a + odd
        odd = ((b & 1) == 1) & (a < b)
        b = b - odd
        out.append((g[odd], np.full(odd.sum(), level), b[odd]))
        a, b, level = a >> 1, b >> 1, level + 1
        live = a < b
        g, a, b = g[live], a[live], b[live]
    if not out:
        return group, group, group
    return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


def uncovered(g: np.ndarray, level: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without copies and blocks inside an ancestor. Blocks nest or are apart, so an ancestor's end reaches beyond."""
    if not g.size:
        return g, level, k
    start = k << level
    order = np.lexsort((-level, start, g))
    g, level, k, start = g[order], level[order], k[order], start[order]
    end = start + (np.int64(1) << level)
    fresh = np.r_[True, g[1:] != g[:-1]]
    rank = np.cumsum(fresh) - 1
    ends, code = np.unique(end, return_inverse=True)
    base = rank * len(ends)
    reach = ends[np.maximum.accumulate(code + base) - base]  # the furthest end so far in the group
    keep = fresh.copy()
    keep[1:] |= end[1:] > reach[:-1]
    return g[keep], level[keep], k[keep]


def merged_upwards(g: np.ndarray, level: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sibling pairs become their parent, level by level."""
    done, at = [], int(level.min(initial=0))
    top = int(level.max(initial=0))
    cg, ck = np.zeros(0, np.int64), np.zeros(0, np.int64)
    while at <= top or cg.size:
        here = level == at
        cg, ck = np.r_[cg, g[here]], np.r_[ck, k[here]]
        order = np.lexsort((ck, cg))
        cg, ck = cg[order], ck[order]
        first = np.zeros(cg.size, bool)
        first[:-1] = (cg[1:] == cg[:-1]) & (ck[1:] == ck[:-1] + 1) & ((ck[:-1] & 1) == 0)
        single = ~first
        single[1:] &= ~first[:-1]
        done.append((cg[single], np.full(single.sum(), at), ck[single]))
        cg, ck, at = cg[first], ck[first] >> 1, at + 1
    return tuple(np.concatenate(x) for x in zip(*done)) if done else (g, level, k)  # type: ignore[return-value]


def periods(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, start, end) of each longest run of points covered by a group's intervals, in order; ends included."""
    group = group.astype(np.int64)
    g, level, k = merged_upwards(*uncovered(*dyadic_blocks(group, start.astype(np.int64), end.astype(np.int64))))
    a = k << level
    b = a + (np.int64(1) << level)
    order = np.lexsort((a, g))
    g, a, b = g[order], a[order], b[order]
    fresh = np.ones(g.size, bool)
    fresh[1:] = (g[1:] != g[:-1]) | (a[1:] != b[:-1])
    last = np.r_[np.flatnonzero(fresh)[1:] - 1, g.size - 1] if g.size else np.zeros(0, int)
    return g[fresh], a[fresh] - _SHIFT, b[last] - _SHIFT - 1


def _folded(table: pa.Table, keys: list[str], sort: bool) -> pa.Table:
    if not table.num_rows:
        return table
    if sort:
        table = table.sort_by([(k, "ascending") for k in keys])
    fresh = changes([flat(table.column(k)) for k in keys])
    heads = np.flatnonzero(fresh)
    g, a, b = periods(np.cumsum(fresh) - 1, table.column("__a").to_numpy(), table.column("__b").to_numpy())
    out = table.select(keys).take(pa.array(heads[g]))
    return out.append_column("__a", pa.array(a)).append_column("__b", pa.array(b))


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, rel, start, end): ``period`` for each longest stretch of intervals that share points, ``gap`` from the end
    of a period to the start of the key's next.

    Both ends are included; an interval that lacks an end, ends before it starts or goes beyond ``FURTHEST``
    doesn't count. A null key is a key of its own. Repeated rows change nothing. The other columns of ``df`` are dropped, so their names can't clash.
    """
    names = [f"__g{i}" for i in range(len(keys))]
    types = dict(df.dtypes)
    source = (
        df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(start).try_cast("bigint").alias("__a"), F.col(end).try_cast("bigint").alias("__b"))
        .filter(f"__a <= __b and __a >= {-FURTHEST} and __b <= {FURTHEST}")
        .withColumns({"__a": F.col("__a") * 2, "__b": F.col("__b") * 2})
    )
    schema = ", ".join([f"{n} {types[k]}" for k, n in zip(keys, names)] + ["__a bigint", "__b bigint"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _folded(pa.Table.from_batches([batch]), names, True).to_batches()

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in held_back(batches, names, lambda t: _folded(t, names, False)):
            done = _folded(part, names, False)
            fresh = changes([flat(done.column(n)) for n in names])
            a, b = done.column("__a").to_numpy() >> 1, done.column("__b").to_numpy() >> 1
            later = np.flatnonzero(~fresh)
            rows = [
                (done, np.full(len(a), "period"), a, b),
                (done.take(pa.array(later)), np.full(len(later), "gap"), b[later - 1], a[later]),
            ]
            for at, rel, x, y in rows:
                arrays = [flat(at.column(n)) for n in names] + [pa.array(rel, pa.string()), pa.array(x), pa.array(y)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, "__rel", "__a", "__b"])

    spread = source.mapInArrow(within, schema).repartition(*names).sortWithinPartitions(*names)
    out = spread.mapInArrow(across, schema.replace("__a bigint", "__rel string, __a bigint"))
    return out.select(
        *[F.col(n).alias(k) for k, n in zip(keys, names)], F.col("__rel").alias("rel"), F.col("__a").alias(start), F.col("__b").alias(end)
    )


def entity_periods(sites: DataFrame) -> DataFrame:
    """Periods and gaps of each entity at each site: (site_id, track, entity_qid, rel, from_year, to_year).

    Of polity, culture, religion and language entries with a QID; open ends are completed by the site's inception and
    dissolution years, else 9999. Copies of a site row change nothing, as union is idempotent. An entry whose years no INT holds
    doesn't count.
    """
    from epochgrid.operators.timelines import timeline_items

    tracks = ["polity", "culture", "religion", "language"]
    items = timeline_items(
        sites.filter(F.col("id").isNotNull()), "id", "timeline", ["record_id", "section", "year", "to_year", "qid"], tracks,
        keep=["inception_year", "dissolution_year"],
    )
    entries = items.select(
        F.col("record_id").alias("site_id"),
        F.col("section").alias("track"),
        F.trim("qid").alias("entity_qid"),
        F.coalesce("year", "inception_year").alias("from_year"),
        F.coalesce("to_year", "dissolution_year", F.lit(9999)).alias("to_year"),
    ).filter(f"entity_qid <> '' and from_year between {-(2**31)} and {2**31 - 1} and to_year between {-(2**31)} and {2**31 - 1}")
    out = merge_intervals(entries, ["site_id", "track", "entity_qid"], "from_year", "to_year")
    return out.withColumn("from_year", F.col("from_year").cast("int")).withColumn("to_year", F.col("to_year").cast("int"))


def p4_found(spark, sf_dir: str) -> DataFrame:
    from epochgrid.sources.tables import table

    return entity_periods(table(spark, sf_dir, "sites"))

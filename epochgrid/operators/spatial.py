"""Points near other points, and the regions that contain them.

Near: longitude and latitude become unit vectors, so that a great-circle distance is a chord and neither the poles nor
the antimeridian are special. A k-d tree over a bounded sample cuts space into cells of about equal load; it decides
only where rows go, never which are found. Each point goes to its home cell and, as a halo, to all cells within the
chord. Each cell is searched with a k-d tree of its own by a dual descent over pairs of nodes. A cell with more points than
``CELL`` (copies of one place can't be cut) becomes blocks: points fall into chunks, a task gets two chunks.

Regions: a plane sweep over the edges, from west to east, keeps the edges under the sweep line in order of latitude; between
two stops of the sweep this order stays, so a point is located by two binary searches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochgrid.operators.arrow import by_group, flat
from epochgrid.session import task_slots

EARTH_KM = 6371.0088
#: Points a task searches at once, and the bound of the sample that places the cuts.
CELL, SAMPLE, CELLS = 40_000, 60_000, 16_384
#: Edges of regions up to which the sweep's result goes to every task; beyond it both sides are cut into strips.
EDGES = 200_000
_LEAF = 12


def great_circle_km(lon_a, lat_a, lon_b, lat_b):
    a = np.sin(np.radians(lat_b - lat_a) / 2) ** 2
    b = np.sin(np.radians(lon_b - lon_a) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1, a + np.cos(np.radians(lat_a)) * np.cos(np.radians(lat_b)) * b)))


def unit_vectors(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    lon, lat = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)


class Cuts:
    """A k-d tree of cells: inner nodes have an axis and a value, leaves a cell number and their share of the sample."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.axis: list[int] = []
        self.value: list[float] = []
        self.kids: list[tuple[int, int]] = []
        self.share: list[float] = []
        self.cell: list[int] = []
        self._grow(sample, max(1, len(sample)), max(1, cells))

    def _grow(self, points: np.ndarray, total: int, cells: int) -> int:
        me = len(self.axis)
        self.axis.append(-1)
        self.value.append(0.0)
        self.kids.append((-1, -1))
        self.cell.append(-1)
        spread = points.max(0) - points.min(0) if len(points) else np.zeros(3)
        if cells > 1 and len(points) > 1 and spread.max() > 0:
            axis = int(spread.argmax())
            values = np.sort(points[:, axis])
            value = float(values[len(values) // 2])
            if value == values[0]:
                value = float(values[np.searchsorted(values, value, "right")])
            low = points[:, axis] < value
            self.axis[me], self.value[me] = axis, value
            self.kids[me] = (self._grow(points[low], total, cells // 2), self._grow(points[~low], total, cells - cells // 2))
        else:
            self.cell[me] = len(self.share)
            self.share.append(len(points) / total)
        return me

    def placed(self, points: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, cell, home) for the home cell of each point and every other cell within reach."""
        out = []
        todo = [(0, np.arange(len(points)), np.ones(len(points), bool))]
        while todo:
            node, at, home = todo.pop()
            if not at.size:
                continue
            if self.axis[node] < 0:
                out.append((at, np.full(at.size, self.cell[node]), home))
                continue
            off = points[at, self.axis[node]] - self.value[node]
            low, high = off <= reach, off >= -reach
            todo.append((self.kids[node][0], at[low], home[low] & (off[low] < 0)))
            todo.append((self.kids[node][1], at[high], home[high] & (off[high] >= 0)))
        if not out:
            none = np.zeros(0, np.int64)
            return none, none, none.astype(bool)
        return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


class LocalTree:
    """A balanced k-d tree over points; leaves hold up to ``_LEAF`` of them, level arrays hold the nodes' boxes."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        self.levels = max(0, math.ceil(math.log2(max(1, n / _LEAF))))
        order, bounds = np.arange(n), np.array([0, n])
        for _ in range(self.levels):
            node = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            p = points[order]
            size = np.maximum.reduceat(p, bounds[:-1]) - np.minimum.reduceat(p, bounds[:-1])
            axis = size.argmax(1)
            order = order[np.lexsort((p[np.arange(n), axis[node]], node))]
            middle = (bounds[:-1] + bounds[1:]) // 2
            bounds = np.unique(np.r_[bounds, middle])
        self.order, self.bounds, self.points = order, bounds, points[order]
        low, high = np.minimum.reduceat(self.points, bounds[:-1]), np.maximum.reduceat(self.points, bounds[:-1])
        self.boxes = [(low, high)]
        while len(low) > 1:
            low, high = np.minimum(low[0::2], low[1::2]), np.maximum(high[0::2], high[1::2])
            self.boxes.append((low, high))
        self.boxes.reverse()

    def pairs(self, reach: float, block: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j) of points at most ``reach`` apart, each once, in parts."""
        a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for low, high in self.boxes[1:]:
            same = a == b
            a, b = (
                np.r_[2 * a, 2 * a, 2 * a + 1, (2 * a + 1)[~same]],
                np.r_[2 * b, 2 * b + 1, 2 * b + 1, (2 * b)[~same]],
            )
            gap = np.maximum(0, np.maximum(low[a] - high[b], low[b] - high[a]))
            near = (gap * gap).sum(1) <= reach * reach
            a, b = a[near], b[near]
        size = np.diff(self.bounds)
        work = np.cumsum(size[a] * size[b])
        at = 0
        while at < len(a):
            to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + block, "right")))
            x, y = a[at:to], b[at:to]
            count = size[x] * size[y]
            pair = np.repeat(np.arange(len(x)), count)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
            i = self.bounds[x][pair] + k // size[y][pair]
            j = self.bounds[y][pair] + k % size[y][pair]
            keep = (x[pair] != y[pair]) | (i < j)
            i, j = i[keep], j[keep]
            d = self.points[i] - self.points[j]
            near = (d * d).sum(1) <= reach * reach
            yield self.order[i[near]], self.order[j[near]]
            at = to


def near_pairs(points: DataFrame, key: str, lon: str, lat: str, km: float, cell: int = CELL) -> DataFrame:
    """(key_a, key_b) of each two different keys at most ``km`` apart along the great circle, the smaller key first.

    A location counts when lon is in −180..180, lat in −90..90, and it isn't (0, 0); others, and null keys, have no pairs. A
    key that comes more than once counts once, with its smallest location. All pairs are given, those of one place too.
    """
    spark = points.sparkSession
    reach = 2 * math.sin(min(km / EARTH_KM, math.pi) / 2) * (1 + 1e-9) + 1e-12
    at = located(points, key, lon, lat)
    n = points.count()
    if n == 0:
        return spark.createDataFrame([], "key_a string, key_b string")
    sample = _valid(points, key, lon, lat).select("lon", "lat").sample(False, min(1.0, SAMPLE / n), 42).limit(2 * SAMPLE).toArrow()
    cells = int(min(CELLS, max(1, math.ceil(n / cell), min(task_slots(spark) * 2, n // 2000))))
    cuts = Cuts(unit_vectors(sample.column("lon").to_numpy(), sample.column("lat").to_numpy()), cells)
    chunks = np.array([max(1, math.ceil(s * n / cell / 2)) for s in cuts.share])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = unit_vectors(batch.column("lon").to_numpy(), batch.column("lat").to_numpy())
            row, where, home = cuts.placed(p, reach)
            spread = chunks[where]
            chunk = batch.column("salt").to_numpy()[row] % spread
            again = np.repeat(np.arange(len(row)), spread)
            other = np.arange(len(again)) - np.repeat(np.cumsum(spread) - spread, spread)
            lower, upper = np.minimum(chunk[again], other), np.maximum(chunk[again], other)
            task = (where[again].astype(np.int64) << 40) | (lower << 20) | upper
            picked = batch.take(pa.array(row[again]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(task), picked.column("key"), picked.column("lon"), picked.column("lat"), pa.array(home[again]), pa.array(chunk[again])],
                names=["task", "key", "lon", "lat", "home", "chunk"],
            )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, ["task"]):
            task = group.column("task")[0].as_py()
            crossing = (task >> 20) & 0xFFFFF != task & 0xFFFFF
            keys = flat(group.column("key"))
            lon, lat = group.column("lon").to_numpy(), group.column("lat").to_numpy()
            home, chunk = group.column("home").to_numpy(), group.column("chunk").to_numpy()
            rank = np.empty(len(keys), np.int64)
            rank[np.array(pa.compute.sort_indices(keys))] = np.arange(len(keys))
            for i, j in LocalTree(unit_vectors(lon, lat)).pairs(reach):
                swap = rank[i] > rank[j]
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                keep = home[i] & (great_circle_km(lon[i], lat[i], lon[j], lat[j]) <= km)
                if crossing:
                    keep &= chunk[i] != chunk[j]
                for part in range(0, int(keep.sum()), 200_000):
                    x, y = i[keep][part : part + 200_000], j[keep][part : part + 200_000]
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(x)), keys.take(pa.array(y))], names=["key_a", "key_b"])

    salted = at.withColumn("salt", F.xxhash64("key").bitwiseAND(F.lit((1 << 62) - 1)))
    placed = salted.mapInArrow(place, "task bigint, key string, lon double, lat double, home boolean, chunk bigint")
    return placed.repartition("task").sortWithinPartitions("task").mapInArrow(search, "key_a string, key_b string")


def _valid(points: DataFrame, key: str, lon: str, lat: str) -> DataFrame:
    return points.select(
        F.col(key).cast("string").alias("key"), F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat")
    ).filter("key is not null and lon between -180 and 180 and lat between -90 and 90 and not (lon = 0 and lat = 0)")


def located(points: DataFrame, key: str, lon: str, lat: str) -> DataFrame:
    """(key, lon, lat) of the locations that count, each key once."""
    return _valid(points, key, lon, lat).groupBy("key").agg(F.min(F.struct("lon", "lat")).alias("at")).select("key", "at.lon", "at.lat")


class Sweep:
    """Regions by a plane sweep over their edges, from west to east; between two stops the edges keep their order from south to
    north, each with the regions right above it.

    Edges lie in buckets of stops, sized so that all buckets together hold ``COPIES`` times the edges at most; the order between two
    stops is worked out from its bucket when a point first falls there, and kept while what is kept has ``KEPT`` edges at most.
    """

    COPIES, KEPT = 8, 1_000_000

    def __init__(self, region: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray):
        swap = x1 > x2
        x1, x2, y1, y2 = np.where(swap, x2, x1), np.where(swap, x1, x2), np.where(swap, y2, y1), np.where(swap, y1, y2)
        slanted = x1 < x2  # an upright edge decides nothing
        self.region, x1, y1, x2, y2 = region[slanted], x1[slanted], y1[slanted], x2[slanted], y2[slanted]
        self.stops = np.unique(np.r_[x1, x2])
        self.slope = (y2 - y1) / (x2 - x1)
        self.base = y1 - self.slope * x1
        self.begin, self.end = np.searchsorted(self.stops, x1), np.searchsorted(self.stops, x2)
        self.width = 1
        while (copies := (self.end - 1) // self.width - self.begin // self.width + 1).sum() > self.COPIES * max(1, len(x1)):
            self.width *= 2
        edge = np.repeat(np.arange(len(x1)), copies)
        bucket = np.repeat(self.begin // self.width, copies) + np.arange(len(edge)) - np.repeat(np.cumsum(copies) - copies, copies)
        order = np.argsort(bucket, kind="stable")
        self.edge = edge[order]
        self.starts = np.searchsorted(bucket[order], np.arange(len(self.stops) // self.width + 2))
        self.kept: dict[int, tuple[np.ndarray, np.ndarray, list[list[int]]]] = {}
        self.held = 0

    def slab(self, k: int) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        """(slope, base, regions above) of the edges between the stops k and k + 1, from south to north."""
        if k in self.kept:
            return self.kept[k]
        b = k // self.width
        e = self.edge[self.starts[b] : self.starts[b + 1]]
        e = e[(self.begin[e] <= k) & (self.end[e] > k)]
        middle = (self.stops[k] + self.stops[k + 1]) / 2
        e = e[np.argsort(self.base[e] + self.slope[e] * middle, kind="stable")]
        open_now: set[int] = set()
        above = []
        for r in self.region[e]:
            open_now ^= {int(r)}
            above.append(sorted(open_now))
        size = len(e) + sum(map(len, above))
        if self.held + size > self.KEPT:
            self.kept, self.held = {}, 0
        self.kept[k] = self.slope[e], self.base[e], above
        self.held += size
        return self.kept[k]

    def containing(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, region) for each region that holds a point; a region's south and west edges belong to it."""
        points, regions = [], []
        slab = np.searchsorted(self.stops, x, "right") - 1
        order = np.argsort(slab, kind="stable")
        cuts = np.r_[0, np.flatnonzero(np.diff(slab[order])) + 1, len(order)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            at = order[a:b]
            k = slab[at[0]] if len(at) else -1
            if not 0 <= k < len(self.stops) - 1:
                continue
            slope, base, above = self.slab(int(k))
            if not len(base):
                continue
            # edges don't cross inside a slab, so they are in order at each x; all flat ones share one search
            if not slope.any():
                below = np.searchsorted(base, y[at], "right") - 1
            else:
                low, high = np.zeros(len(at), np.int64), np.full(len(at), len(base))
                while (live := low < high).any():
                    middle = (low + high) // 2
                    m = np.minimum(middle, len(base) - 1)
                    under = live & (base[m] + slope[m] * x[at] <= y[at])
                    low, high = np.where(under, middle + 1, low), np.where(live & ~under, middle, high)
                below = low - 1
            for point, edge in zip(at, below):
                if edge >= 0:
                    for r in above[edge]:
                        points.append(point)
                        regions.append(r)
        return np.array(points, np.int64), np.array(regions, np.int64)


def in_regions(points: DataFrame, edges: DataFrame, most: int = EDGES) -> DataFrame:
    """(key, region) of each point (key, lon, lat) inside a region given by its edges (region, x1, y1, x2, y2).

    Regions are simple polygons, any number of rings each, whose edges don't cross inside one another; a point on a south
    or west edge is inside, on a north or east edge outside. Up to ``most`` edges the sweep is made once and sent to the
    tasks; beyond it points and edges meet by strips of longitude that hold about ``most`` edges, edges cut at the strips' borders.
    """
    spark = points.sparkSession
    points = points.select("key", "lon", "lat")
    edges = edges.select("region", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]).dropna()
    few = edges.limit(most + 1).toArrow()

    def swept(table: pa.Table) -> tuple[Sweep, pa.Array]:
        names = flat(table.column("region")).dictionary_encode()
        return Sweep(names.indices.to_numpy(), *(table.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2"))), names.dictionary

    def found(sweep: Sweep, names: pa.Array, batch: pa.RecordBatch) -> pa.RecordBatch:
        at, region = sweep.containing(flat(batch.column("lon")).to_numpy(), flat(batch.column("lat")).to_numpy())
        return pa.RecordBatch.from_arrays([flat(batch.column("key")).take(pa.array(at)), names.take(pa.array(region))], names=["key", "region"])

    if few.num_rows <= most:
        shared = spark.sparkContext.broadcast(swept(few))

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield found(*shared.value, batch)

        return points.mapInArrow(local, "key string, region string")

    # beyond it: strips of longitude with about as many edges each, and points of a crowded strip in parts that all get its edges
    many, most = edges.count(), max(1, most)
    cuts = sorted(set(edges.approxQuantile("x1", [k / (many // most + 1) for k in range(1, many // most + 1)], 0.01)))
    # flat and without a lambda, whose outer columns the optimizer overlooks when it carries the expression to the other side of a join
    strip_of = lambda x: F.size(F.array_compact(F.array(*[F.when(x >= c, 1) for c in cuts]).cast("array<int>")))
    borders = F.array(*[F.lit(float(c)) for c in [-1e9, *cuts, 1e9]])
    placed = points.withColumn("strip", strip_of(F.col("lon")))
    parts = F.broadcast(placed.groupBy("strip").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts")))  # one row a strip
    west, east = F.least("x1", "x2"), F.greatest("x1", "x2")
    cut = edges.filter("x1 <> x2").withColumn("strip", F.explode(F.sequence(strip_of(west), strip_of(east))))
    a, b = F.greatest(west, borders[F.col("strip")]), F.least(east, borders[F.col("strip") + 1])
    slope = (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))
    cut = cut.select(
        "strip", "region", a.alias("x1"), (F.col("y1") + slope * (a - F.col("x1"))).alias("y1"),
        b.alias("x2"), (F.col("y1") + slope * (b - F.col("x1"))).alias("y2"),
    ).filter("x1 < x2").join(parts, "strip").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    there = placed.join(parts, "strip").withColumn("part", F.pmod(F.xxhash64("key", "lon", "lat"), "parts").cast("int"))
    both = cut.select("strip", "part", F.lit(0).alias("side"), "region", "x1", "y1", "x2", "y2").unionByName(
        there.select("strip", "part", F.lit(1).alias("side"), "key", "lon", "lat"), allowMissingColumns=True
    )

    def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, place = None, None
        for part in by_group(batches, ["strip", "part", "side"]):
            here = part.column("strip")[0].as_py(), part.column("part")[0].as_py()
            if part.column("side")[0].as_py() == 0:
                made, place = swept(part), here
            elif made is not None and here == place:
                for batch in part.combine_chunks().to_batches(max_chunksize=50_000):
                    yield found(*made, batch)

    return both.repartition("strip", "part").sortWithinPartitions("strip", "part", "side").mapInArrow(strips, "key string, region string")


def box_edges(boxes: DataFrame, region, west, south, east, north) -> DataFrame:
    """The south and north edges of boxes; the upright ones decide nothing in a sweep from west to east."""
    return boxes.select(
        region.alias("region"),
        F.inline(F.array(*[F.struct(west.alias("x1"), y.alias("y1"), east.alias("x2"), y.alias("y2")) for y in (south, north)])),
    )


def p2_found(spark, sf_dir: str) -> DataFrame:
    from epochgrid.sources.tables import table

    sites = table(spark, sf_dir, "sites")
    tiles = table(spark, sf_dir, "tiles").select("lon_min", "lat_min").dropna().distinct()
    near = near_pairs(sites, "id", "lon", "lat", 0.5).select(F.lit("near").alias("rel"), "key_a", "key_b")
    name = F.concat_ws(":", F.col("lon_min").cast("string"), F.col("lat_min").cast("string"))
    x, y = F.col("lon_min").cast("double"), F.col("lat_min").cast("double")
    held = in_regions(located(sites, "id", "lon", "lat"), box_edges(tiles, name, x, y, x + 1, y + 1))
    return near.unionByName(held.select(F.lit("tile").alias("rel"), F.col("key").alias("key_a"), F.col("region").alias("key_b")))

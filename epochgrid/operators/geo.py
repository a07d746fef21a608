"""Territories: clusters of an entity's sites and the shapes around them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochgrid.operators.arrow import by_group
from epochgrid.operators.graph import components
from epochgrid.session import written

RADIUS, BUFFER, SITES = 5.0, 0.08, 3
#: Sites from which an outline is concave, and how long its edges may be, as a share of the longest of the hull.
BENT, SHARE = 5, 0.75


#: Parts a side of a cell is cut into where cells are compared.
FINER = 8


def clusters(points: DataFrame, radius: float = RADIUS) -> DataFrame:
    """(entity, id, cluster): per entity the connected components of points at most ``radius`` degrees apart on the plane; that
    is density clustering where one point is enough. A cluster is named by its smallest id.

    Points of a grid cell a third as wide as the radius are all near each other, so they are linked to one of them only. Two cells are
    compared by the boxes of their points in ``FINER`` times ``FINER`` parts: boxes that lie within the radius, or whose first points
    do, link them, boxes beyond it don't. Places meet each other only where neither says so and no other parts link the two cells.
    """
    side = radius / 3
    p = points.select("entity", "id", "lon", "lat").dropna().distinct()
    p = p.withColumn("cx", F.floor(F.col("lon") / side)).withColumn("cy", F.floor(F.col("lat") / side)).withColumn("node", F.struct("entity", "id"))
    heads = p.groupBy("entity", "cx", "cy").agg(F.min("id").alias("head"))
    p = p.join(heads, ["entity", "cx", "cy"])
    own = p.filter("id <> head").select(F.col("node").alias("a"), F.struct("entity", F.col("head").alias("id")).alias("b"))
    x, y = F.col("lon"), F.col("lat")
    fine = p.withColumn("part", F.struct(F.floor(x / (side / FINER)).alias("x"), F.floor(y / (side / FINER)).alias("y")))
    boxes = fine.groupBy("entity", "cx", "cy", "head", "part").agg(
        F.min(x).alias("w"), F.min(y).alias("s"), F.max(x).alias("e"), F.max(y).alias("n"), F.min(F.struct("lon", "lat")).alias("first")
    )
    steps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(0, 5) for dy in range(-4, 5) if (dx, dy) > (0, 0)]))
    moved = boxes.withColumn("step", steps).select(
        "entity", (F.col("cx") + F.col("step.dx")).alias("cx"), (F.col("cy") + F.col("step.dy")).alias("cy"), F.col("head").alias("other"),
        F.col("part").alias("part_o"), *[F.col(c).alias(f"{c}_o") for c in "wsen"], F.col("first").alias("first_o"),
    )
    zero, reach = F.lit(0.0), radius * radius

    def square(a, b):
        return a * a + b * b

    gap = square(F.greatest(F.col("w") - F.col("e_o"), F.col("w_o") - F.col("e"), zero), F.greatest(F.col("s") - F.col("n_o"), F.col("s_o") - F.col("n"), zero))
    span = square(F.greatest("e", "e_o") - F.least("w", "w_o"), F.greatest("n", "n_o") - F.least("s", "s_o"))
    first = square(F.col("first.lon") - F.col("first_o.lon"), F.col("first.lat") - F.col("first_o.lat"))
    compared = boxes.join(moved, ["entity", "cx", "cy"]).withColumn("sure", (span <= reach) | (first <= reach)).filter(F.col("sure") | (gap <= reach))
    compared = written(compared.select("entity", "head", "other", "part", "part_o", "sure"))
    near = compared.filter("sure").select("entity", "head", "other").distinct()
    open_ = compared.filter("not sure").join(near, ["entity", "head", "other"], "left_anti").select("entity", "head", "other", "part", "part_o")
    places = fine.select("entity", "part", "lon", "lat").distinct()
    pairs = open_.join(places, ["entity", "part"]).join(places.select("entity", F.col("part").alias("part_o"), F.col("lon").alias("x"), F.col("lat").alias("y")), ["entity", "part_o"])
    across = near.unionByName(pairs.filter(square(x - F.col("x"), y - F.col("y")) <= reach).select("entity", "head", "other")).distinct()
    across = across.select(F.struct("entity", F.col("head").alias("id")).alias("a"), F.struct("entity", F.col("other").alias("id")).alias("b"))
    found = components(own.unionByName(across), "a", "b").select(F.col("node"), F.col("component.id").alias("found"))
    return p.join(found, "node", "left").select("entity", "id", "lon", "lat", F.coalesce("found", "id").alias("cluster"))


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners in counter-clockwise order, without collinear ones."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def half(ps: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(points) + half(points[::-1]))


def dug(hull: np.ndarray, points: np.ndarray, share: float) -> np.ndarray:
    """A concave outline: edges of the hull longer than ``share`` of the longest are dug in to the nearest inner point, as long as
    the outline stays simple. It holds all points and is never larger than the hull."""
    ring = [tuple(p) for p in hull]
    inner = {tuple(p) for p in points} - set(ring)

    def length(a, b) -> float:
        return float(np.hypot(a[0] - b[0], a[1] - b[1]))

    def crosses(a, b, c, d) -> bool:
        def side(p, q, r) -> float:
            return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

        return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0

    def inside(p, a, b, c) -> bool:
        d = [(q[0] - r[0]) * (p[1] - r[1]) - (q[1] - r[1]) * (p[0] - r[0]) for r, q in ((a, b), (b, c), (c, a))]
        return all(x >= 0 for x in d) or all(x <= 0 for x in d)

    bound = share * max((length(ring[k - 1], ring[k]) for k in range(len(ring))), default=0)
    k = 0
    while k < len(ring) and inner:
        a, b = ring[k], ring[(k + 1) % len(ring)]
        best = min(inner, key=lambda p: max(length(p, a), length(p, b))) if length(a, b) > bound else None
        fits = (
            best is not None
            and max(length(best, a), length(best, b)) < length(a, b)
            and not any(inside(p, a, b, best) for p in inner if p != best)
            and not any(crosses(a, best, ring[j], ring[(j + 1) % len(ring)]) or crosses(best, b, ring[j], ring[(j + 1) % len(ring)]) for j in range(len(ring)))
        )
        if fits:
            ring.insert(k + 1, best)
            inner.discard(best)
        else:
            k += 1
    return np.array(ring)


def area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return abs(float((x * np.roll(y, -1) - y * np.roll(x, -1)).sum())) / 2


def outer(curve: np.ndarray) -> np.ndarray:
    """The outermost boundary, counter-clockwise, of a closed curve that may cross itself."""
    a, b = curve, np.roll(curve, -1, axis=0)
    keep = np.hypot(*(b - a).T) > 1e-12
    a, d = a[keep], (b - a)[keep]
    cuts: list[list[float]] = [[0.0, 1.0] for _ in a]
    for i in range(len(a)):
        turn = d[i, 0] * d[:, 1] - d[i, 1] * d[:, 0]
        ok = np.abs(turn) > 1e-18
        w, turn = a - a[i], np.where(ok, turn, 1)
        t, u = (w[:, 0] * d[:, 1] - w[:, 1] * d[:, 0]) / turn, (w[:, 0] * d[i, 1] - w[:, 1] * d[i, 0]) / turn
        cuts[i] += t[ok & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)].tolist()
    links: dict[tuple, set[tuple]] = {}
    for p, step, ts in zip(a, d, cuts):
        ends = [tuple(np.round(p + t * step, 9).tolist()) for t in sorted(set(ts))]
        for x, y in zip(ends, ends[1:]):
            if x != y:
                links.setdefault(x, set()).add(y)
                links.setdefault(y, set()).add(x)
    here = start = min(links, key=lambda p: (p[1], p[0]))
    came, ring = np.pi, [start]

    def turned(q: tuple) -> float:  # from where the walk came; back the way it came is last
        angle = (np.arctan2(q[1] - here[1], q[0] - here[0]) - came) % (2 * np.pi)
        return angle if angle > 1e-9 else 2 * np.pi

    while True:
        after = min(links[here], key=turned)
        came, here = np.arctan2(here[1] - after[1], here[0] - after[0]), after
        if here == start or len(ring) > 4 * len(links):
            return np.array(ring)
        ring.append(here)


def widened(ring: np.ndarray, buffer: float) -> np.ndarray:
    """A simple polygon, counter-clockwise, widened by a circle as a polygon of 16 corners; a hole that closes is filled."""
    raw = []
    for k, q in enumerate(ring):
        into, out = q - ring[k - 1], ring[(k + 1) % len(ring)] - q
        first = np.arctan2(into[1], into[0]) - np.pi / 2
        turn = (np.arctan2(out[1], out[0]) - np.pi / 2 - first + np.pi) % (2 * np.pi) - np.pi
        steps = max(1, int(np.ceil(turn / (np.pi / 8))))
        arc = [q + buffer * np.array([np.cos(first + turn * i / steps), np.sin(first + turn * i / steps)]) for i in range(steps + 1)]
        raw += arc if turn >= 0 else [arc[0], q, arc[-1]]
    return outer(np.array(raw))


def clipped(ring: np.ndarray, window: np.ndarray) -> np.ndarray:
    """A polygon cut to a convex window whose corners run counter-clockwise."""
    out = [tuple(p) for p in ring]
    for k in range(len(window)):
        a, b = window[k], window[(k + 1) % len(window)]
        old, out = out, []
        for j in range(len(old)):
            p, q = old[j - 1], old[j]
            sp = (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
            sq = (b[0] - a[0]) * (q[1] - a[1]) - (b[1] - a[1]) * (q[0] - a[0])
            if (sp >= 0) != (sq >= 0):
                u = sp / (sp - sq)
                out.append((p[0] + u * (q[0] - p[0]), p[1] + u * (q[1] - p[1])))
            if sq >= 0:
                out.append(q)
    return np.array(out) if out else np.zeros((0, 2))


def hulls(found: DataFrame, least: int = SITES, buffer: float = BUFFER) -> DataFrame:
    """(entity, cluster, sites, corners, area, geometry, west, south, east, north) of clusters with enough sites: the convex hull,
    widened by ``buffer`` (its circle as a polygon of 16 corners), as GeoJSON, and the box around it. ``corners`` and ``area`` are those
    of the hull itself.

    Only corners count, so tasks first reduce what they have of a cluster to its own hull; a hull of hulls is the hull of all.
    """
    circle = buffer * np.stack([np.cos(np.arange(16) * np.pi / 8), np.sin(np.arange(16) * np.pi / 8)], axis=1)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            for (entity, cluster), g in frame.groupby(["entity", "cluster"], sort=False):
                ring = convex_hull(g[["lon", "lat"]].to_numpy())
                yield pa.RecordBatch.from_pydict({"entity": [entity] * len(ring), "cluster": [cluster] * len(ring), "n": [len(g)] + [0] * (len(ring) - 1), "lon": ring[:, 0], "lat": ring[:, 1]})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, ["entity", "cluster"]):
            n = int(group.column("n").to_numpy().sum())
            ring = convex_hull(np.stack([group.column("lon").to_numpy(), group.column("lat").to_numpy()], axis=1))
            if n < least:
                continue
            wide = convex_hull((ring[:, None, :] + circle[None, :, :]).reshape(-1, 2))
            text = "[[" + ",".join(f"[{x:.6f},{y:.6f}]" for x, y in [*wide, wide[0]]) + "]]"
            yield pa.RecordBatch.from_pydict(
                {"entity": [group.column("entity")[0].as_py()], "cluster": [group.column("cluster")[0].as_py()], "sites": [n], "corners": [len(ring)], "area": [area(ring) if len(ring) > 2 else 0.0], "geometry": ['{"type":"Polygon","coordinates":' + text + "}"],
                 "west": [wide[:, 0].min()], "south": [wide[:, 1].min()], "east": [wide[:, 0].max()], "north": [wide[:, 1].max()]}
            )

    small = found.select("entity", "cluster", "lon", "lat").mapInArrow(reduce, "entity string, cluster string, n bigint, lon double, lat double")
    spread = small.repartition("entity", "cluster").sortWithinPartitions("entity", "cluster")
    return spread.mapInArrow(join, "entity string, cluster string, sites bigint, corners bigint, area double, geometry string, west double, south double, east double, north double")


def outlines(found: DataFrame, least: int = SITES, bent: int = BENT, share: float = SHARE, buffer: float = BUFFER) -> DataFrame:
    """As ``hulls``, but the outline of clusters of ``bent`` sites or more is concave. Inner sites count here, so a cluster's different
    places meet in one task."""
    circle = buffer * np.stack([np.cos(np.arange(16) * np.pi / 8), np.sin(np.arange(16) * np.pi / 8)], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, ["entity", "cluster"]):
            n = int(group.column("n").to_numpy().sum())
            if n < least:
                continue
            points = np.stack([group.column("lon").to_numpy(), group.column("lat").to_numpy()], axis=1)
            ring = convex_hull(points)
            if n >= bent and len(ring) > 2:
                ring = dug(ring, points, share)
                wide = widened(ring, buffer)
            else:
                wide = convex_hull((ring[:, None, :] + circle[None, :, :]).reshape(-1, 2))
            text = "[[" + ",".join(f"[{x:.6f},{y:.6f}]" for x, y in [*wide, wide[0]]) + "]]"
            yield pa.RecordBatch.from_pydict(
                {"entity": [group.column("entity")[0].as_py()], "cluster": [group.column("cluster")[0].as_py()], "sites": [n], "corners": [len(ring)], "area": [area(ring) if len(ring) > 2 else 0.0], "geometry": ['{"type":"Polygon","coordinates":' + text + "}"],
                 "west": [wide[:, 0].min()], "south": [wide[:, 1].min()], "east": [wide[:, 0].max()], "north": [wide[:, 1].max()]}
            )

    places = found.groupBy("entity", "cluster", "lon", "lat").agg(F.count("*").alias("n"))
    spread = places.repartition("entity", "cluster").sortWithinPartitions("entity", "cluster", "lon", "lat")
    return spread.mapInArrow(run, "entity string, cluster string, sites bigint, corners bigint, area double, geometry string, west double, south double, east double, north double")


def territories(rows: DataFrame, radius: float = RADIUS) -> DataFrame:
    """The ``outlines`` of (qid, name, rank, id, lon, lat) by (qid, name, cluster), with the least rank as ``top_rank``. All sites of a QID
    cluster together; its names are told apart only after, so sites of one name may be joined through one of another."""
    found = clusters(rows.withColumnRenamed("qid", "entity"), radius).withColumnRenamed("entity", "qid").select("qid", "id", "cluster").distinct()
    named = rows.join(found, ["qid", "id"]).withColumn("entity", F.to_json(F.struct("qid", "name")))
    top = named.groupBy("entity", "cluster").agg(F.min("rank").alias("top_rank"))
    shapes = outlines(named.select("entity", "cluster", "id", "lon", "lat").distinct()).join(top, ["entity", "cluster"])
    return shapes.withColumn("e", F.from_json("entity", "qid string, name string")).select("e.qid", "e.name", *[c for c in shapes.columns if c != "entity"])


def under(shapes: DataFrame, lon: float, lat: float) -> DataFrame:
    """The shapes whose box holds a place."""
    return shapes.filter(F.lit(lon).between(F.col("west"), F.col("east")) & F.lit(lat).between(F.col("south"), F.col("north")))


def concave(found: DataFrame, share: float = 0.75, least: int = 5) -> DataFrame:
    """(entity, cluster, area, geometry): an outline without buffer that follows the sites closer than the hull, of clusters with
    enough sites. Inner sites count here, so a cluster's different places meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, ["entity", "cluster"]):
            points = np.unique(np.stack([group.column("lon").to_numpy(), group.column("lat").to_numpy()], axis=1), axis=0)
            hull = convex_hull(points)
            if len(points) < least or len(hull) < 3:
                continue
            ring = dug(hull, points, share)
            text = "[[" + ",".join(f"[{x:.6f},{y:.6f}]" for x, y in [*ring, ring[0]]) + "]]"
            yield pa.RecordBatch.from_pydict({"entity": [group.column("entity")[0].as_py()], "cluster": [group.column("cluster")[0].as_py()], "area": [area(ring)], "geometry": ['{"type":"Polygon","coordinates":' + text + "}"]})

    spread = found.select("entity", "cluster", "lon", "lat").distinct().repartition("entity", "cluster").sortWithinPartitions("entity", "cluster")
    return spread.mapInArrow(run, "entity string, cluster string, area double, geometry string")

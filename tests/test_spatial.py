import math
import random

import numpy as np
from pyspark.sql import functions as F

from epochgrid.operators.spatial import EARTH_KM, LocalTree, Sweep, box_edges, great_circle_km, in_regions, located, near_pairs, unit_vectors


def brute(points, km):
    ids = sorted(points)
    out = set()
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if great_circle_km(*points[a], *points[b]) <= km:
                out.add((a, b))
    return out


def test_near(spark):
    random.seed(4)
    points = {f"p{i:04}": (random.uniform(9, 9.3), random.uniform(50, 50.3)) for i in range(500)}
    points |= {f"pole{i}": (random.uniform(-180, 180), 90 - random.random() * 0.01) for i in range(30)}
    points |= {f"line{i}": (random.choice([-1, 1]) * (180 - random.random() * 0.01), random.uniform(0, 0.05)) for i in range(40)}
    points |= {f"same{i:03}": (1.5, 2.5) for i in range(120)}  # a place that can't be cut
    rows = [(k, *v, "x") for k, v in points.items()] * 2
    rows += [(None, 9.1, 50.1, "x"), ("null", None, 50.0, "x"), ("nan", float("nan"), 50.0, "x"), ("zero", 0.0, 0.0, "x"), ("off", 181.0, 3.0, "x"), ("low", 9.0, -91.0, "x")]
    df = spark.createDataFrame(rows, "id string, lon double, lat double, key_a string")
    for cell in (20, 40_000):
        got = near_pairs(df, "id", "lon", "lat", 0.7, cell=cell).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(points, 0.7)
    assert near_pairs(df.limit(0), "id", "lon", "lat", 1.0).collect() == []
    assert near_pairs(df.filter("id = 'zero'"), "id", "lon", "lat", 1.0).collect() == []


def test_local_tree_at_the_edge():
    random.seed(1)
    km = 3.0
    lon = np.array([random.uniform(0, 0.3) for _ in range(300)])
    lat = np.array([random.uniform(0, 0.3) for _ in range(300)])
    tree = LocalTree(unit_vectors(lon, lat))
    got = {(min(a, b), max(a, b)) for i, j in tree.pairs(2 * math.sin(km / EARTH_KM / 2) * (1 + 1e-9)) for a, b in zip(i.tolist(), j.tolist())}
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if great_circle_km(lon[i], lat[i], lon[j], lat[j]) <= km}
    assert want <= got and len(got - want) < 3
    assert [len(list(LocalTree(unit_vectors(lon[:n], lat[:n])).pairs(1))) for n in (1, 2)] == [1, 1]


def inside(x, y, ring):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if min(x1, x2) <= x < max(x1, x2) and y1 + (y2 - y1) * (x - x1) / (x2 - x1) <= y:
            odd = not odd
    return odd


def test_regions(spark):
    random.seed(3)
    rings = {"kite": [(0, 0), (4, 3), (1, 9), (-5, 2)], "dent": [(6, 0), (12, 0), (12, 8), (9, 2), (6, 8)], "over": [(-2, -2), (11, -1), (10, 6)]}
    points = [(f"{i}", random.uniform(-6, 13), random.uniform(-3, 10)) for i in range(800)]
    edges = [(k, *map(float, (*a, *b))) for k, r in rings.items() for a, b in zip(r, r[1:] + r[:1])]
    # edges may cross those of other regions, so each region is swept by itself here
    p = spark.createDataFrame(points, "key string, lon double, lat double")
    for name, ring in rings.items():
        e = spark.createDataFrame([x for x in edges if x[0] == name], "region string, x1 double, y1 double, x2 double, y2 double")
        want = {(i, name) for i, x, y in points if inside(x, y, ring)}
        for most in (100, 0):
            got = in_regions(p, e, most=most).collect()
            assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_boxes_are_half_open(spark):
    boxes = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 0.0), ("c", 0.0, 1.0)], "r string, x double, y double")
    c = F.col
    edges = box_edges(boxes, c("r"), c("x"), c("y"), c("x") + 1, c("y") + 1)
    points = [("1", 0.0, 0.0), ("2", 1.0, 0.0), ("3", 1.0, 1.0), ("4", 0.5, 1.0), ("5", 0.999, 0.999), ("6", 2.0, 0.5), ("7", -0.1, 0.5), (None, 0.5, 0.5)]
    p = spark.createDataFrame(points, "key string, lon double, lat double")
    for most in (100, 0):
        got = {tuple(r) for r in in_regions(p, edges, most=most).collect()}
        assert got == {("1", "a"), ("2", "b"), ("4", "c"), ("5", "a"), (None, "a")}
    assert in_regions(p, edges.limit(0)).collect() == [] and located(p.limit(0), "key", "lon", "lat").count() == 0
    assert Sweep(*(np.zeros(0) for _ in range(5))).containing(np.array([1.0]), np.array([1.0]))[0].size == 0


def test_a_sweep_grows_with_its_edges():
    random.seed(4)
    rng = np.random.default_rng(4)
    n = 50_000  # polygons of four edges, up to five degrees wide
    x, y = rng.uniform(-180, 175, n), rng.uniform(-90, 85, n)
    w, h = rng.uniform(0.1, 5, n), rng.uniform(0.1, 5, n)
    ring = np.stack([np.stack([x, y], 1), np.stack([x + w, y + h / 3], 1), np.stack([x + w / 2, y + h], 1), np.stack([x + w / 9, y + h / 2], 1)], 1)
    to = np.roll(ring, -1, axis=1)
    sweep = Sweep(np.repeat(np.arange(n), 4), ring[:, :, 0].ravel(), ring[:, :, 1].ravel(), to[:, :, 0].ravel(), to[:, :, 1].ravel())
    assert len(sweep.edge) <= 8 * 4 * n
    px, py = rng.uniform(-180, 180, 3000), rng.uniform(-90, 90, 3000)
    got = set(zip(*(a.tolist() for a in sweep.containing(px, py))))
    assert sweep.held <= sweep.KEPT
    for k in range(0, 3000, 60):  # crossings of a ray to the south
        a, b = ring[:, :, 0] <= px[k], to[:, :, 0] <= px[k]
        with np.errstate(divide="ignore", invalid="ignore"):
            at = ring[:, :, 1] + (px[k] - ring[:, :, 0]) * (to[:, :, 1] - ring[:, :, 1]) / (to[:, :, 0] - ring[:, :, 0])
        inside = np.flatnonzero(((a != b) & (at <= py[k])).sum(1) % 2)
        assert {r for p, r in got if p == k} == set(inside.tolist())

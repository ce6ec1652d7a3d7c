import math

import numpy as np
import pytest

from cindral.operators.regions import containing, points_in_regions, points_near_points, unwrapped

R = 6_371_008.8
SCHEMA = "site long, lon double, lat double, radius_m double, ring_lon array<double>, ring_lat array<double>"


def gc(x1, y1, x2, y2):
    p, q = math.radians(y1), math.radians(y2)
    a = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * R * math.asin(min(1.0, math.sqrt(a)))


def inside(x, y, xs, ys):
    ring = unwrapped(xs, ys)
    if ring is None:
        return False
    xs, ys = ring
    x = x + 360 * math.ceil((xs.min() - x) / 360)
    odd = False
    for i in range(len(xs) - 1):
        if (ys[i] > y) != (ys[i + 1] > y) and x < xs[i] + (xs[i + 1] - xs[i]) * (y - ys[i]) / (ys[i + 1] - ys[i]):
            odd = not odd
    return odd


def brute(points, sites):
    out = set()
    for k, x, y in points:
        if k is None or x is None or y is None:
            continue
        for s, lon, lat, r, xs, ys in sites:
            if s is None:
                continue
            if xs is not None:
                if inside(x, y, xs, ys):
                    out.add((s, k))
            elif r is not None and r >= 0 and lon is not None and gc(lon, lat, x, y) <= r:
                out.add((s, k))
    return out


def data(seed=3):
    g = np.random.default_rng(seed)
    points = [(i, float(g.uniform(-180, 180)), float(g.uniform(-90, 90))) for i in range(300)]
    points += [(1000 + i, float(179.9 + g.uniform(-0.3, 0.3) if i % 2 else -179.9 + g.uniform(-0.3, 0.3)), float(51 + g.uniform(-0.3, 0.3))) for i in range(200)]
    points = [(k, (x + 540) % 360 - 180, y) for k, x, y in points]
    points += [(2000 + i, float(g.uniform(-111, -109)), float(g.uniform(39, 41))) for i in range(400)]
    points += [(3000, 0.0, 90.0), (3001, 45.0, 89.99), (3002, None, 1.0), (3003, 1.0, None), (None, 1.0, 1.0), (2000, points[-400][1], points[-400][2])]
    sites = [(1, 180.0, 51.0, 20_000.0, None, None), (2, -179.95, 51.05, 5000.0, None, None), (3, 0.0, 89.9, 30_000.0, None, None), (4, None, None, None, [-110.5, -109.5, -109.5, -110.0, -110.5], [39.5, 39.5, 40.5, 39.8, 40.5])]
    sites += [(5, None, None, None, [179.8, -179.8, -179.8, 179.8], [50.9, 50.9, 51.1, 51.1]), (6, None, None, None, [179.8, 180.2, 180.2, 179.8, 179.8], [50.9, 50.9, 51.1, 51.1, 50.9]), (7, 0.0, 0.0, None, None, None), (8, -110.0, 40.0, -1.0, None, None)]
    sites += [(9, None, None, None, [1.0, 2.0], [1.0, 2.0]), (10, -110.0, 40.0, 0.0, None, None), (None, -110.0, 40.0, 1e5, None, None), (11, -110.0, 40.0, 60_000.0, None, None)]
    return points, sites


@pytest.mark.parametrize("broadcast", [10**9, 0])
def test_against_brute_force(spark, broadcast):
    points, sites = data()
    p = spark.createDataFrame(points, "k long, lon double, lat double").selectExpr("k", "lon", "lat", "'x' site", "1 lo")
    s = spark.createDataFrame(sites, SCHEMA)
    got = [tuple(r) for r in points_in_regions(p, s, "k", "site", broadcast_bytes=broadcast).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(points, sites) and len(got) > 200


def test_empty_and_containing(spark):
    p = spark.createDataFrame([(1, -110.0, 40.0), (2, 10.0, 10.0)], "k long, lon double, lat double")
    s = spark.createDataFrame([(7, -110.0, 40.0, 10.0, None, None)], SCHEMA)
    assert points_in_regions(p.limit(0), s, "k", "site").count() == 0
    assert points_in_regions(p, s.limit(0), "k", "site").count() == 0
    assert {r["k"]: r["regions"] for r in containing(p, s, "k", "site").collect()} == {1: [7], 2: []}


def test_near_points(spark):
    g = np.random.default_rng(1)
    a = [(i, float(g.uniform(-1, 1)), float(g.uniform(-1, 1))) for i in range(150)]
    b = [(i, float(g.uniform(-1, 1)), float(g.uniform(-1, 1))) for i in range(80)]
    got = points_near_points(spark.createDataFrame(a, "k long, lon double, lat double"), spark.createDataFrame(b, "o long, lon double, lat double"), "k", "o", 9000.0)
    want = {(o, k) for k, x, y in a for o, u, v in b if gc(x, y, u, v) <= 9000.0}
    assert {tuple(r) for r in got.collect()} == want and want

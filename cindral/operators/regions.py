"""Points near other points or inside regions (problem 4).

Every region (a disc or a polygon) is covered by quadtree cells, which are ranges of Z-order codes; points get their own code, and a
range join on the codes gives candidates, which are then refined exactly. Ranges are cut at a coarse prefix of the code, so that the
range join is an equi-join on the prefix with a comparison of codes beside it: no cross join, and AQE can split a hot prefix.

Nulls and odd input: points without position, regions without radius or ring (or with a negative radius or under three corners) and
regions without a key give no rows; repeated points and regions count once; an empty table gives an empty result. Rings may be open
or closed, of either direction, not convex, and may cross longitude 180 (either as a jump or with longitudes beyond 180). A point
exactly on an edge of a polygon may fall on either side; a point exactly radius_m away is inside.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindral.functions.sphere import EARTH_M, great_circle_m, morton
from cindral.session import BROADCAST_BYTES, cut

LEVEL = 18  # cells of 0.0014 by 0.0007 degrees
PREFIX = 9  # ranges are cut at cells of 0.7 by 0.35 degrees


def unwrapped(ring_lon, ring_lat) -> tuple[np.ndarray, np.ndarray] | None:
    """Closed ring with continuous longitudes; None if it has no area to test."""
    if ring_lon is None or ring_lat is None or len(ring_lon) != len(ring_lat):
        return None
    x, y = np.asarray(ring_lon, float), np.asarray(ring_lat, float)
    if len(x) < 3 or not (np.isfinite(x).all() and np.isfinite(y).all()):
        return None
    x = x[0] + np.concatenate([[0.0], np.cumsum((np.diff(x) + 180.0) % 360.0 - 180.0)])
    if x[0] != x[-1] or y[0] != y[-1]:
        x, y = np.append(x, x[0]), np.append(y, y[0])
    return (x, y) if len(x) >= 4 else None


def _spread_bits(v: int) -> int:
    out = 0
    for i in range(v.bit_length()):
        out |= (v >> i & 1) << (2 * i)
    return out


def _cover(boxes: list[tuple[float, float, float, float]], level: int, most: int) -> list[tuple[int, int]]:
    """Code ranges (inclusive) of at most about `most` cells that cover the boxes (lon in -180..180)."""
    todo, done = [(0, 0, 0)], []  # depth, column, row
    while todo:
        if len(todo) + len(done) > most:
            break
        split = []
        for depth, cx, cy in todo:
            w, h = 360.0 / (1 << depth), 180.0 / (1 << depth)
            x0, y0 = cx * w - 180.0, cy * h - 90.0
            if not any(x0 <= b[2] and x0 + w >= b[0] and y0 <= b[3] and y0 + h >= b[1] for b in boxes):
                continue
            inside = any(x0 >= b[0] and x0 + w <= b[2] and y0 >= b[1] and y0 + h <= b[3] for b in boxes)
            if inside or depth == level:
                done.append((depth, cx, cy))
            else:
                split += [(depth + 1, 2 * cx + i, 2 * cy + j) for i in (0, 1) for j in (0, 1)]
        todo = split
    for depth, cx, cy in todo:
        w, h = 360.0 / (1 << depth), 180.0 / (1 << depth)
        x0, y0 = cx * w - 180.0, cy * h - 90.0
        if any(x0 <= b[2] and x0 + w >= b[0] and y0 <= b[3] and y0 + h >= b[1] for b in boxes):
            done.append((depth, cx, cy))
    ranges = []
    for depth, cx, cy in done:
        shift = 2 * (level - depth)
        code = (_spread_bits(cx) | _spread_bits(cy) << 1) << shift
        ranges.append((code, code + (1 << shift) - 1))
    ranges.sort()
    merged: list[list[int]] = []
    for lo, hi in ranges:
        if merged and lo <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    return [(a, b) for a, b in merged]


def _wrapped(lo: float, hi: float) -> list[tuple[float, float]]:
    """A longitude interval as one or two intervals in -180..180."""
    if hi - lo >= 360.0:
        return [(-180.0, 180.0)]
    k = math.floor((lo + 180.0) / 360.0) * 360.0
    lo, hi = lo - k, hi - k
    return [(lo, hi)] if hi <= 180.0 else [(lo, 180.0), (-180.0, hi - 360.0)]


def region_boxes(lon, lat, radius_m, ring_lon, ring_lat) -> list[tuple[float, float, float, float]]:
    """Bounding boxes of a disc (ring missing) or polygon; empty if the region cannot hold a point."""
    if ring_lon is not None or ring_lat is not None:
        ring = unwrapped(ring_lon, ring_lat)
        if ring is None:
            return []
        return [(a, ring[1].min(), b, ring[1].max()) for a, b in _wrapped(ring[0].min(), ring[0].max())]
    if radius_m is None or lon is None or lat is None or not (radius_m >= 0 and math.isfinite(lon) and math.isfinite(lat)):
        return []
    d = radius_m / EARTH_M * (1 + 1e-9) + 1e-12
    dd = math.degrees(d)
    south, north = max(-90.0, lat - dd), min(90.0, lat + dd)
    if lat + dd >= 90.0 or lat - dd <= -90.0:
        return [(-180.0, south, 180.0, north)]
    span = math.degrees(math.asin(min(1.0, math.sin(d) / math.cos(math.radians(lat)))))
    return [(a, south, b, north) for a, b in _wrapped(lon - span, lon + span)]


def cover_ranges(regions: DataFrame, key: str, level: int = LEVEL, prefix: int = PREFIX, most: int = 64) -> DataFrame:
    """(key, prefix, lo, hi) of each region; regions has key, lon, lat, radius_m, ring_lon, ring_lat."""
    shift = 2 * (level - prefix)
    kind = dict(regions.dtypes)[key]

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for k, lon, lat, r, xs, ys in zip(b["key"], b["lon"], b["lat"], b["radius_m"], b["ring_lon"], b["ring_lat"]):
                number = lambda v: None if v is None or v != v else float(v)
                boxes = region_boxes(number(lon), number(lat), number(r), xs, ys)
                for lo, hi in _cover(boxes, level, most) if boxes else []:
                    out += [(k, p, max(lo, p << shift), min(hi, (p + 1 << shift) - 1)) for p in range(lo >> shift, (hi >> shift) + 1)]
            yield pd.DataFrame(out, columns=["key", "prefix", "lo", "hi"])

    src = regions.select(F.col(key).alias("key"), *(F.col(c) for c in ("lon", "lat", "radius_m", "ring_lon", "ring_lat")))
    return src.mapInPandas(run, f"key {kind}, prefix long, lo long, hi long").withColumnRenamed("key", key)


def shapes(regions: DataFrame, key: str) -> DataFrame:
    """One row for each usable region: key, centre, radius, and for polygons west and the edges (x1, y1, y2, slope)."""
    kind = dict(regions.dtypes)[key]

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for k, xs, ys in zip(b["key"], b["ring_lon"], b["ring_lat"]):
                ring = unwrapped(xs, ys)
                if ring is None:
                    out.append((k, None, None))
                    continue
                x, y = ring
                out.append((k, float(x.min()), [{"x": float(x[i]), "y": float(y[i]), "y2": float(y[i + 1]), "m": float((x[i + 1] - x[i]) / (y[i + 1] - y[i]))} for i in range(len(x) - 1) if y[i] != y[i + 1]]))
            yield pd.DataFrame(out, columns=["key", "west", "edges"])

    src = regions.select(F.col(key).alias("key"), "ring_lon", "ring_lat")
    rings = src.mapInPandas(run, f"key {kind}, west double, edges array<struct<x:double,y:double,y2:double,m:double>>").withColumnRenamed("key", key)
    return regions.select(key, F.col("lon").alias("_clon"), F.col("lat").alias("_clat"), F.col("radius_m").alias("_r")).join(rings, key)


def points_in_regions(points: DataFrame, regions: DataFrame, point_key: str, region_key: str, lon: str = "lon", lat: str = "lat", level: int = LEVEL, prefix: int = PREFIX, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(region_key, point_key) of every point in a region, once each.

    points: point_key, lon, lat. regions: region_key, lon, lat, radius_m, ring_lon, ring_lat (ring null: a disc). The ranges are
    counted; up to broadcast_bytes they are broadcast, so points are not shuffled before they are found, beyond it both sides are
    shuffled by code prefix and AQE splits hot prefixes.
    """
    regions = regions.select(region_key, "lon", "lat", "radius_m", "ring_lon", "ring_lat").where(F.col(region_key).isNotNull()).dropDuplicates([region_key])
    ranges, shape = cut(cover_ranges(regions, region_key, level, prefix)), cut(shapes(regions, region_key))
    n = ranges.count()
    corners = shape.agg(F.sum(64 + 32 * F.coalesce(F.size("edges"), F.lit(0)))).first()[0] or 0
    if n * 40 <= broadcast_bytes:
        ranges = F.broadcast(ranges)
    if corners <= broadcast_bytes:
        shape = F.broadcast(shape)
    p = points.select(F.col(point_key), F.col(lon).cast("double").alias("_lon"), F.col(lat).cast("double").alias("_lat")).where(
        F.col(point_key).isNotNull() & F.col("_lon").between(-360.0, 360.0) & F.col("_lat").between(-90.0, 90.0) & ~F.isnan("_lon") & ~F.isnan("_lat")
    )
    p = p.withColumn("_code", morton(F.col("_lon"), F.col("_lat"), level)).withColumn("prefix", F.shiftright(F.col("_code"), 2 * (level - prefix)))
    near = p.join(ranges, "prefix").where(F.col("_code").between(F.col("lo"), F.col("hi"))).select(point_key, region_key, "_lon", "_lat")
    x = F.col("_lon") + 360.0 * F.ceil((F.col("west") - F.col("_lon")) / 360.0)
    crossings = F.size(F.filter("edges", lambda e: ((e["y"] > F.col("_lat")) != (e["y2"] > F.col("_lat"))) & (F.col("_x") < e["x"] + e["m"] * (F.col("_lat") - e["y"]))))
    inside = F.when(F.col("edges").isNotNull(), crossings % 2 == 1).otherwise(great_circle_m(F.col("_lon"), F.col("_lat"), F.col("_clon"), F.col("_clat")) <= F.col("_r"))
    return near.join(shape, region_key).withColumn("_x", x).where(inside).select(region_key, point_key).distinct()


def points_near_points(points: DataFrame, others: DataFrame, point_key: str, other_key: str, radius_m: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(other_key, point_key) of all pairs at most radius_m apart: the others are discs of radius_m."""
    none = F.lit(None).cast("array<double>")
    discs = others.select(other_key, F.col(lon).alias("lon"), F.col(lat).alias("lat"), F.lit(float(radius_m)).alias("radius_m"), none.alias("ring_lon"), none.alias("ring_lat"))
    return points_in_regions(points, discs, point_key, other_key, lon, lat)


def containing(points: DataFrame, regions: DataFrame, point_key: str, region_key: str, **kw) -> DataFrame:
    """Every point with the sorted array of the regions it lies in, empty if none."""
    found = points_in_regions(points, regions, point_key, region_key, **kw)
    return points.join(found.groupBy(point_key).agg(F.sort_array(F.collect_set(region_key)).alias("regions")), point_key, "left").withColumn("regions", F.coalesce("regions", F.array().cast(f"array<{dict(regions.dtypes)[region_key]}>")))


__all__ = ["containing", "cover_ranges", "points_in_regions", "points_near_points", "shapes", "unwrapped"]

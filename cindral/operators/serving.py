"""Served event records: hull, footprint, power statistics, ordering and filters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cindral.functions.fireweather import risk_class, spread_risk_score

# Region windows (west, south, east, north), metres to a degree of longitude (at the equator) and latitude.
REGIONS = {"california": (-124.6, 32.0, -114.0, 42.3), "us_west": (-125.0, 31.0, -102.0, 49.2), "conus": (-125.0, 24.0, -66.5, 49.0), "canada": (-141.0, 49.0, -52.0, 83.5), "europe": (-25.0, 34.0, 45.0, 72.0)}
M_LON, M_LAT = 111_320.0, 110_540.0


def region_window(det: DataFrame, region: str, days: float = 7.0) -> DataFrame:
    """Rows in a region's box (closed) in the last days before the newest row of the data."""
    w, s, e, n = REGIONS[region]
    newest = F.broadcast(det.agg(F.max("t").alias("_new")))
    return det.where(F.col("lon").between(w, e) & F.col("lat").between(s, n)).crossJoin(newest).where(F.unix_micros("t") >= F.unix_micros("_new") - int(days * 86_400e6)).drop("_new")


def strongest(det: DataFrame, n: int = 5000, value: str = "frp_mw", key: str = "det_id") -> DataFrame:
    """The n strongest points (no power counts as 0)."""
    return det.orderBy(F.desc(F.coalesce(F.col(value), F.lit(0.0))), key).limit(n)


def extreme_points(det: DataFrame, keys: list[str], directions: int = 64, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(keys, ring): convex ring of the points of each group that are outermost in `directions` directions.

    Outermost points by direction are plain aggregates, so a group of any size reaches one task as at most that many points; with at most
    that many hull corners in different directions the ring is the convex hull. Groups of fewer than three places have no ring.
    """
    angles = [2 * math.pi * i / directions for i in range(directions)]
    d = det.where(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    p = F.struct(F.col(lon).cast("double").alias("x"), F.col(lat).cast("double").alias("y"))
    far = [F.max_by(p, F.struct((F.col(lon) * math.cos(a) + F.col(lat) * math.sin(a)).alias("d"), F.col(lon), F.col(lat))).alias(f"_p{i}") for i, a in enumerate(angles)]
    g = d.groupBy(*keys).agg(*far)
    ring = F.filter(F.array(*(F.col(f"_p{i}") for i in range(directions))), lambda v: v.isNotNull())
    uniq = F.array_distinct(ring)  # in order of direction, so already around the hull
    closed = F.concat(uniq, F.slice(uniq, 1, 1))
    return g.select(*keys, F.when(F.size(uniq) >= 3, F.transform(closed, lambda q: F.array(F.round(q["x"], 4), F.round(q["y"], 4)))).alias("ring"))


def hull(det: DataFrame, keys: list[str], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(keys, ring): exact convex hull, closed. Distinct points are first thinned to the lowest and highest of each longitude (the only ones that can be corners), then sorted and turned in one Python call per group."""
    d = det.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).groupBy(*keys, F.col(lon).cast("double").alias("x")).agg(F.min(F.col(lat).cast("double")).alias("lo"), F.max(F.col(lat).cast("double")).alias("hi"))
    g = d.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("x", "lo", "hi"))).alias("c"))
    kinds = ", ".join(f"`{k}` {dict(det.dtypes)[k]}" for k in keys)

    def half(points):
        out = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    def run(batches):
        import pandas as pd

        for b in batches:
            rings = []
            for c in b["c"]:
                low = half([(r["x"], r["lo"]) for r in c] if len(c) > 1 else [])
                top = half([(r["x"], r["hi"]) for r in reversed(list(c))] if len(c) > 1 else [])
                both = low + top
                ring = [p for i, p in enumerate(both) if i == 0 or p != both[i - 1]]
                ring = ring + [ring[0]] if ring and ring[0] != ring[-1] else ring
                rings.append([list(p) for p in ring] if len(ring) >= 4 else None)
            yield pd.DataFrame({**{k: b[k] for k in keys}, "ring": rings})

    return g.mapInPandas(run, f"{kinds}, ring array<array<double>>")


def area_perimeter(ring: Column, lat0: Column) -> tuple[Column, Column]:
    """Area (ha) and perimeter (km) of a closed ring in a plane around lat0."""
    kx = M_LON * F.cos(F.radians(lat0))
    first = F.get(ring, F.lit(0))
    xy = F.transform(ring, lambda p: F.struct(((p[0] - first[0]) * kx).alias("x"), ((p[1] - first[1]) * M_LAT).alias("y")))
    n = F.size(xy)
    legs = F.arrays_zip(F.slice(xy, 1, n - 1).alias("a"), F.slice(xy, 2, n - 1).alias("b"))
    area = F.aggregate(legs, F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    length = F.aggregate(legs, F.lit(0.0), lambda s, e: s + F.sqrt(F.pow(e["b"]["x"] - e["a"]["x"], F.lit(2.0)) + F.pow(e["b"]["y"] - e["a"]["y"], F.lit(2.0))))
    return F.abs(area) / 2 / 10_000.0, length / 1000.0


def event_records(det: DataFrame, event: str = "root", least: int = 4) -> DataFrame:
    """Records of the events with at least `least` detections and an area: hull, centroid, footprint, power, times, sensors; numbered by strongest power."""
    if "sensor" not in det.columns:
        det = det.withColumn("sensor", F.lit("goes"))
    g = det.groupBy(event).agg(
        F.count("*").alias("n_detections"), F.avg("lon").alias("clon"), F.avg("lat").alias("clat"), F.sum(F.col("frp_mw").cast("double")).alias("frp_total"), F.max(F.col("frp_mw").cast("double")).alias("frp_max"), F.avg(F.col("frp_mw").cast("double")).alias("frp_mean"),
        F.min("t").alias("first_seen"), F.max("t").alias("last_seen"), F.array_join(F.sort_array(F.collect_set(F.lower("sensor"))), ",").alias("sensors"), F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"),
    ).where(F.col("n_detections") >= least)
    r = hull(det.join(g.select(event), event, "left_semi"), [event]).where("ring IS NOT NULL")
    a, p = area_perimeter(F.col("ring"), F.col("clat"))
    e = g.join(r, event).withColumn("footprint_ha", F.bround(a, 1)).withColumn("perimeter_km", F.bround(p, 2))
    return numbered(e, event)


def numbered(events: DataFrame, key: str, blocks: int = 256) -> DataFrame:
    """Adds event_id 1.. by strongest power (then key). Events are ranked within ranges of power and offset by the ranges' counts, so no task holds them all."""
    power = F.coalesce(F.col("frp_max"), F.lit(-1.0))
    cuts = F.broadcast(events.agg(F.percentile_approx(power, [i / blocks for i in range(1, blocks)], 10_000).alias("_cuts")))
    d = events.crossJoin(cuts).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < power))).drop("_cuts")
    n = d.groupBy("_b").count()
    off = F.broadcast(n.withColumn("_off", F.coalesce(F.sum("count").over(W.orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count"))
    return d.join(off, "_b").withColumn("event_id", F.row_number().over(W.partitionBy("_b").orderBy(F.desc(power), key)) + F.col("_off")).drop("_b", "_off")


def unioned(*frames: DataFrame) -> DataFrame:
    """All rows of frames with different columns; a confidence of mixed types becomes text."""
    mixed = len({dict(f.dtypes).get("confidence") for f in frames if "confidence" in f.columns}) > 1
    out = None
    for f in frames:
        f = f.withColumn("confidence", F.col("confidence").cast("string")) if mixed and "confidence" in f.columns else f
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def state_mode(newest: Column, now: Column, frozen: bool = False, stale_hours: float = 24.0) -> Column:
    """What a served state is: `sample` if it was frozen, `stale` if its newest detection is older than stale_hours, else `live` (also without any)."""
    if frozen:
        return F.lit("sample")
    age = (F.unix_micros(now) - F.unix_micros(newest)) / 3.6e9
    return F.when(age > stale_hours, "stale").otherwise("live")


def with_weather(events: DataFrame, weather: DataFrame, key: str = "event_id") -> DataFrame:
    """events with temp_c, rh_pct, wind_ms and the risk of spread (score and class); events without a reading have nulls. weather: key, temp_c, rh_pct, wind_ms, one row an event."""
    w = weather.select(key, *(F.col(c).cast("double").alias(c) for c in ("temp_c", "rh_pct", "wind_ms")), F.lit(True).alias("_got"))
    score = spread_risk_score("temp_c", "rh_pct", "wind_ms")
    d = events.join(w, key, "left").withColumn("risk_score", F.when(F.col("_got"), score))
    return d.withColumn("risk_class", F.when(F.col("_got"), risk_class("risk_score"))).drop("_got")


def snapshot(frames: list[DataFrame], path: str, weather: DataFrame | None = None, least_detections: int = 1, max_gap_s: float = 12 * 3600.0, extra_m: float = 2000.0) -> DataFrame | None:
    """Publishes a state: path/detections (all sensors in one table) and path/events (records as JSON lines); the event records, or None with
    nothing written if there are fewer than least_detections.

    frames: detections with det_id, t, x, y, lon, lat, frp_mw, sensor, tolerance_m. Detections are clustered across sensors at once.
    """
    from cindral.operators.linking import clustered
    from cindral.session import cut

    d = cut(unioned(*frames))
    if d.limit(least_detections).count() < least_detections:
        return None
    e = event_records(clustered(d, max_gap_s=max_gap_s, extra_m=extra_m))
    e = cut(with_weather(e, weather) if weather is not None else e)
    d.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/detections")
    e.write.mode("overwrite").json(f"{path}/events")
    return e


def published(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(detections, events) of a snapshot; the events' times are timestamps again. Reading runs no code from the files."""
    e = spark.read.json(f"{path}/events")
    for c in ("first_seen", "last_seen"):
        e = e.withColumn(c, F.col(c).cast("timestamp")) if c in e.columns else e
    return spark.read.parquet(f"{path}/detections"), e

"""Matching records by nearest time (problem 1).

Both tables are put into cells of place and buckets of the tolerance's width in time; a query record looks into its own and the
adjacent buckets of all cells that its radius touches (an equi-join), the pairs are filtered by exact distance and time difference, and
the smallest difference is kept, among equal ones the smallest key. Records at one place and time are one on either side of the join
(the smallest key stands for them, it wins every tie), so copies do not multiply the pairs.

Nulls and odd input: records without key, time or position, or with a position outside the globe, match nothing and give no row; both
limits are included; repeated rows count once; a query without partner gives no row; other columns are not touched, so clashing names
do no harm; an empty table gives an empty result. Longitudes may use either convention, and places may straddle longitude 180 or a pole.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindral.functions.sphere import EARTH_M, cell_of, cells_within, great_circle_m


def _placed(df: DataFrame, key: str, time: str, lon: str, lat: str, p: str) -> DataFrame:
    """One row for each place and time: the smallest key, microseconds, position in -180..180."""
    x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    df = df.select(F.col(key).alias(f"{p}key"), F.unix_micros(F.col(time).cast("timestamp")).alias(f"{p}t"), x.alias(f"{p}x"), y.alias(f"{p}y"))
    ok = F.col(f"{p}key").isNotNull() & F.col(f"{p}t").isNotNull() & F.col(f"{p}x").between(-360.0, 360.0) & F.col(f"{p}y").between(-90.0, 90.0)
    return df.where(ok)


def nearest_in_time(queries: DataFrame, records: DataFrame, query_key: str, record_key: str, tolerance_s: float, radius_m: float, query_time: str = "t", record_time: str = "t", query_lon: str = "lon", query_lat: str = "lat", record_lon: str = "lon", record_lat: str = "lat") -> DataFrame:
    """(query_key, record_key, gap_us) for each query record with a partner within radius_m and tolerance_s."""
    height = math.degrees(2 * radius_m / EARTH_M) * (1 + 1e-6)
    width = max(1, int(round(tolerance_s * 1e6)))
    r = _placed(records, record_key, record_time, record_lon, record_lat, "r_").groupBy("r_t", "r_x", "r_y").agg(F.min("r_key").alias("r_key"))
    r = r.withColumn("cell", cell_of(F.col("r_x"), F.col("r_y"), height)).withColumn("bucket", F.floor(F.col("r_t") / width))
    q = _placed(queries, query_key, query_time, query_lon, query_lat, "q_")
    places = q.select("q_t", "q_x", "q_y").distinct()
    b = F.floor(F.col("q_t") / width)
    places = places.withColumn("cell", F.explode(cells_within(F.col("q_x"), F.col("q_y"), radius_m, height))).withColumn("bucket", F.explode(F.sequence(b - 1, b + 1)))
    gap = F.abs(F.col("q_t") - F.col("r_t"))
    near = r.join(places, ["cell", "bucket"]).where((gap <= width) & (great_circle_m(F.col("q_x"), F.col("q_y"), F.col("r_x"), F.col("r_y")) <= radius_m))
    best = near.groupBy("q_t", "q_x", "q_y").agg(F.min(F.struct(gap.alias("gap"), F.col("r_key").alias("key"))).alias("best"))
    found = q.select("q_key", "q_t", "q_x", "q_y").join(best, ["q_t", "q_x", "q_y"])
    # A query key given with several places or times counts once, with its best partner.
    found = found.groupBy("q_key").agg(F.min("best").alias("best"))
    return found.select(F.col("q_key").alias(query_key), F.col("best.key").alias(record_key), F.col("best.gap").alias("gap_us"))

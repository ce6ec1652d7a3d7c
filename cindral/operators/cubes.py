"""Brightness cubes in long form (t, row, col, ...): assembly on one grid, differences, covariates, blocks of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindral.functions.geometry import solar_position
from cindral.operators.ordered import running_sums
from cindral.session import checked, cut


def bt_difference(a: Column, b: Column) -> Column:
    """Difference of two channels; null where either is."""
    return a - b


def hour_of_day(t: Column) -> Column:
    """UTC hour with its fraction."""
    return F.hour(t) + F.minute(t) / 60.0 + F.second(t) / 3600.0


def assembled(frames: DataFrame, keys: list[str] | None = None, t: str = "t", digits: int = 4) -> DataFrame:
    """frames (keys, t, row, col, lat, ...) of the grid of each key's first frame, with `frame`, their number in order of time from 0.

    A frame's grid is its cells with their latitudes; frames of another grid are left out. Grids are compared by a hash, one row a frame.
    """
    keys = keys or []
    cell = F.xxhash64("row", "col", F.round("lat", digits)).cast("decimal(38,0)")
    grids = cut(frames.where(F.col(t).isNotNull()).groupBy(*keys, t).agg(F.count("*").alias("_n"), F.sum(cell).alias("_h")))
    first = grids.groupBy(*keys).agg(F.min_by(F.struct("_n", "_h"), t).alias("_g"))
    same = grids.join(checked(cut(first)), keys) if keys else grids.crossJoin(F.broadcast(first))
    kept = running_sums(same.where(F.struct("_n", "_h") == F.col("_g")).select(*keys, t), [F.col(t)], {"frame": F.lit(1)}, keys)
    return frames.join(checked(cut(kept.withColumn("frame", (F.col("frame") - 1).cast("int")))), [*keys, t])


def with_solar_zenith(cube: DataFrame, t: str = "t", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """cube with the sun's zenith angle of every cell and frame."""
    zenith, _ = solar_position(lat, lon, F.dayofyear(t).cast("double"), hour_of_day(F.col(t)))
    return cube.withColumn("solar_zenith_deg", zenith.cast("float"))


def power_series(det: DataFrame, event: str = "root") -> DataFrame:
    """(event, t, hours, frp_mw) of the detections with power, hours counted from the event's first of them."""
    d = det.where(F.col("frp_mw").isNotNull() & F.col("t").isNotNull()).select(event, "t", F.col("frp_mw").cast("double").alias("frp_mw"))
    first = d.groupBy(event).agg(F.min("t").alias("_t0"))
    return d.join(first, event).select(event, "t", ((F.unix_micros("t") - F.unix_micros("_t0")) / 3.6e9).alias("hours"), "frp_mw")


def time_blocks(times: DataFrame, n_folds: int, t: str = "t") -> DataFrame:
    """(t, fold): the distinct times in n_folds runs of equal length, in order."""
    d = running_sums(times.where(F.col(t).isNotNull()).select(t).distinct(), [F.col(t)], {"_i": F.lit(1)})
    n = F.broadcast(d.agg(F.count("*").alias("_n")))
    return d.crossJoin(n).select(t, F.least(F.floor((F.col("_i") - 1) * n_folds / F.col("_n")), F.lit(n_folds - 1)).cast("int").alias("fold"))


def to_odd(k: float) -> int:
    """Nearest odd whole number of at least 1 (halves to the even, even ones up)."""
    k = max(1, round(k))
    return k + 1 - k % 2

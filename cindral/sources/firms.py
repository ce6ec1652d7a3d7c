"""FIRMS CSV records: scan, parsing of their spellings, detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cindral.functions.grids import AnalysisGrid, project


def position(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Longitude (-180..180) and latitude read from CSV strings; null where unreadable or off the globe."""
    x, y = (F.regexp_replace(F.trim(c), r"^\+", "").try_cast("double") for c in (lon, lat))
    ok = x.between(-180.0, 360.0) & y.between(-90.0, 90.0)
    return F.when(ok, F.when(x > 180.0, x - 360.0).otherwise(x)), F.when(ok, y)


def acquired(day: Column, clock: Column) -> Column:
    """UTC time from acq_date (2017-07-05, 2017/07/05 or 20170705) and acq_time (HHMM, leading zeros optional, colon optional); null where unreadable."""
    d = F.regexp_replace(F.trim(day), "[/.-]", "")
    c = F.trim(clock)
    colon = F.regexp_extract(c, r"^(\d{1,2}):(\d{2})(?::00)?$", 0) != ""
    digits = F.when(colon, F.concat(F.lpad(F.split_part(c, F.lit(":"), F.lit(1)), 2, "0"), F.split_part(c, F.lit(":"), F.lit(2)))).when(c.rlike(r"^\d{1,4}$"), F.lpad(c, 4, "0"))
    ok = d.rlike(r"^\d{8}$") & digits.rlike(r"^([01]\d|2[0-3])[0-5]\d$")
    return F.when(ok, F.try_to_timestamp(F.concat(d, digits), F.lit("yyyyMMddHHmm")))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The CSV with every field as string."""
    return spark.read.option("header", True).csv(path)


def records(df: DataFrame) -> DataFrame:
    """Typed records of raw string rows; rows without readable position or time are skipped. Both names of the brightness fields are known."""
    have = {c.lower(): c for c in df.columns}
    text = lambda *names: F.coalesce(*(F.col(f"`{have[n]}`") for n in names if n in have), F.lit(None).cast("string"))
    number = lambda *names: F.trim(text(*names)).try_cast("double")
    lon, lat = position(text("longitude"), text("latitude"))
    extra = [F.col("firms_id")] if "firms_id" in have else []
    out = df.select(
        *extra, lon.alias("lon"), lat.alias("lat"), acquired(text("acq_date"), text("acq_time")).alias("t"), number("bright_ti4", "brightness").alias("bt_mir_k"), number("bright_ti5", "bright_t31").alias("bt_tir_k"),
        number("scan").alias("scan"), number("track").alias("track"), number("frp").alias("frp_mw"), text("satellite").alias("satellite"), text("instrument").alias("instrument"), text("confidence").alias("confidence"),
        text("proc_version", "version").alias("version"), F.upper(F.substring(text("daynight"), 1, 1)).alias("daynight"),
    )
    return out.where("lon IS NOT NULL AND lat IS NOT NULL AND t IS NOT NULL")


def detections(df: DataFrame, crs: str = "EPSG:5070") -> DataFrame:
    """Records as detections on a projected plane; sensor is the instrument in lower case."""
    x, y = project("lon", "lat", crs)
    return records(df).withColumn("sensor", F.lower(F.coalesce("instrument", F.lit("viirs")))).withColumn("x", x).withColumn("y", y)


def freshest(df: DataFrame, hours: float = 24.0, source: str = "instrument", region: str = "conus") -> DataFrame:
    """Of each source the rows of the last hours before its own newest row, with tile; rows outside the grid are dropped."""
    d = detections(df)
    # Sources are few: their newest times are a small table, no source is gathered for a window.
    newest = F.broadcast(d.groupBy(source).agg(F.max("t").alias("_new")))
    d = d.join(newest, source).where(F.unix_micros("t") >= F.unix_micros("_new") - int(hours * 3.6e9)).drop("_new")
    return d.withColumn("tile_id", AnalysisGrid(region).tile_id("x", "y")).where("tile_id <> ''")

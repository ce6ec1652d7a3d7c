"""Sizing of an archive and of its ingest, as expressions over a frame of plans or probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tile edge (m), bytes to a dense sample and to a stored detection, share of pixels that burn, standard plans
# (name, tiles, years, cadence in minutes, bands, MB and seconds to a granule, one file to a band, storage).
TILE_M, BYTES_SAMPLE, BYTES_DETECTION, DETECTION_RATE, COMPRESSION, WORKERS = 96_000.0, 2, 56, 2.5e-05, 4.0, 12
COLUMNS = "name string, n_tiles int, years double, cadence_min double, n_bands int, granule_mb double, seconds_per_granule double, per_band boolean, storage string"
STANDARD = [
    ("FDC detection history", 500, 3.0, 5.0, 1, 0.32, 14.7, False, "sparse"), ("FDC dense mask (comparison)", 500, 3.0, 5.0, 1, 0.32, 14.7, False, "dense"), ("minimal climatology", 100, 2.0, 15.0, 3, 4.48, 14.7, True, "dense"),
    ("standard climatology", 200, 2.0, 15.0, 5, 4.48, 14.7, True, "dense"), ("generous climatology", 300, 3.0, 15.0, 5, 4.48, 14.7, True, "dense"), ("high-cadence tier", 20, 0.42, 5.0, 5, 4.48, 14.7, True, "dense"), ("naive: everything at 5 min", 300, 3.0, 5.0, 5, 4.48, 14.7, True, "dense"),
]


def standard_plans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STANDARD, COLUMNS)


def costed(plans: DataFrame, resolution_m: float = 2000.0) -> DataFrame:
    """plans with raw_gb, disk_gb, granule_reads, download_tb and wall_clock_hours."""
    side = max(1, round(TILE_M / resolution_m))
    steps = 1440.0 / F.col("cadence_min") * F.col("years") * 365.25
    samples = F.col("n_tiles") * F.col("n_bands") * float(side * side) * steps
    raw = F.when(F.col("storage") == "sparse", samples * DETECTION_RATE * BYTES_DETECTION).otherwise(samples * BYTES_SAMPLE)
    reads = steps * F.when(F.col("per_band"), F.col("n_bands")).otherwise(1)
    p = plans.withColumn("raw_gb", raw / 1e9).withColumn("disk_gb", F.when(F.col("storage") == "sparse", raw).otherwise(raw / COMPRESSION) / 1e9)
    return p.withColumn("granule_reads", F.bround(reads).cast("long")).withColumn("download_tb", reads * F.col("granule_mb") / 1e6).withColumn("wall_clock_hours", reads * F.col("seconds_per_granule") / WORKERS / 3600.0)


def fitted(plans: DataFrame, disk_gb: float, least_tiles: int = 20) -> DataFrame:
    """plans with fewer tiles where they exceed the disk (at least `least_tiles`)."""
    c = costed(plans)
    fewer = F.greatest(F.lit(least_tiles), F.floor(F.col("n_tiles") * disk_gb / F.col("disk_gb")).cast("int"))
    return c.withColumn("n_tiles", F.when(F.col("disk_gb") > disk_gb, fewer).otherwise(F.col("n_tiles"))).select(*plans.columns)


def tiers(spark: SparkSession, disk_gb: float) -> DataFrame:
    """Detection history, climatology and high-cadence tier within a disk: the history first, 15 % (at least 8 GB) of the rest for high cadence."""
    plan = lambda *r: spark.createDataFrame([r], COLUMNS)
    history = standard_plans(spark).where("name = 'FDC detection history'")
    rest = max(disk_gb - costed(history).first()["disk_gb"], 0.0)
    high = max(8.0, 0.15 * rest)
    climatology = fitted(plan("climatology", 300, 3.0, 15.0, 5, 4.48, 14.7, True, "dense"), max(rest - high, 0.0))
    return costed(history.unionByName(climatology).unionByName(fitted(plan("high-cadence", 40, 0.42, 5.0, 5, 4.48, 14.7, True, "dense"), high)))


def recommended_workers(probes: DataFrame) -> DataFrame:
    """One row: fewest workers within 10 % of the fastest probe; null if more than half of the probes were too short or too variable. probes: workers, granules_per_second, spread, too_fast."""
    noisy = F.coalesce(F.col("too_fast").cast("boolean"), F.lit(False)) | (F.coalesce("spread", F.lit(0.0)) > 0.25)
    top = probes.agg(F.max("granules_per_second").alias("_top"), F.count_if(noisy).alias("_noisy"), F.count("*").alias("_n"), F.max_by("workers", "granules_per_second").alias("best"))
    knee = probes.crossJoin(F.broadcast(top)).where(F.col("granules_per_second") >= 0.9 * F.col("_top")).groupBy("best", "_noisy", "_n").agg(F.min("workers").alias("_k"))
    return knee.select(F.when(F.col("_noisy") * 2 <= F.col("_n"), F.col("_k")).alias("workers"), "best")

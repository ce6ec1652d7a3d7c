"""Granule keys, fire-mask codes, sensors and platforms, confidence, causes, label records."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cindral.functions._num import Number, col, lookup

# Fire-mask codes with meaning and confidence; codes whose power is unreliable; high-confidence codes.
MASK_MEANING = {
    10: "good_quality_fire", 11: "saturated_fire", 12: "cloud_contaminated_fire", 13: "high_probability_fire", 14: "medium_probability_fire", 15: "low_probability_fire",
    30: "good_quality_fire_temporally_filtered", 31: "saturated_fire_temporally_filtered", 32: "cloud_contaminated_fire_temporally_filtered",
    33: "high_probability_fire_temporally_filtered", 34: "medium_probability_fire_temporally_filtered", 35: "low_probability_fire_temporally_filtered",
}
MASK_CONFIDENCE = {10: 0.95, 30: 0.98, 11: 0.9, 31: 0.93, 12: 0.55, 32: 0.6, 13: 0.8, 33: 0.85, 14: 0.55, 34: 0.6, 15: 0.3, 35: 0.35}
UNFILTERED_CODES, FILTERED_CODES = (10, 11, 12, 13, 14, 15), (30, 31, 32, 33, 34, 35)
UNRELIABLE_FRP_CODES = (11, 12, 31, 32)
HIGH_CONFIDENCE_CODES = (10, 11, 13, 30, 31, 33)
DEFAULT_CONFIDENCE = 0.5
FIRST_LIGHT = dt.datetime(2017, 1, 1)
DOMAINS = {"C": "conus", "F": "full_disk", "M": "mesoscale"}
# Sensors (kind, mid- and thermal-infrared wavelength, saturation, resolution, constant's key) and platforms (sensor, status, data from, data to, power bias).
SENSORS = {
    "viirs": ("leo", 3.74, 11.45, 650.0, 375.0, None), "slstr": ("leo", 3.742, 10.85, 311.0, 1000.0, None), "abi": ("geo", 3.9, 11.2, 400.0, 2000.0, "goes_imager"),
    "fci": ("geo", 3.8, 10.5, 400.0, 1000.0, None), "seviri": ("geo", 3.9, 10.8, 335.0, 3000.0, "seviri"), "modis": ("leo", 3.96, 11.0, 331.0, 1000.0, "modis_c6"), "metimage": ("leo", 3.7, 10.8, None, 500.0, None),
}
PLATFORMS = {
    "snpp": ("Suomi-NPP", "viirs", "ending", "2011-10-28", "2026-11-01", 1.0), "noaa20": ("NOAA-20 (JPSS-1)", "viirs", "secondary", "2017-11-18", None, 1.0),
    "noaa21": ("NOAA-21 (JPSS-2)", "viirs", "primary", "2023-02-23", None, 1.1), "noaa22": ("NOAA-22 (JPSS-4)", "viirs", "planned", "2027-01-01", None, 1.0),
    "sentinel3a": ("Sentinel-3A", "slstr", "primary", "2016-02-16", None, 1.0), "sentinel3b": ("Sentinel-3B", "slstr", "primary", "2018-04-25", None, 1.0),
    "sentinel3c": ("Sentinel-3C", "slstr", "planned", "2027-04-01", None, 1.0), "goes19": ("GOES-19 (GOES-East)", "abi", "primary", "2025-04-04", None, 1.0),
    "goes18": ("GOES-18 (GOES-West)", "abi", "primary", "2023-01-10", None, 1.0), "mtg_i1": ("Meteosat-12 (MTG-I1)", "fci", "secondary", "2025-01-01", None, 1.0),
    "msg": ("Meteosat Second Generation", "seviri", "primary", None, None, 1.0), "terra": ("Terra", "modis", "ending", None, "2026-12-31", 1.0), "aqua": ("Aqua", "modis", "ending", None, "2026-12-31", 1.0),
}
UNKNOWN_CAUSES = ("missing/undefined", "missing data/not specified/undetermined", "undefined", "", "unknown")
LIGHTNING_CAUSES = ("natural", "lightning")
ACRE_HA = 0.404686


def granule_start(key: Number | str) -> Column:
    """Scan start in a granule's name (sYYYYDDDHHMMSS...), null if there is none."""
    s = F.regexp_extract(F.element_at(F.split(col(key), "/"), -1), r"(?:^|_)s(\d{13,})(?:_|\.|$)", 1)
    day = F.try_make_timestamp_ltz(F.substring(s, 1, 4).try_cast("int"), F.lit(1), F.lit(1), F.substring(s, 8, 2).try_cast("int"), F.substring(s, 10, 2).try_cast("int"), F.substring(s, 12, 2).try_cast("decimal(8,6)"), F.lit("UTC"))
    return F.when(s != "", day + F.make_dt_interval(F.substring(s, 5, 3).try_cast("int") - 1))


def granule_product(key: Number | str) -> Column:
    """Product of a granule's name (the second part, without its mode), `unknown` if there is none."""
    part = F.get(F.split(F.element_at(F.split(col(key), "/"), -1), "_"), 1)
    return F.when(part.isNotNull(), F.regexp_replace(part, r"-[^-]*$", "")).otherwise("unknown")


def granule_domain(key: Number | str) -> Column:
    return lookup(F.substring(granule_product(key), -1, 1), DOMAINS, "unknown")


def key_prefix(product: str, when: Number | str) -> Column:
    """`PRODUCT/YYYY/DDD/HH/` of a UTC time."""
    return F.concat(F.lit(f"{product}/"), F.date_format(col(when), "yyyy/DDD/HH"), F.lit("/"))


def validated_scan_start(t: Number | str, key: Number | str) -> Column:
    """t, or the time in the key where t is before the first instrument."""
    return F.when(col(t) < F.lit(FIRST_LIGHT), F.coalesce(granule_start(key), col(t))).otherwise(col(t))


def is_fire_code(code: Number | str, high_confidence_only: bool = False) -> Column:
    return col(code).isin(*(HIGH_CONFIDENCE_CODES if high_confidence_only else MASK_MEANING))


def mask_confidence(code: Number | str) -> Column:
    return lookup(col(code).cast("int"), MASK_CONFIDENCE, DEFAULT_CONFIDENCE)


def mask_meaning(code: Number | str) -> Column:
    return lookup(col(code).cast("int"), MASK_MEANING)


def reliable_frp(frp: Number | str, code: Number | str) -> Column:
    return F.when(~F.coalesce(col(code).isin(*UNRELIABLE_FRP_CODES), F.lit(False)), col(frp))


def mask_summary(df: DataFrame, code: str = "mask_code") -> DataFrame:
    """Rows by meaning of the mask, known codes only."""
    return df.where(is_fire_code(code)).groupBy(mask_meaning(code).alias("meaning")).agg(F.count("*").alias("n"))


def confidence_pct(value: Number | str, fraction: bool | None = None) -> Column:
    """Percent of a confidence given as l/n/h, as 0..1 or as 0..100.

    fraction: whether numbers are shares (True), percents (False), or shares up to 1 (None, as served).
    """
    v = F.lower(F.trim(col(value).cast("string")))
    n = v.try_cast("double")
    scaled = n * 100.0 if fraction else (n if fraction is False else F.when(n <= 1.0, n * 100.0).otherwise(n))
    words = lookup(v, {"l": 30, "low": 30, "n": 70, "nominal": 70, "h": 95, "high": 95})
    return F.coalesce(F.bround(scaled).cast("int"), words)


def sensor_family(name: Number | str) -> Column:
    n = F.lower(col(name))
    return F.when(n.contains("goes") | n.contains("abi"), "goes").when(n.contains("viirs"), "viirs").when(n.contains("modis") | n.isin("terra", "aqua"), "modis").otherwise("other")


def sensor_from_granule(key: Number | str) -> Column:
    """goes18 from `.../g18/...` or `..._G18_...`."""
    n = F.regexp_extract(F.lower(col(key)), r"(?:^|[/_])g(\d{2})(?=[/_])", 1)
    return F.when(n != "", F.concat(F.lit("goes"), n)).otherwise("unknown")


def sensors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in SENSORS.items()], "sensor string, kind string, mir_um double, tir_um double, mir_saturation_k double, resolution_m double, wooster_key string")


def platforms(spark: SparkSession) -> DataFrame:
    day = lambda s: s and dt.date.fromisoformat(s)
    rows = [(k, n, s, st, day(a), day(b), f) for k, (n, s, st, a, b, f) in PLATFORMS.items()]
    return spark.createDataFrame(rows, "platform string, name string, sensor string, status string, data_start date, data_end date, frp_bias_factor double")


def active_platforms(spark: SparkSession, on: dt.date, kind: str | None = None) -> DataFrame:
    """Platforms with data on a day: from <= day < to, neither planned nor retired, by name."""
    d = F.lit(on)
    p = platforms(spark).where((F.coalesce(F.col("data_start"), d) <= d) & (F.col("data_end").isNull() | (d < F.col("data_end"))) & ~F.col("status").isin("planned", "retired"))
    p = p.join(F.broadcast(sensors(spark).select("sensor", "kind")), "sensor")
    return (p.where(F.col("kind") == kind) if kind else p).orderBy("name")


def coverage_report(spark: SparkSession, on: dt.date) -> DataFrame:
    """One line for each kind, and a note where fewer than three VIIRS fly."""
    a = active_platforms(spark, on)
    line = a.groupBy("kind").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("names"))
    viirs = a.where("sensor = 'viirs'").agg(F.count("*").alias("n")).where("n < 3").select(F.lit("note").alias("kind"), "n", F.lit("fewer than three VIIRS platforms").alias("names"))
    return line.unionByName(viirs)


def frp_to_reference_scale(frp: Number | str, platform: Number | str) -> Column:
    """Power divided by the platform's bias; null for an unknown platform."""
    return col(frp) / lookup(F.lower(col(platform)), {k: v[5] for k, v in PLATFORMS.items()})


def classify_cause(raw: Number | str) -> Column:
    c = F.lower(F.trim(col(raw)))
    return F.when(c.isNull() | c.isin(*UNKNOWN_CAUSES), "").when(c.isin(*LIGHTNING_CAUSES), "lightning").otherwise("human")


def normalize_occurrences(df: DataFrame, id: str = "id", lon: str = "lon", lat: str = "lat", year: str = "year", cause: str = "cause") -> DataFrame:
    """Rows with place and year; missing identifiers are made from the place and year."""
    df = df.where(F.col(lon).isNotNull() & F.col(lat).isNotNull() & F.col(year).isNotNull())
    made = F.concat(F.lit("fire_"), F.hex(F.xxhash64(lon, lat, year)))
    return df.select(F.coalesce(F.col(id).cast("string"), made).alias("id"), F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat"), F.col(year).cast("int").alias("year"), classify_cause(cause).alias("cause"))


def parse_any_date(text: Number | str) -> Column:
    """Date in ISO, slashed, US or compact spelling; null if none fits."""
    t = F.substring(F.trim(col(text)), 1, 10)
    return F.coalesce(*(F.try_to_date(F.when(t.rlike(p), t), f) for p, f in ((r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"), (r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy"), (r"^\d{8}$", "yyyyMMdd"))))


def first_of(df: DataFrame, *names: str) -> Column:
    """First non-empty of the columns that exist, by name without regard to case; null if none does."""
    by = {c.lower(): c for c in df.columns}
    found = [F.nullif(F.trim(F.col(f"`{by[n.lower()]}`").cast("string")), F.lit("")) for n in names if n.lower() in by]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def normalize_perimeters(df: DataFrame) -> DataFrame:
    """Perimeter attributes under their usual names, area in hectares, dates parsed, fire type in the registry's words."""
    acres = first_of(df, "BurnBndAc", "acres", "area_acres").try_cast("double")
    kind = F.lower(first_of(df, "Incid_Type", "fire_type", "type"))
    fire_type = F.when(kind.contains("prescribed"), "prescribed").when(kind.contains("wildland fire use") | kind.contains("wfu"), "wildfire_use").when(kind.contains("wild"), "wildfire").otherwise("unknown")
    return df.select(
        first_of(df, "Event_ID", "event_id", "fire_id").alias("event_id"), first_of(df, "Incid_Name", "fire_name", "name").alias("name"), parse_any_date(first_of(df, "Ig_Date", "ignition_date", "start_date")).alias("ignition_date"),
        (acres * ACRE_HA).alias("area_ha"), first_of(df, "BurnBndLon", "lon", "longitude").try_cast("double").alias("lon"), first_of(df, "BurnBndLat", "lat", "latitude").try_cast("double").alias("lat"), fire_type.alias("fire_type"),
    )


def parse_centroid(wkt: Number | str) -> tuple[Column, Column]:
    """Longitude and latitude of `POINT (x y)`; null otherwise."""
    part = lambda g: F.regexp_extract(col(wkt), r"(?i)POINT\s*\(\s*(-?[\d.]+)\s+(-?[\d.]+)\s*\)", g).try_cast("double")
    return part(1), part(2)


def burned_from_severity(code: Number | str, burned: tuple[int, ...] = (2, 3, 4), unburned: tuple[int, ...] = (1,), background: bool = False) -> tuple[Column, Column]:
    """(burned, valid) of a severity class; class 0 is valid background if wanted."""
    c = col(code)
    return F.coalesce(c.isin(*burned), F.lit(False)), F.coalesce(c.isin(*burned, *unburned, *((0,) if background else ())), F.lit(False))


def latest_steps(df: DataFrame, path: str = "path") -> DataFrame:
    """Of delineation files, the one of the highest monitoring step for each activation and area of interest."""
    p = F.col(path)
    d = df.select(path, F.regexp_extract(p, r"(EMSR\d+)", 1).alias("code"), F.regexp_extract(p, r"(AOI\d+)", 1).alias("aoi"), F.coalesce(F.regexp_extract(p, r"MONIT(\d+)", 1).try_cast("int"), F.lit(0)).alias("step"))
    return d.where("code <> ''").groupBy("code", "aoi").agg(F.max_by(path, F.struct("step", path)).alias(path), F.max("step").alias("step"))

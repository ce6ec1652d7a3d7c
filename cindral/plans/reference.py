"""Queries of the engine's operators over whole tables, each with SQL where SQL can express it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cindral.frames import ntz, read
from cindral.functions import codes, fireweather, geometry, radiative, spectral
from cindral.functions.grids import GRS80_A, GRS80_E2, AnalysisGrid, RasterSpec, block_key, parse_tile_id, project
from cindral.operators import features, linking, models, planning, protocols, raster, scores, series, serving, splits
from cindral.session import cut
from cindral.sources import firms, store

QUERIES: dict = {}
SQL: dict[str, str] = {}
DET = ("det_id", "t", "tile_id", "x", "y", "lon", "lat", "mask_code", "confidence", "frp_mw", "temp_k", "area_m2", "view_zenith_deg", "true_pixel_area_m2", "pixel_id", "satellite", "granule_key")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def det(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Detections, each once; only the named columns are read."""
    return read(spark, sf_dir, "detections", *dict.fromkeys(["det_id", *cols])).dropDuplicates(["det_id"])


def sql_det(*cols: str) -> str:
    return f"d AS (SELECT DISTINCT {', '.join(dict.fromkeys(['det_id', *cols]))} FROM detections)"


def r6(c: Column, name: str, digits: int = 6) -> Column:
    return F.round(c.cast("double"), digits).alias(name)


def r32(c: Column, name: str) -> Column:
    """To single precision: unlike decimal places this never puts an exact binary value between two."""
    return c.cast("float").cast("double").alias(name)


# --- physics ---

PL = "119104295.3 / (pow({w}, 5) * (exp(14387.769 / ({w} * {t})) - 1))"
AMF = "1 / cos(radians(least(greatest({z}, 0.0), 80.0)))"
K_W = repr(radiative.K_WATER)
TAU = f"exp(-({AMF}) * (-ln(0.92) + {K_W} * sqrt(greatest({{w}}, 0.0)) + 0.06 * {{a}}))"


@query("ref_planck", f"""WITH {sql_det('temp_k')}, q AS (SELECT det_id, temp_k::DOUBLE AS t FROM d WHERE temp_k BETWEEN 150 AND 2000),
p AS (SELECT *, {PL.format(w='3.9', t='t')} AS m, {PL.format(w='11.0', t='t')} AS l, 14387.769 / (3.9 * t) AS x, {PL.format(w='3.9', t='300.0')} AS b FROM q)
SELECT det_id, round(m, 4) AS mir, round(l, 6) AS tir, round(14387.769 / (3.9 * ln(1 + 119104295.3 / (pow(3.9, 5) * m))), 6) AS back_k, round(x * exp(x) / (exp(x) - 1), 6) AS exponent, round(m / b, 4) AS contrast,
  round(0.01 * m + 0.99 * b, 6) AS mixed, round(t / (x * exp(x) / (exp(x) - 1)) * 0.01, 6) AS bt_error FROM p""")
def ref_planck(spark, sf):
    d = det(spark, sf, "temp_k").where("temp_k BETWEEN 150 AND 2000").withColumn("t", F.col("temp_k").cast("double"))
    m = radiative.planck_radiance(3.9, "t")
    return d.select("det_id", r6(m, "mir", 4), r6(radiative.planck_radiance(11.0, "t"), "tir"), r6(radiative.brightness_temperature(3.9, m), "back_k"), r6(radiative.planck_sensitivity_exponent(3.9, "t"), "exponent"), r6(radiative.dozier_contrast_ratio(3.9, "t", 300.0), "contrast", 4), r6(radiative.mixed_pixel_radiance(3.9, 0.01, "t", 300.0), "mixed"), r6(radiative.emissivity_error_to_bt_error("t", 3.9, 0.01), "bt_error"))


@query("ref_frp", f"""WITH {sql_det('temp_k', 'view_zenith_deg', 'true_pixel_area_m2')}, q AS (SELECT det_id, temp_k::DOUBLE AS t, view_zenith_deg::DOUBLE AS z, true_pixel_area_m2::DOUBLE AS a FROM d
  WHERE temp_k BETWEEN 250 AND 1500 AND view_zenith_deg BETWEEN 0 AND 90 AND true_pixel_area_m2 IS NOT NULL),
p AS (SELECT *, {TAU.format(z='z', w='20.0', a='0.1')} AS tau, {PL.format(w='3.9', t='t')} AS f, {PL.format(w='3.9', t='300.0')} AS b FROM q),
o AS (SELECT *, greatest(a * 5.670374419e-08 / (3.07e-09 * tau) * (f - b), 0) / 1e6 AS frp FROM p)
SELECT det_id, round({AMF.format(z='z')}, 6) AS air_mass, round(tau, 6) AS tau, round(1 / tau, 6) AS factor, round(frp, 3) AS frp, round(frp * sqrt(0.01 + pow(0.084, 2) + pow(0.02 * b / (f - b), 2) + pow(0.01 * f / (f - b), 2)), 3) AS sigma,
  round(frp * 0.368, 3) AS fuel, t >= 400 AS saturated, t BETWEEN 665 AND 1365 AS valid FROM o WHERE abs(f - b) > 0.001""")
def ref_frp(spark, sf):
    d = det(spark, sf, "temp_k", "view_zenith_deg", "true_pixel_area_m2").where("temp_k BETWEEN 250 AND 1500 AND view_zenith_deg BETWEEN 0 AND 90 AND true_pixel_area_m2 IS NOT NULL").withColumns({c: F.col(c).cast("double") for c in ("temp_k", "view_zenith_deg", "true_pixel_area_m2")})
    tau, f, b = radiative.transmittance_mir(20.0, "view_zenith_deg", 0.1), radiative.planck_radiance(3.9, "temp_k"), radiative.planck_radiance(3.9, 300.0)
    d = d.withColumn("tau", tau).withColumn("f", f).withColumn("b", b).withColumn("frp", radiative.frp_from_radiance("f", "b", "true_pixel_area_m2", radiative.wooster_a(F.lit("goes_imager")), "tau")).where(F.abs(F.col("f") - F.col("b")) > 0.001)
    return d.select("det_id", r6(radiative.air_mass_factor("view_zenith_deg"), "air_mass"), r6(F.col("tau"), "tau"), r6(radiative.frp_atmospheric_correction_factor(20.0, "view_zenith_deg", 0.1), "factor"), r6(F.col("frp"), "frp", 3), r6(radiative.frp_uncertainty("frp", "f", "b", 0.01 * F.col("f"), 0.02 * F.col("b")), "sigma", 3), r6(radiative.fuel_consumed_kg("frp"), "fuel", 3), radiative.saturation_mask("temp_k", 400.0).alias("saturated"), radiative.wooster_validity("temp_k").alias("valid"))


@query("ref_footprint", f"""WITH {sql_det('view_zenith_deg')}, q AS (SELECT det_id, view_zenith_deg::DOUBLE AS v, least(greatest(view_zenith_deg::DOUBLE, 0.0), 80.0) AS z FROM d WHERE view_zenith_deg BETWEEN -90 AND 90),
g AS (SELECT *, CASE WHEN z > 0 THEN pow((6371.0 + 833.0) * sin(radians(z) - asin(6371.0 * sin(radians(z)) / (6371.0 + 833.0))) / (833.0 * sin(radians(z))), 2) ELSE 1 END / cos(radians(z)) AS leo,
   CASE WHEN z > 0 THEN pow((6371.0 + 35786.0) * sin(radians(z) - asin(6371.0 * sin(radians(z)) / (6371.0 + 35786.0))) / (35786.0 * sin(radians(z))), 2) ELSE 1 END / cos(radians(z)) AS geo FROM q)
SELECT det_id, round(leo, 6) AS growth, round(375.0 * 375.0 * least(leo, 4.0), 3) AS viirs_area, round(greatest(2000.0 * sqrt(geo) * sqrt(2.0) / 2 + 1000.0 * tan(radians(z)), 1000.0), 4) AS tolerance,
  round(greatest(greatest(2000.0 * sqrt(geo) * sqrt(2.0) / 2 + 1000.0 * tan(radians(z)), 1000.0), 5000.0), 4) AS fused FROM g""")
def ref_footprint(spark, sf):
    d = det(spark, sf, "view_zenith_deg").where("view_zenith_deg BETWEEN -90 AND 90").withColumn("v", F.col("view_zenith_deg").cast("double"))
    return d.select("det_id", r6(geometry.pixel_area_growth("v"), "growth"), r6(geometry.viirs_pixel_area_m2("v"), "viirs_area", 3), r6(geometry.geo_leo_tolerance_m("v"), "tolerance", 4), r6(geometry.tolerance_m(F.lit("goes"), F.lit("forest"), F.col("v")), "fused", 4))


@query("ref_solar", f"""WITH {sql_det('t', 'lon', 'lat')}, q AS (SELECT det_id, lon, lat, dayofyear(t)::DOUBLE AS doy, hour(t) + minute(t) / 60.0 + second(t) / 3600.0 AS h FROM d WHERE t IS NOT NULL AND lon IS NOT NULL),
g AS (SELECT *, 2 * pi() / 365.0 * (doy - 1 + (h - 12) / 24.0) AS g FROM q),
e AS (SELECT *, 229.18 * (7.5e-05 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) AS eq,
   0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS dc FROM g),
z AS (SELECT *, radians((h * 60 + eq + 4 * lon) / 4 - 180) AS ha FROM e)
SELECT det_id, round(degrees(acos(least(1.0, greatest(-1.0, sin(radians(lat)) * sin(dc) + cos(radians(lat)) * cos(dc) * cos(ha))))), 5) AS zenith, round((h + lon / 15.0) - 24 * floor((h + lon / 15.0) / 24), 6) AS solar_hour, round(sin(2 * pi() * doy / 365.25), 6) AS doy_sin FROM z""")
def ref_solar(spark, sf):
    h = F.hour("t") + F.minute("t") / 60.0 + F.second("t") / 3600.0
    d = det(spark, sf, "t", "lon", "lat").where("t IS NOT NULL AND lon IS NOT NULL").withColumn("h", h).withColumn("doy", F.dayofyear("t").cast("double"))
    zen, _ = geometry.solar_position("lat", "lon", "doy", "h")
    return d.select("det_id", r6(zen, "zenith", 5), r6(geometry.local_solar_time_hours("lon", "h"), "solar_hour"), r6(geometry.day_of_year_encoding("doy")[0], "doy_sin"))


@query("ref_fixed_grid", f"""WITH {sql_det('lon', 'lat')}, q AS (SELECT det_id, radians(lat) AS p, radians(lon + 75.0) AS dl FROM d WHERE lon IS NOT NULL AND lat IS NOT NULL),
c AS (SELECT *, atan(pow(6356752.31414 / 6378137.0, 2) * tan(p)) AS pc FROM q), r AS (SELECT *, 6356752.31414 / sqrt(1 - (1 - pow(6356752.31414 / 6378137.0, 2)) * pow(cos(pc), 2)) AS rc, 42164160.0 AS h FROM c),
s AS (SELECT *, h - rc * cos(pc) * cos(dl) AS sx, -rc * cos(pc) * sin(dl) AS sy, rc * sin(pc) AS sz, cos(p) * cos(dl) AS cp FROM r)
SELECT det_id, round(asin(-sy / sqrt(sx * sx + sy * sy + sz * sz)), 8) AS x, round(atan(sz / sx), 8) AS y, round(degrees(asin(least(1.0, sin(acos(cp)) / sqrt(1 + pow(6378137.0 / h, 2) - 2 * 6378137.0 / h * cp)))), 6) AS vza FROM s
WHERE h * (h - sx) >= sy * sy + pow(6378137.0 / 6356752.31414, 2) * sz * sz""")
def ref_fixed_grid(spark, sf):
    g = geometry.FixedGrid()
    d = det(spark, sf, "lon", "lat").where("lon IS NOT NULL AND lat IS NOT NULL")
    x, y = g.to_scan_angles("lat", "lon")
    return d.select("det_id", r6(x, "x", 8), r6(y, "y", 8), r6(g.view_zenith_deg("lat", "lon"), "vza")).where("x IS NOT NULL")


ND = "CASE WHEN abs({a} + {b}) >= 1e-8 THEN ({a} - {b}) / ({a} + {b}) END"


@query("ref_indices", f"""WITH q AS (SELECT l_orderkey, l_linenumber, l_quantity / 50.0 AS nir, l_discount AS swir, l_tax AS red FROM lineitem),
i AS (SELECT *, {ND.format(a='nir', b='swir')} AS pre, {ND.format(a='red', b='swir')} AS post FROM q), s AS (SELECT *, (pre - post) * 1000 AS dn FROM i)
SELECT l_orderkey, l_linenumber, round(pre, 6) AS nbr, round({ND.format(a='nir', b='red')}, 6) AS ndvi, round(dn, 4) AS dnbr, round(dn / sqrt(greatest(abs(pre), 0.001)), 4) AS rdnbr, round(dn / (pre + 1.001), 3) AS rbr,
  CASE WHEN dn IS NULL THEN -1 ELSE (dn >= 100)::INT + (dn >= 270)::INT + (dn >= 440)::INT + (dn >= 660)::INT END AS severity FROM s""")
def ref_indices(spark, sf):
    d = read(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50.0).alias("nir"), F.col("l_discount").alias("swir"), F.col("l_tax").alias("red"))
    d = d.withColumn("pre", spectral.nbr("nir", "swir")).withColumn("post", spectral.normalized_difference("red", "swir"))
    return d.select("l_orderkey", "l_linenumber", r6(F.col("pre"), "nbr"), r6(spectral.ndvi("nir", "red"), "ndvi"), r6(spectral.dnbr("pre", "post"), "dnbr", 4), r6(spectral.rdnbr("pre", "post"), "rdnbr", 4), r6(spectral.rbr("pre", "post"), "rbr", 3), spectral.classify_severity(spectral.dnbr("pre", "post")).cast("int").alias("severity"))


def weather(spark, sf):
    """Daily weather of cells, made from the orders by arithmetic."""
    d = read(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    return d.select("o_orderkey", F.col("o_custkey").alias("cell"), F.to_date("o_orderdate").alias("day"), (F.col("o_orderkey") % 41 - 5).cast("double").alias("temp"), (F.col("o_orderkey") % 97 + 3).cast("double").alias("rh"), (F.col("o_orderkey") % 61).cast("double").alias("wind"), F.when(F.col("o_orderkey") % 5 == 0, (F.col("o_orderkey") % 37) / 2.0).otherwise(0.0).alias("rain"))


_MO = "147.2 * (101.0 - 85.0) / (59.5 + 85.0)"


@query("ref_fwi_day", f"""WITH w AS (SELECT o_orderkey, month(o_orderdate) AS mo, (o_orderkey % 41 - 5)::DOUBLE AS t, (o_orderkey % 97 + 3)::DOUBLE AS h, (o_orderkey % 61)::DOUBLE AS wi, CASE WHEN o_orderkey % 5 = 0 THEN (o_orderkey % 37) / 2.0 ELSE 0.0 END AS r FROM orders),
a AS (SELECT *, CASE WHEN r > 0.5 THEN least(250.0, {_MO} + 42.5 * (r - 0.5) * exp(-100.0 / (251.0 - {_MO})) * (1 - exp(-6.93 / (r - 0.5)))) ELSE {_MO} END AS m0,
  0.942 * pow(h, 0.679) + 11 * exp((h - 100) / 10) + 0.18 * (21.1 - t) * (1 - exp(-0.115 * h)) AS ed, 0.618 * pow(h, 0.753) + 10 * exp((h - 100) / 10) + 0.18 * (21.1 - t) * (1 - exp(-0.115 * h)) AS ew FROM w),
b AS (SELECT *, CASE WHEN m0 > ed THEN ed + (m0 - ed) * pow(10, -((0.424 * (1 - pow(h / 100, 1.7)) + 0.0694 * sqrt(wi) * (1 - pow(h / 100, 8))) * 0.581 * exp(0.0365 * t)))
  WHEN m0 < ew THEN ew - (ew - m0) * pow(10, -((0.424 * (1 - pow((100 - h) / 100, 1.7)) + 0.0694 * sqrt(wi) * (1 - pow((100 - h) / 100, 8))) * 0.581 * exp(0.0365 * t))) ELSE m0 END AS m FROM a),
c AS (SELECT *, least(101.0, greatest(0.0, 59.5 * (250 - least(250.0, greatest(0.0, m))) / (147.2 + least(250.0, greatest(0.0, m))))) AS ffmc,
  greatest(0.0, greatest(0.0, CASE WHEN r > 1.5 THEN 43.43 * (5.6348 - ln(greatest(1e-6, 280 / exp(0.023 * 6) + 1000 * (0.92 * r - 1.27) / (48.77 + 100 / (0.5 + 0.3 * 6) * (0.92 * r - 1.27))))) ELSE 6.0 END)
    + 1.894 * (greatest(t, -1.1) + 1.1) * (100 - h) * ([6.5, 7.5, 9.0, 12.8, 13.9, 13.9, 12.4, 10.9, 9.4, 8.0, 7.0, 6.0])[mo] * 0.0001) AS dmc,
  greatest(0.0, CASE WHEN r > 2.8 THEN 15 - 400 * ln(1 + 3.937 * (0.83 * r - 1.27) / (800 * exp(-15 / 400.0))) ELSE 15.0 END) + greatest(0.0, (0.36 * (greatest(t, -2.8) + 2.8) + ([-1.6, -1.6, -1.6, 0.9, 3.8, 5.8, 6.4, 5.0, 2.4, 0.4, -1.6, -1.6])[mo]) / 2) AS dc FROM b),
e AS (SELECT *, 147.2 * (101 - ffmc) / (59.5 + ffmc) AS mm FROM c),
f AS (SELECT *, 0.208 * exp(0.05039 * wi) * 91.9 * exp(-0.1386 * mm) * (1 + pow(mm, 5.31) / 49300000.0) AS isi, greatest(0.0, CASE WHEN dmc <= 0.4 * dc THEN 0.8 * dmc * dc / greatest(dmc + 0.4 * dc, 1e-9) ELSE dmc - (1 - 0.8 * dc / (dmc + 0.4 * dc)) * (0.92 + pow(0.0114 * dmc, 1.7)) END) AS bui FROM e),
g AS (SELECT *, 0.1 * isi * CASE WHEN bui <= 80 THEN 0.626 * pow(greatest(bui, 1e-9), 0.809) + 2 ELSE 1000 / (25 + 108.64 * exp(-0.023 * bui)) END AS bb FROM f),
k AS (SELECT *, CASE WHEN bb > 1 THEN exp(2.72 * pow(0.434 * ln(greatest(bb, 1.0)), 0.647)) ELSE bb END AS fwi FROM g)
SELECT o_orderkey, round(ffmc, 5) AS ffmc, round(dmc, 5) AS dmc, round(dc, 5) AS dc, round(isi, 5) AS isi, round(bui, 5) AS bui, round(fwi, 4) AS fwi, (fwi >= 5.2)::INT + (fwi >= 11.2)::INT + (fwi >= 21.3)::INT + (fwi >= 38)::INT + (fwi >= 50)::INT + (fwi >= 70)::INT AS effis FROM k""")
def ref_fwi_day(spark, sf):
    w = weather(spark, sf).withColumn("mo", F.month("day"))
    w = w.withColumn("f", fireweather.ffmc("temp", "rh", "wind", "rain", 85.0)).withColumn("p", fireweather.dmc("temp", "rh", "rain", 6.0, "mo")).withColumn("c", fireweather.dc("temp", "rain", 15.0, "mo"))
    w = w.withColumn("i", fireweather.isi("f", "wind")).withColumn("u", fireweather.bui("p", "c")).withColumn("s", fireweather.fwi("i", "u"))
    return w.select("o_orderkey", r6(F.col("f"), "ffmc", 5), r6(F.col("p"), "dmc", 5), r6(F.col("c"), "dc", 5), r6(F.col("i"), "isi", 5), r6(F.col("u"), "bui", 5), r6(F.col("s"), "fwi", 4), fireweather.effis_class("s").cast("int").alias("effis"))


@query("ref_fwi_season")
def ref_fwi_season(spark, sf):
    """Codes carried from day to day in each cell."""
    w = weather(spark, sf).groupBy("cell", "day").agg(*(F.avg(c).alias(c) for c in ("temp", "rh", "wind", "rain")))
    d = series.fire_weather_days(w)
    return d.select("cell", "day", *(r6(F.col(c), c, 4) for c in ("ffmc", "dmc", "dc", "isi", "bui", "fwi", "dsr")))


@query("ref_spread_risk", """WITH w AS (SELECT o_orderkey, (o_orderkey % 41 - 5)::DOUBLE AS t, (o_orderkey % 97 + 3)::DOUBLE AS h, (o_orderkey % 61) / 3.6 AS w FROM orders),
s AS (SELECT o_orderkey, round_even(100 * (0.55 * least(1.0, greatest(0.0, w / 15)) + 0.3 * least(1.0, greatest(0.0, (45 - h) / 45)) + 0.15 * least(1.0, greatest(0.0, (t - 15) / 25))), 1) AS score FROM w)
SELECT o_orderkey, score, CASE WHEN score >= 75 THEN 'Extreme' WHEN score >= 50 THEN 'High' WHEN score >= 25 THEN 'Moderate' ELSE 'Low' END AS risk FROM s""")
def ref_spread_risk(spark, sf):
    w = weather(spark, sf).withColumn("score", fireweather.spread_risk_score("temp", "rh", F.col("wind") / 3.6))
    return w.select("o_orderkey", F.col("score").cast("double").alias("score"), fireweather.risk_class("score").alias("risk"))


@query("ref_physics_features")
def ref_physics_features(spark, sf):
    h = F.hour("t") + F.minute("t") / 60.0 + F.second("t") / 3600.0
    d = det(spark, sf, "t", "lon", "lat", "temp_k", "view_zenith_deg").where("t IS NOT NULL AND lon IS NOT NULL AND temp_k BETWEEN 150 AND 2000 AND view_zenith_deg BETWEEN 0 AND 90").withColumn("utc_hour", h).withColumn("day_of_year", F.dayofyear("t").cast("double"))
    zen, az = geometry.solar_position("lat", "lon", "day_of_year", "utc_hour")
    d = d.withColumns({"solar_zenith_deg": zen, "solar_azimuth_deg": az, "longitude_deg": F.col("lon"), "bt_mir_k": F.col("temp_k"), "bt_tir_k": 300.0 + (F.col("temp_k") - 300.0) * 0.2, "bt_mir_background_k": F.lit(300.0), "bt_tir_background_k": F.lit(295.0), "view_azimuth_deg": F.lit(180.0), "tcwv_kg_m2": F.lit(20.0)})
    return features.physics_features(d, ["det_id"]).select("det_id", *(r6(F.col(c), c, 5) for c in features.feature_names()))


# --- grids, codes, sources ---


@query("ref_tiles", f"""WITH {sql_det('x', 'y')}, i AS (SELECT det_id, floor((x + 2400000.0) / 96000)::INT AS ix, floor((y - 192000.0) / 96000)::INT AS iy FROM d WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT det_id, CASE WHEN ix BETWEEN 0 AND 48 AND iy BETWEEN 0 AND 31 THEN 'conus/x' || lpad(ix::VARCHAR, 4, '0') || '_y' || lpad(iy::VARCHAR, 4, '0') ELSE '' END AS tile FROM i""")
def ref_tiles(spark, sf):
    return det(spark, sf, "x", "y").where("x IS NOT NULL AND y IS NOT NULL").select("det_id", AnalysisGrid("conus").tile_id("x", "y").alias("tile"))


@query("ref_parse_tiles", "SELECT DISTINCT tile_id, split_part(tile_id, '/', 1) AS region, regexp_extract(tile_id, 'x([0-9]+)_', 1)::INT AS ix, regexp_extract(tile_id, '_y([0-9]+)$', 1)::INT AS iy FROM detections WHERE tile_id <> ''")
def ref_parse_tiles(spark, sf):
    r, x, y = parse_tile_id("tile_id")
    return read(spark, sf, "detections", "tile_id").where("tile_id <> ''").distinct().select("tile_id", r.alias("region"), x.alias("ix"), y.alias("iy"))


def _albers_xy() -> tuple[str, str]:
    """The projection of (lon, lat) as SQL."""
    e = math.sqrt(GRS80_E2)
    q = lambda s: (1 - e * e) * (s / (1 - e * e * s * s) - 1 / (2 * e) * math.log((1 - e * s) / (1 + e * s)))
    s0, s1, s2 = (math.sin(math.radians(v)) for v in (23.0, 29.5, 45.5))
    m1, m2 = ((1 - s * s) / (1 - e * e * s * s) for s in (s1, s2))
    n = (m1 - m2) / (q(s2) - q(s1))
    c = m1 + n * q(s1)
    r0 = GRS80_A * math.sqrt(c - n * q(s0)) / n
    ql = f"(1 - {e * e!r}) * (sin(radians(lat)) / (1 - {e * e!r} * pow(sin(radians(lat)), 2)) - 1 / (2 * {e!r}) * ln((1 - {e!r} * sin(radians(lat))) / (1 + {e!r} * sin(radians(lat)))))"
    rho, a = f"({GRS80_A} * sqrt({c!r} - {n!r} * ({ql})) / {n!r})", f"({n!r} * radians(lon + 96 - 360 * floor((lon + 276) / 360.0)))"
    return f"({rho} * sin({a}))", f"({r0!r} - {rho} * cos({a}))"


def _albers_sql() -> str:
    x, y = _albers_xy()
    return f"WITH {sql_det('lon', 'lat')} SELECT det_id, round({x}, 2) AS px, round({y}, 2) AS py FROM d WHERE lon IS NOT NULL AND lat IS NOT NULL"


@query("ref_project", _albers_sql())
def ref_project(spark, sf):
    x, y = project("lon", "lat", "EPSG:5070")
    return det(spark, sf, "lon", "lat").where("lon IS NOT NULL AND lat IS NOT NULL").select("det_id", r6(x, "px", 2), r6(y, "py", 2))


_CONF = " ".join(f"WHEN {k} THEN {v}" for k, v in codes.MASK_CONFIDENCE.items())
_MEAN = " ".join(f"WHEN {k} THEN '{v}'" for k, v in codes.MASK_MEANING.items())


@query("ref_mask", f"WITH {sql_det('mask_code', 'frp_mw')} SELECT det_id, CASE mask_code {_CONF} ELSE 0.5 END::DOUBLE AS conf, CASE mask_code {_MEAN} END AS meaning, mask_code IN (10, 11, 13, 30, 31, 33) AS high, round(CASE WHEN mask_code NOT IN (11, 12, 31, 32) THEN frp_mw END::DOUBLE, 4) AS frp FROM d")
def ref_mask(spark, sf):
    return det(spark, sf, "mask_code", "frp_mw").select("det_id", codes.mask_confidence("mask_code").cast("double").alias("conf"), codes.mask_meaning("mask_code").alias("meaning"), codes.is_fire_code("mask_code", True).alias("high"), r6(codes.reliable_frp("frp_mw", "mask_code"), "frp", 4))


@query("ref_mask_summary", f"WITH {sql_det('mask_code')} SELECT CASE mask_code {_MEAN} END AS meaning, count(*) AS n FROM d WHERE mask_code IN ({', '.join(map(str, codes.MASK_MEANING))}) GROUP BY 1")
def ref_mask_summary(spark, sf):
    return codes.mask_summary(det(spark, sf, "mask_code"))


@query("ref_granules", "WITH g AS (SELECT granule_key, regexp_extract(granule_key, 's([0-9]{13})[0-9]*_', 1) AS s, count(*) AS n FROM (SELECT DISTINCT det_id, granule_key FROM detections) WHERE granule_key IS NOT NULL GROUP BY 1, 2) SELECT granule_key, n, strptime(substr(s, 1, 4) || '-01-01 ' || substr(s, 8, 6), '%Y-%m-%d %H%M%S') + to_days(substr(s, 5, 3)::INT - 1) AS scan_start, 'goes' || regexp_extract(granule_key, '/g([0-9]{2})/', 1) AS sensor FROM g")
def ref_granules(spark, sf):
    g = det(spark, sf, "granule_key").where("granule_key IS NOT NULL").groupBy("granule_key").agg(F.count("*").alias("n"))
    return g.select("granule_key", "n", ntz(codes.granule_start("granule_key")).alias("scan_start"), codes.sensor_from_granule("granule_key").alias("sensor"))


_FIRMS = """f0 AS (SELECT DISTINCT * FROM firms), f1 AS (SELECT *, TRY_CAST(trim(longitude) AS DOUBLE) AS x0, TRY_CAST(trim(latitude) AS DOUBLE) AS y0, replace(replace(trim(acq_date), '/', ''), '-', '') AS dd, trim(acq_time) AS c FROM f0),
f2 AS (SELECT *, CASE WHEN c LIKE '%:%' THEN lpad(replace(c, ':', ''), 4, '0') WHEN regexp_full_match(c, '[0-9]{1,4}') THEN lpad(c, 4, '0') END AS hm FROM f1 WHERE x0 BETWEEN -180 AND 360 AND y0 BETWEEN -90 AND 90),
f AS (SELECT firms_id, CASE WHEN x0 > 180 THEN x0 - 360 ELSE x0 END AS lon, y0 AS lat, TRY_STRPTIME(dd || hm, '%Y%m%d%H%M') AS t, TRY_CAST(trim(bright_ti4) AS DOUBLE) AS bt_mir_k, TRY_CAST(trim(frp) AS DOUBLE) AS frp_mw, instrument, confidence, upper(substr(daynight, 1, 1)) AS daynight FROM f2 WHERE regexp_full_match(hm, '([01][0-9]|2[0-3])[0-5][0-9]'))"""


def firm(spark, sf):
    return firms.records(read(spark, sf, "firms").dropDuplicates(["firms_id"]))


@query("ref_firms", f"WITH {_FIRMS} SELECT firms_id, lon, lat, t, bt_mir_k, frp_mw, daynight, CASE WHEN confidence = 'l' THEN 30 WHEN confidence = 'n' THEN 70 WHEN confidence = 'h' THEN 95 ELSE round_even(TRY_CAST(confidence AS DOUBLE), 0)::INT END AS pct FROM f WHERE t IS NOT NULL")
def ref_firms(spark, sf):
    return firm(spark, sf).select("firms_id", "lon", "lat", ntz("t").alias("t"), "bt_mir_k", "frp_mw", "daynight", codes.confidence_pct("confidence", False).alias("pct"))


@query("ref_firms_latest", f"""WITH {_FIRMS}, k AS (SELECT *, {_albers_xy()[0]} AS x, {_albers_xy()[1]} AS y FROM f WHERE t IS NOT NULL), m AS (SELECT instrument, max(t) AS n FROM k GROUP BY 1)
SELECT instrument, count(*) AS n, min(k.t) AS first_t, max(k.t) AS last_t FROM k JOIN m USING (instrument) WHERE k.t >= m.n - INTERVAL 24 HOUR AND floor((x + 2400000) / 96000) BETWEEN 0 AND 48 AND floor((y - 192000) / 96000) BETWEEN 0 AND 31 GROUP BY 1""")
def ref_firms_latest(spark, sf):
    d = firms.freshest(read(spark, sf, "firms").dropDuplicates(["firms_id"]))
    return d.groupBy("instrument").agg(F.count("*").alias("n"), ntz(F.min("t")).alias("first_t"), ntz(F.max("t")).alias("last_t"))


def _values(rows) -> str:
    text = lambda v: "NULL" if v is None else "'" + v + "'" if isinstance(v, str) else str(v)
    return "VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)


@query("ref_platforms", f"WITH p(platform, name, sensor, status, a, b, bias) AS ({_values([(k, *v) for k, v in codes.PLATFORMS.items()])}), s(sensor, kind) AS ({_values([(k, v[0]) for k, v in codes.SENSORS.items()])}) SELECT platform, name, sensor, kind, status FROM p JOIN s USING (sensor) WHERE coalesce(a, '2000-01-01') <= '2026-06-01' AND (b IS NULL OR b > '2026-06-01') AND status NOT IN ('planned', 'retired')")
def ref_platforms(spark, sf):
    import datetime as dt

    return codes.active_platforms(spark, dt.date(2026, 6, 1)).select("platform", "name", "sensor", "kind", "status")


@query("ref_window", f"WITH {sql_det('t', 'lon', 'lat')} SELECT min(t)::DATE AS start_date, max(t)::DATE AS end_date, date_diff('day', min(t)::DATE, max(t)::DATE) + 1 AS n_days, min(lon) - 0.25 AS west, min(lat) - 0.25 AS south, max(lon) + 0.25 AS east, max(lat) + 0.25 AS north, count(*) AS n_detections FROM d")
def ref_window(spark, sf):
    return store.window_summary(det(spark, sf, "t", "lon", "lat"))


@query("ref_region", f"WITH {sql_det('t', 'lon', 'lat', 'frp_mw')}, m AS (SELECT max(t) AS n FROM d) SELECT det_id, round(frp_mw::DOUBLE, 4) AS frp FROM d, m WHERE lon BETWEEN -124.6 AND -114.0 AND lat BETWEEN 32.0 AND 42.3 AND t >= m.n - INTERVAL 168 HOUR")
def ref_region(spark, sf):
    return serving.region_window(det(spark, sf, "t", "lon", "lat", "frp_mw"), "california", 7).select("det_id", r6(F.col("frp_mw"), "frp", 4))


@query("ref_strongest", f"WITH {sql_det('frp_mw')} SELECT det_id, round(frp_mw::DOUBLE, 4) AS frp FROM d ORDER BY coalesce(frp_mw, 0) DESC, det_id LIMIT 5000")
def ref_strongest(spark, sf):
    return serving.strongest(det(spark, sf, "frp_mw")).select("det_id", r6(F.col("frp_mw"), "frp", 4))


@query("ref_union", f"WITH {sql_det('t', 'lon', 'lat', 'frp_mw', 'confidence')}, {_FIRMS}, u AS (SELECT 'goes' AS sensor, lon, lat, frp_mw::DOUBLE AS frp_mw, t FROM d UNION ALL SELECT lower(coalesce(instrument, 'viirs')), lon, lat, frp_mw, t FROM f WHERE t IS NOT NULL) SELECT sensor, count(*) AS n, count(frp_mw) AS with_frp, round(max(frp_mw), 3) AS peak FROM u GROUP BY 1")
def ref_union(spark, sf):
    g = det(spark, sf, "t", "lon", "lat", "frp_mw", "confidence").withColumn("sensor", F.lit("goes"))
    f = firm(spark, sf).withColumn("sensor", F.lower(F.coalesce("instrument", F.lit("viirs"))))
    return serving.unioned(g, f).groupBy("sensor").agg(F.count("*").alias("n"), F.count("frp_mw").alias("with_frp"), r6(F.max(F.col("frp_mw").cast("double")), "peak", 3))


# --- series ---


@query("ref_coverage", f"""WITH {sql_det('t', 'satellite')}, u AS (SELECT satellite, t, count(*) AS c FROM d WHERE t IS NOT NULL GROUP BY 1, 2), g AS (SELECT *, CASE WHEN t - lag(t) OVER w <= INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS f FROM u WINDOW w AS (PARTITION BY satellite ORDER BY t)),
i AS (SELECT *, sum(f) OVER (PARTITION BY satellite ORDER BY t) AS i FROM g) SELECT satellite, min(t) AS lo, max(t) AS hi, sum(c)::BIGINT AS n FROM i GROUP BY satellite, i""")
def ref_coverage(spark, sf):
    c = series.coverage_intervals(det(spark, sf, "t", "satellite"), keys=["satellite"])
    return c.select("satellite", ntz("lo").alias("lo"), ntz("hi").alias("hi"), "n")


@query("ref_coverage_gaps", f"WITH {sql_det('t', 'satellite')}, u AS (SELECT DISTINCT satellite, t FROM d WHERE t IS NOT NULL), g AS (SELECT satellite, t AS gap_start, lead(t) OVER (PARTITION BY satellite ORDER BY t) AS gap_end FROM u) SELECT satellite, gap_start, gap_end, (epoch_us(gap_end) - epoch_us(gap_start)) / 1e6 AS gap_s FROM g WHERE gap_end - gap_start > INTERVAL 20 MINUTE")
def ref_coverage_gaps(spark, sf):
    g = series.coverage_gaps(series.coverage_intervals(det(spark, sf, "t", "satellite"), keys=["satellite"]), ["satellite"])
    return g.select("satellite", ntz("gap_start").alias("gap_start"), ntz("gap_end").alias("gap_end"), "gap_s")


@query("ref_cadence", f"WITH {sql_det('t', 'granule_key', 'satellite')}, g AS (SELECT satellite, granule_key, min(t) AS t FROM d WHERE t IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY satellite, floor(epoch_us(t) / 900000000) ORDER BY t, granule_key) AS i FROM g) SELECT satellite, granule_key, t FROM r WHERE i = 1")
def ref_cadence(spark, sf):
    g = det(spark, sf, "t", "granule_key", "satellite").where("t IS NOT NULL").groupBy("satellite", "granule_key").agg(F.min("t").alias("t"))
    return series.cadence_thinned(g, 15, keys=["satellite"]).select("satellite", "granule_key", ntz("t").alias("t"))


@query("ref_thinned", f"WITH {sql_det('t', 'lon', 'lat')}, r AS (SELECT det_id, row_number() OVER (PARTITION BY round_even(lon / 0.02, 0), round_even(lat / 0.02, 0), floor(epoch_us(t) / 3600000000) ORDER BY t, det_id) AS i FROM d WHERE lon IS NOT NULL AND lat IS NOT NULL AND t IS NOT NULL) SELECT det_id FROM r WHERE i = 1")
def ref_thinned(spark, sf):
    return linking.thinned(det(spark, sf, "t", "lon", "lat")).select("det_id")


_BIN = "floor(hour(t) + minute(t) / 60.0 + second(t) / 3600.0)::INT % 24"


def _temps(spark, sf):
    return det(spark, sf, "pixel_id", "t", "temp_k").where("temp_k BETWEEN 150 AND 2000 AND t IS NOT NULL")


_TEMPS = f"{sql_det('pixel_id', 't', 'temp_k')}, q AS (SELECT det_id, pixel_id, t, temp_k::DOUBLE AS v, {_BIN} AS bin FROM d WHERE temp_k BETWEEN 150 AND 2000 AND t IS NOT NULL)"


@query("ref_climatology", f"WITH {_TEMPS} SELECT pixel_id, bin, count(*) AS n, round(avg(v), 6) AS mean, (var_pop(v) * count(*))::REAL::DOUBLE AS m2, var_samp(v)::REAL::DOUBLE AS variance FROM q GROUP BY 1, 2")
def ref_climatology(spark, sf):
    c = series.climatology_readout(series.climatology(_temps(spark, sf), ["pixel_id"], "temp_k"))
    return c.select("pixel_id", "bin", "n", r6(F.col("mean"), "mean"), r32(F.col("m2"), "m2"), r32(F.col("variance"), "variance"))


@query("ref_climatology_merge", f"WITH {_TEMPS} SELECT pixel_id, bin, count(*) AS n, round(avg(v), 6) AS mean, (var_pop(v) * count(*))::REAL::DOUBLE AS m2 FROM q GROUP BY 1, 2")
def ref_climatology_merge(spark, sf):
    """The state of two halves, merged: equal to the state of all."""
    t = _temps(spark, sf)
    half = lambda r: series.climatology(t.where(F.col("det_id") % 2 == r), ["pixel_id"], "temp_k")
    m = series.merged_climatology(half(0).unionByName(half(1)), ["pixel_id"])
    return m.select("pixel_id", "bin", "n", r6(F.col("mean"), "mean"), r32(F.col("m2"), "m2"))


@query("ref_amplitude", f"WITH {_TEMPS}, m AS (SELECT pixel_id, bin, avg(v) AS m FROM q GROUP BY 1, 2), a AS (SELECT max(m) - min(m) AS a FROM m GROUP BY pixel_id HAVING count(*) >= 8) SELECT count(*) AS n_series, round(quantile_cont(a, 0.25), 6) AS p25, round(quantile_cont(a, 0.5), 6) AS median, round(quantile_cont(a, 0.9), 6) AS p90 FROM a")
def ref_amplitude(spark, sf):
    a = series.diurnal_amplitude(series.climatology(_temps(spark, sf), ["pixel_id"], "temp_k"), ["pixel_id"])
    return a.select("n_series", *(r6(F.col(c), c) for c in ("p25", "median", "p90")))


@query("ref_residuals", f"WITH {_TEMPS} SELECT det_id, round(v - avg(v) OVER (PARTITION BY pixel_id, bin), 5) AS residual FROM q")
def ref_residuals(spark, sf):
    return series.hourly_residuals(_temps(spark, sf).withColumn("temp_k", F.col("temp_k").cast("double")), ["pixel_id"], "temp_k").select("det_id", r6(F.col("residual"), "residual", 5))


@query("ref_persistent", f"""WITH {_TEMPS}, i AS (SELECT *, row_number() OVER (PARTITION BY pixel_id ORDER BY t, det_id) AS idx, v > 600 AS e FROM q), r AS (SELECT pixel_id, idx, min(e::INT) OVER w AS m, count(*) OVER w AS c FROM i WINDOW w AS (PARTITION BY pixel_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT pixel_id, min(CASE WHEN m = 1 AND c = 3 THEN idx END)::INT AS first FROM r GROUP BY 1""")
def ref_persistent(spark, sf):
    from pyspark.sql.window import Window as W

    d = _temps(spark, sf).withColumn("idx", F.row_number().over(W.partitionBy("pixel_id").orderBy("t", "det_id"))).withColumn("e", F.col("temp_k") > 600)
    return series.first_persistent(d, ["pixel_id"], "idx", "e")


@query("ref_far_threshold", f"WITH {_TEMPS}, a AS (SELECT quantile_cont(v, 0.99) AS a FROM q), g AS (SELECT bin, count(*) AS n, quantile_cont(v, 0.99) AS o FROM q GROUP BY 1) SELECT bin, round(CASE WHEN n >= 100 THEN o ELSE a END, 5) AS threshold FROM g, a")
def ref_far_threshold(spark, sf):
    d = _temps(spark, sf).select(F.col("temp_k").cast("double").alias("v"), series.hour_bin("t").alias("bin"))
    return series.far_threshold(d, "v", 0.01, ["bin"]).select("bin", r6(F.col("threshold"), "threshold", 5))


@query("ref_harmonics")
def ref_harmonics(spark, sf):
    d = series.harmonic_fit(_temps(spark, sf).withColumn("temp_k", F.col("temp_k").cast("double")), ["pixel_id"], "temp_k", order=1)
    return d.select("pixel_id", *(r6(F.get("coef", F.lit(i)), f"c{i}", 3) for i in range(3)))


@query("ref_hourly", f"WITH {sql_det('t', 'satellite', 'frp_mw')} SELECT satellite, date_trunc('hour', t) AS start, count(*) AS n, round(sum(frp_mw::DOUBLE), 2) AS total, round(max(frp_mw)::DOUBLE, 4) AS peak FROM d WHERE t IS NOT NULL GROUP BY 1, 2")
def ref_hourly(spark, sf):
    from cindral.streaming.nrt import hourly

    d = det(spark, sf, "t", "satellite", "frp_mw").where("t IS NOT NULL").withColumn("frp_mw", F.col("frp_mw").cast("double"))
    return hourly(d, ["satellite"]).select("satellite", ntz("start").alias("start"), "n", r6(F.col("total"), "total", 2), r6(F.col("peak"), "peak", 4))


@query("ref_sessions", f"""WITH {sql_det('t', 'pixel_id', 'frp_mw')}, g AS (SELECT *, CASE WHEN t - lag(t) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS f FROM d WHERE t IS NOT NULL AND pixel_id IS NOT NULL WINDOW w AS (PARTITION BY pixel_id ORDER BY t)),
i AS (SELECT *, sum(f) OVER (PARTITION BY pixel_id ORDER BY t) AS i FROM g) SELECT pixel_id, min(t) AS start, max(t) + INTERVAL 12 HOUR AS "end", count(*) AS n, round(max(frp_mw)::DOUBLE, 4) AS peak FROM i GROUP BY pixel_id, i""")
def ref_sessions(spark, sf):
    from cindral.streaming.nrt import sessions

    s = sessions(det(spark, sf, "t", "pixel_id", "frp_mw").where("t IS NOT NULL AND pixel_id IS NOT NULL"), ["pixel_id"])
    return s.select("pixel_id", ntz("start").alias("start"), ntz("end").alias("end"), "n", r6(F.col("peak"), "peak", 4))


# --- linking ---

GAP_S = 3 * 3600.0
_TOL = "6000.0"


def _placed(spark, sf):
    d = det(spark, sf, "t", "x", "y", "lon", "lat", "frp_mw", "view_zenith_deg", "confidence").where("x IS NOT NULL AND y IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL AND t IS NOT NULL")
    return d.withColumn("sensor", F.lit("goes")).withColumn("tolerance_m", geometry.tolerance_m(F.lit("goes")))


def events(spark, sf):
    """All detections with place and time, with their fire event (flat tolerances, three hours)."""
    return linking.clustered(_placed(spark, sf), max_gap_s=GAP_S)


def _thinned_events(spark, sf):
    return linking.clustered(linking.thinned(_placed(spark, sf)), max_gap_s=GAP_S)


_EVENTS = f"""{sql_det('t', 'x', 'y', 'lon', 'lat', 'frp_mw', 'view_zenith_deg', 'confidence')}, th AS (SELECT *, row_number() OVER (PARTITION BY round_even(lon / 0.02, 0), round_even(lat / 0.02, 0), floor(epoch_us(t) / 3600000000) ORDER BY t, det_id) AS i FROM d WHERE x IS NOT NULL AND y IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL AND t IS NOT NULL),
e AS (SELECT *, floor(x / {_TOL})::BIGINT AS cx, floor(y / {_TOL})::BIGINT AS cy FROM th WHERE i = 1), nb AS (SELECT *, unnest([-1, 0, 1]) AS dx FROM e), nn AS (SELECT *, unnest([-1, 0, 1]) AS dy FROM nb),
lk AS (SELECT a.det_id AS a, b.det_id AS b FROM nn a JOIN e b ON b.cx = a.cx + a.dx AND b.cy = a.cy + a.dy WHERE a.det_id <> b.det_id AND abs(epoch_us(a.t) - epoch_us(b.t)) <= {int(GAP_S * 1e6)} AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= {_TOL} * {_TOL}),
cc(det_id, root) USING KEY (det_id) AS (SELECT det_id, det_id FROM e UNION SELECT n.det_id, n.g FROM (SELECT l.a AS det_id, min(c.root) AS g FROM cc c JOIN lk l ON l.b = c.det_id GROUP BY l.a) n JOIN recurring.cc r ON r.det_id = n.det_id WHERE n.g < r.root)"""


_ALL_EVENTS = _EVENTS.replace("FROM th WHERE i = 1", "FROM th")


@query("ref_events", f"WITH RECURSIVE {_ALL_EVENTS} SELECT det_id, root FROM cc")
def ref_events(spark, sf):
    return events(spark, sf).select("det_id", "root")


_FEATURES = """WITH RECURSIVE {events}, g AS (SELECT root, t, x, y, frp_mw::DOUBLE AS f, view_zenith_deg::DOUBLE AS v, confidence::DOUBLE AS c, epoch_us(t) / 3.6e9 AS h, CASE WHEN frp_mw IS NOT NULL THEN epoch_us(t) / 3.6e9 END AS hf FROM cc JOIN e USING (det_id))
SELECT root, count(*) AS n_detections, round(max(h) - min(h), 4) AS duration_h, round(max(f), 4) AS peak_frp_mw, round(sum(f) + 1e-5, 3) AS total_frp_mw, round(CASE WHEN count(f) >= 3 AND max(hf) - min(hf) >= 0.5 THEN regr_slope(f, hf - 415000) + 1e-5 END, 2) AS growth,
  round(avg(v) + 1e-7, 5) AS mean_view_zenith_deg, round(avg(c) + 1e-7, 5) AS mean_confidence, round(sqrt(var_pop(x) + var_pop(y)) + 1e-4, 1) AS spread, round(avg(x) + 1e-4, 2) AS centroid_x, round(avg(y) + 1e-4, 2) AS centroid_y FROM g GROUP BY 1"""


@query("ref_event_features", _FEATURES.replace("{events}", _ALL_EVENTS))
def ref_event_features(spark, sf):
    return _features(events(spark, sf))


def _features(e):
    f = linking.event_features(e)
    return f.select("root", "n_detections", r6(F.col("duration_h"), "duration_h", 4), r6(F.col("peak_frp_mw"), "peak_frp_mw", 4), r6(F.col("total_frp_mw") + 1e-5, "total_frp_mw", 3), r6(F.col("frp_growth_mw_per_h") + 1e-5, "growth", 2), r6(F.col("mean_view_zenith_deg") + 1e-7, "mean_view_zenith_deg", 5), r6(F.col("mean_confidence") + 1e-7, "mean_confidence", 5), r6(F.col("spatial_spread_m") + 1e-4, "spread", 1), r6(F.col("centroid_x") + 1e-4, "centroid_x", 2), r6(F.col("centroid_y") + 1e-4, "centroid_y", 2))


@query("ref_events_thinned", f"WITH RECURSIVE {_EVENTS} SELECT det_id, root FROM cc")
def ref_events_thinned(spark, sf):
    """Events of the first detection of each 0.02-degree cell and hour, as the reference's evaluation thins them."""
    return _thinned_events(spark, sf).select("det_id", "root")


@query("ref_event_features_thinned", _FEATURES.replace("{events}", _EVENTS))
def ref_event_features_thinned(spark, sf):
    return _features(_thinned_events(spark, sf))


@query("ref_event_records")
def ref_event_records(spark, sf):
    e = serving.event_records(events(spark, sf))
    return e.select("event_id", "root", "n_detections", r6(F.col("frp_max"), "frp_max", 3), "footprint_ha", "perimeter_km", F.size("ring").alias("corners"), ntz("first_seen").alias("first_seen"), ntz("last_seen").alias("last_seen"), "sensors")


def _firms_xy(spark, sf):
    return firms.detections(read(spark, sf, "firms").dropDuplicates(["firms_id"]))


@query("ref_event_matches")
def ref_event_matches(spark, sf):
    """One-to-one matches between events of the two sources."""
    a = linking.event_features(events(spark, sf)).select(F.col("root").alias("event_id"), F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y"), "start", "end")
    v = _firms_xy(spark, sf).withColumn("tolerance_m", geometry.tolerance_m(F.col("sensor")))
    b = linking.event_features(linking.clustered(v, "firms_id", max_gap_s=GAP_S)).select(F.col("root").alias("event_id"), F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y"), "start", "end")
    m = linking.matched_one_to_one(linking.candidate_matches(cut(a), cut(b), 6000.0, 180 * 60))
    return m.select("pred_id", "truth_id", r6(F.col("distance_m"), "distance_m", 2), r6(F.col("lead_min"), "lead_min", 3))


_CO = f"""{sql_det('t', 'x', 'y')}, {_FIRMS}"""


@query("ref_coincidence", f"""WITH {_CO}, v AS (SELECT firms_id, {_albers_xy()[0]} AS x, {_albers_xy()[1]} AS y, epoch_us(t) AS u FROM f WHERE t IS NOT NULL), g AS (SELECT det_id, x, y, epoch_us(t) AS u FROM d WHERE x IS NOT NULL AND y IS NOT NULL AND t IS NOT NULL),
box AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM d), i AS (SELECT v.* FROM v, box WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1), st(dx, dy) AS (SELECT a, b FROM range(-1, 2) p(a), range(-1, 2) q(b)), sz(s) AS (VALUES (2000.0), (4000.0), (50000.0)),
gb AS (SELECT DISTINCT s, floor(x / s) AS cx, floor(y / s) AS cy, u FROM g, sz), vb AS (SELECT DISTINCT s, floor(x / s) AS cx, floor(y / s) AS cy, u FROM v, sz),
h AS (SELECT a.s, firms_id, min(abs(a.u - gb.u)) / 6e7 AS gap FROM (SELECT s, firms_id, u, floor(x / s) + dx AS cx, floor(y / s) + dy AS cy FROM i, sz, st WHERE s < 50000) a JOIN gb ON gb.s = a.s AND gb.cx = a.cx AND gb.cy = a.cy WHERE abs(a.u - gb.u) <= 1800000000 GROUP BY 1, 2),
w AS (SELECT DISTINCT a.s, det_id FROM (SELECT s, det_id, u, floor(x / s) + dx AS cx, floor(y / s) + dy AS cy FROM g, sz, st) a JOIN vb ON vb.s = a.s AND vb.cx = a.cx AND vb.cy = a.cy WHERE abs(a.u - vb.u) <= 1800000000),
e AS (SELECT f.s, count(*) AS n, count(k.det_id) AS tp FROM (SELECT s, det_id FROM (SELECT det_id FROM w WHERE s = 50000), sz WHERE sz.s < 50000) f LEFT JOIN w k ON k.s = f.s AND k.det_id = f.det_id GROUP BY 1)
SELECT e.s::DOUBLE AS cell_m, (SELECT count(*) FROM i) AS n_viirs, (SELECT count(*) FROM h WHERE h.s = e.s) AS tp, round((SELECT quantile_cont(gap, 0.5) FROM h WHERE h.s = e.s), 6) AS median_gap_min, round((SELECT count(*) FROM h WHERE h.s = e.s) / (SELECT count(*) FROM i), 6) AS pod, n AS n_evaluable, tp AS tp_goes, n - tp AS fp, round(tp / n, 6) AS precision, round((n - tp) / n, 6) AS far FROM e""")
def ref_coincidence(spark, sf):
    """Share of polar detections that the geostationary source saw within a cell and half an hour, at two cell sizes."""
    g, v = cut(det(spark, sf, "t", "x", "y")), cut(_firms_xy(spark, sf))
    out, seen = None, cut(linking.coincidence(g, v, "det_id", 50_000.0, 1800.0))
    for size in (2000.0, 4000.0):
        c = linking.coincidence_scores(g, v, "firms_id", size).crossJoin(linking.precision_far_scores(g, v, "det_id", size, seen=seen).withColumnRenamed("tp", "tp_goes")).withColumn("cell_m", F.lit(size))
        out = c if out is None else out.unionByName(c)
    return out.select("cell_m", "n_viirs", "tp", r6(F.col("median_gap_min"), "median_gap_min"), r6(F.col("pod"), "pod"), "n_evaluable", "tp_goes", "fp", r6(F.col("precision"), "precision"), r6(F.col("far"), "far"))


@query("ref_self_coincidence", f"""WITH {sql_det('t', 'x', 'y', 'satellite')}, k AS (SELECT *, floor(x / 4000)::BIGINT AS cx, floor(y / 4000)::BIGINT AS cy FROM d WHERE t IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL), a AS (SELECT *, unnest([-1, 0, 1]) AS dx FROM k WHERE satellite = 'goes19'), b AS (SELECT *, unnest([-1, 0, 1]) AS dy FROM a)
SELECT b.det_id, min(abs(epoch_us(b.t) - epoch_us(k.t))) / 1e6 AS gap_s FROM b JOIN k ON k.cx = b.cx + b.dx AND k.cy = b.cy + b.dy AND k.satellite = 'goes18' WHERE abs(epoch_us(b.t) - epoch_us(k.t)) <= 1800000000 GROUP BY 1""")
def ref_self_coincidence(spark, sf):
    d = det(spark, sf, "t", "x", "y", "satellite")
    return linking.coincidence(d.where("satellite = 'goes19'"), d.where("satellite = 'goes18'"), "det_id", 4000.0, 1800.0)


@query("ref_cohort", f"""WITH {sql_det('t', 'lon', 'lat', 'frp_mw')}, q AS (SELECT *, round_even(lon / 0.25, 0)::INT AS gx, round_even(lat / 0.25, 0)::INT AS gy FROM d WHERE lon IS NOT NULL AND lat IS NOT NULL AND t IS NOT NULL), d0 AS (SELECT min(t) AS d0 FROM q),
f AS (SELECT gx, gy, min(t) AS ign, count(*) AS n, avg(lon) AS lon FROM q GROUP BY 1, 2 HAVING count(*) >= 50), f2 AS (SELECT f.* FROM f, d0 WHERE (epoch_us(ign) - epoch_us(d0)) / 3.6e9 >= 30),
s AS (SELECT q.gx, q.gy, regr_slope(coalesce(frp_mw, 0)::DOUBLE, (epoch_us(t) - epoch_us(ign)) / 3.6e9) AS slope FROM q JOIN f2 USING (gx, gy) WHERE (epoch_us(t) - epoch_us(ign)) / 3.6e9 <= 2 GROUP BY 1, 2),
l AS (SELECT *, (hour(ign) + minute(ign) / 60.0 + lon / 15) - 24 * floor((hour(ign) + minute(ign) / 60.0 + lon / 15) / 24) AS lst FROM f2 JOIN s USING (gx, gy)),
c AS (SELECT *, CASE WHEN (lst >= 20 OR lst < 6) AND abs(slope) <= 200 THEN 'night_coldstart' WHEN NOT (lst >= 20 OR lst < 6) THEN 'day' END AS stratum FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY abs(slope) ASC NULLS LAST, n DESC, gx, gy) AS rank FROM c WHERE stratum IS NOT NULL)
SELECT stratum, rank::INT AS rank, gx, gy, n AS n_detections, round(lst, 5) AS lst FROM r WHERE rank <= 3""")
def ref_cohort(spark, sf):
    return series.fire_cohort(det(spark, sf, "t", "lon", "lat", "frp_mw")).select("stratum", "rank", "gx", "gy", "n_detections", r6(F.col("local_solar_hour"), "lst", 5))


# --- scores ---


def _labelled(spark, sf):
    """Truth: the retrieved temperature is above 600 K. Score: the code's confidence. Only readable rows."""
    d = det(spark, sf, "temp_k", "confidence", "frp_mw").where("temp_k BETWEEN 150 AND 2000 AND confidence IS NOT NULL")
    return d.select("det_id", (F.col("temp_k") > 600).cast("int").alias("y"), F.col("confidence").cast("double").alias("p"), F.col("temp_k").cast("double").alias("v"), F.col("frp_mw").cast("double").alias("f"))


_LAB = f"{sql_det('temp_k', 'confidence', 'frp_mw')}, q AS (SELECT det_id, (temp_k > 600)::INT AS y, confidence::DOUBLE AS p, temp_k::DOUBLE AS v, frp_mw::DOUBLE AS f FROM d WHERE temp_k BETWEEN 150 AND 2000 AND confidence IS NOT NULL)"


@query("ref_confusion", f"WITH {_LAB}, c AS (SELECT count(*) FILTER (y = 1 AND p > 0.7) AS tp, count(*) FILTER (y = 0 AND p > 0.7) AS fp, count(*) FILTER (y = 1 AND p <= 0.7) AS fn, count(*) FILTER (y = 0 AND p <= 0.7) AS tn FROM q) SELECT tp, fp, fn, tn, round(tp / (tp + fp), 8) AS precision, round(tp / (tp + fn), 8) AS recall, round(2 * tp / (2 * tp + fp + fn), 8) AS f1, round(tp / (tp + fp + fn), 8) AS iou, round((tp + fp) / (tp + fn), 8) AS area_ratio FROM c")
def ref_confusion(spark, sf):
    c = scores.ratios(scores.confusion(_labelled(spark, sf).withColumn("c", (F.col("p") > 0.7).cast("int")), "y", "c"))
    return c.select("tp", "fp", "fn", "tn", *(r6(F.col(n), n, 8) for n in ("precision", "recall", "f1", "iou", "area_ratio")))


@query("ref_average_precision", f"WITH {_LAB}, w AS (SELECT y, sum(y) OVER (ORDER BY v DESC, det_id ROWS UNBOUNDED PRECEDING) AS tp, row_number() OVER (ORDER BY v DESC, det_id) AS k FROM (SELECT det_id, (p > 0.7)::INT AS y, v FROM q)) SELECT round(sum(y * tp / k) / sum(y), 8) AS average_precision FROM w")
def ref_average_precision(spark, sf):
    d = _labelled(spark, sf).withColumn("y", (F.col("p") > 0.7).cast("int"))
    return scores.average_precision(d, "y", "v", "det_id").select(r6(F.col("average_precision"), "average_precision", 8))


@query("ref_probability_scores", f"WITH {_LAB} SELECT count(*) AS n, round(avg(y), 8) AS base_rate, round(avg(pow(p - y, 2)), 8) AS brier, round(-avg(y * ln(greatest(1e-15, least(1 - 1e-15, p))) + (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15, p)))), 8) AS log_loss FROM q")
def ref_probability_scores(spark, sf):
    return scores.probability_scores(_labelled(spark, sf), "y", "p").select("n", *(r6(F.col(n), n, 8) for n in ("base_rate", "brier", "log_loss")))


@query("ref_reliability", f"WITH {_LAB}, b AS (SELECT least(9, floor(p * 10 + 1e-9))::INT AS bin, y, p FROM q) SELECT bin, count(*) AS n, round(avg(p), 8) AS mean_pred, round(avg(y), 8) AS obs_freq FROM b GROUP BY 1")
def ref_reliability(spark, sf):
    d = _labelled(spark, sf).withColumn("p", F.col("p") + 1e-9)
    return scores.reliability(d, "y", "p", equal_mass=False).select("bin", "n", r6(F.col("mean_pred") - 1e-9, "mean_pred", 8), r6(F.col("obs_freq"), "obs_freq", 8))


@query("ref_calibration", f"""WITH {_LAB}, s AS (SELECT y, 1 / (1 + exp(-(v - 600) / 100)) AS p FROM q), e AS (SELECT list_sort(list_distinct(quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM s), b AS (SELECT y, p, len(list_filter(e[2:len(e) - 1], lambda z: z <= p)) AS b FROM s, e),
g AS (SELECT b, count(*) AS n, avg(p) AS m, avg(y) AS o FROM b GROUP BY 1) SELECT round(sum(n * abs(m - o)) / sum(n), 8) AS ece FROM g""")
def ref_calibration(spark, sf):
    d = _labelled(spark, sf).withColumn("p", 1 / (1 + F.exp(-(F.col("v") - 600) / 100)))
    return scores.calibration_error(d, "y", "p").select(r6(F.col("ece"), "ece", 8))


@query("ref_brier_parts", f"""WITH {_LAB}, b AS (SELECT least(9, floor(p * 10 + 1e-9))::INT AS b, y, p FROM q), g AS (SELECT count(*) AS n, avg(p) AS m, avg(y) AS o FROM b GROUP BY b), t AS (SELECT sum(n) AS n, sum(n * o) / sum(n) AS base FROM g)
SELECT round(sum(g.n * pow(m - o, 2)) / any_value(t.n), 8) AS reliability, round(sum(g.n * pow(o - base, 2)) / any_value(t.n), 8) AS resolution, round(any_value(base * (1 - base)), 8) AS uncertainty FROM g, t""")
def ref_brier_parts(spark, sf):
    d = _labelled(spark, sf).withColumn("p", F.col("p") + 1e-9)
    return scores.brier_decomposition(d, "y", "p").select(*(r6(F.col(n), n, 8) for n in ("reliability", "resolution", "uncertainty")))


@query("ref_quantile_scores", f"WITH {_LAB}, h AS (SELECT f, 20.0 AS q1, 50.0 AS q5, 150.0 AS q9 FROM q WHERE f BETWEEN 0 AND 100000) SELECT round(2 * (avg(greatest(0.1 * (f - q1), -0.9 * (f - q1))) + avg(greatest(0.5 * (f - q5), -0.5 * (f - q5))) + avg(greatest(0.9 * (f - q9), -0.1 * (f - q9)))) / 3, 5) AS crps FROM h")
def ref_quantile_scores(spark, sf):
    d = _labelled(spark, sf).where("f BETWEEN 0 AND 100000").withColumns({"q1": F.lit(20.0), "q5": F.lit(50.0), "q9": F.lit(150.0)})
    return scores.crps(d, "f", {0.1: "q1", 0.5: "q5", 0.9: "q9"}).select(r6(F.col("crps"), "crps", 5))


@query("ref_otsu", f"""WITH {_LAB}, l AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM q), h AS (SELECT lo, hi, least(255, floor((v - lo) * 256 / (hi - lo)))::INT AS b, count(*) AS n FROM q, l WHERE v BETWEEN lo AND hi GROUP BY 1, 2, 3),
c AS (SELECT *, lo + (b + 0.5) * (hi - lo) / 256 AS c FROM h), s AS (SELECT *, sum(n) OVER (ORDER BY b) / sum(n) OVER () AS w, sum(n * c) OVER (ORDER BY b) / sum(n) OVER () AS m, sum(n * c) OVER () / sum(n) OVER () AS g FROM c)
SELECT round(c, 6) AS threshold FROM s ORDER BY CASE WHEN w < 1 THEN pow(g * w - m, 2) / (w * (1 - w)) ELSE 0 END DESC, b LIMIT 1""")
def ref_otsu(spark, sf):
    return scores.otsu_threshold(_labelled(spark, sf), "v").select(r6(F.col("threshold"), "threshold"))


@query("ref_tuned", f"""WITH {_LAB}, l AS (SELECT min(v) AS lo, max(v) AS hi FROM q), c AS (SELECT i, lo + i * (hi - lo) / 199 AS t FROM l, range(200) r(i)), z AS (SELECT v, (p > 0.7)::INT AS y FROM q),
s AS (SELECT i, t, 2.0 * sum(y) FILTER (v > t) / (count(*) FILTER (v > t) + sum(y)) AS f1 FROM z, c GROUP BY 1, 2) SELECT round(t, 6) AS threshold, round(f1, 8) AS score FROM s WHERE f1 IS NOT NULL ORDER BY f1 DESC, i LIMIT 1""")
def ref_tuned(spark, sf):
    d = _labelled(spark, sf).withColumn("y", (F.col("p") > 0.7).cast("int"))
    return scores.tuned_threshold(d, "v", "y").select(r6(F.col("threshold"), "threshold"), r6(F.col("score"), "score", 8))


@query("ref_areas", f"""WITH {_LAB}, z AS (SELECT (p > 0.7)::INT AS m, y AS r, count(*) AS n FROM q GROUP BY 1, 2), a(m, a) AS (VALUES (0, 200000.0), (1, 20000.0)), i AS (SELECT m, sum(n) AS ni FROM z GROUP BY 1),
k AS (SELECT z.*, ni, a / 220000.0 AS w FROM z JOIN i USING (m) JOIN a USING (m)) SELECT r AS class, round(220000 * sum(w * n / ni), 3) AS adjusted_area, round(220000 * sqrt(sum(w * w * n / ni * (1 - n / ni) / (ni - 1))), 4) AS standard_error FROM k GROUP BY 1""")
def ref_areas(spark, sf):
    c = _labelled(spark, sf).groupBy((F.col("p") > 0.7).cast("int").alias("map_class"), F.col("y").alias("ref_class")).agg(F.count("*").alias("n"))
    a = spark.createDataFrame([(0, 200000.0), (1, 20000.0)], "map_class int, mapped_area double")
    return scores.estimate_areas(c, a).select("class", r6(F.col("adjusted_area"), "adjusted_area", 3), r6(F.col("standard_error"), "standard_error", 4))


@query("ref_robust_scale", f"WITH {_LAB}, m AS (SELECT y, quantile_cont(v, 0.5) AS c FROM q GROUP BY 1) SELECT q.y, round(any_value(c), 6) AS center, round(1.4826 * quantile_cont(abs(v - c), 0.5), 6) AS scale FROM q JOIN m USING (y) GROUP BY 1")
def ref_robust_scale(spark, sf):
    return scores.robust_scale(_labelled(spark, sf), "v", ["y"]).select("y", r6(F.col("center"), "center"), r6(F.col("scale"), "scale"))


@query("ref_bootstrap")
def ref_bootstrap(spark, sf):
    """Paired difference of two scores over satellites and days."""
    d = det(spark, sf, "t", "satellite", "confidence", "temp_k").where("t IS NOT NULL AND confidence IS NOT NULL AND temp_k IS NOT NULL").groupBy("satellite", F.to_date("t").alias("day")).agg(F.avg("confidence").alias("a"), F.avg(F.col("temp_k") / 1000.0).alias("b"))
    return scores.paired_bootstrap(d.withColumn("k", F.concat_ws("/", "satellite", "day")), "a", "b", "k", 1000)


@query("ref_prior_correction", f"WITH {_LAB}, c AS (SELECT det_id, least(1 - 1e-12, greatest(1e-12, p)) AS p FROM q), o AS (SELECT det_id, p / (1 - p) * (0.02 / 0.98 * 0.75 / 0.25) AS o FROM c) SELECT det_id, round(o / (1 + o), 8) AS p FROM o")
def ref_prior_correction(spark, sf):
    return _labelled(spark, sf).select("det_id", r6(scores.rare_event_correction(F.col("p"), 0.02, 0.25), "p", 8))


@query("ref_temperature", f"WITH {_LAB}, t AS (SELECT exp(ln(0.2) + (ln(5.0) - ln(0.2)) * i / 48) AS t FROM range(49) r(i)), b AS (SELECT t, avg(pow(1 / (1 + exp(-ln(c / (1 - c)) / t)) - y, 2)) AS b FROM (SELECT y, greatest(1e-7, least(1 - 1e-7, p)) AS c FROM q), t GROUP BY 1) SELECT round(t, 6) AS temperature, round(b, 8) AS brier FROM b ORDER BY b, t LIMIT 1")
def ref_temperature(spark, sf):
    return scores.fit_temperature(_labelled(spark, sf), "y", "p").select(r6(F.col("temperature"), "temperature"), r6(F.col("brier"), "brier", 8))


@query("ref_climatology_baseline", f"WITH {sql_det('t', 'satellite', 'frp_mw')} SELECT satellite, round(avg(frp_mw::DOUBLE), 5) AS climatology FROM d WHERE t IS NOT NULL AND least((dayofyear(t) - 200 + 366) % 366, 366 - (dayofyear(t) - 200 + 366) % 366) <= 5 GROUP BY 1")
def ref_climatology_baseline(spark, sf):
    d = det(spark, sf, "t", "satellite", "frp_mw").where("t IS NOT NULL").withColumn("doy", F.dayofyear("t"))
    return scores.climatology_baseline(d, "doy", "frp_mw", 200, 5, by=["satellite"]).select("satellite", r6(F.col("climatology"), "climatology", 5))


# --- rasters ---

SPEC = RasterSpec.of(-125.0, 25.0, -65.0, 50.0, 0.5)


@query("ref_rasterized", f"WITH {sql_det('t', 'lon', 'lat')}, c AS (SELECT floor((50 - lat) / 25 * 50)::INT AS row, floor((lon + 125) / 60 * 120)::INT AS col, t FROM d WHERE lon IS NOT NULL AND t IS NOT NULL) SELECT row, col, min(t) AS first FROM c WHERE row BETWEEN 0 AND 49 AND col BETWEEN 0 AND 119 GROUP BY 1, 2")
def ref_rasterized(spark, sf):
    return raster.rasterized(det(spark, sf, "t", "lon", "lat"), SPEC).select("row", "col", ntz("first").alias("first"))


@query("ref_ignition_cells", f"WITH {sql_det('t', 'lon', 'lat')}, c AS (SELECT floor((50 - lat) / 25 * 50)::INT AS row, floor((lon + 125) / 60 * 120)::INT AS col, epoch_us(t) AS u FROM d WHERE lon IS NOT NULL AND t IS NOT NULL), r AS (SELECT row, col, min(u) AS u FROM c WHERE row BETWEEN 0 AND 49 AND col BETWEEN 0 AND 119 GROUP BY 1, 2), q AS (SELECT greatest(quantile_cont(u, 0.05), min(u)) AS q FROM r) SELECT row, col FROM r, q WHERE u <= q")
def ref_ignition_cells(spark, sf):
    r = raster.rasterized(det(spark, sf, "t", "lon", "lat"), SPEC).withColumn("u", F.unix_micros("first"))
    return raster.ignition_cells(r, "u").select("row", "col")


_ELEV = "(row * 7 + col * 13) % 101 + 0.5 * row"


def _dem(spark, rows: int = 400, cols: int = 600):
    return spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col")).withColumn("elev", ((F.col("row") * 7 + F.col("col") * 13) % 101 + 0.5 * F.col("row")).cast("double"))


@query("ref_elevation", f"""WITH {sql_det('x', 'y')}, p AS (SELECT det_id, (x + 2400000) / 8000 AS c, (3200000 - y) / 8000 AS r FROM d WHERE x IS NOT NULL AND y IS NOT NULL), f AS (SELECT det_id, floor(c)::INT AS c0, floor(r)::INT AS r0, c - floor(c) AS fc, r - floor(r) AS fr FROM p),
e AS (SELECT det_id, c0, r0, (1 - fr) * ((1 - fc) * ((r0 * 7 + c0 * 13) % 101 + 0.5 * r0) + fc * ((r0 * 7 + (c0 + 1) * 13) % 101 + 0.5 * r0)) + fr * ((1 - fc) * (((r0 + 1) * 7 + c0 * 13) % 101 + 0.5 * (r0 + 1)) + fc * (((r0 + 1) * 7 + (c0 + 1) * 13) % 101 + 0.5 * (r0 + 1))) AS v FROM f)
SELECT det_id, round(CASE WHEN c0 BETWEEN 0 AND 598 AND r0 BETWEEN 0 AND 398 THEN v + 1e-7 END, 5) AS elev FROM e""")
def ref_elevation(spark, sf):
    d = det(spark, sf, "x", "y").where("x IS NOT NULL AND y IS NOT NULL")
    return raster.sampled(d, _dem(spark), -2400000.0, 3200000.0, 8000.0, -8000.0).select("det_id", r6(F.col("elev") + 1e-7, "elev", 5))


def _counts(spark, sf):
    r, c, inside = SPEC.cell("lon", "lat")
    return det(spark, sf, "lon", "lat", "frp_mw").where(inside).groupBy(r.alias("row"), c.alias("col")).agg(F.count("*").cast("double").alias("value"))


_CELLS = f"{sql_det('lon', 'lat', 'frp_mw')}, c0 AS (SELECT floor((50 - lat) / 25 * 50)::INT AS row, floor((lon + 125) / 60 * 120)::INT AS col FROM d WHERE lon IS NOT NULL), c AS (SELECT row, col, count(*)::DOUBLE AS value FROM c0 WHERE row BETWEEN 0 AND 49 AND col BETWEEN 0 AND 119 GROUP BY 1, 2)"


@query("ref_regrid", f"""WITH {_CELLS}, x AS (SELECT i, j, greatest(0.0, least((i + 1.0), (j + 1) * 7.5) - greatest(i, j * 7.5)) AS f FROM range(120) a(i), range(16) b(j)), y AS (SELECT i, j, greatest(0.0, least((i + 1.0), (j + 1) * 7.5) - greatest(i, j * 7.5)) AS f FROM range(50) a(i), range(7) b(j))
SELECT y.j::INT AS row, x.j::INT AS col, round(sum(value * x.f * y.f), 6) AS value FROM c JOIN x ON x.i = c.col AND x.f > 0 JOIN y ON y.i = c.row AND y.f > 0 GROUP BY 1, 2""")
def ref_regrid(spark, sf):
    src_x, src_y = [float(i) for i in range(121)], [float(i) for i in range(51)]
    d = raster.conservative_regrid(_counts(spark, sf), src_x, src_y, [7.5 * i for i in range(17)], [7.5 * i for i in range(8)])
    return d.select("row", "col", r6(F.col("value"), "value"))


@query("ref_coarsened", f"WITH {_CELLS} SELECT floor(row / 4)::INT AS row, floor(col / 4)::INT AS col, round(avg(value), 6) AS value FROM c GROUP BY 1, 2")
def ref_coarsened(spark, sf):
    return raster.coarsened(_counts(spark, sf), 4, "fraction").select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), r6(F.col("value"), "value"))


def _full(spark, sf):
    grid = spark.range(50 * 120).select(F.floor(F.col("id") / 120).cast("int").alias("row"), (F.col("id") % 120).cast("int").alias("col"))
    return grid.join(_counts(spark, sf), ["row", "col"], "left").fillna({"value": 0.0}).withColumn("o", (F.col("value") > 0).cast("double")).withColumn("p", F.least(F.lit(1.0), F.col("value") / 10.0))


_FULL = f"{_CELLS}, g AS (SELECT i // 120 AS row, i % 120 AS col FROM range(6000) r(i)), u AS (SELECT g.row, g.col, (coalesce(value, 0) > 0)::INT::DOUBLE AS o, least(1.0, coalesce(value, 0) / 10) AS p FROM g LEFT JOIN c ON c.row = g.row AND c.col = g.col)"


@query("ref_neighborhood", f"WITH {_FULL} SELECT a.row::INT AS row, a.col::INT AS col, round(sum(b.p) / 25, 8) AS p FROM u a JOIN u b ON b.row BETWEEN a.row - 2 AND a.row + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2 GROUP BY 1, 2")
def ref_neighborhood(spark, sf):
    return raster.neighborhood_mean(_full(spark, sf), "p", 5, 50, 120).select("row", "col", r6(F.col("p"), "p", 8))


@query("ref_fss", f"WITH {_FULL}, m AS (SELECT a.row, a.col, sum(b.p) / 25 AS p, sum(b.o) / 25 AS o FROM u a JOIN u b ON b.row BETWEEN a.row - 2 AND a.row + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2 GROUP BY 1, 2) SELECT round(1 - avg(pow(o - p, 2)) / (avg(o * o) + avg(p * p)), 8) AS fss FROM m")
def ref_fss(spark, sf):
    return raster.fractions_skill_score(cut(_full(spark, sf)), "o", "p", 5, 50, 120).select(r6(F.col("fss"), "fss", 8))


@query("ref_dilated", f"WITH {_CELLS} SELECT DISTINCT (row + i)::INT AS row, (col + j)::INT AS col FROM c, range(-1, 2) a(i), range(-1, 2) b(j) WHERE row + i BETWEEN 0 AND 49 AND col + j BETWEEN 0 AND 119")
def ref_dilated(spark, sf):
    return raster.dilated(_counts(spark, sf), "value", 1, 50, 120)


@query("ref_buffered", f"WITH {_CELLS}, o AS (SELECT i, j, sqrt(i * i + j * j) AS d FROM range(-3, 4) a(i), range(-3, 4) b(j) WHERE sqrt(i * i + j * j) <= 2.5), m AS (SELECT (row + i)::INT AS row, (col + j)::INT AS col, min(d) AS dist FROM c, o WHERE row + i BETWEEN 0 AND 49 AND col + j BETWEEN 0 AND 119 GROUP BY 1, 2) SELECT row, col, round(dist, 8) AS dist, round(CASE WHEN dist = 0 THEN 1 ELSE least(1.0, greatest(0.0, 1 - dist / 2.5)) END, 8) AS prob FROM m")
def ref_buffered(spark, sf):
    return raster.buffered(_counts(spark, sf), "value", 2.5, 50, 120).select("row", "col", r6(F.col("dist"), "dist", 8), r6(F.col("prob"), "prob", 8))


@query("ref_f1_tolerance", f"WITH {_CELLS}, t AS (SELECT row, col FROM c WHERE value >= 3), p AS (SELECT row, col FROM c WHERE value < 3), n AS (SELECT (SELECT count(*) FROM p WHERE EXISTS (SELECT 1 FROM t WHERE abs(t.row - p.row) <= 1 AND abs(t.col - p.col) <= 1)) / (SELECT count(*) FROM p) AS pr, (SELECT count(*) FROM t WHERE EXISTS (SELECT 1 FROM p WHERE abs(t.row - p.row) <= 1 AND abs(t.col - p.col) <= 1)) / (SELECT count(*) FROM t) AS rc) SELECT pr AS precision, rc AS recall, round(2 * pr * rc / (pr + rc), 12) AS f1 FROM n")
def ref_f1_tolerance(spark, sf):
    c = cut(_counts(spark, sf))
    return raster.f1_with_tolerance(c.where("value >= 3"), c.where("value < 3"), 1, 50, 120).select("precision", "recall", r6(F.col("f1"), "f1", 12))


@query("ref_arrival")
def ref_arrival(spark, sf):
    """Arrival of a front on each tile's 32 x 32 grid of readings, seeded where the tile burned first; elliptical variant beside it."""
    d = det(spark, sf, "t", "tile_id", "x", "y", "frp_mw").where("tile_id <> '' AND x IS NOT NULL AND t IS NOT NULL")
    cells = d.groupBy("tile_id", F.pmod(F.floor(F.col("x") / 3000), F.lit(32)).cast("int").alias("col"), F.pmod(F.floor(F.col("y") / 3000), F.lit(32)).cast("int").alias("row")).agg(F.min("t").alias("first"), F.count("*").alias("n"))
    first = cells.groupBy("tile_id").agg(F.min("first").alias("_f"))
    cells = cells.join(first, "tile_id").select("tile_id", "row", "col", (F.col("first") == F.col("_f")).alias("seed"), "n")
    grid = cells.select("tile_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(1023)))).select("tile_id", (F.col("k") % 32).alias("col"), F.floor(F.col("k") / 32).cast("int").alias("row"))
    full = grid.join(cells, ["tile_id", "row", "col"], "left").fillna({"seed": False, "n": 0})
    full = full.withColumn("ros", raster.rate_of_spread(F.col("n") / 20.0, F.lit(0.3), F.col("row") / 64.0)).withColumn("w", F.lit(0.5)).withColumn("wd", F.lit(0.7))
    a = raster.arrival_times(full, ["tile_id"]).withColumnRenamed("arrival", "front")
    b = raster.arrival_times(a, ["tile_id"], wind="w", direction="wd")
    return b.groupBy("tile_id").agg(r6(F.max("front"), "front_max", 5), r6(F.max("arrival"), "ellipse_max", 5), F.count("front").alias("reached"))


@query("ref_rate_of_spread", "SELECT o_orderkey, round(greatest(0.001, 0.2 * (0.15 + (o_orderkey % 11) / 10.0) * (1 + 1.8 * (o_orderkey % 7) / 6.0) * exp(1.2 * (o_orderkey % 5) / 4.0)), 8) AS ros, round(1 + 3 * (o_orderkey % 7) / 6.0, 8) AS lb FROM orders")
def ref_rate_of_spread(spark, sf):
    o = F.col("o_orderkey")
    f, w, s = (o % 11) / 10.0, (o % 7) / 6.0, (o % 5) / 4.0
    return read(spark, sf, "orders", "o_orderkey").select("o_orderkey", r6(raster.rate_of_spread(f, w, s), "ros", 8), r6(raster.length_to_breadth(w), "lb", 8))


@query("ref_front_shape", f"""WITH {sql_det('x', 'y', 'tile_id')}, g AS (SELECT tile_id, count(*) AS n, var_samp(x / 1000) AS a, var_samp(y / 1000) AS d, covar_samp(x / 1000, y / 1000) AS b FROM d WHERE tile_id <> '' AND x IS NOT NULL GROUP BY 1)
SELECT tile_id, round(least(1000.0, CASE WHEN n < 3 THEN 1 ELSE sqrt(greatest((a + d) / 2 + sqrt(pow((a - d) / 2, 2) + b * b), 1e-9) / greatest((a + d) / 2 - sqrt(pow((a - d) / 2, 2) + b * b), 1e-9)) END), 3) AS ratio FROM g""")
def ref_front_shape(spark, sf):
    d = det(spark, sf, "x", "y", "tile_id").where("tile_id <> '' AND x IS NOT NULL").select("tile_id", (F.col("x") / 1000).alias("col"), (F.col("y") / 1000).alias("row"))
    return raster.front_length_breadth(d, ["tile_id"]).select("tile_id", r6(F.least(F.lit(1000.0), "ratio"), "ratio", 3))


@query("ref_composite", f"WITH {sql_det('pixel_id', 'temp_k', 'frp_mw', 'mask_code')} SELECT pixel_id, round(avg(temp_k::DOUBLE) FILTER (mask_code IN (10, 13, 30, 33)), 5) AS temp_k, round(avg(frp_mw::DOUBLE) FILTER (mask_code IN (10, 13, 30, 33)), 5) AS frp_mw, count(*) FILTER (mask_code IN (10, 13, 30, 33)) AS n_valid FROM d GROUP BY 1")
def ref_composite(spark, sf):
    d = det(spark, sf, "pixel_id", "temp_k", "frp_mw", "mask_code").withColumn("ok", F.coalesce(F.col("mask_code").isin(10, 13, 30, 33), F.lit(False))).withColumns({c: F.col(c).cast("double") for c in ("temp_k", "frp_mw")})
    return raster.composite(d, ["pixel_id"], ["temp_k", "frp_mw"], "ok").select("pixel_id", r6(F.col("temp_k"), "temp_k", 5), r6(F.col("frp_mw"), "frp_mw", 5), "n_valid")


@query("ref_class_histogram", f"WITH {sql_det('mask_code', 'satellite')} SELECT satellite, mask_code::INT AS code, count(*) AS n FROM d GROUP BY 1, 2")
def ref_class_histogram(spark, sf):
    return raster.class_histogram(det(spark, sf, "mask_code", "satellite").withColumn("code", F.col("mask_code").cast("int")), "code", ["satellite"])


# --- splits, sampling, labels, models ---


def units(spark, sf):
    return read(spark, sf, "example_units").dropDuplicates(["uid"])


@query("ref_year_folds", """WITH u AS (SELECT DISTINCT uid, year(when_date) AS y FROM example_units WHERE when_date IS NOT NULL), ys AS (SELECT y, row_number() OVER (ORDER BY y) AS k FROM (SELECT DISTINCT y FROM u)), f AS (SELECT k - 2 AS fold, y AS t, k FROM ys WHERE k >= 2)
SELECT fold::INT AS fold, t::VARCHAR AS held_out, CASE WHEN u.y = f.t THEN 'test' WHEN ys.k = f.k - 1 THEN 'val' ELSE 'train' END AS split_name, uid FROM f, u JOIN ys USING (y)""")
def ref_year_folds(spark, sf):
    return splits.leave_year_out(units(spark, sf))


@query("ref_group_folds", "WITH u AS (SELECT DISTINCT uid, ecoregion AS g FROM example_units WHERE ecoregion IS NOT NULL), n AS (SELECT g AS h, row_number() OVER (ORDER BY g) - 1 AS fold FROM (SELECT DISTINCT g FROM u)) SELECT fold::INT AS fold, h AS held_out, CASE WHEN g = h THEN 'test' ELSE 'train' END AS split_name, uid FROM u, n")
def ref_group_folds(spark, sf):
    return splits.leave_one_group_out(units(spark, sf), "ecoregion")


@query("ref_block_folds")
def ref_block_folds(spark, sf):
    return splits.spatial_blocks(units(spark, sf))


@query("ref_split_overlap", "SELECT fold, uid, array_to_string(list_sort(list_distinct(list(split_name))), '+') AS parts FROM leave_year_out GROUP BY 1, 2 HAVING count(DISTINCT split_name) > 1")
def ref_split_overlap(spark, sf):
    return splits.overlap(read(spark, sf, "leave_year_out", "fold", "split_name", "uid")).select("fold", "uid", F.array_join("parts", "+").alias("parts"))


@query("ref_split_summary", "SELECT fold, held_out, split_name, count(DISTINCT uid) AS n FROM leave_year_out GROUP BY 1, 2, 3")
def ref_split_summary(spark, sf):
    return splits.sizes(read(spark, sf, "leave_year_out", "fold", "held_out", "split_name", "uid"))


@query("ref_blocks", "SELECT uid, (floor(lon / 5) * 100000 + floor(lat / 5))::BIGINT AS block FROM (SELECT DISTINCT uid, lon, lat FROM example_units)")
def ref_blocks(spark, sf):
    return units(spark, sf).select("uid", block_key("lon", "lat").alias("block"))


@query("ref_reporting_weight", "WITH u AS (SELECT DISTINCT uid, lon, lat, label_source AS s FROM example_units), p AS (SELECT floor(lon / 0.25) AS x, floor(lat / 0.25) AS y, count(*) AS n FROM u WHERE s = 'fpa_fod' GROUP BY 1, 2), w AS (SELECT uid, coalesce(n, 0) + 0.001 AS w FROM u LEFT JOIN p ON p.x = floor(lon / 0.25) AND p.y = floor(lat / 0.25)) SELECT uid, round(w / sum(w) OVER (), 10) AS weight FROM w")
def ref_reporting_weight(spark, sf):
    u = units(spark, sf)
    return splits.reporting_weight(u, u.where("label_source = 'fpa_fod'")).select("uid", r6(F.col("weight"), "weight", 10))


@query("ref_negatives")
def ref_negatives(spark, sf):
    u = units(spark, sf).select(F.col("uid").alias("id"), "lon", "lat", "label_source", block_key("lon", "lat", 20.0).alias("stratum"))
    return splits.stratified_negatives(u.where("label_source = 'mtbs'"), u.where("label_source <> 'mtbs'"), ratio=2.0).select("id", "stratum")


@query("ref_background")
def ref_background(spark, sf):
    u = units(spark, sf).select(F.col("uid").alias("id"), "area_ha", "label_source")
    return splits.weighted_background(u.where("label_source = 'mtbs'"), u.where("label_source <> 'mtbs'"), 100, "area_ha").select("id")


@query("ref_candidate_grid", "SELECT 'cell_' || i AS id, -124.875 + (i % 100) * 0.25 AS lon, 30.125 + (i // 100) % 80 * 0.25 AS lat, (2019 + i // 8000)::INT AS year, (floor((-124.875 + (i % 100) * 0.25) / 5) * 100000 + floor((30.125 + (i // 100) % 80 * 0.25) / 5))::BIGINT AS stratum FROM range(16000) r(i)")
def ref_candidate_grid(spark, sf):
    return splits.candidate_grid(spark, -125.0, 30.0, -100.0, 50.0, [2019, 2020])


@query("ref_leakage")
def ref_leakage(spark, sf):
    """Boosted trees judged in spatial blocks: whether a unit is large, from physics-free attributes."""
    u = units(spark, sf).where("area_ha IS NOT NULL AND when_date IS NOT NULL").select("uid", "lon", "lat", (F.col("area_ha") > 300).cast("double").alias("label"), F.dayofyear("when_date").cast("double").alias("season"), F.year("when_date").cast("double").alias("age"), (F.length("ecoregion") + F.ascii(F.substring("ecoregion", 5, 1))).cast("double").alias("eco"))
    u = cut(u)
    p = models.out_of_fold(u, splits.spatial_blocks(u), ["season", "age", "eco"])
    return models.scorecard(p).select(r6(F.col("average_precision"), "average_precision", 4), r6(F.col("brier"), "brier", 4), r6(F.col("log_loss"), "log_loss", 4), r6(F.col("base_rate"), "base_rate", 6))


@query("ref_burned_area", f"WITH u AS (SELECT DISTINCT uid, ecoregion, area_ha FROM example_units WHERE area_ha IS NOT NULL), a AS (SELECT quantile_cont(ln(1 + area_ha), 0.5) AS a FROM u), g AS (SELECT ecoregion, count(*) AS n, quantile_cont(ln(1 + area_ha), 0.5) AS o FROM u GROUP BY 1) SELECT ecoregion, n, round(exp(CASE WHEN n >= 30 THEN o ELSE a END) - 1, 4) AS median_ha FROM g, a")
def ref_burned_area(spark, sf):
    q = models.conditional_quantiles(units(spark, sf).where("area_ha IS NOT NULL"), ["ecoregion"], "area_ha", [0.25, 0.5, 0.9])
    return q.select("ecoregion", "n", r6(F.get("q", F.lit(1)), "median_ha", 4))


@query("ref_plans", f"WITH p(name, n_tiles, years, cadence, bands, mb, s, per_band, storage) AS ({_values([tuple(str(v) if isinstance(v, bool) else v for v in r) for r in planning.STANDARD])}), k AS (SELECT *, 1440 / cadence * years * 365.25 AS steps FROM p), r AS (SELECT *, steps * CASE WHEN per_band = 'True' THEN bands ELSE 1 END AS reads, n_tiles * bands * 2304.0 * steps AS samples FROM k) SELECT name, n_tiles::INT AS n_tiles, round(CASE storage WHEN 'sparse' THEN samples * 2.5e-05 * 56 ELSE samples * 2 / 4 END / 1e9, 4) AS disk_gb, round(reads * mb / 1e6, 6) AS download_tb, round_even(reads, 0)::BIGINT AS granule_reads, round(reads * s / 12 / 3600, 4) AS hours FROM r")
def ref_plans(spark, sf):
    return planning.costed(planning.standard_plans(spark)).select("name", "n_tiles", r6(F.col("disk_gb"), "disk_gb", 4), r6(F.col("download_tb"), "download_tb", 6), "granule_reads", r6(F.col("wall_clock_hours"), "hours", 4))


@query("ref_fold_skill", """WITH u AS (SELECT DISTINCT uid, area_ha::DOUBLE AS v, continent AS c, coalesce(length(fire_name) > 11, false)::INT AS y, year(when_date) AS yr FROM example_units), ys AS (SELECT y, row_number() OVER (ORDER BY y) AS k FROM (SELECT DISTINCT yr AS y FROM u WHERE yr IS NOT NULL)), f AS (SELECT k - 2 AS fold, k FROM ys WHERE k >= 2),
m AS (SELECT fold::INT AS fold, CASE WHEN ys.k = f.k THEN 'test' WHEN ys.k = f.k - 1 THEN 'val' ELSE 'train' END AS part, u.* FROM f, u JOIN ys ON ys.y = u.yr WHERE v IS NOT NULL), g AS (SELECT fold, c AS g, v, y FROM m WHERE part = 'train' UNION ALL SELECT fold, '*', v, y FROM m WHERE part = 'train'),
l AS (SELECT fold, g, min(v) AS lo, max(v) AS hi, sum(y) AS pos FROM g GROUP BY 1, 2), s AS (SELECT l.fold, l.g, i, lo + i * (hi - lo) / 199 AS t, 2.0 * sum(y) FILTER (v > lo + i * (hi - lo) / 199) / nullif(count(*) FILTER (v > lo + i * (hi - lo) / 199) + any_value(pos), 0) AS f1 FROM l JOIN g ON g.fold = l.fold AND g.g = l.g, range(200) r(i) GROUP BY 1, 2, 3, 4),
b AS (SELECT fold, g, t FROM (SELECT *, row_number() OVER (PARTITION BY fold, g ORDER BY coalesce(f1, 0) DESC, i) AS k FROM s WHERE f1 IS NOT NULL OR NOT EXISTS (SELECT 1)) WHERE k = 1), x AS (SELECT m.fold, y, (v > coalesce(b.t, a.t))::INT AS p FROM m LEFT JOIN b ON b.fold = m.fold AND b.g = m.c JOIN b a ON a.fold = m.fold AND a.g = '*' WHERE part = 'test'),
n AS (SELECT fold, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn FROM x GROUP BY 1)
SELECT fold, tp, fp, fn, tn, round(2 * tp / nullif(2 * tp + fp + fn, 0), 8) AS f1, round(2 * (tp + fn) / nullif(2 * (tp + fn) + fp + tn, 0), 8) AS naive_f1, round(2 * tp / nullif(2 * tp + fp + fn, 0) - 2 * (tp + fn) / nullif(2 * (tp + fn) + fp + tn, 0), 8) AS skill FROM n""")
def ref_fold_skill(spark, sf):
    """Skill of an area threshold tuned on each fold's training years, per continent."""
    u = units(spark, sf).where("area_ha IS NOT NULL").withColumn("y", (F.length("fire_name") > 11).cast("int"))
    f = protocols.fold_skill(u.select("uid", "area_ha", "continent", "y"), splits.leave_year_out(units(spark, sf)), "area_ha", "y", strata="continent")
    return f.select("fold", "tp", "fp", "fn", "tn", r6(F.col("f1"), "f1", 8), r6(F.col("naive_f1"), "naive_f1", 8), r6(F.col("skill"), "skill", 8))


@query("ref_group_thresholds", f"""WITH {_LAB.replace("'confidence'", "'confidence'")}, z AS (SELECT q.y AS g, q.v, (q.p > 0.7)::INT AS y FROM q), l AS (SELECT g, min(v) AS lo, max(v) AS hi, sum(y) AS pos FROM z GROUP BY 1), c AS (SELECT g, i, lo + i * (hi - lo) / 199 AS t, pos FROM l, range(200) r(i)),
s AS (SELECT c.g, i, t, 2.0 * sum(y) FILTER (v > t) / (count(*) FILTER (v > t) + any_value(pos)) AS f1 FROM z JOIN c ON c.g = z.g GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY f1 DESC, i) AS k FROM s WHERE f1 IS NOT NULL) SELECT g, round(t, 5) AS threshold, round(f1, 8) AS f1 FROM k WHERE k = 1""")
def ref_group_thresholds(spark, sf):
    d = _labelled(spark, sf).select(F.col("y").alias("g"), "v", (F.col("p") > 0.7).cast("int").alias("y"))
    return protocols.cuts_by(d, ["g"], "v", "y").select("g", r6(F.col("threshold"), "threshold", 5), r6(F.col("f1"), "f1", 8))


@query("ref_first_frames", f"""WITH {sql_det('t', 'lon', 'lat', 'pixel_id')}, p AS (SELECT pixel_id, round(CASE WHEN max(lon) - min(lon) > 180 THEN CASE WHEN avg(CASE WHEN lon < 0 THEN lon + 360 ELSE lon END) > 180 THEN avg(CASE WHEN lon < 0 THEN lon + 360 ELSE lon END) - 360 ELSE avg(CASE WHEN lon < 0 THEN lon + 360 ELSE lon END) END ELSE avg(lon) END, 4) AS plon, round(avg(lat), 4) AS plat FROM d WHERE lon IS NOT NULL AND lat IS NOT NULL GROUP BY 1),
n AS (SELECT p.pixel_id, min(d.t) AS t FROM p JOIN d ON d.lat BETWEEN plat - 0.05 AND plat + 0.05 AND d.t IS NOT NULL AND sqrt(pow((plat - d.lat) * 111.0, 2) + pow(least(abs(plon - d.lon), 360 - abs(plon - d.lon)) * 111.0 * cos(radians(d.lat)), 2)) <= 3.0 GROUP BY 1), z AS (SELECT date_trunc('day', min(t)) AS z FROM d)
SELECT pixel_id, ceil((epoch_us(t) - epoch_us(z)) / 2.7e9)::INT AS frame_idx FROM n, z""")
def ref_first_frames(spark, sf):
    d = det(spark, sf, "t", "lon", "lat", "pixel_id")
    # The mean place of a pixel on both sides of longitude 180 is taken east of it.
    mean, east = F.avg("lon"), F.avg(F.pmod(F.col("lon"), F.lit(360.0)))
    p = d.where("lon IS NOT NULL AND lat IS NOT NULL").groupBy("pixel_id").agg(F.round(F.when(F.max("lon") - F.min("lon") > 180, F.when(east > 180, east - 360).otherwise(east)).otherwise(mean), 4).alias("lon"), F.round(F.avg("lat"), 4).alias("lat"))
    # Frames of 45 minutes from the first day of the detections to the first frame at or after the last one.
    step = F.expr("INTERVAL 45 MINUTES")
    ends = d.agg(F.date_trunc("day", F.min("t")).alias("lo"), (F.max("t") + step).alias("hi")).where("lo IS NOT NULL")
    f = ends.select(F.posexplode(F.sequence("lo", "hi", step)).alias("frame_idx", "t"))
    return protocols.first_frames(d, p, f, 0.05)

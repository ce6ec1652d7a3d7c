"""More queries of the engine's operators over whole tables: labels, stores, cubes, harnesses, serving; each with SQL where SQL can express it."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cindral.frames import ntz, read
from cindral.functions import codes, geometry, grids, radiative, spectral
from cindral.functions.grids import GRS80_A, GRS80_E2
from cindral.operators import cubes, features, harness, labels, linking, raster, scores, series, serving, splits
from cindral.plans.reference import _FULL, _LAB, _albers_sql, _counts, _full, _labelled, _placed, det, r6, r32, sql_det, units, weather
from cindral.session import checkpoint_dir, cut
from cindral.sources import store

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- physics and geometry ---

_B = "119104295.3 / (pow({w}, 5) * (exp(14387.769 / ({w} * {t})) - 1))"
_MIXED = f"""{sql_det('temp_k', 'area_m2', 'true_pixel_area_m2')}, q AS (SELECT det_id, least(0.2, area_m2::DOUBLE / true_pixel_area_m2) AS p, temp_k::DOUBLE AS t FROM d WHERE temp_k > 305 AND temp_k <= 2000 AND area_m2 > 0 AND true_pixel_area_m2 > 0)"""


def _mixed(spark, sf):
    d = det(spark, sf, "temp_k", "area_m2", "true_pixel_area_m2").where("temp_k > 305 AND temp_k <= 2000 AND area_m2 > 0 AND true_pixel_area_m2 > 0")
    return d.select("det_id", F.least(F.lit(0.2), F.col("area_m2").cast("double") / F.col("true_pixel_area_m2")).alias("p"), F.col("temp_k").cast("double").alias("t"))


@query("ref_retrieval", f"WITH {_MIXED} SELECT det_id, CASE WHEN t > 600 AND t < 1400 AND p > 1e-9 THEN round(p, 5) END AS fire_fraction, CASE WHEN t > 600 AND t < 1400 AND p > 1e-9 THEN t::REAL::DOUBLE END AS t_fire_k, t > 600 AND t < 1400 AND p > 1e-9 AS converged FROM q")
def ref_retrieval(spark, sf):
    """Two-band retrieval on radiances made from the detections' own temperature and area: it must give them back inside the prior, and nothing outside."""
    d = _mixed(spark, sf)
    mix = lambda lam: radiative.mixed_pixel_radiance(lam, F.col("p"), F.col("t"), 300.0)
    got = d.withColumn("r", radiative.retrieve(mix(3.9), mix(11.0), 300.0))
    return got.select("det_id", r6(F.col("r.fire_fraction"), "fire_fraction", 5), r32(F.col("r.t_fire_k"), "t_fire_k"), F.col("r.converged").alias("converged"))


_ROW = "(SELECT 1)"


@query("ref_condition", f"""WITH {_MIXED}, r AS (SELECT det_id, {_B.format(w='3.9', t='t')} - {_B.format(w='3.9', t='300.0')} AS u1, {_B.format(w='11.0', t='t')} - {_B.format(w='11.0', t='300.0')} AS u2,
  p * (14387.769 / (3.9 * t)) * exp(14387.769 / (3.9 * t)) / (exp(14387.769 / (3.9 * t)) - 1) * {_B.format(w='3.9', t='t')} / t AS v1, p * (14387.769 / (11.0 * t)) * exp(14387.769 / (11.0 * t)) / (exp(14387.769 / (11.0 * t)) - 1) * {_B.format(w='11.0', t='t')} / t AS v2 FROM q),
s AS (SELECT det_id, u1 / greatest(abs(u1), abs(v1)) AS a, v1 / greatest(abs(u1), abs(v1)) AS b, u2 / greatest(abs(u2), abs(v2)) AS c, v2 / greatest(abs(u2), abs(v2)) AS e FROM r),
k AS (SELECT det_id, a * a + b * b + c * c + e * e AS s, abs(a * e - b * c) AS d FROM s) SELECT det_id, round(log10((s + sqrt(greatest(0.0, s * s - 4 * d * d))) / (2 * d)), 4) AS log_condition FROM k WHERE d > 0""")
def ref_condition(spark, sf):
    k = radiative.condition_number("p", "t", 300.0)
    return _mixed(spark, sf).withColumn("k", k).where(F.col("k") < float("inf")).select("det_id", r6(F.log10("k"), "log_condition", 4))


@query("ref_power_by_temperature", f"""WITH {sql_det('temp_k', 'true_pixel_area_m2', 'satellite')}, q AS (SELECT det_id, temp_k::DOUBLE AS t, true_pixel_area_m2::DOUBLE AS a, satellite FROM d WHERE temp_k BETWEEN 250 AND 2000 AND true_pixel_area_m2 IS NOT NULL)
SELECT det_id, round(greatest(a * 5.670374419e-08 / (3.07e-09 * 0.8) * ({_B.format(w='3.9', t='t')} - {_B.format(w='3.9', t='290.0')}), 0) / 1e6, 3) AS frp, round(100 / CASE lower(satellite) WHEN 'goes18' THEN 1.0 WHEN 'goes19' THEN 1.0 WHEN 'noaa21' THEN 1.1 END, 6) AS scaled FROM q""")
def ref_power_by_temperature(spark, sf):
    d = det(spark, sf, "temp_k", "true_pixel_area_m2", "satellite").where("temp_k BETWEEN 250 AND 2000 AND true_pixel_area_m2 IS NOT NULL").withColumns({c: F.col(c).cast("double") for c in ("temp_k", "true_pixel_area_m2")})
    frp = radiative.frp_from_brightness_temperature("temp_k", 290.0, "true_pixel_area_m2", 3.9, 3.07e-09, 0.8)
    return d.select("det_id", r6(frp, "frp", 3), r6(codes.frp_to_reference_scale(F.lit(100.0), F.col("satellite")), "scaled"))


@query("ref_glint", f"""WITH {sql_det('view_zenith_deg', 'lon', 'lat')}, q AS (SELECT det_id, radians(30 + abs(lat) / 3) AS s, radians(least(90.0, greatest(0.0, view_zenith_deg::DOUBLE))) AS v, radians(lon - 180) AS r, lon, lat FROM d WHERE view_zenith_deg IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL),
c AS (SELECT *, greatest(-1.0, least(1.0, cos(radians(lat)) * cos(radians(lon + 75)))) AS k, 6378137.0 / 42164000.0 AS g FROM q)
SELECT det_id, round(degrees(acos(greatest(-1.0, least(1.0, cos(s) * cos(v) - sin(s) * sin(v) * cos(r))))), 5) AS glint, round(500 * tan(least(asin(least(1.0, sqrt(greatest(0.0, 1 - k * k)) / sqrt(1 + g * g - 2 * g * k))), radians(85.0))), 4) AS parallax FROM c""")
def ref_glint(spark, sf):
    d = det(spark, sf, "view_zenith_deg", "lon", "lat").where("view_zenith_deg IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL")
    v = F.least(F.lit(90.0), F.greatest(F.lit(0.0), F.col("view_zenith_deg").cast("double")))
    return d.select("det_id", r6(geometry.glint_angle_deg(30 + F.abs("lat") / 3, v, F.col("lon"), F.lit(180.0)), "glint", 5), r6(geometry.parallax_offset_m(500.0, -75.0, F.col("lon"), F.col("lat")), "parallax", 4))


@query("ref_grid_round_trip", f"""WITH {sql_det('lon', 'lat')}, q AS (SELECT det_id, lon, lat, cos(radians(lat)) * cos(radians(lon + 75.0)) AS cp, radians(lon + 75.0) AS dl, atan(pow(6356752.31414 / 6378137.0, 2) * tan(radians(lat))) AS pc FROM d WHERE lon IS NOT NULL AND lat IS NOT NULL),
r AS (SELECT *, 6356752.31414 / sqrt(1 - (1 - pow(6356752.31414 / 6378137.0, 2)) * pow(cos(pc), 2)) AS rc, 42164160.0 AS h FROM q), s AS (SELECT *, h - rc * cos(pc) * cos(dl) AS sx, -rc * cos(pc) * sin(dl) AS sy, rc * sin(pc) AS sz FROM r)
SELECT det_id, CASE WHEN near THEN round(lat, 5) END AS lat, CASE WHEN near THEN round(CASE WHEN lon > 105 THEN lon - 360 ELSE lon END, 5) END AS lon FROM (SELECT *, degrees(asin(least(1.0, sin(acos(cp)) / sqrt(1 + pow(6378137.0 / h, 2) - 2 * 6378137.0 / h * cp)))) < 85 AS near FROM s) WHERE h * (h - sx) >= sy * sy + pow(6378137.0 / 6356752.31414, 2) * sz * sz""")
def ref_grid_round_trip(spark, sf):
    """Place to scan angles and back, of what the satellite sees; nearer than five degrees to the limb, where a place has no five digits, null."""
    g = geometry.FixedGrid()
    x, y = g.to_scan_angles("lat", "lon")
    d = det(spark, sf, "lon", "lat").where("lon IS NOT NULL AND lat IS NOT NULL").withColumns({"sx": x, "sy": y}).where("sx IS NOT NULL")
    lat, lon = g.to_latlon("sx", "sy")
    near = g.view_zenith_deg("lat", "lon") < 85
    return d.select("det_id", F.when(near, r6(lat, "lat", 5)).alias("lat"), F.when(near, r6(lon, "lon", 5)).alias("lon"))


@query("ref_serving_tolerance", f"""WITH {sql_det('view_zenith_deg', 'satellite')}, q AS (SELECT det_id, CASE WHEN view_zenith_deg IS NOT NULL THEN least(greatest(view_zenith_deg::DOUBLE, 0.0), 80.0) END AS z, CASE WHEN lower(satellite) LIKE '%goes%' THEN 6000.0 ELSE 2000.0 END AS flat FROM d)
SELECT det_id, round(greatest(1000.0, CASE WHEN z IS NULL THEN flat ELSE 2000.0 * sqrt(CASE WHEN z > 0 THEN pow((6371.0 + 35786.0) * sin(radians(z) - asin(6371.0 * sin(radians(z)) / (6371.0 + 35786.0))) / (35786.0 * sin(radians(z))), 2) ELSE 1 END / cos(radians(z))) * sqrt(2.0) / 2 + 1000.0 * tan(radians(z)) END), 4) AS tolerance FROM q""")
def ref_serving_tolerance(spark, sf):
    d = det(spark, sf, "view_zenith_deg", "satellite")
    return d.select("det_id", r6(geometry.serving_tolerance_m(codes.sensor_family("satellite"), F.col("view_zenith_deg").cast("double")), "tolerance", 4))


def _conic_sql() -> str:
    e = math.sqrt(GRS80_E2)
    m = lambda p: math.cos(p) / math.sqrt(1 - GRS80_E2 * math.sin(p) ** 2)
    t = lambda p: math.sqrt((1 - math.sin(p)) / (1 + math.sin(p)) * ((1 + e * math.sin(p)) / (1 - e * math.sin(p))) ** e)
    p1, p2 = math.radians(49), math.radians(77)
    n = math.log(m(p1) / m(p2)) / math.log(t(p1) / t(p2))
    f = GRS80_A * m(p1) / (n * t(p1) ** n)
    ts = f"sqrt((1 - s) / (1 + s) * pow((1 + {e!r} * s) / (1 - {e!r} * s), {e!r}))"
    a = f"{n!r} * radians(lon + 95 - 360 * floor((lon + 275) / 360.0))"
    return f"WITH {sql_det('lon', 'lat')}, q AS (SELECT det_id, lon, sin(radians(lat)) AS s FROM d WHERE lon IS NOT NULL AND lat IS NOT NULL) SELECT det_id, round({f!r} * pow({ts}, {n!r}) * sin({a}), 1) AS px, round({f * t(p1) ** n!r} - {f!r} * pow({ts}, {n!r}) * cos({a}), 1) AS py FROM q"


@query("ref_project_canada", _conic_sql())
def ref_project_canada(spark, sf):
    x, y = grids.project("lon", "lat", "EPSG:3979")
    return det(spark, sf, "lon", "lat").where("lon IS NOT NULL AND lat IS NOT NULL").select("det_id", r6(x, "px", 1), r6(y, "py", 1))


def _azimuthal_sql() -> str:
    e = math.sqrt(GRS80_E2)
    q = lambda s: (1 - e * e) * (s / (1 - e * e * s * s) + math.atanh(e * s) / e)
    qp, s0 = q(1.0), math.sin(math.radians(52))
    b0, rq = math.asin(q(s0) / qp), GRS80_A * math.sqrt(qp / 2)
    d = GRS80_A * math.cos(math.radians(52)) / math.sqrt(1 - e * e * s0 * s0) / (rq * math.cos(b0))
    beta = f"asin(greatest(-1.0, least(1.0, (1 - {e * e!r}) * (s / (1 - {e * e!r} * s * s) + atanh({e!r} * s) / {e!r}) / {qp!r})))"
    k = f"({rq!r} * sqrt(2 / (1 + {math.sin(b0)!r} * sin(b) + {math.cos(b0)!r} * cos(b) * cos(l))))"
    return f"WITH {sql_det('lon', 'lat')}, q AS (SELECT det_id, radians(lon - 10) AS l, sin(radians(lat)) AS s FROM d WHERE lon IS NOT NULL AND lat IS NOT NULL), b AS (SELECT *, {beta} AS b FROM q) SELECT det_id, round(4321000 + {k} * {d!r} * cos(b) * sin(l), 1) AS px, round(3210000 + {k} / {d!r} * ({math.cos(b0)!r} * sin(b) - {math.sin(b0)!r} * cos(b) * cos(l)), 1) AS py FROM b"


@query("ref_project_europe", _azimuthal_sql())
def ref_project_europe(spark, sf):
    x, y = grids.project("lon", "lat", "EPSG:3035")
    return det(spark, sf, "lon", "lat").where("lon IS NOT NULL AND lat IS NOT NULL").select("det_id", r6(x, "px", 1), r6(y, "py", 1))


@query("ref_post_fire", "SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_quantity / 50.0 + l_discount) > 1e-6 THEN round((l_quantity / 50.0 - l_discount) / (l_quantity / 50.0 + l_discount), 6) END AS nbr FROM lineitem")
def ref_post_fire(spark, sf):
    d = read(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return d.select("l_orderkey", "l_linenumber", r6(spectral.post_fire_nbr(F.col("l_quantity") / 50.0, F.col("l_discount")), "nbr"))


# --- labels ---

_CAUSES = ("Natural", "lightning ", "Arson", "Missing/Undefined", "", "Debris burning", "UNKNOWN")
_CAUSE_SQL = "list_value(" + ", ".join(f"'{c}'" for c in _CAUSES) + ")"


def _occurrences(spark, sf):
    """Fire occurrences in raw spellings, made from the orders by arithmetic."""
    o = F.col("o_orderkey")
    d = read(spark, sf, "orders", "o_orderkey", "o_orderdate")
    pick = F.element_at(F.array(*(F.lit(c) for c in _CAUSES)), (o % 7 + 1).cast("int"))
    return d.select(o.alias("k"), F.concat(F.lit("f"), o).alias("id"), F.when(o % 11 > 0, -120.0 + (o % 4001) / 100.0).alias("lon"), (25.0 + o % 24).cast("double").alias("lat"), F.year("o_orderdate").alias("year"), F.when(o % 13 > 0, pick).alias("cause"))


_OCC = f"""occ AS (SELECT 'f' || o_orderkey AS id, CASE WHEN o_orderkey % 11 > 0 THEN -120.0 + (o_orderkey % 4001) / 100.0 END AS lon, (25 + o_orderkey % 24)::DOUBLE AS lat, year(o_orderdate) AS year, CASE WHEN o_orderkey % 13 > 0 THEN {_CAUSE_SQL}[(o_orderkey % 7)::INT + 1] END AS cause FROM orders),
norm AS (SELECT id, lon, lat, year::INT AS year, CASE WHEN cause IS NULL OR lower(trim(cause)) IN ('missing/undefined', '', 'unknown') THEN '' WHEN lower(trim(cause)) IN ('natural', 'lightning') THEN 'lightning' ELSE 'human' END AS cause FROM occ WHERE lon IS NOT NULL)"""


@query("ref_occurrences", f"WITH {_OCC} SELECT id, round(lon, 6) AS lon, lat, year, cause FROM norm")
def ref_occurrences(spark, sf):
    return codes.normalize_occurrences(_occurrences(spark, sf)).select("id", r6(F.col("lon"), "lon"), "lat", "year", "cause")


@query("ref_perimeters", """WITH o AS (SELECT o_orderkey AS k, o_orderdate::DATE AS d FROM orders) SELECT 'E' || k AS event_id, CASE k % 5 WHEN 4 THEN NULL ELSE d END AS ignition_date, round((k % 1000)::DOUBLE * 0.404686::DOUBLE, 6) AS area_ha, CASE k % 4 WHEN 0 THEN 'wildfire' WHEN 1 THEN 'prescribed' WHEN 2 THEN 'wildfire_use' ELSE 'unknown' END AS fire_type FROM o""")
def ref_perimeters(spark, sf):
    """Perimeter attributes under other names, with dates in four spellings and some unreadable."""
    o = F.col("o_orderkey")
    f = F.element_at(F.array(*(F.date_format("o_orderdate", p) for p in ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "yyyyMMdd")), F.lit("n/a")), (o % 5 + 1).cast("int"))
    kind = F.element_at(F.array(*(F.lit(c) for c in ("Wildfire", "Prescribed Fire", "Wildland Fire Use", "Other"))), (o % 4 + 1).cast("int"))
    d = read(spark, sf, "orders", "o_orderkey", "o_orderdate").select(F.concat(F.lit("E"), o).alias("EVENT_ID"), f.alias("Ig_Date"), (o % 1000).cast("string").alias("BurnBndAc"), kind.alias("Incid_Type"))
    return codes.normalize_perimeters(d).select("event_id", "ignition_date", r6(F.col("area_ha"), "area_ha"), "fire_type")


_REG = "r AS (SELECT DISTINCT uid AS event_id, label_source AS source, continent AS region, area_ha, lon, lat, CASE WHEN hash_.h % 3 > 0 THEN 'p' END AS geometry_path, CASE WHEN hash_.h % 2 > 0 THEN 'm' END AS interior_mask_path FROM example_units, LATERAL (SELECT length(uid) + ascii(substr(uid, length(uid), 1)) AS h) hash_)"


def _registry(spark, sf):
    h = F.length("uid") + F.ascii(F.substring("uid", -1, 1))
    return units(spark, sf).select(F.col("uid").alias("event_id"), F.col("label_source").alias("source"), F.col("continent").alias("region"), "area_ha", "lon", "lat", F.when(h % 3 > 0, "p").alias("geometry_path"), F.when(h % 2 > 0, "m").alias("interior_mask_path"))


@query("ref_training_records", f"WITH {_REG} SELECT event_id, source FROM r WHERE lower(source) NOT IN ('copernicus_ems', 'nirops', 'cbi') AND NOT (geometry_path IS NOT NULL AND interior_mask_path IS NULL)")
def ref_training_records(spark, sf):
    return labels.assert_trainable(labels.training_records(_registry(spark, sf))).select("event_id", "source")


@query("ref_evaluation_records", f"WITH {_REG} SELECT event_id, source FROM r WHERE lower(source) IN ('copernicus_ems', 'nirops', 'cbi')")
def ref_evaluation_records(spark, sf):
    return labels.evaluation_records(_registry(spark, sf)).select("event_id", "source")


@query("ref_registry", f"WITH {_REG} SELECT region, source, count(*) AS n FROM r GROUP BY 1, 2")
def ref_registry(spark, sf):
    return store.registry_summary(_registry(spark, sf))


@query("ref_source_quality", "SELECT DISTINCT label_source AS source, CASE lower(label_source) WHEN 'mtbs' THEN 'analyst_qc' WHEN 'effis' THEN 'analyst_qc' WHEN 'nbac' THEN 'highres_auto' WHEN 'landsat_c2_l3_ba' THEN 'highres_auto' WHEN 'fpa_fod' THEN 'administrative' WHEN 'wfigs' THEN 'administrative' WHEN 'cnfdb' THEN 'administrative' WHEN 'welty_jeffries' THEN 'administrative' WHEN 'copernicus_ems' THEN 'vhr_human' WHEN 'feds' THEN 'coarse_auto' WHEN 'mcd64a1' THEN 'coarse_auto' WHEN 'globfire' THEN 'coarse_auto' WHEN 'cbi' THEN 'field' WHEN 'nirops' THEN 'airborne_ir' END AS quality FROM example_units")
def ref_source_quality(spark, sf):
    return read(spark, sf, "example_units", "label_source").distinct().select(F.col("label_source").alias("source"), store.source_quality(F.col("label_source")).alias("quality"))


@query("ref_climates", "SELECT o_orderkey, CASE WHEN o_orderkey % 34 BETWEEN 1 AND 30 THEN (['Af', 'Am', 'Aw', 'BWh', 'BWk', 'BSh', 'BSk', 'Csa', 'Csb', 'Csc', 'Cwa', 'Cwb', 'Cwc', 'Cfa', 'Cfb', 'Cfc', 'Dsa', 'Dsb', 'Dsc', 'Dsd', 'Dwa', 'Dwb', 'Dwc', 'Dwd', 'Dfa', 'Dfb', 'Dfc', 'Dfd', 'ET', 'EF'])[(o_orderkey % 34)::INT] ELSE '?' END AS climate FROM orders")
def ref_climates(spark, sf):
    return read(spark, sf, "orders", "o_orderkey").select("o_orderkey", labels.climate_name(F.when(F.col("o_orderkey") % 34 < 33, F.col("o_orderkey") % 34)).alias("climate"))


@query("ref_candidates", "SELECT 'EMSR' || s_suppkey AS code, (2010 + s_suppkey % 12) || '-07-01' AS event_date, round(s_suppkey % 30 + 0.5, 3) AS lon, round(40 + s_suppkey % 20 + 0.25, 3) AS lat FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 5 > 0 AND s_suppkey % 4 <> 1 AND 2010 + s_suppkey % 12 >= 2017 AND s_suppkey % 7 <> 2")
def ref_candidates(spark, sf):
    """Activations of a service's replies, also other kinds, open ones and unreadable places."""
    k = F.col("s_suppkey")
    point = F.when(k % 7 == 2, "POINT EMPTY").otherwise(F.concat(F.lit("POINT ("), k % 30 + 0.5, F.lit(" "), k % 20 + 40.25, F.lit(")")))
    d = read(spark, sf, "supplier", "s_suppkey").select(F.concat(F.lit("EMSR"), k).alias("code"), F.lit("n").alias("name"), F.when(k % 3 == 0, "Flood").otherwise("Wildfire").alias("category"), F.concat(k % 12 + 2010, F.lit("-07-01T10:00")).alias("eventTime"), point.alias("centroid"), (k % 5).cast("int").alias("n_products"), (k % 4 != 1).alias("closed"))
    c = labels.wildfire_candidates(d)
    return c.join(labels.event_dates(c), ["code", "event_date"]).select("code", "event_date", r6(F.col("lon"), "lon", 3), r6(F.col("lat"), "lat", 3))


@query("ref_delineations", "SELECT 'EMSR' || lpad((s_suppkey % 40)::VARCHAR, 3, '0') AS code, 'AOI' || lpad((s_suppkey % 3)::VARCHAR, 2, '0') AS aoi, max(CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE s_suppkey % 9 END)::INT AS step FROM supplier GROUP BY 1, 2")
def ref_delineations(spark, sf):
    k = F.col("s_suppkey")
    name = F.concat(F.lit("x/EMSR"), F.lpad((k % 40).cast("string"), 3, "0"), F.lit("_AOI"), F.lpad((k % 3).cast("string"), 2, "0"), F.when(k % 4 == 0, "_DEL_PRODUCT").otherwise(F.concat(F.lit("_DEL_MONIT"), F.lpad((k % 9).cast("string"), 2, "0"))), F.lit(".json"))
    return codes.latest_steps(read(spark, sf, "supplier", "s_suppkey").select(name.alias("path"))).select("code", "aoi", "step")


@query("ref_severity", "SELECT o_orderkey, o_orderkey % 7 IN (2, 3, 4) AS burned, o_orderkey % 7 IN (0, 1, 2, 3, 4) AS valid FROM orders")
def ref_severity(spark, sf):
    b, v = codes.burned_from_severity(F.col("o_orderkey") % 7, background=True)
    return read(spark, sf, "orders", "o_orderkey").select("o_orderkey", b.alias("burned"), v.alias("valid"))


@query("ref_sample_cells", f"WITH {sql_det('temp_k', 'mask_code')} SELECT det_id, temp_k IS NOT NULL AND temp_k::DOUBLE <> 400 AND mask_code % 2 = 0 AS valid, mask_code > 12 AS reference FROM d WHERE mask_code IS NOT NULL")
def ref_sample_cells(spark, sf):
    d = det(spark, sf, "temp_k", "mask_code").where("mask_code IS NOT NULL").withColumns({"reference": F.col("mask_code") > 12, "ok": F.col("mask_code") % 2 == 0})
    return labels.sample_cells(d, "temp_k", "reference", "ok", 400.0).select("det_id", "valid", "reference")


@query("ref_windows", _albers_sql().replace("detections", "example_units").replace("det_id", "uid").replace("SELECT DISTINCT uid, lon, lat FROM", "SELECT DISTINCT uid, lon, lat, area_ha FROM").replace("SELECT uid, round(", "SELECT uid, area_ha, (").replace(", 2) AS px, round(", ") AS px, (").replace(", 2) AS py FROM", ") AS py FROM").replace("WITH d AS", "WITH w AS (WITH d AS", 1) + "), h AS (SELECT *, least(30000.0, greatest(15000.0, 2.5 * sqrt(greatest(coalesce(area_ha, 0), 0) * 1e4 / pi()))) AS h FROM w) SELECT uid, floor((px - h) / 30) * 30 AS x0, floor((py - h) / 30) * 30 AS y0, ((ceil((px + h) / 30) - floor((px - h) / 30)))::INT AS width, ((ceil((py + h) / 30) - floor((py - h) / 30)))::INT AS height FROM h")
def ref_windows(spark, sf):
    return labels.target_windows(units(spark, sf).where("lon IS NOT NULL AND lat IS NOT NULL"), "conus").select("uid", "x0", "y0", "width", "height")


@query("ref_stitched", f"WITH {sql_det('mask_code', 'pixel_id')}, c AS (SELECT pixel_id % 50 AS e, (pixel_id % 7) * 20 + det_id % 32 AS row, (pixel_id % 5) * 24 + (det_id // 32) % 32 AS col, (mask_code > 12)::INT AS v FROM d WHERE pixel_id IS NOT NULL AND mask_code IS NOT NULL) SELECT e::BIGINT AS event_id, row::BIGINT AS row, col::BIGINT AS col, max(v) AS burned FROM c WHERE row < 130 AND col < 110 GROUP BY 1, 2, 3")
def ref_stitched(spark, sf):
    d = det(spark, sf, "mask_code", "pixel_id").where("pixel_id IS NOT NULL AND mask_code IS NOT NULL")
    stem = F.concat_ws("_", F.col("pixel_id") % 50, F.col("pixel_id") % 7, F.col("pixel_id") % 5)
    chips = d.select(stem.alias("stem"), (F.col("det_id") % 32).alias("row"), (F.floor(F.col("det_id") / 32) % 32).alias("col"), (F.col("mask_code") > 12).cast("int").alias("value"))
    m = d.select(stem.alias("stem"), (F.col("pixel_id") % 50).alias("event_id"), (F.col("pixel_id") % 7 * 20).alias("y0"), (F.col("pixel_id") % 5 * 24).alias("x0"), F.lit(130).alias("height"), F.lit(110).alias("width")).distinct()
    return labels.stitched(chips, m)


@query("ref_ignition_frames", f"WITH {_OCC}, p AS (SELECT * FROM norm WHERE cause = 'lightning'), c AS (SELECT * FROM norm WHERE cause <> 'lightning'), n AS (SELECT floor(lon / 0.25) AS x, floor(lat / 0.25) AS y, count(*) AS n FROM p GROUP BY 1, 2), w AS (SELECT c.id, coalesce(n, 0) + 0.001 AS w FROM c LEFT JOIN n ON x = floor(lon / 0.25) AND y = floor(lat / 0.25)) SELECT id, round(w / sum(w) OVER (), 10) AS weight, 0 AS stratum FROM w")
def ref_ignition_frames(spark, sf):
    n = codes.normalize_occurrences(_occurrences(spark, sf))
    _, c = labels.ignition_frames(n.where("cause = 'lightning'"), n.where("cause <> 'lightning'").drop("cause"), [])
    return c.select("id", r6(F.col("weight"), "weight", 10), F.col("stratum").cast("int").alias("stratum"))


# --- stores ---


def _folder(spark, name: str) -> str:
    """A fresh folder for a store, beside the checkpoints (shared by the machines)."""
    import uuid

    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("ref_store", f"WITH {sql_det('t', 'tile_id', 'frp_mw', 'granule_key', 'x')}, k AS (SELECT *, coalesce(ascii(substr(granule_key, length(granule_key) - 4, 1)), 0) % 3 AS part FROM d) SELECT tile_id, t::DATE AS day, count(*) AS n, round(sum(frp_mw::DOUBLE), 2) AS frp FROM k WHERE granule_key IS NOT NULL AND (t IS NULL OR t >= TIMESTAMP '2017-07-03') GROUP BY 1, 2")
def ref_store(spark, sf):
    """Detections written in two overlapping batches, merged by granule, compacted, pruned, and read back."""
    s = store.DetectionStore(spark, _folder(spark, "store"))
    d = det(spark, sf, "t", "tile_id", "x", "y", "lon", "lat", "mask_code", "confidence", "frp_mw", "temp_k", "area_m2", "view_zenith_deg", "true_pixel_area_m2", "granule_key").where("granule_key IS NOT NULL")
    d = d.select(*(F.col(f.name).cast(f.dataType) for f in store.DETECTIONS.fields))
    part = F.pmod(F.xxhash64("granule_key"), F.lit(3))
    for some in ((0, 1), (1, 2)):
        s.write(d.where(part.isin(*some)))
    s.compact()
    first = d.agg(F.min("t")).first()[0]
    if first is not None:
        import datetime as dt

        s.prune(dt.date(2017, 7, 3))
    return s.read().groupBy("tile_id", "day").agg(F.count("*").alias("n"), r6(F.sum(F.col("frp_mw").cast("double")), "frp", 2))


@query("ref_manifest", f"WITH {sql_det('granule_key')}, g AS (SELECT granule_key AS key, count(*) AS n FROM d WHERE granule_key IS NOT NULL GROUP BY 1) SELECT key, n AS n_detections, n % 3 = 0 AS failed FROM g")
def ref_manifest(spark, sf):
    """A manifest of two appends: every granule failed first; the second leaves a third failed, which are the ones pending."""
    s = store.DetectionStore(spark, _folder(spark, "manifest"))
    g = cut(det(spark, sf, "granule_key").where("granule_key IS NOT NULL").groupBy("granule_key").agg(F.count("*").alias("n")))
    rec = lambda status: g.select(F.col("granule_key").alias("key"), F.lit(None).cast("string").alias("scan_start"), status.alias("status"), F.col("n").alias("n_detections"), F.lit(0.0).alias("elapsed_s"), F.lit(None).cast("string").alias("error"))
    d = spark.createDataFrame([], store.DETECTIONS)
    s.write(d, rec(F.lit("error")))
    s.write(d, rec(F.when(F.col("n") % 3 == 0, "error").otherwise("ok")))
    late = s.pending(g.select(F.col("granule_key").alias("key"))).withColumn("failed", F.lit(True))
    return s.manifest().join(late, "key", "left").select("key", "n_detections", F.coalesce("failed", F.lit(False)).alias("failed"))


@query("ref_climatology_store", f"WITH {sql_det('pixel_id', 't', 'temp_k', 'granule_key')}, q AS (SELECT pixel_id, temp_k::DOUBLE AS v, hour(t)::INT AS bin FROM d WHERE temp_k IS NOT NULL AND t IS NOT NULL AND granule_key IS NOT NULL) SELECT pixel_id, bin, count(*) AS n, round(avg(v), 5) AS mean FROM q GROUP BY 1, 2")
def ref_climatology_store(spark, sf):
    """A climatology grown by two batches of which the second repeats granules of the first."""
    s = store.ClimatologyStore(spark, _folder(spark, "climatology"), ["pixel_id"], "temp_k")
    d = det(spark, sf, "pixel_id", "t", "temp_k", "granule_key")
    part = F.pmod(F.xxhash64("granule_key"), F.lit(3))
    s.add(d.where(part < 2))
    s.add(d.where(part > 0))
    return s.states().select("pixel_id", "bin", "n", r6(F.col("mean"), "mean", 5))


# --- cubes ---


@query("ref_power_series", f"WITH {sql_det('t', 'pixel_id', 'frp_mw')}, q AS (SELECT det_id, pixel_id, t, frp_mw::DOUBLE AS frp FROM d WHERE t IS NOT NULL AND frp_mw IS NOT NULL AND pixel_id IS NOT NULL) SELECT pixel_id, round((epoch_us(t) - epoch_us(min(t) OVER (PARTITION BY pixel_id))) / 3.6e9, 6) AS hours, round(frp, 4) AS frp_mw FROM q")
def ref_power_series(spark, sf):
    d = cubes.power_series(det(spark, sf, "t", "pixel_id", "frp_mw").where("pixel_id IS NOT NULL"), "pixel_id")
    return d.select("pixel_id", r6(F.col("hours"), "hours"), r6(F.col("frp_mw"), "frp_mw", 4))


@query("ref_time_blocks", f"WITH {sql_det('t')}, u AS (SELECT DISTINCT t FROM d WHERE t IS NOT NULL), i AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM u) SELECT t, least(i * 5 // n, 4)::INT AS fold FROM i")
def ref_time_blocks(spark, sf):
    return cubes.time_blocks(det(spark, sf, "t"), 5).select(ntz("t").alias("t"), "fold")


_CUBE = f"""{sql_det('t', 'lat', 'lon', 'pixel_id', 'temp_k', 'satellite')}, f AS (SELECT satellite, date_trunc('hour', t) AS t, (pixel_id % 40)::INT AS row, 0 AS col, avg(temp_k::DOUBLE) AS bt FROM d WHERE t IS NOT NULL AND pixel_id IS NOT NULL GROUP BY 1, 2, 3)"""


@query("ref_cube", f"WITH {_CUBE}, g AS (SELECT satellite, t, list(row ORDER BY row) AS g FROM f GROUP BY 1, 2), r AS (SELECT satellite, min_by(g, t) AS g0 FROM g GROUP BY 1), k AS (SELECT g.satellite, g.t, row_number() OVER (PARTITION BY g.satellite ORDER BY g.t) - 1 AS frame FROM g JOIN r USING (satellite) WHERE g.g = r.g0) SELECT satellite, t, frame::INT AS frame, row, round(bt - 300, 5) AS diff FROM f JOIN k USING (satellite, t)")
def ref_cube(spark, sf):
    """Hourly frames of each satellite on the grid of its first frame, and their difference to a flat channel."""
    d = det(spark, sf, "t", "pixel_id", "temp_k", "satellite").where("t IS NOT NULL AND pixel_id IS NOT NULL")
    f = d.groupBy("satellite", F.date_trunc("hour", "t").alias("t"), (F.col("pixel_id") % 40).cast("int").alias("row")).agg(F.avg(F.col("temp_k").cast("double")).alias("bt")).withColumns({"col": F.lit(0), "lat": F.col("row") / 2.0})
    return cubes.assembled(f, ["satellite"]).select("satellite", ntz("t").alias("t"), "frame", "row", r6(cubes.bt_difference(F.col("bt"), F.lit(300.0)), "diff", 5))


@query("ref_solar_cube", f"""WITH {sql_det('t', 'lon', 'lat')}, q AS (SELECT det_id, lon, lat, dayofyear(t)::DOUBLE AS doy, hour(t) + minute(t) / 60.0 + second(t) / 3600.0 AS h FROM d WHERE t IS NOT NULL AND lon IS NOT NULL),
g AS (SELECT *, 2 * pi() / 365.0 * (doy - 1 + (h - 12) / 24.0) AS g FROM q), e AS (SELECT *, 229.18 * (7.5e-05 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) AS eq,
0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS dc FROM g), z AS (SELECT *, radians((h * 60 + eq + 4 * lon) / 4 - 180) AS ha FROM e)
SELECT det_id, floor(degrees(acos(least(1.0, greatest(-1.0, sin(radians(lat)) * sin(dc) + cos(radians(lat)) * cos(dc) * cos(ha)))))) AS zenith FROM z""")
def ref_solar_cube(spark, sf):
    d = det(spark, sf, "t", "lon", "lat").where("t IS NOT NULL AND lon IS NOT NULL")
    return cubes.with_solar_zenith(d).select("det_id", F.floor("solar_zenith_deg").cast("double").alias("zenith"))


# --- harnesses and scores ---


@query("ref_stratified_draw", f"WITH {_LAB} SELECT (p > 0.7)::INT AS map_class, y AS ref_class, count(*) AS n FROM q GROUP BY 1, 2")
def ref_stratified_draw(spark, sf):
    """A draw of more cells than there are takes every cell: the whole confusion."""
    d = _labelled(spark, sf).withColumn("m", harness.above(F.col("p"), 0.7))
    return harness.stratified_confusion(d, "y", "m", {0: 10**9, 1: 10**9}, "det_id").select("map_class", "ref_class", "n")


_SKILLS = f"{sql_det('t', 'satellite', 'confidence', 'temp_k', 'frp_mw')}, s AS (SELECT satellite || t::DATE AS fire, avg(confidence::DOUBLE) AS c, avg(temp_k::DOUBLE / 1000) AS k FROM d WHERE t IS NOT NULL AND satellite IS NOT NULL AND confidence IS NOT NULL AND temp_k BETWEEN 150 AND 2000 GROUP BY 1)"


@query("ref_head_to_head", f"WITH {_SKILLS} SELECT 'c' AS a, 'k' AS b, count(*) AS n, round(avg(c), 6) AS mean_a, round(avg(k), 6) AS mean_b, round(avg(c - k), 6) AS mean_diff, true AS inside FROM s")
def ref_head_to_head(spark, sf):
    """Two scores over satellites and days; the interval must hold the mean."""
    d = det(spark, sf, "t", "satellite", "confidence", "temp_k").where("t IS NOT NULL AND satellite IS NOT NULL AND confidence IS NOT NULL AND temp_k BETWEEN 150 AND 2000")
    s = cut(d.groupBy(F.concat("satellite", F.to_date("t").cast("string")).alias("fire")).agg(F.avg(F.col("confidence").cast("double")).alias("c"), F.avg(F.col("temp_k").cast("double") / 1000).alias("k")))
    r = harness.head_to_head(s.unpivot(["fire"], ["c", "k"], "model", "skill"), ["c", "k"], 2000)
    return r.select("a", "b", "n", *(r6(F.col(c), c) for c in ("mean_a", "mean_b", "mean_diff")), F.col("mean_diff").between(F.col("ci_low"), F.col("ci_high")).alias("inside"))


@query("ref_early_detection", f"""WITH {sql_det('pixel_id', 't', 'temp_k')}, q AS (SELECT det_id, pixel_id, temp_k::DOUBLE AS bt, row_number() OVER (PARTITION BY pixel_id ORDER BY t, det_id) - 1 AS idx, count(*) OVER (PARTITION BY pixel_id) AS n, pixel_id % 5 = 0 AS fire FROM d WHERE t IS NOT NULL AND pixel_id IS NOT NULL AND temp_k BETWEEN 150 AND 2000),
m AS (SELECT pixel_id, avg(bt) AS m FROM q WHERE NOT fire OR idx < 5 GROUP BY 1), r AS (SELECT q.*, bt - m AS res FROM q JOIN m USING (pixel_id)), c AS (SELECT quantile_cont(res, 0.9) AS cr, quantile_cont(bt, 0.9) AS cb FROM r WHERE NOT fire)
SELECT round(min(CASE WHEN res > cr THEN (idx - 5) * 5.0 END), 4) AS residual_min, round(min(CASE WHEN bt > cb THEN (idx - 5) * 5.0 END), 4) AS absolute_min FROM r, c WHERE fire AND idx >= 5""")
def ref_early_detection(spark, sf):
    from pyspark.sql.window import Window as W

    d = det(spark, sf, "pixel_id", "t", "temp_k").where("t IS NOT NULL AND pixel_id IS NOT NULL AND temp_k BETWEEN 150 AND 2000")
    d = d.select(F.col("pixel_id").alias("pixel"), "t", F.col("temp_k").cast("double").alias("bt"), (F.row_number().over(W.partitionBy("pixel_id").orderBy("t", "det_id")) - 1).alias("idx"), (F.col("pixel_id") % 5 == 0).alias("fire"), F.lit(5).alias("onset"))
    return harness.early_detection(d, 0.1, order=0).select(r6(F.col("residual_min"), "residual_min", 4), r6(F.col("absolute_min"), "absolute_min", 4))


@query("ref_forecast_scores", f"""WITH {_FULL}, f AS (SELECT (col // 30)::INT AS fire, p, o, row % 7 = 0 AS t0, row % 11 > 0 AS valid FROM u), k AS (SELECT fire, p, o::INT AS y, (p > 0.5)::INT AS c FROM f WHERE NOT t0 AND valid), h AS (SELECT fire, p, sum(y) AS yp, count(*) AS n FROM k GROUP BY 1, 2),
w AS (SELECT fire, yp, sum(yp) OVER (PARTITION BY fire ORDER BY p DESC) AS cp, sum(n) OVER (PARTITION BY fire ORDER BY p DESC) AS cn FROM h), a AS (SELECT fire, sum(yp * cp / cn) / nullif(sum(yp), 0) AS ap FROM w GROUP BY 1),
s AS (SELECT fire, count(*) AS n, avg(y) AS base_rate, avg(pow(p - y, 2)) AS brier, count(*) FILTER (c = 1 AND y = 1) AS tp, sum(c) AS sel, sum(y) AS pos FROM k GROUP BY 1)
SELECT fire, n, round(base_rate, 8) AS base_rate, round(brier, 8) AS brier, round(ap, 8) AS ap, round(coalesce(2 * tp / nullif(sel + pos, 0), 0), 8) AS f1, round(coalesce(tp / nullif(sel + pos - tp, 0), 0), 8) AS iou FROM s LEFT JOIN a USING (fire)""")
def ref_forecast_scores(spark, sf):
    d = _full(spark, sf).select(F.floor(F.col("col") / 30).cast("int").alias("fire"), "p", (F.col("o") > 0).alias("fire_t1"), (F.col("row") % 7 == 0).alias("fire_t"), (F.col("row") % 11 > 0).alias("valid"))
    return harness.forecast_scores(d, "p", ["fire"]).select("fire", "n", *(r6(F.col(c), c, 8) for c in ("base_rate", "brier", "ap", "f1", "iou")))


def _fires(spark, sf):
    """Fires on 32 x 32 cells of each tile: what burned in the first half of the time, and in the second."""
    d = det(spark, sf, "t", "tile_id", "x", "y").where("tile_id <> '' AND x IS NOT NULL AND t IS NOT NULL")
    cell = lambda c: F.pmod(F.floor(F.col(c) / 3000), F.lit(32)).cast("int")
    seen = d.groupBy(F.col("tile_id").alias("fire"), cell("y").alias("row"), cell("x").alias("col")).agg(F.min("t").alias("t"))
    ends = seen.groupBy("fire").agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    grid = ends.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(1023)))).select("fire", "_a", "_b", F.floor(F.col("k") / 32).cast("int").alias("row"), (F.col("k") % 32).cast("int").alias("col"))
    mid = (F.unix_micros("_a") + F.unix_micros("_b")) / 2
    g = grid.join(seen, ["fire", "row", "col"], "left")
    early = F.coalesce(F.unix_micros("t") <= mid, F.lit(False))
    return g.select("fire", "row", "col", early.alias("fire_t"), F.col("t").isNotNull().alias("fire_t1"), F.lit(True).alias("valid"), ((F.unix_micros("t") - F.unix_micros("_a")) / 3.6e9).alias("time"), F.lit(0.6).alias("fuel"), F.lit(0.3).alias("wind"), (F.col("row") / 64.0).alias("slope"))


@query("ref_next_day")
def ref_next_day(spark, sf):
    f = cut(_fires(spark, sf))
    folds = cut(harness.grouped_folds(f, 3, "fire"))
    r = harness.next_day(f, folds, "fire", 32, 32)
    return r.select("model", "fire", "n", *(r6(F.col(c), c, 6) for c in ("base_rate", "ap", "f1", "iou", "brier")))


@query("ref_assimilated")
def ref_assimilated(spark, sf):
    d = _fires(spark, sf).withColumn("ros", raster.rate_of_spread(F.col("fuel"), F.col("wind"), F.col("slope")))
    a = harness.assimilated(d, ["fire"])
    return a.select("fire", r6(F.col("k"), "k", 5), "n_early", "n_late", *(r6(F.col(c), c, 6) for c in ("dice", "pod", "far")))


@query("ref_early_and_late", f"""WITH {sql_det('t', 'tile_id', 'x', 'y')}, s AS (SELECT tile_id, floor(y / 3000)::BIGINT - 32 * floor(floor(y / 3000) / 32.0)::BIGINT AS r, floor(x / 3000)::BIGINT - 32 * floor(floor(x / 3000) / 32.0)::BIGINT AS c, min(epoch_us(t)) AS u FROM d WHERE tile_id <> '' AND x IS NOT NULL AND t IS NOT NULL GROUP BY 1, 2, 3),
q AS (SELECT tile_id, quantile_cont(u, 0.5) AS m, count(*) AS n FROM s GROUP BY 1 HAVING count(*) >= 2) SELECT tile_id AS fire, count(*) FILTER (u <= m) AS n_early, count(*) FILTER (u > m) AS n_late FROM s JOIN q USING (tile_id) GROUP BY 1""")
def ref_early_and_late(spark, sf):
    """The detected cells that calibrate a fire's spread and those that judge it."""
    d = _fires(spark, sf).withColumn("ros", F.lit(1.0))
    return harness.assimilated(d, ["fire"]).select("fire", "n_early", "n_late")


@query("ref_area_tail", """WITH u AS (SELECT DISTINCT uid, ecoregion, area_ha::DOUBLE AS a FROM example_units WHERE area_ha IS NOT NULL AND ecoregion IS NOT NULL), l AS (SELECT quantile_cont(ln(1 + a), 0.9) AS g FROM u),
q AS (SELECT ecoregion, count(*) AS n, CASE WHEN count(*) >= 30 THEN quantile_cont(ln(1 + a), 0.9) ELSE any_value(g) END AS q FROM u, l GROUP BY 1), e AS (SELECT ln(1 + a) - q AS e FROM u JOIN q USING (ecoregion) WHERE ln(1 + a) - q > 0),
m AS (SELECT count(*) AS k, avg(e) AS m, var_samp(e) AS v FROM e), t AS (SELECT k, 0.5 * (1 - m * m / v) AS c, 0.5 * m * (m * m / v + 1) AS s FROM m)
SELECT ecoregion, n, round(exp(q) - 1, 3) AS q90, CASE WHEN k >= 30 THEN round(exp(q + s / c * (pow(0.2, -c) - 1)) - 1, 2) END AS q98 FROM q, t""")
def ref_area_tail(spark, sf):
    u = units(spark, sf).where("area_ha IS NOT NULL AND ecoregion IS NOT NULL")
    q = harness.burned_area_quantiles(u, ["ecoregion"], "area_ha", [0.5, 0.9, 0.98])
    n = u.count()
    return q.select("ecoregion", "n", r6(F.get("q", F.lit(1)), "q90", 3), (r6(F.get("q", F.lit(2)), "q98", 2) if n >= 300 else F.lit(None).cast("double").alias("q98")))


@query("ref_area_evaluation")
def ref_area_evaluation(spark, sf):
    u = units(spark, sf).where("area_ha IS NOT NULL AND ecoregion IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL")
    r = harness.evaluate_burned_area(u.select("uid", "ecoregion", "area_ha"), splits.spatial_blocks(u, 4), ["ecoregion"], "area_ha", [0.1, 0.25, 0.5, 0.75, 0.9, 0.98])
    return r.select("fold", "n", *(r6(F.col(c), c, 4) for c in ("crps", "crps_climatology", "skill", "rmse")))


@query("ref_sample_size", f"WITH {_LAB}, s AS (SELECT y, count(*) / sum(count(*)) OVER () AS w, avg((p > 0.7)::INT) AS u FROM q GROUP BY y) SELECT ceil(pow(sum(w * sqrt(greatest(u * (1 - u), 0))) / 0.01, 2))::BIGINT AS n FROM s")
def ref_sample_size(spark, sf):
    d = _labelled(spark, sf)
    s = d.groupBy("y").agg(F.count("*").alias("k"), F.avg((F.col("p") > 0.7).cast("double")).alias("u")).crossJoin(F.broadcast(d.agg(F.count("*").alias("all")))).withColumn("w", F.col("k") / F.col("all"))
    return scores.sample_size(s, "w", "u").select(F.col("n").cast("long").alias("n"))


@query("ref_allocated", f"WITH {sql_det('mask_code')}, s AS (SELECT mask_code::INT AS stratum, count(*)::DOUBLE AS w, mask_code IN (12, 32) AS rare FROM d WHERE mask_code IS NOT NULL GROUP BY 1, 3), k AS (SELECT *, 1000 - 75 * count(*) FILTER (rare) OVER () AS rest, sum(w) FILTER (NOT rare) OVER () AS total FROM s), p AS (SELECT *, CASE WHEN rare THEN 75 ELSE floor(w / total * rest + 1e-9) END AS part, row_number() OVER (PARTITION BY rare ORDER BY w DESC, stratum) AS i FROM k) SELECT stratum, (part + CASE WHEN NOT rare AND i = 1 THEN rest - sum(part) FILTER (NOT rare) OVER () ELSE 0 END)::BIGINT AS n FROM p")
def ref_allocated(spark, sf):
    s = det(spark, sf, "mask_code").where("mask_code IS NOT NULL").groupBy(F.col("mask_code").cast("int").alias("stratum")).agg(F.count("*").cast("double").alias("weight")).withColumn("rare", F.col("stratum").isin(12, 32))
    return scores.allocate(s, 1000).select("stratum", "n")


@query("ref_latency", "WITH m AS (SELECT (o_orderkey % 301 - 120)::DOUBLE AS l FROM orders) SELECT count(*) AS n, quantile_cont(l, 0.25) AS p25, quantile_cont(l, 0.5) AS median, quantile_cont(l, 0.75) AS p75, round(avg((l > 0)::INT), 8) AS earlier FROM m")
def ref_latency(spark, sf):
    m = read(spark, sf, "orders", "o_orderkey").select((F.col("o_orderkey") % 301 - 120).cast("double").alias("lead_min"))
    r = linking.latency(m)
    return r.select("n", F.col("p25_lead_min").alias("p25"), F.col("median_lead_min").alias("median"), F.col("p75_lead_min").alias("p75"), r6(F.col("frac_earlier"), "earlier", 8))


@query("ref_labelled_samples", f"""WITH {sql_det('t', 'x', 'y', 'satellite')}, k AS (SELECT *, floor(x / 4000)::BIGINT AS cx, floor(y / 4000)::BIGINT AS cy FROM d WHERE t IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL), a AS (SELECT *, unnest([-1, 0, 1]) AS dx FROM k WHERE satellite = 'goes19'), b AS (SELECT *, unnest([-1, 0, 1]) AS dy FROM a),
h AS (SELECT DISTINCT b.det_id FROM b JOIN k ON k.cx = b.cx + b.dx AND k.cy = b.cy + b.dy AND k.satellite = 'goes18' WHERE abs(epoch_us(b.t) - epoch_us(k.t)) <= 1800000000) SELECT d.det_id, (h.det_id IS NOT NULL)::INT AS label FROM d LEFT JOIN h USING (det_id) WHERE satellite = 'goes19'""")
def ref_labelled_samples(spark, sf):
    d = det(spark, sf, "t", "x", "y", "satellite")
    return linking.labelled_samples(d.where("satellite = 'goes19'"), d.where("satellite = 'goes18'"), "det_id").select("det_id", "label")


@query("ref_strongest_of_tiles", f"WITH {sql_det('tile_id', 'frp_mw')}, r AS (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY frp_mw DESC NULLS LAST, det_id) AS i FROM d WHERE tile_id IS NOT NULL) SELECT det_id, tile_id FROM r WHERE i <= 20")
def ref_strongest_of_tiles(spark, sf):
    return linking.top_rows(det(spark, sf, "tile_id", "frp_mw").where("tile_id IS NOT NULL"), ["tile_id"], 20).select("det_id", "tile_id")


@query("ref_negative_counts", "WITH u AS (SELECT DISTINCT uid, label_source AS s, (floor(lon / 20) * 100000 + floor(lat / 20))::BIGINT AS b FROM example_units), p AS (SELECT b, count(*) * 2 AS w FROM u WHERE s = 'mtbs' GROUP BY 1), c AS (SELECT b, count(*) AS n FROM u WHERE s <> 'mtbs' GROUP BY 1) SELECT b AS stratum, least(w, n)::BIGINT AS n FROM p JOIN c USING (b)")
def ref_negative_counts(spark, sf):
    u = units(spark, sf).select(F.col("uid").alias("id"), "label_source", grids.block_key("lon", "lat", 20.0).alias("stratum"))
    return splits.stratified_negatives(u.where("label_source = 'mtbs'"), u.where("label_source <> 'mtbs'"), ratio=2.0).groupBy("stratum").agg(F.count("*").alias("n"))


@query("ref_block_parts", "WITH u AS (SELECT count(DISTINCT uid) AS n FROM example_units WHERE lon IS NOT NULL AND lat IS NOT NULL) SELECT n AS tested, n * 4 AS trained, 0 AS in_both FROM u")
def ref_block_parts(spark, sf):
    """Every unit is tested once, trains in the other folds, and is never in both parts of one."""
    m = cut(splits.spatial_blocks(units(spark, sf)))
    both = splits.overlap(m).agg(F.count("*").cast("int").alias("in_both"))
    return m.agg(F.count_if(F.col("split_name") == "test").alias("tested"), F.count_if(F.col("split_name") == "train").alias("trained")).crossJoin(both)


@query("ref_evenly_spaced", "WITH u AS (SELECT DISTINCT uid, area_ha FROM example_units WHERE area_ha IS NOT NULL), r AS (SELECT uid, row_number() OVER (ORDER BY area_ha, uid) - 1 AS i, count(*) OVER () AS m FROM u) SELECT uid FROM r WHERE i IN (SELECT round_even(k * (m - 1) / 9.0, 0) FROM range(10) x(k), (SELECT count(*) AS m FROM u))")
def ref_evenly_spaced(spark, sf):
    """Ten fires at even ranks of size (the operator's feature)."""
    return splits.evenly_spaced(units(spark, sf), 10, "area_ha", "uid", "size").select("uid")


@query("ref_standardized", f"WITH {sql_det('temp_k', 'frp_mw')} SELECT det_id, round((temp_k::DOUBLE - 300) / 50, 6) AS temp_k, (temp_k IS NULL)::INT AS missing__temp_k FROM d")
def ref_standardized(spark, sf):
    d = det(spark, sf, "temp_k").withColumn("temp_k", F.col("temp_k").cast("double"))
    d = features.with_missingness(d, ["temp_k"]).withColumn("missing__temp_k", F.col("temp_k").isNull().cast("int"))
    return d.select("det_id", r6((F.col("temp_k") - 300) / 50, "temp_k"), "missing__temp_k")


# --- serving ---


@query("ref_state_mode", f"WITH {sql_det('t', 'satellite')}, m AS (SELECT satellite, max(t) AS t FROM d GROUP BY 1), n AS (SELECT max(t) + INTERVAL 20 HOUR AS now FROM d) SELECT satellite, CASE WHEN (epoch_us(now) - epoch_us(t)) / 3.6e9 > 24 THEN 'stale' ELSE 'live' END AS mode FROM m, n")
def ref_state_mode(spark, sf):
    d = det(spark, sf, "t", "satellite")
    now = F.broadcast(d.agg((F.max("t") + F.expr("INTERVAL 20 HOURS")).alias("now")))
    return d.groupBy("satellite").agg(F.max("t").alias("t")).crossJoin(now).select("satellite", serving.state_mode(F.col("t"), F.col("now")).alias("mode"))


@query("ref_weather", """WITH e AS (SELECT o_orderkey AS event_id, (o_orderkey % 41 - 5)::DOUBLE AS t, (o_orderkey % 97 + 3)::DOUBLE AS h, (o_orderkey % 61) / 3.6 AS w, o_orderkey % 6 > 0 AS got FROM orders),
s AS (SELECT *, round_even(100 * (0.55 * least(1.0, greatest(0.0, w / 15)) + 0.3 * least(1.0, greatest(0.0, (45 - h) / 45)) + 0.15 * least(1.0, greatest(0.0, (t - 15) / 25))), 1) AS score FROM e) SELECT event_id, CASE WHEN got THEN t END AS temp_c, CASE WHEN got THEN score END AS risk_score, CASE WHEN got THEN CASE WHEN score >= 75 THEN 'Extreme' WHEN score >= 50 THEN 'High' WHEN score >= 25 THEN 'Moderate' ELSE 'Low' END END AS risk_class FROM s""")
def ref_weather(spark, sf):
    w = weather(spark, sf).select(F.col("o_orderkey").alias("event_id"), F.col("temp").alias("temp_c"), F.col("rh").alias("rh_pct"), (F.col("wind") / 3.6).alias("wind_ms"))
    e = serving.with_weather(w.select("event_id"), w.where("event_id % 6 > 0"))
    return e.select("event_id", "temp_c", F.col("risk_score").cast("double").alias("risk_score"), "risk_class")


@query("ref_snapshot", f"WITH {sql_det('x', 'y', 'lon', 'lat', 't')} SELECT count(*) AS n_detections, true AS complete FROM d WHERE x IS NOT NULL AND y IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL AND t IS NOT NULL")
def ref_snapshot(spark, sf):
    """A published state read back: all detections, and events that hold no more than they."""
    path = _folder(spark, "snapshot")
    serving.snapshot([_placed(spark, sf).drop("confidence")], path, max_gap_s=3 * 3600.0, extra_m=0.0)
    d, e = serving.published(spark, path)
    n = e.agg(F.coalesce(F.sum("n_detections"), F.lit(0)).alias("in_events"))
    return d.agg(F.count("*").alias("n_detections")).crossJoin(n).select("n_detections", (F.col("in_events") <= F.col("n_detections")).alias("complete"))

import datetime as dt
import json
import math
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from cindral.functions import codes, fireweather as fw, geometry, grids, radiative, spectral
from cindral.operators import features, linking, raster, scores, series, serving, splits
from cindral.sources import firms, store

T0 = dt.datetime(2026, 7, 15, 12, 0)


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_entry_points():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) > 80
    code = "import sys; sys.modules['cindral.llm'] = None; import __spark_entry__ as e; assert 'p1_found' not in e.queries() and 'p4_found' in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


def test_fire_weather_example(spark):
    r = one(spark, fw.ffmc(17.0, 42.0, 25.0, 0.0, 85.0).alias("f"), fw.dmc(17.0, 42.0, 0.0, 6.0, 4.0).alias("p"), fw.dc(17.0, 0.0, 15.0, 4.0).alias("d")).asDict()
    r |= one(spark, fw.isi(r["f"], 25.0).alias("i"), fw.bui(r["p"], r["d"]).alias("u")).asDict()
    r |= one(spark, fw.fwi(r["i"], r["u"]).alias("s")).asDict()
    for k, v, tol in (("f", 87.7, 0.15), ("p", 8.5, 0.2), ("d", 19.0, 0.5), ("i", 10.9, 0.3), ("u", 8.5, 0.3), ("s", 10.1, 0.5)):
        assert abs(r[k] - v) <= tol, k


def test_fire_weather_recurrence_equals_columns(spark):
    g = random.Random(0)
    rows = [(c, dt.date(2020, 5, 1) + dt.timedelta(days=i), g.uniform(-3, 35), g.uniform(5, 100), g.uniform(0, 50), g.choice([0.0, 0.0, 0.3, 2.0, 9.0, 40.0])) for c in (1, 2) for i in range(25)]
    rows.append((3, dt.date(2020, 5, 1), None, 1.0, 1.0, 1.0))
    df = spark.createDataFrame(rows, "cell int, day date, temp double, rh double, wind double, rain double")
    got = {(r["cell"], r["day"]): r for r in series.fire_weather_days(df).collect()}
    state = {1: (85.0, 6.0, 15.0), 2: (85.0, 6.0, 15.0)}
    for c, d, t, h, w, r in sorted(rows[:-1], key=lambda x: (x[1], x[0]))[:20]:
        a = one(spark, fw.ffmc(t, h, w, r, state[c][0]).alias("f"), fw.dmc(t, h, r, state[c][1], float(d.month)).alias("p"), fw.dc(t, r, state[c][2], float(d.month)).alias("c"))
        state[c] = (a["f"], a["p"], a["c"])
        assert all(abs(x - got[(c, d)][k]) < 1e-9 for x, k in zip(state[c], ("ffmc", "dmc", "dc")))
    assert got[(3, dt.date(2020, 5, 1))]["ffmc"] is None


def test_physics_anchors(spark):
    r = one(
        spark, radiative.transmittance_mir(20.0, 0.0).alias("tau"), radiative.brightness_temperature(3.9, radiative.planck_radiance(3.9, 512.0)).alias("t"), radiative.planck_radiance(3.9, 0.0).alias("zero"),
        radiative.brightness_temperature(3.9, -1.0).alias("none"), geometry.pixel_area_growth(0.0).alias("nadir"), spectral.normalized_difference(0.0, 0.0).alias("nd"), spectral.classify_severity(F.lit(None).cast("double")).alias("sev"),
        fw.spread_risk_score(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double")).alias("risk"), fw.risk_class(75.0).alias("cls"), codes.confidence_pct(F.lit("n")).alias("n"), codes.confidence_pct(F.lit("0.5")).alias("h"),
    )
    assert abs(r["tau"] - 0.69) < 1e-12 and abs(r["t"] - 512) < 1e-9 and r["zero"] == 0 and r["none"] is None and r["nadir"] == 1 and r["nd"] is None and r["sev"] == -1 and r["risk"] is None and r["cls"] == "Extreme" and (r["n"], r["h"]) == (70, 50)


def test_retrieval_and_condition(spark):
    df = spark.createDataFrame([(0.002, 900.0), (0.01, 1100.0), (0.05, 700.0)], "p double, t double")
    mix = lambda lam: radiative.mixed_pixel_radiance(lam, F.col("p"), F.col("t"), 300.0)
    for r in df.withColumn("r", radiative.retrieve(mix(3.9), mix(11.0), 300.0)).withColumn("k", radiative.condition_number("p", "t", 300.0)).collect():
        assert r["r"]["converged"] and abs(r["r"]["t_fire_k"] - r["t"]) < 1e-3 and abs(r["r"]["fire_fraction"] - r["p"]) < 1e-8 and r["k"] >= 1
    assert spark.range(1).select(radiative.retrieve(F.lit(None).cast("double"), 1.0, 300.0).alias("r")).first()["r"]["converged"] is False


def test_projections(spark):
    # Published worked examples are on other ellipsoids; these are round-trip and area checks.
    r = one(spark, *[c.alias(n) for n, c in zip("ab", grids.project(-96.0, 23.0))], *[c.alias(n) for n, c in zip("cd", grids.project(-95.0, 49.0, "EPSG:3979"))], *[c.alias(n) for n, c in zip("ef", grids.project(10.0, 52.0, "EPSG:3035"))])
    assert max(abs(r["a"]), abs(r["b"]), abs(r["c"]), abs(r["d"])) < 1e-6 and abs(r["e"] - 4321000) < 1e-6 and abs(r["f"] - 3210000) < 1e-6
    g = geometry.FixedGrid()
    lat, lon = g.to_latlon(*g.to_scan_angles(40.0, -100.0))
    far = g.to_scan_angles(40.0, 100.0)[0]
    q = one(spark, lat.alias("lat"), lon.alias("lon"), far.alias("far"), g.view_zenith_deg(0.0, -75.0).alias("z"))
    assert abs(q["lat"] - 40) < 1e-9 and abs(q["lon"] + 100) < 1e-9 and q["far"] is None and q["z"] < 1e-6


def test_tiles_and_keys(spark):
    grid = grids.AnalysisGrid("conus")
    r = one(spark, grid.tile_id(0.0, 1e6).alias("t"), grid.tile_id(-9e6, 0.0).alias("o"), *[c.alias(n) for n, c in zip("rxy", grids.parse_tile_id(F.lit("conus/x0031_y0072")))], codes.granule_start(F.lit("a/OR_ABI-L2-FDCC-M6_G18_s20261961201172_e2.nc")).cast("timestamp_ntz").alias("s"), codes.granule_start(F.lit("nothing")).alias("none"), codes.granule_product(F.lit("a/OR_ABI-L2-FDCC-M6_G18_s2.nc")).alias("p"))
    assert r["t"] == "conus/x0025_y0008" and r["o"] == "" and (r["r"], r["x"], r["y"]) == ("conus", 31, 72) and r["s"] == dt.datetime(2026, 7, 15, 12, 1, 17) and r["none"] is None and r["p"] == "ABI-L2-FDCC"
    box = spark.createDataFrame([(1, 0.0, 1e6, 1e5, 1.1e6)], "k int, w double, s double, e double, n double")
    assert grid.tiles_for_bounds(box, "w", "s", "e", "n").count() == 4 and grid.tiles(spark).count() == 49 * 32


def test_firms(spark):
    rows = [(1, "10.5", " 200.0", "20200102", "5", "l"), (2, "-", "1", "2020-01-02", "0100", "n"), (3, "1", "1", "2020/01/02", "2460", "n"), (4, "1", "1", "2020/01/02", "23:59", "77"), (5, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "firms_id int, latitude string, longitude string, acq_date string, acq_time string, confidence string").withColumn("brightness", F.lit("300.5"))
    got = {r["firms_id"]: r for r in firms.records(df).withColumn("u", F.col("t").cast("timestamp_ntz")).collect()}
    assert set(got) == {1, 4} and got[1]["lon"] == -160.0 and got[1]["u"] == dt.datetime(2020, 1, 2, 0, 5) and got[4]["bt_mir_k"] == 300.5


def detections(n=220, seed=1):
    g = random.Random(seed)
    out = []
    for i in range(n):
        out.append((i, g.choice(["viirs", "goes", "modis"]), g.uniform(0, 60_000), g.uniform(0, 60_000), T0 + dt.timedelta(minutes=g.randrange(0, 3000)), g.choice([None, g.uniform(1, 90)])))
    return out


def test_clusters_against_brute_force(spark):
    rows = detections()
    tol = geometry.SENSOR_TOLERANCE_M
    df = spark.createDataFrame(rows, "det_id long, sensor string, x double, y double, t timestamp, frp_mw double").withColumn("tolerance_m", geometry.tolerance_m(F.col("sensor"), mode="serving"))
    got, rounds = ({r["det_id"]: r["root"] for r in linking.clustered(df, max_gap_s=4 * 3600, local_edges=n).collect()} for n in (10**6, 0))
    top = list(range(len(rows)))

    def root(v):
        while top[v] != v:
            v = top[v]
        return v

    for a in rows:
        for b in rows[: a[0]]:
            if abs((a[4] - b[4]).total_seconds()) <= 4 * 3600 and math.hypot(a[2] - b[2], a[3] - b[3]) <= max(tol[a[1]], tol[b[1]]):
                p, q = root(a[0]), root(b[0])
                top[max(p, q)] = min(p, q)
    assert got == rounds == {i: root(i) for i in range(len(rows))} and len(set(got.values())) < len(rows)


def test_event_features(spark):
    rows = [(1, 7, "goes", 0.0, 0.0, T0, 10.0, "grass"), (2, 7, "GOES", 0.0, 0.0, T0 + dt.timedelta(hours=1), 30.0, "forest"), (3, 7, "viirs", 3000.0, 0.0, T0 + dt.timedelta(hours=2), 50.0, "forest"), (4, 8, "goes", 0.0, 0.0, T0, 1.0, None), (5, 8, "goes", 0.0, 0.0, T0 + dt.timedelta(minutes=12), 2.0, None)]
    df = spark.createDataFrame(rows, "det_id long, root long, sensor string, x double, y double, t timestamp, frp_mw double, landcover string")
    f = {r["root"]: r for r in linking.event_features(df).collect()}
    assert abs(f[7]["frp_growth_mw_per_h"] - 20) < 1e-6 and f[7]["peak_frp_mw"] == 50 and f[7]["n_sensors"] == 2 and f[7]["landcover_forest"] == 1 and f[7]["duration_h"] == 2
    assert f[8]["frp_growth_mw_per_h"] is None and f[8]["landcover_grass"] == 0 and f[8]["mean_confidence"] is None


def test_matching_equals_greedy(spark):
    g = random.Random(5)
    cand = [(f"p{g.randrange(30)}", f"t{g.randrange(30)}", float(g.randrange(20)), 0.0) for _ in range(200)]
    cand = list({c[:2]: c for c in cand}.values())
    got = {tuple(r)[:2] for r in linking.matched_one_to_one(spark.createDataFrame(cand, "pred_id string, truth_id string, distance_m double, lead_min double")).collect()}
    used_p, used_t, want = set(), set(), set()
    for p, t, d, _ in sorted(cand, key=lambda c: (c[2], c[0], c[1])):
        if p not in used_p and t not in used_t:
            used_p.add(p), used_t.add(t), want.add((p, t))
    assert got == want


def test_coincidence_example(spark):
    s = "k long, x double, y double, t timestamp"
    v, g = spark.createDataFrame([(1, 100.0, 100.0, T0)], s), spark.createDataFrame([(2, 5100.0, 100.0, T0 + dt.timedelta(minutes=2))], s)
    assert linking.coincidence(v, g, "k", 2000.0, 1800).count() == 0
    assert [tuple(r) for r in linking.coincidence(v, g, "k", 4000.0, 1800).collect()] == [(1, 120.0)]


def test_metrics_examples(spark):
    c = scores.ratios(scores.confusion(spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0)], "t int, p int"), "t", "p")).first()
    assert (c["tp"], c["fp"], c["fn"], c["tn"]) == (1, 1, 1, 1) and abs(c["iou"] - 1 / 3) < 1e-12
    df = spark.createDataFrame([(1, 0, 0.1), (2, 0, 0.4), (3, 1, 0.35), (4, 1, 0.8)], "i int, y int, s double")
    assert abs(scores.average_precision(df, "y", "s", "i").first()[0] - 0.8333333) < 1e-6
    a = {r["class"]: r for r in scores.estimate_areas(spark.createDataFrame([(0, 0, 97), (0, 1, 3), (1, 0, 10), (1, 1, 90)], "map_class int, ref_class int, n long"), spark.createDataFrame([(0, 200000.0), (1, 20000.0)], "map_class int, mapped_area double")).collect()}
    assert abs(a[1]["adjusted_area"] - 24000) < 1e-6 and abs(a[1]["users_accuracy"] - 0.9) < 1e-12
    with pytest.raises(Exception, match="fewer than two"):
        scores.estimate_areas(spark.createDataFrame([(0, 0, 1), (1, 1, 9)], "map_class int, ref_class int, n long"), spark.createDataFrame([(0, 1.0), (1, 1.0)], "map_class int, mapped_area double")).collect()
    strata = lambda *w: spark.createDataFrame([(i, float(x), i in (2, 3)) for i, x in enumerate(w)], "stratum int, weight double, rare boolean")
    n = lambda d: [r["n"] for r in d.orderBy("stratum").collect()]
    assert n(scores.allocate(strata(0.7, 0.2, 0.1), 500)) == [331, 94, 75]
    assert n(scores.allocate(strata(0.3, 0.3, 0.1, 0.1, 0.2), 251)) == [39, 37, 75, 75, 25] and sum(n(scores.allocate(strata(0.3, 0.3, 0.1, 0.1, 0.2), 987))) == 987
    with pytest.raises(Exception, match="below the floor"):
        n(scores.allocate(strata(0.5, 0.3, 0.2), 74))


def test_climatology_merge_is_single_pass(spark):
    g = np.random.default_rng(0)
    rows = [(i % 3, T0 + dt.timedelta(minutes=17 * i), float(g.normal(300, 9)), i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "px int, t timestamp, v double, half int")
    key = lambda d: {(r["px"], r["bin"]): (r["n"], r["mean"], r["m2"]) for r in d.collect()}
    whole = key(series.climatology(df, ["px"], "v"))
    parts = key(series.merged_climatology(series.climatology(df.where("half = 0"), ["px"], "v").unionByName(series.climatology(df.where("half = 1"), ["px"], "v")), ["px"]))
    assert whole.keys() == parts.keys() and all(np.allclose(whole[k], parts[k]) for k in whole)


@pytest.mark.parametrize("block", [3600, 7 * 86_400])
def test_islands(spark, block):
    t = [0, 10, 20, 45, 50, 300, 310, 900]
    df = spark.createDataFrame([(T0 + dt.timedelta(minutes=m),) for m in t] + [(None,)], "t timestamp")
    got = sorted((int((r["lo"] - r["hi"]).total_seconds() // -60), r["n"]) for r in series.coverage_intervals(df, block_s=block).collect())
    assert got == sorted([(20, 3), (5, 2), (10, 2), (0, 1)])
    assert series.coverage_gaps(series.coverage_intervals(df, block_s=block)).count() == 3


def test_regrid(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 0, 5.0), (1, 1, 7.0)], "row int, col int, value double")
    assert [r["value"] for r in raster.conservative_regrid(cells, [0, 1, 2], [0, 1, 2], [0, 2], [0, 2]).collect()] == [16.0]
    g = random.Random(2)
    dst = sorted({0.0, 2.0, *(g.uniform(0, 2) for _ in range(5))})
    out = raster.conservative_regrid(cells, [0, 1, 2], [0, 1, 2], dst, dst)
    raster.check_mass(cells, out)
    with pytest.raises(NotImplementedError):
        raster.coarsened(cells, 2, "flux")


def test_bilinear(spark):
    dem = spark.createDataFrame([(r, c, float(2 * c + 3 * r)) for r in range(4) for c in range(4) if (r, c) != (3, 3)], "row int, col int, elev double")
    p = spark.createDataFrame([(1, 0.5, 0.25), (2, 2.5, 2.5), (3, 9.0, 1.0), (4, None, 1.0)], "det_id int, x double, y double")
    assert {r["det_id"]: r["elev"] for r in raster.sampled(p, dem, 0.0, 0.0, 1.0, 1.0).collect()} == {1: 1.75, 2: None, 3: None, 4: None}


def test_fronts(spark):
    cells = [(1, r, c, 1.0, r == 0 and c == 0, 0.0, 0.0) for r in range(12) for c in range(12)] + [(2, r, c, 0.0, False, 0.0, 0.0) for r in range(2) for c in range(2)]
    df = spark.createDataFrame(cells, "fire int, row int, col int, ros double, seed boolean, w double, d double")
    t = {(r["fire"], r["row"], r["col"]): r["arrival"] for r in raster.arrival_times(df, ["fire"]).collect()}
    assert t[(1, 0, 7)] == 7 and abs(t[(1, 5, 5)] - math.hypot(5, 5)) < 1.2 and t[(2, 1, 1)] is None
    e = {(r["row"], r["col"]): r["arrival"] for r in raster.arrival_times(df.where("fire = 1"), ["fire"], wind="w", direction="d").collect()}
    assert abs(e[(4, 4)] - 4 * math.sqrt(2)) < 1e-9
    # With wind along the columns: downwind at the head's speed, upwind slower by (1 + e) / (1 - e); every time is explained by a neighbour.
    windy = [(1, r, c, 1.0, r == 6 and c == 6, 1.0, 0.0) for r in range(13) for c in range(13)]
    d = spark.createDataFrame(windy, "fire int, row int, col int, ros double, seed boolean, w double, d double")
    a = {(r["row"], r["col"]): r["arrival"] for r in raster.arrival_times(d, ["fire"], wind="w", direction="d").collect()}
    ecc = math.sqrt(15) / 4
    cost = lambda dy, dx: math.hypot(dy, dx) * (1 - ecc * math.cos(math.atan2(dy, dx))) / (1 - ecc)
    assert abs(a[(6, 12)] - 6) < 1e-9 and abs(a[(6, 0)] - 6 * (1 + ecc) / (1 - ecc)) < 1e-9
    for (y, x), t in a.items():
        near = [a[(y - dy, x - dx)] + cost(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (y - dy, x - dx) in a]
        assert t == 0.0 if (y, x) == (6, 6) else abs(t - min(near)) < 1e-9


def test_fss_and_dilation(spark):
    g = spark.createDataFrame([(r, c, float((r, c) == (2, 2)), float((r, c) == (2, 3))) for r in range(6) for c in range(6)], "row int, col int, o double, p double")
    f = [raster.fractions_skill_score(g, "o", "p", n, 6, 6).first()["fss"] for n in (1, 3, 5)]
    assert f[0] == 0 and f[0] < f[1] < f[2]
    assert raster.dilated(g, "o", 1, 6, 6).count() == 9
    wrapped = raster.neighborhood_mean(g, "o", 5, 6, 6, wrap=True).agg(F.sum("o")).first()[0]
    assert abs(wrapped - 1.0) < 1e-12
    r = raster.f1_with_tolerance(g.where("o > 0"), g.where("p > 0"), 1, 6, 6).first()
    assert r["f1"] == 1.0


def test_splits(spark):
    rows = [(f"u{i}", float(-120 + 7 * (i % 9)), float(30 + 3 * (i % 5)), dt.date(2018 + i % 5, 7, 1), f"e{i % 3}" if i % 7 else None) for i in range(60)]
    u = spark.createDataFrame(rows, "uid string, lon double, lat double, when_date date, ecoregion string")
    for m in (splits.spatial_blocks(u, 4), splits.leave_one_group_out(u, "ecoregion"), splits.leave_year_out(u)):
        splits.verify_no_overlap(m)
    b = splits.spatial_blocks(u, 4).where("split_name = 'test'")
    assert b.count() == 60 and b.select("uid").distinct().count() == 60
    y = splits.leave_year_out(u)
    assert {(r["held_out"], r["split_name"]) for r in y.select("held_out", "split_name").distinct().collect()} >= {("2019", "val"), ("2022", "test")}
    assert splits.fingerprint(y, "year", {}) == splits.fingerprint(y.orderBy("uid"), "year", {}) != splits.fingerprint(y, "x", {})
    with pytest.raises(NotImplementedError):
        splits.random_split(u)
    with pytest.raises(ValueError):
        splits.require_unique(u.unionByName(u))
    with pytest.raises(ValueError):
        splits.spatial_blocks(u, 1000)


def test_hull(spark):
    g = random.Random(3)
    pts = [(1, g.uniform(0, 1), g.uniform(0, 1)) for _ in range(200)] + [(1, x, y) for x in (0.0, 1.0) for y in (0.0, 1.0)] + [(2, 0.0, 0.0), (2, 1.0, 1.0), (3, 0.0, 0.0), (3, 0.0, 1.0), (3, 1.0, 0.0)]
    rings = {r["k"]: r["ring"] for r in serving.hull(spark.createDataFrame(pts, "k int, lon double, lat double"), ["k"]).collect()}
    assert {tuple(p) for p in rings[1]} == {(0, 0), (0, 1), (1, 0), (1, 1)} and rings[1][0] == rings[1][-1] and rings[2] is None and len(rings[3]) == 4


def test_store(spark, tmp_path):
    s = store.DetectionStore(spark, str(tmp_path / "a"))
    s.check_config({"satellite": 18})
    s.check_config({"satellite": 18})
    with pytest.raises(ValueError):
        s.check_config({"satellite": 16})
    row = lambda key, day, n, tile="conus/x0001_y0001": [(dt.datetime(2020, 1, day, 1), tile, 1.0, 2.0, -100.0, 40.0, 10, 0.95, float(i), 400.0, 1.0, 1.0, 1.0, key) for i in range(n)]
    frame = lambda rows: spark.createDataFrame([(*r[:6], r[6], *r[7:]) for r in rows], store.DETECTIONS)
    rec = lambda *r: spark.createDataFrame(r, store.MANIFEST)
    s.write(frame(row("k1", 1, 3) + row("k2", 1, 2)), rec(("k1", "2020-01-01T01:00:00", "ok", 3, 0.1, None), ("k2", None, "error", 0, 0.1, "x")))
    s.write(frame(row("k2", 1, 4) + row("k3", 2, 1, "")), rec(("k2", "2020-01-01T01:00:00", "ok", 4, 0.1, None)))
    s.write(frame(row("k2", 1, 4)))
    assert {r["granule_key"]: r["count"] for r in s.read().groupBy("granule_key").count().collect()} == {"k1": 3, "k2": 4, "k3": 1}
    assert {r["key"]: r["status"] for r in s.manifest().collect()} == {"k1": "ok", "k2": "ok"}
    keys = spark.createDataFrame([("k1",), ("k9",)], "key string")
    assert [r["key"] for r in s.pending(keys).collect()] == ["k9"]
    extra = s.read().where("day = date'2020-01-01'").limit(2)
    extra.repartition(2).write.mode("append").partitionBy("year", "tile", "day").parquet(s.rows)
    n = s.read().count()
    assert s.compact().count() == 1 and s.read().count() == n and s.compact().count() == 0
    assert s.prune(dt.date(2020, 1, 2)) == 1 and s.read().count() == 1


def test_json_and_kmz(spark, tmp_path):
    e = spark.createDataFrame([("a<b", "#E8552B", [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]])], "name string, color string, ring array<array<double>>")
    fc = json.loads(store.feature_collection(e, ["name"]))
    assert fc["features"][0]["properties"]["name"] == "a<b" and len(fc["features"][0]["geometry"]["coordinates"][0]) == 4
    assert store.write_kmz(e, str(tmp_path / "x.kmz")) == (1, 0)
    many = spark.createDataFrame([(i, float(i % 7), "#E8552B", [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]) for i in range(20)], "event_id long, frp_max double, color string, ring array<array<double>>")
    fc = json.loads(store.feature_collection(many, ["event_id"], limit=4))
    assert fc["omitted"] == 16 and [f["properties"]["event_id"] for f in fc["features"]] == [6, 13, 5, 12]
    assert store.write_kmz(many, str(tmp_path / "y.kmz"), name="event_id", limit=4) == (4, 16)


def test_store_keeps_rows_without_time(spark, tmp_path):
    s = store.DetectionStore(spark, str(tmp_path / "a"))
    row = lambda key, day, v: (dt.datetime(2020, 1, day, 1) if day else None, "conus/x0001_y0001", 1.0, 2.0, -100.0, 40.0, 10, 0.95, v, 400.0, 1.0, 1.0, 1.0, key)
    frame = lambda *rows: spark.createDataFrame(list(rows), store.DETECTIONS)
    s.write(frame(row("g1", None, 1.0), row("g1", 1, 2.0)))
    s.write(frame(row("g2", None, 3.0)))
    s.write(frame(row("g2", None, 4.0), row("g3", 1, 5.0)))
    s.write(frame(row("g4", None, 6.0)).limit(0))
    assert sorted((r["granule_key"], r["frp_mw"]) for r in s.read().collect()) == [("g1", 1.0), ("g1", 2.0), ("g2", 4.0), ("g3", 5.0)]
    assert s.compact(min_files=1).count() == 2 and s.read().count() == 4
    rec = lambda *r: spark.createDataFrame(r, store.MANIFEST)
    for i in range(4):
        s.write(frame(row("g4", 2, 6.0)), rec(("k", None, f"try {i}", 0, 0.1, None), ("k", None, f"again {i}", 0, 0.1, None)))
    assert [r["status"] for r in s.manifest().collect()] == ["again 3"]


def test_only_the_subpackage_may_be_missing():
    run = lambda code: subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0], capture_output=True, text=True)
    broken = run("import sys; sys.modules['cindral.operators.raster'] = None; import __spark_entry__ as e; e.queries()")
    assert broken.returncode != 0 and "cindral.operators.raster" in broken.stderr


def test_session_twice_and_package_on_workers(tmp_path):
    code = f"import sys; sys.path.insert(0, {__file__.rsplit('/tests/', 1)[0]!r}); from cindral.session import session; a = session('local[2]', 2); b = session('local[2]', 2); assert a is b\n"
    code += "from cindral.operators.drift import leaves; print(leaves(a.createDataFrame([(1, '{\"a\": 1}')], 'k int, body string'), ['k']).count())"
    r = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert r.returncode == 0 and r.stdout.strip().endswith("1"), r.stderr[-2000:]


def test_checkpoint_folder_is_asked_for_off_local():
    from types import SimpleNamespace as N

    from cindral import session

    none = N(isDefined=lambda: False)
    sc = N(getConf=lambda: N(get=lambda k, d: d), _jsc=N(sc=lambda: N(getCheckpointDir=lambda: none)), master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(N(sparkContext=sc))


def test_features_without_coordinates(spark):
    assert len(features.feature_names()) == 35 and not set(features.feature_names()) & features.FORBIDDEN
    with pytest.raises(ValueError):
        features.assert_allowed(["frp", "Lat"])
    d = spark.createDataFrame([(1.0, None), (2.0, 3.0)], "a double, b double")
    assert features.with_missingness(d, ["a", "b"]).columns == ["a", "b", "missing__b"]


def test_stream_keeps_identity(spark, tmp_path):
    from cindral.streaming.nrt import EventTracker, detections_stream

    schema = "det_id long, t timestamp, x double, y double, frp_mw double, sensor string, tolerance_m double"
    src = tmp_path / "in"
    row = lambda i, minutes, x: (i, T0 + dt.timedelta(minutes=minutes), x, 0.0, 5.0, "goes", 1000.0)
    for n, rows in enumerate([[row(5, 0, 0.0), row(6, 10, 100.0)], [row(1, 30, 200.0), row(9, 40, 90_000.0), row(5, 0, 0.0)], [row(12, 2000, 0.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = detections_stream(spark, str(src), spark.createDataFrame([], schema).schema, files=1)
        tracker = EventTracker(spark, str(tmp_path / "state"), extra_m=0.0)
        tracker.run(stream, str(tmp_path / "ck"), str(tmp_path / "out")).awaitTermination()
    # Batches without data (they only move the watermark) report no events.
    paths = sorted((tmp_path / "out").iterdir(), key=lambda p: int(p.name.split("=")[1]))
    out = [{(r["event_id"], r["is_update"], r["n_detections"]) for r in spark.read.parquet(str(p)).collect()} for p in paths]
    assert [o for o in out if o] == [{(5, False, 2)}, {(5, True, 3), (9, False, 1)}, {(12, False, 1)}]


def test_event_queries_count_all_detections(spark, tmp_path):
    from cindral.plans import reference as plans

    # Six readings of one pixel in one hour and cell, and one of another fire: none may be thinned out.
    kind = {"det_id": "long", "t": "timestamp_ntz", "mask_code": "short", "pixel_id": "long", "tile_id": "string", "satellite": "string", "granule_key": "string"}
    row = lambda i, minute, x, frp: tuple({"det_id": i, "t": T0.replace(minute=minute), "x": x, "y": 0.0, "lon": -96.0 + x / 1e5, "lat": 23.0 + i % 2 / 1e4, "frp_mw": frp, "mask_code": 10, "pixel_id": 1, "tile_id": "", "satellite": "g", "granule_key": ""}.get(c, 0.5) for c in plans.DET)
    rows = [row(i, 5 * i, 10.0 * (i % 3), float(i)) for i in range(1, 7)] + [row(9, 0, 50_000.0, 3.0)]
    spark.createDataFrame(rows, ", ".join(f"{c} {kind.get(c, 'double')}" for c in plans.DET)).write.parquet(str(tmp_path / "detections.parquet"))
    assert {tuple(r) for r in plans.ref_events(spark, str(tmp_path)).collect()} == {*((i, 1) for i in range(1, 7)), (9, 9)}
    got = {r["root"]: (r["n_detections"], r["total_frp_mw"], r["peak_frp_mw"]) for r in plans.ref_event_features(spark, str(tmp_path)).collect()}
    assert got[1][0] == 6 and abs(got[1][1] - 21.0) < 0.01 and got[1][2] == 6.0 and got[9][0] == 1
    assert [(r["root"], r["n_detections"]) for r in plans.ref_event_records(spark, str(tmp_path)).collect()] == [(1, 6)]
    assert {r["det_id"] for r in plans.ref_events_thinned(spark, str(tmp_path)).collect()} == {1, 9}


def test_first_frames_reach_every_pixel(spark, tmp_path):
    from cindral.plans import reference as plans

    # Later than 600 frames, both sides of longitude 180, far north where 3 km are more than a cell, and Alaska west of -140.
    rows = [(1, dt.datetime(2017, 7, 1, 0, 10), -100.0, 40.0, 1), (2, dt.datetime(2017, 7, 30, 1, 0), -110.0, 40.0, 2), (3, dt.datetime(2017, 7, 2, 0, 0), 179.995, 50.0, 3), (4, dt.datetime(2017, 7, 1, 0, 45), -179.995, 50.0, 4)]
    rows += [(5, dt.datetime(2017, 7, 3, 0, 0), 179.999, 20.0, 5), (6, dt.datetime(2017, 7, 3, 1, 0), -179.999, 20.0, 5), (7, dt.datetime(2017, 7, 4), -150.0, 75.0, 7), (8, dt.datetime(2017, 7, 5), -149.902, 75.0, 8), (9, dt.datetime(2017, 7, 6), -145.0, 20.0, 9)]
    spark.createDataFrame(rows, "det_id long, t timestamp_ntz, lon double, lat double, pixel_id long").write.parquet(str(tmp_path / "detections.parquet"))
    got = {r["pixel_id"]: r["frame_idx"] for r in plans.ref_first_frames(spark, str(tmp_path)).collect()}
    assert got == {1: 1, 2: 29 * 32 + 2, 3: 1, 4: 1, 5: 64, 7: 96, 8: 96, 9: 160}
    assert {r["det_id"] for r in plans.ref_fixed_grid(spark, str(tmp_path)).collect()} == {1, 2, 9}

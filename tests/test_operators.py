import datetime as dt
import math
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from cindral.operators import cubes, harness, labels, linking, models, scores, serving, splits
from cindral.operators.ordered import running_sums
from cindral.operators.quantiles import exact_quantiles
from cindral.sources import store

T0 = dt.datetime(2026, 7, 15, 12, 0)


def test_quantiles_equal_numpy(spark):
    g = np.random.default_rng(0)
    groups = {"a": g.normal(0, 1, 700).round(1), "b": g.exponential(5, 3), None: np.array([4.0]), "c": np.full(50, 7.0)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    qs = [0.0, 0.05, 0.25, 0.5, 0.77, 0.99, 1.0]
    for accuracy in (20_000, 40):  # few steps of the sketch: brackets wider than a value
        got = {r["k"]: (r["n"], r["q"]) for r in exact_quantiles(df, "v", qs, ["k"], accuracy).collect()}
        assert set(got) == set(groups)
        for k, vs in groups.items():
            assert got[k][0] == len(vs) and np.allclose(got[k][1], np.quantile(vs, qs))
    whole = exact_quantiles(df, "v", [0.5]).first()
    assert whole["n"] == 754 and abs(whole["q"][0] - np.quantile(np.concatenate(list(groups.values())), 0.5)) < 1e-12
    empty = exact_quantiles(df.where("v > 1e9"), "v", [0.5]).first()
    assert empty["n"] == 0 and empty["q"] is None


def test_running_sums(spark):
    g = random.Random(1)
    rows = [("x" if g.random() < 0.8 else "y", g.randrange(5), i, g.randrange(10)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, s int, id int, v int")
    got = {r["id"]: r["total"] for r in running_sums(df, [F.desc("s"), F.col("id")], {"total": F.col("v")}, ["k"]).collect()}
    for k in "xy":
        total = 0
        for _, s, i, v in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2])):
            total += v
            assert got[i] == total


def test_average_precision_of_ties(spark):
    g = random.Random(2)
    rows = [(i, int(g.random() < 0.3), g.choice([0.2, 0.5, 0.9])) for i in range(300)]
    tp, k, total = 0, 0, 0.0
    for _, y, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        k += 1
        tp += y
        total += y * tp / k
    got = scores.average_precision(spark.createDataFrame(rows, "i int, y int, s double"), "y", "s", "i").first()[0]
    assert abs(got - total / tp) < 1e-12


def test_bootstrap(spark):
    g = np.random.default_rng(3)
    d = g.normal(0.3, 1.0, 400)
    rows = [(f"f{i}", float(1 + v), 1.0) for i, v in enumerate(d)]
    df = spark.createDataFrame(rows, "k string, a double, b double")
    r = scores.paired_bootstrap(df.repartition(5), "a", "b", "k", 3000).first()
    assert abs(r["mean_diff"] - d.mean()) < 1e-12
    se = d.std() / math.sqrt(len(d))
    assert abs(r["ci_low"] - (d.mean() - 1.96 * se)) < 0.25 * se and abs(r["ci_high"] - (d.mean() + 1.96 * se)) < 0.25 * se and r["p_a_better"] > 0.99
    again = scores.paired_bootstrap(df.repartition(2), "a", "b", "k", 3000).first()
    assert all(abs(x - y) < 1e-12 for x, y in zip(r, again))  # wherever the rows are


def test_clusters_of_fixed_pixels(spark):
    """Many readings of one place are one node; the groups are those of all pairs."""
    g = random.Random(4)
    rows = [(i, float(4000 * g.randrange(12)), float(4000 * g.randrange(12)), T0 + dt.timedelta(minutes=g.randrange(0, 1500)), g.choice([4100.0, 6000.0])) for i in range(400)]
    rows += [(900, 0.0, 0.0, None, 5000.0), (901, None, 0.0, T0, 5000.0), (902, 0.0, 0.0, T0, None)]
    df = spark.createDataFrame(rows, "det_id long, x double, y double, t timestamp, tolerance_m double")
    got = {r["det_id"]: r["root"] for r in linking.clustered(df, max_gap_s=3600).collect()}
    pairs = linking.links(df, max_gap_s=3600)
    want = {r["det_id"]: r["root"] for r in linking.groups(df, pairs, "det_id").collect()}
    assert got == want and got[900] == 900 and got[901] == 901 and got[902] == 902 and 10 < len(set(got.values())) < 300


def test_contraction_in_parts():
    e = [(i, i + 1) for i in range(50)]
    import pandas as pd

    class Fake:
        schema = None

        def mapInPandas(self, f, _):
            return pd.concat(list(f(iter([pd.DataFrame(e[i : i + 10], columns=["a", "b"]) for i in range(0, 50, 10)]))))

    got = linking._contracted(Fake(), most=20)
    assert len(got) == 50 and got["a"].nunique() == 3  # parts of about 20 edges


def test_registry_rules(spark):
    rows = [("a", "mtbs", "p", "m"), ("b", "mtbs", "p", None), ("c", "NIROPS", "p", "m"), ("d", "nbac", None, None), ("e", None, None, None)]
    r = spark.createDataFrame(rows, "event_id string, source string, geometry_path string, interior_mask_path string")
    ids = lambda d: {x["event_id"] for x in d.collect()}
    assert ids(labels.training_records(r)) == {"a", "d", "e"} and ids(labels.training_records(r, False)) == {"a", "b", "d", "e"} and ids(labels.evaluation_records(r)) == {"c"}
    with pytest.raises(ValueError, match="b has an outline"):
        labels.assert_trainable(r)
    with pytest.raises(ValueError, match="c is reserved"):
        labels.assert_trainable(r.where("event_id = 'c'"))
    assert labels.assert_trainable(r.where("event_id = 'a'")).count() == 1


def test_cubes(spark):
    rows = [(m, r, 0, float(r), 300.0 + r) for m in (0, 30, 60) for r in range(3)] + [(45, r, 0, float(r), 1.0) for r in range(2)]
    f = spark.createDataFrame([(T0 + dt.timedelta(minutes=m), *x) for m, *x in rows], "t timestamp, row int, col int, lat double, bt double")
    got = cubes.assembled(f)
    assert {(r["t"].minute + 60 * (r["t"].hour - T0.hour), r["frame"]) for r in got.collect()} == {(0, 0), (30, 1), (60, 2)}
    b = cubes.time_blocks(spark.createDataFrame([(T0 + dt.timedelta(hours=i),) for i in range(10)], "t timestamp"), 3)
    assert sorted(r["fold"] for r in b.collect()) == [0, 0, 0, 0, 1, 1, 1, 2, 2, 2]
    assert [cubes.to_odd(k) for k in (0, 1, 2, 3.4, 4, 7)] == [1, 1, 3, 3, 5, 7]


def test_stores(spark, tmp_path):
    s = store.ClimatologyStore(spark, str(tmp_path / "c"), ["px"], "v")
    row = lambda g, i, v: (g, 1, T0 + dt.timedelta(minutes=i), v)
    frame = lambda *r: spark.createDataFrame(list(r), "granule_key string, px int, t timestamp, v double")
    assert s.states() is None and s.add(frame(row("a", 0, 1.0), row("b", 1, 3.0))) == 2
    assert s.add(frame(row("b", 1, 99.0), row("c", 2, 5.0))) == 1 and s.add(frame(row("c", 2, 5.0))) == 0
    r = s.states().first()
    assert (r["n"], r["mean"]) == (3, 3.0) and abs(r["m2"] - 8.0) < 1e-9 and {x[0] for x in s.done().collect()} == {"a", "b", "c"}
    db = tmp_path / "f.sqlite"
    with sqlite3.connect(db) as c:
        c.execute('CREATE TABLE "Fires" (FOD_ID INTEGER, LATITUDE REAL, CAUSE TEXT)')
        c.executemany("INSERT INTO Fires VALUES (?, ?, ?)", [(i, i / 2, None if i % 3 else "x") for i in range(25)])
    d = store.read_sqlite(spark, str(db), "Fires", {"FOD_ID": "long", "LATITUDE": "double", "CAUSE": "string"}, rows=7)
    assert sorted((r[0], r[1], r[2]) for r in d.collect())[:2] == [(0, 0.0, "x"), (1, 0.5, None)] and d.count() == 25


def test_snapshot_and_state(spark, tmp_path):
    rows = [(i, T0 + dt.timedelta(minutes=i), 500.0 * (i % 2), 500.0 * (i // 2 % 2), -100 + 0.005 * (i % 2), 40 + 0.005 * (i // 2 % 2), 5.0, "goes", 6000.0) for i in range(8)]
    d = spark.createDataFrame(rows, "det_id long, t timestamp, x double, y double, lon double, lat double, frp_mw double, sensor string, tolerance_m double")
    w = spark.createDataFrame([(1, 30.0, 10.0, 12.0)], "event_id long, temp_c double, rh_pct double, wind_ms double")
    assert serving.snapshot([d], str(tmp_path / "none"), least_detections=9) is None and not (tmp_path / "none").exists()
    serving.snapshot([d], str(tmp_path / "s"), w)
    det, e = serving.published(spark, str(tmp_path / "s"))
    (r,) = e.collect()
    assert det.count() == 8 and r["n_detections"] == 8 and r["temp_c"] == 30.0 and r["risk_class"] in ("Moderate", "High", "Extreme") and r["first_seen"] == T0
    modes = spark.range(1).select(serving.state_mode(F.lit(T0), F.lit(T0 + dt.timedelta(hours=25))), serving.state_mode(F.lit(None).cast("timestamp"), F.lit(T0)), serving.state_mode(F.lit(T0), F.lit(T0), frozen=True)).first()
    assert tuple(modes) == ("stale", "live", "sample")


def test_early_detection_leads(spark):
    rows = []
    for px in range(6):
        for i in range(96):
            h = i / 4
            fire = 12.0 * (i - 40) if px == 0 and 40 <= i < 60 else 0.0
            rows.append((px, i, T0.replace(hour=0) + dt.timedelta(minutes=15 * i), 290 + 15 * math.sin(2 * math.pi * h / 24 - 2) + 0.2 * ((7 * i + px) % 5) + fire / 4, px == 0, 40))
    d = spark.createDataFrame(rows, "pixel int, idx int, t timestamp, bt double, fire boolean, onset int")
    r = harness.early_detection(d, 0.01, 15.0, order=1).first()
    assert 0 <= r["residual_min"] < r["absolute_min"] and r["lead_min"] == r["absolute_min"] - r["residual_min"]


def test_spread_harnesses(spark):
    rows = [(f, r, c, (r, c) == (4, 4), abs(r - 4) + abs(c - 4) <= 2, True, 0.5, 0.2, 0.1, float(math.hypot(r - 4, c - 4)) if math.hypot(r - 4, c - 4) <= 2.3 else None, 2.0) for f in "abc" for r in range(9) for c in range(9)]
    d = spark.createDataFrame(rows, "fire string, row int, col int, fire_t boolean, fire_t1 boolean, valid boolean, fuel double, wind double, slope double, time double, ros double")
    folds = harness.grouped_folds(d, 3)
    assert sorted(r["fold"] for r in folds.collect()) == [0, 1, 2]
    got = harness.next_day(d, folds, "fire", 9, 9).collect()
    assert {(r["model"], r["fire"]) for r in got} == {(m, f) for m in ("persistence_buffer", "physics") for f in "abc"} and all(r["n"] == 80 and r["ap"] > 0.5 for r in got)
    a = harness.assimilated(d, ["fire"]).collect()
    assert len(a) == 3 and all(r["pod"] > 0.6 and r["far"] == 0 and r["n_early"] + r["n_late"] == 21 and 0.2 < r["k"] < 0.7 for r in a)
    with pytest.raises(ValueError):
        harness.grouped_folds(d, 4)
    assert {r["split_name"] for r in harness.grouped_split(d, fire="fire").collect()} == {"test", "val", "train"}


def test_area_tail(spark):
    g = np.random.default_rng(5)
    rows = [(f"u{i}", "e", float(np.expm1(g.exponential(1.5)))) for i in range(4000)]
    q = harness.burned_area_quantiles(spark.createDataFrame(rows, "uid string, eco string, ha double"), ["eco"], "ha", [0.5, 0.9, 0.99]).first()["q"]
    assert abs(np.log1p(q[2]) - 1.5 * math.log(100)) < 0.7  # of an exponential the tail is exponential


def test_importance_and_folds(spark):
    g = random.Random(6)
    rows = [(f"u{i}", x, y, float(x > 0.5)) for i in range(240) for x, y in [(g.random(), g.random())]]
    d = spark.createDataFrame(rows, "uid string, signal double, noise double, label double")
    imp = dict(models.permutation_importance(d.where("uid < 'u2'"), d.where("uid >= 'u2'"), ["signal", "noise"], rounds=3))
    assert imp["signal"] > 0.2 > abs(imp["noise"])
    folds = d.select(F.lit(0).alias("fold"), F.when(F.col("uid") < "u2", "train").otherwise("test").alias("split_name"), "uid")
    assert models.out_of_fold(d, folds, ["signal", "noise"], rounds=3).count() == d.where("uid >= 'u2'").count()


def test_target_windows_and_stitching(spark):
    r = spark.createDataFrame([("a", -96.0, 37.0, 1000.0), ("b", -96.0, 37.0, None), ("c", -96.0, 37.0, 1e7)], "uid string, lon double, lat double, area_ha double")
    w = {x["uid"]: (x["width"], x["height"]) for x in labels.target_windows(r, "conus").collect()}
    assert w["b"] == w["a"] and w["b"][0] in (1000, 1001) and w["c"][0] in (2000, 2001)
    chips = spark.createDataFrame([("s", 0, 0, 0), ("s", 1, 1, 1), ("t", 0, 0, 1), ("t", 5, 5, 1), ("none", 0, 0, 1)], "stem string, row int, col int, value int")
    m = spark.createDataFrame([("s", "e", 0, 0, 4, 4), ("t", "e", 0, 0, 4, 4)], "stem string, event_id string, y0 int, x0 int, height int, width int")
    assert {tuple(x) for x in labels.stitched(chips, m).collect()} == {("e", 0, 0, 1), ("e", 1, 1, 1)}


def test_folds_are_bounded(spark):
    u = spark.createDataFrame([(f"u{i}", f"g{i}") for i in range(6)], "uid string, g string")
    old, splits.MOST_FOLDS = splits.MOST_FOLDS, 5
    try:
        with pytest.raises(ValueError, match="more than 5 folds"):
            splits.leave_one_group_out(u, "g")
        assert splits.leave_one_group_out(u, "g", max_folds=2).count() == 12
    finally:
        splits.MOST_FOLDS = old

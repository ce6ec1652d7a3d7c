import datetime as dt

import numpy as np

from cindral.operators.spikes import Reading, implausible, residuals, stuck, tail_shape

SCHEMA = "det_id long, pixel_id long, t timestamp, frp_mw float, temp_k float, view_zenith_deg float"
T0 = dt.datetime(2020, 1, 1)


def pixels(n_pixels=120, n=60, seed=5):
    g = np.random.default_rng(seed)
    rows, k = [], 0
    for p in range(n_pixels):
        level, frp = g.uniform(400, 800), g.uniform(20, 200)
        for i in range(n):
            rows.append([k, p, T0 + dt.timedelta(minutes=5 * i), float(frp * np.exp(g.normal(0, 0.2))), float(level + g.normal(0, 8) + (150 if p == 3 and i >= 30 else 0)), float(48 + 0.1 * g.integers(0, 2))])
            k += 1
    rows[10][4] = 1200.0  # one spike
    rows[130][3], rows[131][3] = 9000.0, 9500.0  # two in a row
    rows[250][4] = 5.0  # impossible
    rows[251][5] = 99.0
    rows[252][5] = 70.0  # spike of the angle
    for i in range(7):
        rows[300 + i][4] = 500.0  # stuck
    rows[310][3] = float("nan")
    rows[311][2] = None
    rows[312][4] = None
    want = {(10, "temp_k"), (130, "frp_mw"), (131, "frp_mw"), (250, "temp_k"), (251, "view_zenith_deg"), (252, "view_zenith_deg")} | {(300 + i, "temp_k") for i in range(7)}
    return rows, want


def found(spark, rows, **kw):
    return {tuple(r) for r in implausible(spark.createDataFrame([tuple(r) for r in rows], SCHEMA), **kw).select("det_id", "field_name").collect()}


def test_planted_and_normal_changes(spark):
    rows, want = pixels()
    assert found(spark, rows) == want  # the lasting change of level in pixel 3 is not found


def test_repeats_and_hot_source(spark):
    rows, want = pixels()
    assert found(spark, rows + rows[:100]) == want
    one = [[r[0], 7, T0 + dt.timedelta(minutes=i), *r[3:]] for i, r in enumerate(rows)]
    whole, cut = found(spark, one), found(spark, one, chunk=150)
    assert len(whole ^ cut) <= 2 and {k for k in want if k[1] == "view_zenith_deg"} <= cut


def test_stuck_run_across_chunks(spark):
    rows = [(i, 1, T0 + dt.timedelta(minutes=i), float(20 + i % 7 + 0.01 * i), float(300 + (i * 37) % 11 + 0.01 * i), 40.0) for i in range(400)]
    rows = [(*r[:4], 555.0, r[5]) if 190 <= r[0] < 204 else r for r in rows]
    for chunk in (10_000, 100, 67):
        got = {k for k, f in found(spark, rows, chunk=chunk) if f == "temp_k"}
        assert got == set(range(190, 204)), chunk


def test_small_sources_and_empty(spark):
    rows = [(i, 1, T0 + dt.timedelta(minutes=i), 10.0, 300.0 + i, 40.0) for i in range(20)] + [(99, None, T0, -5.0, 1.0, 200.0), (100, 2, None, -5.0, 300.0, 40.0)]
    got = found(spark, rows)
    assert (100, "frp_mw") in got and all(k != 99 for k, _ in got)
    assert {k for k, f in got if f == "frp_mw"} == {*range(20), 100}  # one value twenty times is stuck
    assert implausible(spark.createDataFrame([], SCHEMA)).count() == 0


def test_kernels():
    x = np.array([1.0, 1, 1, 1, 1, 2, 2, 2])
    assert stuck(x, np.array([0] * 8)).tolist() == [True] * 5 + [False] * 3
    assert stuck(x, np.array([0, 0, 0, 1, 1, 1, 1, 1])).tolist() == [False] * 8
    g = np.random.default_rng(0)
    y = g.normal(0, 1, 5000)
    z = residuals(y, np.zeros(5000, int), Reading(-10, 10, floor=0.01))
    assert np.abs(z).max() < 5 and len(residuals(y[:0], np.zeros(0, int), Reading(0, 1))) == 0
    h = np.bincount(np.minimum((np.abs(z) / 0.05).astype(int), 399), minlength=400)
    shape, cutoff = tail_shape(h, 1e-5)
    assert -0.2 <= shape <= 0 and 2.5 < cutoff < 9 and tail_shape(h * 0, 1e-5) == (0.0, np.inf)


def test_own_tails_and_season():
    from cindral.operators.spikes import SEASONS, own_tails

    g = np.random.default_rng(1)
    z = np.concatenate([g.normal(0, 1, 400), g.normal(0, 2, 400), [0.5]])
    z[:8] = 90.0  # wrong readings do not move a tail
    u, e, k = own_tails(z, np.repeat([0, 1, 3], [400, 400, 1]), 4)
    assert 1.0 < u[0] < 1.35 and 1.5 < u[1] / u[0] < 2.6 and k.tolist() == [100, 100, 0, 0] and 0.05 < e[0] < 0.5
    # A daily cycle of fixed offsets is normal with the parts of the day and stands out without.
    part = np.arange(3000) % SEASONS
    y = g.normal(0, 1, 3000) + np.array([0, 0, 4, 0, -4, 0])[part]
    zero = np.zeros(3000, int)
    spread = [np.abs(residuals(y, zero, Reading(-99, 99, floor=0.01), part=q)).mean() for q in (None, part)]
    assert spread[1] < 0.8 * spread[0]


def test_source_with_a_heavier_tail_has_a_higher_cutoff(spark):
    from pyspark.sql import functions as F

    from cindral.operators.spikes import own_cutoff

    d = spark.createDataFrame([(1.2, 0.25, 100), (1.8, 0.8, 100), (1.8, 0.8, 8), (1.8, 0.8, 0)], "_u double, _e double, _k long").coalesce(1)
    quiet, heavy, short, none = (r[0] for r in d.select(own_cutoff(-0.05, 6.0, 1e-5, 1.0).alias("c")).collect())
    assert quiet < short < heavy and none == 6.0
    assert d.select(F.min(own_cutoff(-0.05, 6.0, 1e-5, 50.0))).first()[0] == 50.0

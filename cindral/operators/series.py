"""Ordered operators: islands and gaps, runs, thinning, climatology, residuals, latency of detection, fire-weather recurrence."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cindral.operators.quantiles import exact_quantiles
from cindral.session import spread


def coverage_intervals(times: DataFrame, t: str = "t", max_gap_s: float = 1200.0, keys: list[str] | None = None, block_s: int = 7 * 86_400) -> DataFrame:
    """(keys, lo, hi, n): islands of times at most max_gap_s apart.

    Distinct times are cut into blocks; a block's islands come from its own window, and islands that touch across blocks are joined by a
    second pass over the islands (few), so that no key is sorted in one task.
    """
    keys = keys or []
    gap = int(max_gap_s * 1e6)
    d = times.where(F.col(t).isNotNull()).groupBy(*keys, F.unix_micros(t).alias("u")).agg(F.count("*").alias("c")).withColumn("_b", F.floor(F.col("u") / (block_s * 1_000_000)))
    w = W.partitionBy(*keys, "_b").orderBy("u")
    d = d.withColumn("_i", F.sum(F.when(F.col("u") - F.lag("u").over(w) <= gap, 0).otherwise(1)).over(w))
    small = d.groupBy(*keys, "_b", "_i").agg(F.min("u").alias("lo"), F.max("u").alias("hi"), F.sum("c").alias("n"))
    w2 = W.partitionBy(*keys).orderBy("lo")
    small = small.withColumn("_j", F.sum(F.when(F.col("lo") - F.lag("hi").over(w2) <= gap, 0).otherwise(1)).over(w2))
    return small.groupBy(*keys, "_j").agg(F.timestamp_micros(F.min("lo")).alias("lo"), F.timestamp_micros(F.max("hi")).alias("hi"), F.sum("n").alias("n")).drop("_j")


def coverage_gaps(intervals: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, gap_start, gap_end, gap_s) between islands."""
    w = W.partitionBy(*(keys or [])).orderBy("lo")
    d = intervals.withColumn("gap_end", F.lead("lo").over(w)).where("gap_end IS NOT NULL")
    return d.select(*(keys or []), F.col("hi").alias("gap_start"), "gap_end", ((F.unix_micros("gap_end") - F.unix_micros("hi")) / 1e6).alias("gap_s"))


def cadence_thinned(frames: DataFrame, minutes: int, t: str = "t", key: str = "granule_key", keys: list[str] | None = None) -> DataFrame:
    """The first frame of every cadence bucket, counted from the epoch (so that years do not collide)."""
    row = F.struct(*frames.columns)
    return frames.where(F.col(t).isNotNull()).groupBy(*(keys or []), F.floor(F.unix_micros(t) / (minutes * 60_000_000)).alias("_b")).agg(F.min_by(row, F.struct(t, key)).alias("_r")).select("_r.*")


def first_persistent(df: DataFrame, keys: list[str], order: str, exceeds: str, k: int = 3) -> DataFrame:
    """(keys, first): the smallest `order` at which the k-th exceedance in a row happens; null if none."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(-(k - 1), 0)
    run = F.min(F.coalesce(F.col(exceeds), F.lit(False)).cast("int")).over(w) * (F.count("*").over(w) == k).cast("int")
    return df.withColumn("_r", run).groupBy(*keys).agg(F.min(F.when(F.col("_r") == 1, F.col(order))).alias("first"))


def hour_bin(t: str, n_bins: int = 24):
    """Bin of the UTC time of day."""
    c = F.col(t)
    return F.pmod(F.floor((F.hour(c) + F.minute(c) / 60.0 + F.second(c) / 3600.0) * n_bins / 24.0), F.lit(n_bins)).cast("int")


def climatology(df: DataFrame, keys: list[str], value: str, t: str = "t", n_bins: int = 24) -> DataFrame:
    """(keys, bin, n, mean, m2): mergeable state of mean and variance in each time-of-day bin."""
    d = df.where(F.col(value).isNotNull() & F.col(t).isNotNull())
    return d.groupBy(*keys, hour_bin(t, n_bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(value).cast("double")).alias("mean"), (F.var_pop(F.col(value).cast("double")) * F.count("*")).alias("m2"))


def merged_climatology(states: DataFrame, keys: list[str]) -> DataFrame:
    """One state of several rows of states: the parts' spread about their common mean is added, as differences, so that nothing cancels."""
    w = W.partitionBy(*keys, "bin")  # the same distribution as the aggregation, so one shuffle
    s = states.where("n > 0").withColumn("_mean", F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w))
    off = F.col("mean") - F.col("_mean")
    return s.groupBy(*keys, "bin").agg(F.sum("n").alias("n"), F.first("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * off * off).alias("m2"))


def climatology_readout(states: DataFrame, ddof: int = 1) -> DataFrame:
    """Adds variance and std; null where too few values."""
    v = F.when(F.col("n") > ddof, F.col("m2") / (F.col("n") - ddof))
    return states.withColumn("variance", v).withColumn("std", F.sqrt(v))


def diurnal_amplitude(states: DataFrame, keys: list[str], least_bins: int = 8) -> DataFrame:
    """One row: number of series with enough bins, median, lower quartile and 90th percentile of (largest - smallest bin mean)."""
    per = states.where("n > 0").groupBy(*keys).agg((F.max("mean") - F.min("mean")).alias("a"), F.count("*").alias("b")).where(F.col("b") >= least_bins)
    return exact_quantiles(per, "a", [0.25, 0.5, 0.9]).select(F.col("n").alias("n_series"), F.get("q", F.lit(0)).alias("p25"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("p90"))


def hourly_residuals(df: DataFrame, keys: list[str], value: str, clear: str | None = None, t: str = "t") -> DataFrame:
    """df with `baseline` (mean of its series and hour over the clear rows) and `residual`."""
    b = F.lit(True) if clear is None else F.col(clear)
    base = df.where(b & F.col(value).isNotNull()).groupBy(*keys, hour_bin(t).alias("_bin")).agg(F.avg(F.col(value).cast("double")).alias("baseline"))
    return df.withColumn("_bin", hour_bin(t)).join(base, [*keys, "_bin"], "left").withColumn("residual", F.col(value) - F.col("baseline")).drop("_bin")


def harmonic_fit(df: DataFrame, keys: list[str], value: str, t: str = "t", order: int = 2) -> DataFrame:
    """(keys, coef): least-squares coefficients (constant, then sine and cosine of 1..order cycles a day).

    The sums of the normal equations are one aggregation in the JVM; only the small systems are solved in Python.
    """
    h = (F.hour(t) + F.minute(t) / 60.0 + F.second(t) / 3600.0) * (2 * math.pi / 24.0)
    basis = [F.lit(1.0)]
    for k in range(1, order + 1):
        basis += [F.sin(k * h), F.cos(k * h)]
    m = len(basis)
    sums = [F.sum(basis[i] * basis[j]).alias(f"a{i}_{j}") for i in range(m) for j in range(i, m)] + [F.sum(b * F.col(value)).alias(f"b{i}") for i, b in enumerate(basis)]
    g = df.where(F.col(value).isNotNull() & F.col(t).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), *sums).where(F.col("n") >= m)
    kinds = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys)

    def solve(batches):
        import numpy as np
        import pandas as pd

        for p in batches:
            a = np.zeros((len(p), m, m))
            for i in range(m):
                for j in range(i, m):
                    a[:, i, j] = a[:, j, i] = p[f"a{i}_{j}"]
            b = p[[f"b{i}" for i in range(m)]].to_numpy()
            x = np.einsum("nij,nj->ni", np.linalg.pinv(a), b) if len(p) else b
            yield pd.DataFrame({**{k: p[k] for k in keys}, "coef": list(x)})

    return g.mapInPandas(solve, f"{kinds}, coef array<double>")


def far_threshold(pool: DataFrame, value: str, far: float, by: list[str] | None = None, least: int = 100) -> DataFrame:
    """Percentile 100 (1 - far) of fire-free values: by group where it has `least` values, else the pool's."""
    all_ = exact_quantiles(pool, value, [1.0 - far]).select(F.get("q", F.lit(0)).alias("_all"))
    if not by:
        return all_.withColumnRenamed("_all", "threshold")
    g = exact_quantiles(pool, value, [1.0 - far], by).select(*by, F.col("n").alias("_n"), F.get("q", F.lit(0)).alias("_own"))
    return g.crossJoin(F.broadcast(all_)).select(*by, F.when(F.col("_n") >= least, F.col("_own")).otherwise(F.col("_all")).alias("threshold"))


def lead_times(first_a: DataFrame, first_b: DataFrame, keys: list[str], minutes_per_step: float = 5.0) -> DataFrame:
    """One row: series with both detections, median and quartiles of how many minutes a comes before b, share in which it does."""
    d = first_a.withColumnRenamed("first", "_a").join(first_b.withColumnRenamed("first", "_b"), keys).where("_a IS NOT NULL AND _b IS NOT NULL").withColumn("lead_min", (F.col("_b") - F.col("_a")) * minutes_per_step)
    q = F.percentile("lead_min", [0.25, 0.5, 0.75])
    return d.agg(F.count("*").alias("n"), q.alias("q"), F.avg((F.col("lead_min") > 0).cast("double")).alias("frac_led")).select("n", F.get("q", F.lit(0)).alias("p25_min"), F.get("q", F.lit(1)).alias("median_min"), F.get("q", F.lit(2)).alias("p75_min"), "frac_led")


def fire_cohort(det: DataFrame, cell_deg: float = 0.25, baseline_h: float = 30.0, least: int = 50, per_stratum: int = 3, slow_mw_per_h: float = 200.0) -> DataFrame:
    """Cells with enough detections after a clear baseline: ignition, local solar hour, two-hour ramp of power, stratum, the best of each stratum."""
    d = det.where("lon IS NOT NULL AND lat IS NOT NULL AND t IS NOT NULL").withColumn("gx", F.bround(F.col("lon") / cell_deg).cast("int")).withColumn("gy", F.bround(F.col("lat") / cell_deg).cast("int"))
    start = F.broadcast(d.agg(F.min("t").alias("_d0")))
    first = d.groupBy("gx", "gy").agg(F.min("t").alias("ignition"), F.count("*").alias("n_detections"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat")).where(F.col("n_detections") >= least)
    first = first.crossJoin(start).where((F.unix_micros("ignition") - F.unix_micros("_d0")) / 3.6e9 >= baseline_h).drop("_d0")
    x = (F.unix_micros("t") - F.unix_micros("ignition")) / 3.6e9
    ramp = d.select("gx", "gy", "t", F.coalesce(F.col("frp_mw").cast("double"), F.lit(0.0)).alias("f")).join(first.select("gx", "gy", "ignition"), ["gx", "gy"]).withColumn("x", x).where("x <= 2.0")
    ramp = ramp.groupBy("gx", "gy").agg(F.regr_slope("f", "x").alias("slope"))
    lst = F.pmod(F.hour("ignition") + F.minute("ignition") / 60.0 + F.col("lon") / 15.0, F.lit(24.0))
    night = (F.col("local_solar_hour") >= 20.0) | (F.col("local_solar_hour") < 6.0)
    c = first.join(ramp, ["gx", "gy"], "left").withColumn("local_solar_hour", lst)
    c = c.withColumn("stratum", F.when(night & (F.abs("slope") <= slow_mw_per_h), "night_coldstart").when(~night, "day")).where("stratum IS NOT NULL")
    w = W.partitionBy("stratum").orderBy(F.asc_nulls_last(F.abs("slope")), F.desc("n_detections"), "gx", "gy")
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_stratum)


def _step(f0, p0, d0, t, h, w, r, mo, lat):
    """One day of the three moisture codes for many cells at once."""
    import numpy as np

    from cindral.functions import fireweather as fw
    from cindral.functions._num import InArrays

    table = lambda north, equator: (np.full(12, equator) if abs(lat) <= 10.0 else np.array(north) if lat > 0 else np.roll(north, 6))[mo - 1]
    return fw.next_ffmc(InArrays, t, h, w, r, f0), fw.next_dmc(InArrays, t, h, r, p0, table(fw.DMC_NORTH, fw.DMC_EQUATOR)), fw.next_dc(InArrays, t, r, d0, table(fw.DC_NORTH, fw.DC_EQUATOR))


def fire_weather_days(df: DataFrame, cell: str = "cell", day: str = "day", lat: float = 46.0) -> DataFrame:
    """Daily codes with the state carried from day to day within each cell; a day without readings keeps the state.

    df: cell, day (unique within a cell), temp, rh, wind, rain. Cells are sorted by day inside their task; the n-th days of all cells of a
    batch are one NumPy step, so the work in Python is as many steps as a cell has days, whatever the number of cells. The indices of
    the day follow as Columns.
    """
    from cindral.functions import fireweather as fw

    kind, day_kind = dict(df.dtypes)[cell], dict(df.dtypes)[day]
    names = ["temp", "rh", "wind", "rain"]

    def run(batches):
        import numpy as np
        import pandas as pd

        def work(b):
            c = b["c"].to_numpy()
            new = np.append(True, c[1:] != c[:-1])
            start = np.flatnonzero(new)
            rank = np.arange(len(b)) - start[np.cumsum(new) - 1]
            x = b[names].to_numpy(float)
            month = pd.to_datetime(b["d"]).dt.month.to_numpy()
            out = np.full((len(b), 3), np.nan)
            state = np.tile([fw.START_FFMC, fw.START_DMC, fw.START_DC], (len(start), 1))
            group = np.cumsum(new) - 1
            order = np.argsort(rank, kind="stable")
            for i in np.split(order, np.flatnonzero(np.diff(rank[order])) + 1):
                ok = i[~np.isnan(x[i]).any(axis=1)]
                g = group[ok]
                with np.errstate(all="ignore"):
                    s = np.column_stack(_step(*state[g].T, *x[ok].T, month[ok], lat))
                state[g] = s
                out[ok] = s
            return pd.DataFrame({"c": b["c"], "d": b["d"], "wind": b["wind"], "ffmc": out[:, 0], "dmc": out[:, 1], "dc": out[:, 2]})

        rest = None
        for b in batches:
            rest = b if rest is None or not len(rest) else pd.concat([rest, b], ignore_index=True)
            last = (rest["c"] == rest["c"].iloc[-1]).to_numpy() if len(rest) else np.zeros(0, bool)
            if len(rest) < 50_000 or last.all():
                continue
            yield work(rest[~last].reset_index(drop=True))
            rest = rest[last].reset_index(drop=True)
        if rest is not None and len(rest):
            yield work(rest)

    src = df.where(F.col(cell).isNotNull() & F.col(day).isNotNull()).select(F.col(cell).alias("c"), F.col(day).alias("d"), *(F.col(n).cast("double") for n in names))
    d = spread(src, "c").sortWithinPartitions("c", "d").mapInPandas(run, f"c {kind}, d {day_kind}, wind double, ffmc double, dmc double, dc double")
    clean = lambda n: F.when(~F.isnan(n), F.col(n)).alias(n)
    d = d.select(F.col("c").alias(cell), F.col("d").alias(day), clean("wind"), clean("ffmc"), clean("dmc"), clean("dc"))
    d = d.withColumn("isi", fw.isi("ffmc", "wind")).withColumn("bui", fw.bui("dmc", "dc"))
    return d.withColumn("fwi", fw.fwi("isi", "bui")).withColumn("dsr", fw.dsr("fwi")).drop("wind")

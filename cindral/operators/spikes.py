"""Implausible readings of a source: impossible values, stuck runs and spikes (problem 5).

A spike is a peak over threshold: each reading's residual is its distance from what the source shows around it (the medians of the
readings before and after it, so that lasting changes of level and growth are normal), less the source's own offset for that time of
day, in units of the source's own scale. Each source has a generalised Pareto tail fitted to its residuals beyond a quantile, and its cutoff
is the level that a normal reading exceeds with a fixed small risk. Thirty readings say little of a tail: the shape is that of the
tail of all sources of the field, and the source's cutoff is drawn towards theirs by how few residuals it rests on.

A source's readings are ordered by time within bounded chunks: a source with more than `chunk` readings (a third of all rows, say) is
split at quantiles of time, and each chunk also gets the last readings before and the first after it, so that no source is gathered
in one task and every reading sees its whole surroundings.

Nulls and odd input: rows without source are left out; rows without time are tested for impossible values only; null and NaN readings
are no readings; rows repeated under one key count once; equal times are ordered by key; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cindral.session import cut, spread


@dataclass(frozen=True)
class Reading:
    """What is known of a measured field: its physical range, whether its noise is relative (log), its resolution, and whether runs of one value count."""

    low: float
    high: float
    log: bool = False
    floor: float = 0.0
    stuck: bool = True


#: The readings of detections.
READINGS = {
    "frp_mw": Reading(0.0, 100_000.0, log=True, floor=0.02),
    "temp_k": Reading(20.0, 2000.0, floor=0.5),
    "view_zenith_deg": Reading(0.0, 90.0, floor=0.1, stuck=False),
}

SIDE = 9  # readings before and after that make the surroundings
ONE_SIDED = 0.85  # at the ends of a series there is one side only, from which noise is further away than from the nearer of two
STUCK = 5
SEASONS, SEASON_WEIGHT = 6, 10  # parts of the day; an offset of n readings counts n / (n + SEASON_WEIGHT)
OWN_TAIL, OWN_WEIGHT = 0.25, 25  # share of a source's residuals that make its tail; a tail of k residuals counts k / (k + OWN_WEIGHT)
KEEP = 3.0  # residuals (in scales) below this are counted in the histogram only
BINS, BIN = 400, 0.05


def _medians(y: np.ndarray, group: np.ndarray, side: int):
    """Medians of up to `side` values before and after each value of its group, NaN where fewer than 4."""
    pad = np.full(side, np.nan)
    view = np.lib.stride_tricks.sliding_window_view
    values = view(np.concatenate([pad, y, pad]), 2 * side + 1)
    same = view(np.concatenate([np.full(side, -1), group, np.full(side, -1)]), 2 * side + 1) == group[:, None]

    def median(part: slice) -> np.ndarray:
        m = np.where(same[:, part], values[:, part], np.inf)
        m.sort(axis=1)
        n = same[:, part].sum(axis=1)
        rows = np.arange(len(m))
        out = (m[rows, np.maximum(n - 1, 0) // 2] + m[rows, np.minimum(n // 2, side - 1)]) / 2
        return np.where(n >= 4, out, np.nan)

    with np.errstate(invalid="ignore"):
        return median(slice(0, side)), median(slice(side + 1, None))


def _group_median(v: np.ndarray, start: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Median of each group of consecutive rows; order: np.lexsort((v, group))."""
    n = np.diff(np.append(start, len(v)))
    s = v[order]
    return (s[start + (n - 1) // 2] + s[start + n // 2]) / 2


def _season(off: np.ndarray, s: np.ndarray, index: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Offset of each value's part of the day in its group: the median of the distances from the surroundings there, which a few wrong
    readings hardly move (each counts two scales at most), weighed by their number."""
    key = index * SEASONS + part
    order = np.lexsort((np.clip(off, -2 * s[index], 2 * s[index]), key))
    k = key[order]
    start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    n = np.diff(np.append(start, len(k)))
    v = np.clip(off, -2 * s[index], 2 * s[index])[order]
    median = (v[start + (n - 1) // 2] + v[start + n // 2]) / 2
    out = np.empty(len(off))
    out[order] = np.repeat(median * n / (n + SEASON_WEIGHT), n)
    return out


def residuals(x: np.ndarray, group: np.ndarray, kind: Reading, side: int = SIDE, part: np.ndarray | None = None) -> np.ndarray:
    """Signed distance of each value (in order of group and time, no NaN) from its surroundings, in scales of its group.

    part: the part of the day of each value, 0 to SEASONS - 1; without it there is no seasonal offset.
    """
    if not len(x):
        return x
    y = np.log(np.maximum(x, 0.1)) if kind.log else x.astype(float)
    before, after = _medians(y, group, side)
    b, a = np.where(np.isnan(before), after, before), np.where(np.isnan(after), before, after)
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    index = np.cumsum(np.append(True, group[1:] != group[:-1])) - 1

    def scale(v: np.ndarray) -> np.ndarray:
        return 1.4826 * _group_median(v, start, np.lexsort((v, index)))

    signed = np.where(np.isnan(lo), 0.0, y - (lo + hi) / 2)
    off = np.abs(signed)
    step = np.abs(np.diff(y, append=y[-1]))
    last = np.append(start[1:], len(y)) - 1
    step[last] = np.where(last > 0, step[np.maximum(last - 1, 0)], 0.0)
    s = np.maximum(np.minimum(scale(off), scale(step) / np.sqrt(2)), kind.floor)
    if part is not None:
        y = y - _season(signed, s, index, part)
    d = np.where(y > hi, y - hi, np.where(y < lo, y - lo, 0.0))
    d = np.where(np.isnan(before) | np.isnan(after), ONE_SIDED * d, d)
    with np.errstate(divide="ignore", invalid="ignore"):
        z = d / s[index]
    return np.where(np.isnan(z), 0.0, z)


def stuck(x: np.ndarray, group: np.ndarray, least: int = STUCK) -> np.ndarray:
    """Whether each value belongs to a run of at least `least` consecutive equal values of its group."""
    if not len(x):
        return np.zeros(0, bool)
    new = np.append(True, (x[1:] != x[:-1]) | (group[1:] != group[:-1]))
    run = np.cumsum(new) - 1
    return np.bincount(run)[run] >= least


def _chunked(df: DataFrame, chunk: int, halo: int) -> DataFrame:
    """Adds _chunk and _halo: the chunk of each row of a source, and copies of the rows next to a chunk."""
    counts = df.groupBy("_src").count().where(F.col("count") > chunk)
    flat = df.withColumn("_chunk", F.lit(0)).withColumn("_halo", F.lit(False))
    counts = cut(counts)
    most = counts.agg(F.max("count")).first()[0]
    if most is None:
        return flat
    parts = -(-most // chunk)
    hot = df.where(F.col("_t").isNotNull()).join(counts, "_src")
    # One row for each hot source, at most (rows / chunk) of them; quantile sketches merge before the shuffle.
    bounds = hot.groupBy("_src").agg(F.percentile_approx("_t", [i / parts for i in range(1, parts)], 10_000).alias("_at")) if parts > 1 else None
    marked = df.join(bounds, "_src", "left").withColumn("_chunk", F.when(F.col("_at").isNull() | F.col("_t").isNull(), 0).otherwise(F.size(F.filter(F.array_distinct("_at"), lambda b: b < F.col("_t"))))).drop("_at")
    flat, big = marked.where(F.col("_chunk").isNull()), marked
    key = W.partitionBy("_src", "_chunk")
    big = big.join(counts.select("_src", F.lit(True).alias("_hot")), "_src", "left")
    rest = big.where(F.col("_hot").isNull()).drop("_hot").withColumn("_halo", F.lit(False))
    big = big.where(F.col("_hot")).drop("_hot")
    # Chunks that hold a boundary's ties may be empty; the next chunk that exists is the neighbour.
    exist = big.groupBy("_src", "_chunk").count().select("_src", "_chunk", F.lead("_chunk").over(W.partitionBy("_src").orderBy("_chunk")).alias("_next"), F.lag("_chunk").over(W.partitionBy("_src").orderBy("_chunk")).alias("_prev"))
    ranked = big.withColumn("_a", F.row_number().over(key.orderBy("_t", "_key"))).withColumn("_z", F.row_number().over(key.orderBy(F.desc("_t"), F.desc("_key"))))
    edge = ranked.where((F.col("_a") <= halo) | (F.col("_z") <= halo)).join(exist, ["_src", "_chunk"])
    cols = [c for c in df.columns]
    to_next = edge.where((F.col("_z") <= halo) & F.col("_next").isNotNull()).select(*cols, F.col("_next").alias("_chunk"))
    to_prev = edge.where((F.col("_a") <= halo) & F.col("_prev").isNotNull()).select(*cols, F.col("_prev").alias("_chunk"))
    return rest.select(*cols, "_chunk", "_halo").unionByName(big.select(*cols, "_chunk").withColumn("_halo", F.lit(False))).unionByName(to_next.unionByName(to_prev).withColumn("_halo", F.lit(True)))


def own_tails(z: np.ndarray, group: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, e, k) of each group 0 .. size - 1 (z in order of group): the quantile of |z| where its tail begins, the p-quantile of the excesses
    (p = 1 - 2**-0.5, which wrong readings move only if they are most of the tail), and the number of residuals in the tail."""
    a = np.abs(z)
    order = np.lexsort((a, group))
    n = np.bincount(group, minlength=size)
    start = np.cumsum(n) - n
    s = np.append(a[order], 0.0)
    level = lambda q: s[np.minimum(start + (q * np.maximum(n - 1, 0)).astype(int), len(a))]
    u = level(1 - OWN_TAIL)
    return u, np.maximum(level(1 - OWN_TAIL * 2**-0.5) - u, 1e-3), (OWN_TAIL * n).astype(int)


def tail_shape(counts: np.ndarray, risk: float, tail: float = 0.05) -> tuple[float, float]:
    """(shape, cutoff in scales that a normal reading exceeds with the given risk) of the residuals of all sources: generalised Pareto tail
    beyond the (1 - tail) quantile.

    counts: histogram of |residual| in bins of BIN. Shape and scale come from two low quantiles of the excesses, which the few wrong
    readings among them hardly move: with p = 1 - 2**-0.5, (median / p-quantile) is 2**(shape / 2) + 1. Noise of instruments has no
    heavy tail, so the shape is at most 0.
    """
    n = counts.sum()
    if n == 0:
        return 0.0, np.inf
    above = np.append(counts[::-1].cumsum()[::-1], 0).astype(float)

    def level(k: float) -> float:
        i = max(0, int(np.searchsorted(-above, -k, side="right")) - 1)
        i = min(i, len(counts) - 1)
        inside = (above[i] - k) / (above[i] - above[i + 1]) if above[i] > above[i + 1] else 0.0
        return (i + min(max(inside, 0.0), 1.0)) * BIN

    k = max(tail * n, 1.0)
    u = level(k)
    q29, q50 = max(level(k * 2**-0.5) - u, 1e-3), max(level(k / 2) - u, 1e-3)
    shape = float(np.clip(2 * np.log2(max(q50 / q29 - 1.0, 1e-3)), -0.2, 0.0))
    scale = q50 / np.log(2.0) if shape > -1e-6 else q50 * shape / (2.0**shape - 1.0)
    ratio = k / (n * risk)
    return shape, u + (scale * np.log(ratio) if shape > -1e-6 else scale / shape * (ratio**shape - 1.0))


def own_cutoff(shape: float, pooled: float, risk: float, floor: float) -> Column:
    """Cutoff of a source with the tail (_u, _e, _k): of its own quantiles with the pooled shape, drawn towards the pooled cutoff, at least floor."""
    ratio = OWN_TAIL / risk
    flat = shape > -1e-6
    scale = F.col("_e") * (2 / np.log(2.0) if flat else shape / (2.0 ** (shape / 2) - 1.0))
    own = F.col("_u") + scale * float(np.log(ratio) if flat else (ratio**shape - 1.0) / shape)
    weight = F.col("_k") / (F.col("_k") + F.lit(float(OWN_WEIGHT)))
    return F.greatest(F.lit(float(floor)), weight * own + (1 - weight) * float(pooled))


def implausible(df: DataFrame, key: str = "det_id", source: str = "pixel_id", time: str = "t", readings: dict[str, Reading] | None = None, least: int = 30, risk: float = 1e-5, chunk: int = 20_000, floor: float = 5.0) -> DataFrame:
    """(key, field_name, impossible, stuck, spike, residual) of the readings that are wrong in at least one way.

    least: readings (rows) of a source from which spikes are looked for. risk: chance that a normal reading passes the cutoff. floor: scales
    within which nothing is far outside, however quiet the tail.
    """
    readings = readings or READINGS
    names = list(readings)
    kind = dict(df.dtypes)[key]
    base = df.where(F.col(source).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.col(source).alias("_src"), F.unix_micros(F.col(time).cast("timestamp")).alias("_t"), *(F.col(c).cast("float") for c in names)
    )
    base = _chunked(base, chunk, 4 * SIDE)

    def run(batches):
        import pandas as pd

        hist = {c: np.zeros(BINS, np.int64) for c in names}
        rest = None

        def work(p: "pd.DataFrame"):
            new = ((p["_src"].values[1:] != p["_src"].values[:-1]) | (p["_chunk"].values[1:] != p["_chunk"].values[:-1])) if len(p) else []
            group = np.cumsum(np.append(True, new)) - 1
            keys, again = p["_key"].values, np.zeros(len(p), bool)
            again[1:] = (keys[1:] == keys[:-1]) & ~np.asarray(new, bool)
            p, group = p[~again], group[~again]
            size = np.bincount(group)[group]
            timed, own = p["_t"].notna().values, ~p["_halo"].values.astype(bool)
            hot = size > chunk // 2
            out = []
            for c in names:
                r, x = readings[c], p[c].values.astype(float)
                there = ~np.isnan(x)
                impossible = there & ((x < r.low) | (x > r.high))
                runs, z = np.zeros(len(x), bool), np.zeros(len(x))
                i = np.flatnonzero(there & timed)
                if r.stuck:
                    runs[i] = stuck(x[i], group[i])
                i = np.flatnonzero(there & timed & ~impossible)
                part = (p["_t"].values[i] // (86_400_000_000 // SEASONS) % SEASONS).astype(int)
                z[i] = residuals(x[i], group[i], r, part=part)
                z[~((size >= least) | hot)] = 0.0
                fit = own[i] & (size[i] >= least)
                u, e, n = own_tails(z[i], group[i], int(group.max(initial=-1)) + 1)
                hist[c] += np.bincount(np.minimum((np.abs(z[i][fit]) / BIN).astype(int), BINS - 1), minlength=BINS)
                k = np.flatnonzero(own & (impossible | runs | (np.abs(z) >= KEEP)))
                out.append(pd.DataFrame({"_key": p["_key"].values[k], "field_name": c, "impossible": impossible[k], "stuck": runs[k], "residual": z[k], "_u": u[group[k]], "_e": e[group[k]], "_k": n[group[k]], "bin": -1, "n": 0}))
            return pd.concat(out, ignore_index=True)

        for b in batches:
            rest = b if rest is None or not len(rest) else pd.concat([rest, b], ignore_index=True)
            if len(rest) < 30_000:
                continue
            tail = (rest["_src"].values == rest["_src"].values[-1]) & (rest["_chunk"].values == rest["_chunk"].values[-1])
            if tail.all():
                continue
            yield work(rest[~tail])
            rest = rest[tail]
        if rest is not None and len(rest):
            yield work(rest)
        for c in names:
            b = np.flatnonzero(hist[c])
            yield pd.DataFrame({"_key": None, "field_name": c, "impossible": False, "stuck": False, "residual": 0.0, "_u": 0.0, "_e": 0.0, "_k": 0, "bin": b, "n": hist[c][b]})

    schema = f"_key {kind}, field_name string, impossible boolean, stuck boolean, residual double, _u double, _e double, _k long, bin int, n long"
    sorted_ = spread(base, "_src", "_chunk").sortWithinPartitions("_src", "_chunk", "_t", "_key")
    done = cut(sorted_.mapInPandas(run, schema))
    # At most BINS rows for each field.
    bins = done.where("bin >= 0").groupBy("field_name", "bin").agg(F.sum("n").alias("n")).collect()
    cutoffs = {}
    for c in names:
        h = np.zeros(BINS, np.int64)
        for row in bins:
            if row["field_name"] == c:
                h[row["bin"]] += row["n"]
        cutoffs[c] = own_cutoff(*tail_shape(h, risk), risk, floor) if h.sum() else F.lit(1e300)
    above = F.coalesce(*(F.when(F.col("field_name") == c, F.abs("residual") > v) for c, v in cutoffs.items()))
    found = done.where("bin < 0").withColumn("spike", above).where("impossible or stuck or spike")
    found = found.groupBy("_key", "field_name").agg(F.max("impossible").alias("impossible"), F.max("stuck").alias("stuck"), F.max("spike").alias("spike"), F.max_by("residual", F.abs("residual")).alias("residual"))
    return found.withColumnRenamed("_key", key)

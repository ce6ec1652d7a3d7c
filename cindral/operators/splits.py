"""Leakage-proof folds in long form (fold, split_name, uid), sampling and ignition designs."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cindral.functions.grids import block_key
from cindral.operators.ordered import running_sums
from cindral.session import checked, cut


MOST_FOLDS = 100_000  # rows of a broadcast


def random_split(*_args, **_kwargs):
    """Not offered: fire data is autocorrelated in space and time, a random split overstates skill."""
    raise NotImplementedError("use spatial_blocks, leave_one_group_out or leave_year_out")


def require_unique(units: DataFrame, key: str = "uid") -> DataFrame:
    """units, checked for repeated keys (raises)."""
    bad = units.groupBy(key).count().where(F.col("count") > 1).limit(1).collect()
    if bad:
        raise ValueError(f"repeated {key}: {bad[0][0]!r}")
    return units


def spatial_blocks(units: DataFrame, n_folds: int = 5, degrees: float = 5.0, seed: int = 0, key: str = "uid") -> DataFrame:
    """Whole lon/lat blocks dealt to folds in an order fixed by seed; every other unit trains."""
    u = units.where("lon IS NOT NULL AND lat IS NOT NULL").select(F.col(key).alias("uid"), block_key("lon", "lat", degrees).alias("block"))
    blocks = u.select("block").distinct()
    n = blocks.count()
    if n < n_folds:
        raise ValueError(f"only {n} blocks for {n_folds} folds")
    # Blocks are bounded by the globe (64,800 at one degree).
    dealt = F.broadcast(blocks.withColumn("fold", F.pmod(F.row_number().over(W.orderBy(F.xxhash64("block", F.lit(seed)), "block")) - 1, F.lit(n_folds)).cast("int")))
    u = u.join(dealt, "block").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    return u.select(F.col("k").alias("fold"), F.when(F.col("k") == F.col("fold"), "test").otherwise("train").alias("split_name"), "uid")


def leave_one_group_out(units: DataFrame, by: str, key: str = "uid", max_folds: int | None = None) -> DataFrame:
    """One fold for each value of `by` in order; units without it take no part. (fold, held_out, split_name, uid)"""
    u = units.where(F.col(by).isNotNull()).select(F.col(key).alias("uid"), F.col(by).cast("string").alias("g"))
    names = u.select("g").distinct().withColumn("fold", (F.row_number().over(W.orderBy("g")) - 1).cast("int"))
    names = names.where(F.col("fold") < max_folds) if max_folds is not None else names
    f = names.withColumnRenamed("g", "held_out")
    # Each unit is in each fold by definition of the scheme: the result has units x folds rows. Folds are model fits, so they are few.
    if f.limit(MOST_FOLDS + 1).count() > MOST_FOLDS:
        raise ValueError(f"more than {MOST_FOLDS} folds: give max_folds")
    return u.crossJoin(F.broadcast(f)).select("fold", "held_out", F.when(F.col("g") == F.col("held_out"), "test").otherwise("train").alias("split_name"), "uid")


def leave_year_out(units: DataFrame, day: str = "when_date", n_test: int = 1, n_val: int = 1, key: str = "uid") -> DataFrame:
    """Sliding test years, validation in the years before them, training in all others. (fold, held_out, split_name, uid)"""
    u = units.where(F.col(day).isNotNull()).select(F.col(key).alias("uid"), F.year(day).alias("y"))
    years = sorted(r["y"] for r in u.select("y").distinct().collect())  # a few dozen at most
    if len(years) < n_test + n_val + 1:
        raise ValueError(f"only {len(years)} distinct years")
    rows, fold = [], 0
    for i in range(n_val, len(years) - n_test + 1):
        test, val = years[i : i + n_test], years[i - n_val : i] if n_val else []
        if len(test) + len(val) == len(years):
            continue
        held = ",".join(map(str, test))
        rows += [(fold, held, "test" if y in test else "val" if y in val else "train", y) for y in years]
        fold += 1
    plan = u.sparkSession.createDataFrame(rows, "fold int, held_out string, split_name string, y int")
    return u.join(F.broadcast(plan), "y").select("fold", "held_out", "split_name", "uid")


def overlap(manifest: DataFrame, keys: tuple[str, ...] = ("fold",), uid: str = "uid", part: str = "split_name") -> DataFrame:
    """Units in more than one part of a fold, with their parts."""
    return manifest.groupBy(*keys, uid).agg(F.sort_array(F.collect_set(part)).alias("parts")).where(F.size("parts") > 1)


def sizes(manifest: DataFrame, by: tuple[str, ...] = ("fold", "held_out", "split_name"), uid: str = "uid") -> DataFrame:
    """(by, n): units of each part."""
    return manifest.groupBy(*by).agg(F.count_distinct(uid).alias("n"))


def verify_no_overlap(manifest: DataFrame) -> None:
    bad = overlap(manifest).limit(1).collect()
    if bad:
        raise AssertionError(f"unit in several parts of a fold: {bad[0]}")


def fingerprint(manifest: DataFrame, scheme: str, params: dict) -> str:
    """16 hex digits of a hash over the sorted members: per-row hashes are summed in the cluster, so members do not reach the driver."""
    r = manifest.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("fold", "split_name", "uid").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return hashlib.sha256(json.dumps([scheme, params, r["n"], str(r["h"])], sort_keys=True, default=str).encode()).hexdigest()[:16]


def in_fold(records: DataFrame, manifest: DataFrame, fold: int, part: str = "train", uid: str = "uid") -> DataFrame:
    """Records of one part of a fold; raises if a member has no record."""
    m = manifest.where((F.col("fold") == fold) & (F.col("split_name") == part)).select(uid).distinct()
    missing = m.join(records.select(uid), uid, "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"member without record: {missing[0][0]!r}")
    return records.join(m, uid, "left_semi")


def _u01(*cols) -> Column:
    """Number in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def stratified_negatives(presence: DataFrame, candidates: DataFrame, stratum: str = "stratum", id: str = "id", ratio: float = 1.0, seed: int = 0) -> DataFrame:
    """Of each stratum about ratio times as many candidates as presences, without presences, by hash order."""
    want = presence.groupBy(stratum).agg(F.bround(F.count("*") * ratio).cast("long").alias("_want"))
    pool = candidates.join(presence.select(id), id, "left_anti").join(checked(cut(want)), stratum)
    w = W.partitionBy(stratum).orderBy(F.xxhash64(id, F.lit(seed)), id)
    return pool.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= F.col("_want")).drop("_i", "_want")


def weighted_background(presence: DataFrame, candidates: DataFrame, n: int, weight: str | None = None, id: str = "id", seed: int = 0) -> DataFrame:
    """n candidates without presences, drawn without replacement in proportion to weight (exponential keys; the n smallest)."""
    w = F.greatest(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    pool = candidates.join(presence.select(id), id, "left_anti").withColumn("_k", F.try_divide(-F.ln(_u01(id, F.lit(seed))), w)).where("_k IS NOT NULL")
    return pool.orderBy("_k", id).limit(n).drop("_k")


def reporting_weight(candidates: DataFrame, presence: DataFrame, degrees: float = 0.25, floor: float = 0.001) -> DataFrame:
    """candidates with `weight`: presences in the same cell plus a floor, as a share of all."""
    cell = lambda d: d.withColumn("_cx", F.floor(F.col("lon") / degrees)).withColumn("_cy", F.floor(F.col("lat") / degrees))
    n = cell(presence).groupBy("_cx", "_cy").agg(F.count("*").alias("_n"))
    c = cell(candidates).join(n, ["_cx", "_cy"], "left").withColumn("_w", F.coalesce("_n", F.lit(0)) + floor)
    total = F.broadcast(c.agg(F.sum("_w").alias("_total")))
    return c.crossJoin(total).withColumn("weight", F.col("_w") / F.col("_total")).drop("_cx", "_cy", "_n", "_w", "_total")


def candidate_grid(spark, west: float, south: float, east: float, north: float, years: list[int], cell_deg: float = 0.25, block_deg: float = 5.0) -> DataFrame:
    """Cell centres of a box in every year."""
    import math

    nx, ny = math.ceil((east - west) / cell_deg - 0.5 - 1e-12), math.ceil((north - south) / cell_deg - 0.5 - 1e-12)
    d = spark.range(nx * ny * len(years)).withColumnRenamed("id", "i")
    cell = F.col("i") % (nx * ny)
    d = d.select("i", (west + cell_deg / 2 + (cell % nx) * cell_deg).alias("lon"), (south + cell_deg / 2 + F.floor(cell / nx) * cell_deg).alias("lat"), F.element_at(F.array(*(F.lit(y) for y in years)), (F.floor(F.col("i") / (nx * ny)) + 1).cast("int")).alias("year"))
    return d.select(F.concat(F.lit("cell_"), "i").alias("id"), "lon", "lat", "year", block_key("lon", "lat", block_deg).alias("stratum"))


def ignition_samples(presence: DataFrame, candidates: DataFrame, features: list[str], ratio: float = 3.0, seed: int = 0) -> DataFrame:
    """Presences (y = 1) and stratified negatives (y = 0) with features, cause and 5-degree block; ybar is their mean of y."""
    keep = ["id", "lon", "lat", "year", *features]
    neg = stratified_negatives(presence, candidates, ratio=ratio, seed=seed).select(*keep, F.lit("").alias("cause"), F.lit(0).alias("y"))
    return presence.select(*keep, "cause", F.lit(1).alias("y")).unionByName(neg).withColumn("block", block_key("lon", "lat", 5.0))


def evenly_spaced(df: DataFrame, n: int, by: str, key: str, mode: str = "largest") -> DataFrame:
    """n rows: the largest by a value, or of n evenly spaced ranks (`size`)."""
    if mode == "largest":
        return df.orderBy(F.desc_nulls_last(by), key).limit(n)
    m = df.where(F.col(by).isNotNull()).count()
    ranks = sorted({round(i * (m - 1) / max(n - 1, 1)) for i in range(min(n, m))}) or [-1]
    d = running_sums(df.where(F.col(by).isNotNull()), [F.col(by), F.col(key)], {"_i": F.lit(1)})
    return d.where((F.col("_i") - 1).isin(ranks)).drop("_i")


def tile_crops(cells: DataFrame, keys: list[str], size: int, least_valid: float = 0.5, row: str = "row", column: str = "col", valid: str = "valid", burned: str = "burned") -> DataFrame:
    """Windows of size x size cells with enough valid ones, with the share burned."""
    r, c = F.floor(F.col(row) / size).alias("crop_row"), F.floor(F.col(column) / size).alias("crop_col")
    g = cells.groupBy(*keys, r, c).agg(F.avg(F.col(valid).cast("double")).alias("valid_share"), F.avg(F.when(F.col(valid), F.col(burned).cast("double"))).alias("burned_share"), F.count("*").alias("n"))
    return g.where((F.col("n") == size * size) & (F.col("valid_share") >= least_valid))

"""Evaluation protocols composed from the scores: thresholds per fold and stratum, skill over the naive map, lead of detection."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cindral.operators.scores import confusion, ratios
from cindral.session import checked, cut


def cuts_by(df: DataFrame, by: list[str], value: str, truth: str, steps: int = 200) -> DataFrame:
    """(by, threshold, f1): the best of `steps` equal cuts of each group, by counting rows between cuts (at most steps + 1 rows a group)."""
    v, y = F.col(value).cast("double"), F.coalesce(F.col(truth).cast("double") > 0, F.lit(False)).cast("long")
    d = df.where(v.isNotNull()).select(*by, v.alias("v"), y.alias("y"))
    r = d.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("y").alias("pos"))
    d = d.join(checked(cut(r)), by)
    k = F.coalesce(F.ceil(F.try_divide((F.col("v") - F.col("lo")) * (steps - 1), F.col("hi") - F.col("lo"))), F.lit(0)).cast("int")
    h = d.groupBy(*by, "lo", "hi", "pos", k.alias("k")).agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    h = h.groupBy(*by, "lo", "hi", "pos").agg(F.collect_list(F.struct("k", "n", "p")).alias("h"))  # at most steps + 1 entries
    c = h.select(*by, "lo", "hi", "pos", "h", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("i"))
    over = lambda f: F.aggregate("h", F.lit(0).cast("long"), lambda s, e: s + F.when(e["k"] > F.col("i"), e[f]).otherwise(0))
    c = c.withColumn("tp", over("p")).withColumn("sel", over("n")).withColumn("f1", F.try_divide(2 * F.col("tp"), F.col("sel") + F.col("pos"))).where("f1 IS NOT NULL")
    c = c.withColumn("threshold", F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (steps - 1))
    return c.groupBy(*by).agg(F.max_by("threshold", F.struct("f1", -F.col("i"))).alias("threshold"), F.max("f1").alias("f1"))


def fold_skill(df: DataFrame, folds: DataFrame, value: str, truth: str, uid: str = "uid", strata: str | None = None) -> DataFrame:
    """(fold, threshold scores on the test part): F1 and IoU of the threshold tuned on the train part (per stratum where given), F1 of the naive all-positive map, and the skill over it."""
    m = folds.where(F.col("split_name").isin("train", "test")).select("fold", "split_name", uid)
    d = df.join(m, uid)
    by = ["fold", *([strata] if strata else [])]
    t = cuts_by(d.where("split_name = 'train'"), by, value, truth).select(*by, "threshold")
    test = d.where("split_name = 'test'").join(checked(cut(t)), by, "left")
    if strata:  # a stratum that did not train takes the fold's own threshold
        test = test.join(checked(cut(cuts_by(d.where("split_name = 'train'"), ["fold"], value, truth).select("fold", F.col("threshold").alias("_all")))), "fold").withColumn("threshold", F.coalesce("threshold", "_all"))
    test = test.withColumn("_pred", (F.col(value) > F.col("threshold")).cast("int")).withColumn("_one", F.lit(1))
    got = ratios(confusion(test, truth, "_pred", ["fold"])).select("fold", "tp", "fp", "fn", "tn", "f1", "iou")
    naive = ratios(confusion(test, truth, "_one", ["fold"])).select("fold", F.col("f1").alias("naive_f1"))
    return got.join(naive, "fold").withColumn("skill", F.col("f1") - F.col("naive_f1"))


def summary(per_fold: DataFrame, value: str = "skill") -> DataFrame:
    """One row: folds, mean, standard deviation, folds won."""
    return per_fold.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count_if(F.col(value) > 0).alias("wins"))


def baseline_contamination(first: DataFrame, clear_until: str, seen: str) -> DataFrame:
    """Share of fire pixels first seen inside the window that was taken as clear."""
    return first.where(F.col(seen).isNotNull()).agg(F.count("*").alias("n"), F.avg((F.col(seen) <= F.col(clear_until)).cast("double")).alias("share"))


def lead_by_stratum(per_fire: DataFrame, per_pixel: DataFrame, stratum: str = "stratum", lead: str = "lead_min") -> DataFrame:
    """(stratum, grain, n, median): leads of fires, and of all their pixels together."""
    both = per_fire.select(stratum, lead, F.lit("fire").alias("grain")).unionByName(per_pixel.select(stratum, lead, F.lit("pixel").alias("grain")))
    return both.where(F.col(lead).isNotNull()).groupBy(stratum, "grain").agg(F.count("*").alias("n"), F.percentile(lead, 0.5).alias("median"))


def first_frames(det: DataFrame, pixels: DataFrame, frames: DataFrame, cell_deg: float, most_km: float = 3.0) -> DataFrame:
    """(pixel_id, frame_idx): first frame at or after a detection within most_km of a pixel's centre, also across longitude 180.

    pixels: pixel_id, lon, lat. frames: frame_idx, t. Pixels are found by cells of at least the reach, frames by the hour.
    """
    turn = math.floor(360.0 / max(cell_deg, most_km / 111.0 * 2))  # cells round a parallel, all of one width
    size = 360.0 / turn
    cell = lambda d: d.withColumn("_i", F.pmod(F.floor((F.col("lon") + 180.0) / size), F.lit(turn))).withColumn("_j", F.floor(F.col("lat") / size))
    p = cell(pixels.select("pixel_id", "lon", "lat")).select("pixel_id", F.col("lon").alias("plon"), F.col("lat").alias("plat"), "_i", "_j")
    d = det.where("lon IS NOT NULL AND lat IS NOT NULL AND t IS NOT NULL").select("lon", "lat", F.unix_micros("t").alias("u"))
    # Degrees of longitude shrink towards the poles: more cells to either side, at most all.
    wide = F.ceil(F.least(most_km / 111.0 / F.greatest(F.cos(F.radians("lat")), F.lit(1e-6)), F.lit(180.0)) / size)
    d = cell(d).withColumn("_i", F.explode(F.array_distinct(F.transform(F.sequence(F.col("_i") - wide, F.col("_i") + wide), lambda c: F.pmod(c, F.lit(turn))))))
    d = d.withColumn("_j", F.explode(F.sequence(F.col("_j") - 1, F.col("_j") + 1))).join(p, ["_i", "_j"])
    dlon = F.abs(F.col("plon") - F.col("lon"))
    km = F.sqrt(F.pow((F.col("plat") - F.col("lat")) * 111.0, F.lit(2.0)) + F.pow(F.least(dlon, 360.0 - dlon) * 111.0 * F.cos(F.radians("lat")), F.lit(2.0)))
    first = d.where(km <= most_km).groupBy("pixel_id").agg(F.min("u").alias("u"))
    f = frames.select("frame_idx", F.unix_micros("t").alias("fu")).where("fu IS NOT NULL")
    # Within the hour of a detection frames are joined by the hour; where it has none left, the next hour with frames gives its first.
    hour = 3_600_000_000
    same = first.withColumn("h", F.floor(F.col("u") / hour)).join(f.withColumn("h", F.floor(F.col("fu") / hour)), "h").where("fu >= u").groupBy("pixel_id").agg(F.min(F.struct("fu", "frame_idx")).alias("s"))
    rest = first.join(same.select("pixel_id"), "pixel_id", "left_anti").withColumn("h", F.floor(F.col("u") / hour))
    starts = f.groupBy(F.floor(F.col("fu") / hour).alias("h")).agg(F.min(F.struct("fu", "frame_idx")).alias("s"))
    # One row for each hour asked for or present: as many as the archive has hours.
    line = rest.select("h").distinct().join(starts, "h", "full").select("h", "s")
    nxt = line.withColumn("n", F.first("s", ignorenulls=True).over(W.orderBy("h").rowsBetween(1, W.unboundedFollowing))).select("h", F.col("n").alias("s"))
    after = rest.join(checked(cut(nxt)), "h").where("s IS NOT NULL").select("pixel_id", "s")
    return same.unionByName(after).select("pixel_id", F.col("s.frame_idx").alias("frame_idx"))

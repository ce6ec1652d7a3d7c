"""Exact quantiles of groups of any size, without gathering their values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cindral.session import checked, cut


def exact_quantiles(df: DataFrame, value: str, qs: list[float], by: list[str] | None = None, accuracy: int = 20_000, name: str = "q") -> DataFrame:
    """(by..., n, q): quantiles of the non-null values, linear between order statistics; one row without groups (q null if there are no values).

    A sketch brackets each quantile's rank (to 2 / accuracy of the rows); a second pass counts what lies below each bracket and takes the
    values next to it; a third counts the distinct values inside, of which there are few, and reads the two at the rank.
    """
    names = by or []
    by = ["_by"] if names else []  # one struct, so that groups with nulls join like others
    group = [F.struct(*(F.col(c) for c in names)).alias("_by")] if names else []
    d = cut(df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v")))
    lows, highs = ([min(1.0, max(0.0, q + s * 2 / accuracy)) for q in qs] for s in (-1, 1))
    g = cut(d.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("_v", lows + highs, accuracy).alias("_p")))
    lo, hi = (lambda k: F.get("_p", F.lit(k))), (lambda k: F.get("_p", F.lit(len(qs) + k)))
    join = (lambda x: d.join(checked(x, 64 + 16 * len(qs)), by)) if by else (lambda x: d.crossJoin(F.broadcast(x)))
    near = join(g)
    v = F.col("_v")
    around = [F.struct(F.count_if(v < lo(k)).alias("below"), F.max(F.when(v < lo(k), v)).alias("prev"), F.min(F.when(v > hi(k), v)).alias("next")).alias(f"_s{k}") for k in range(len(qs))]
    sides = near.groupBy(*by).agg(*around)
    every = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"_s{k}").alias("s")) for k in range(len(qs))))
    sides = sides.select(*by, F.explode(every).alias("e")).select(*by, "e.k", "e.s.*")
    ranks = g.select(*by, "n", F.posexplode(F.array(*(F.lit(float(q)) for q in qs)))).withColumn("_pos", F.col("col") * (F.col("n") - 1)).select(*by, "n", F.col("pos").alias("k"), "_pos", F.floor("_pos").alias("_i"))
    hit = F.filter(F.array(*(F.when(v.between(lo(k), hi(k)), F.lit(k)) for k in range(len(qs)))), lambda k: k.isNotNull())
    inside = near.select(*by, "_v", F.explode(hit).alias("k")).groupBy(*by, "k", "_v").agg(F.count("*").alias("_c"))
    run = F.sum("_c").over(W.partitionBy(*by, "k").orderBy("_v"))
    inside = inside.withColumn("_to", run).join(ranks.join(sides, [*by, "k"]), [*by, "k"])
    at = lambda i: F.max(F.when((F.col("below") + F.col("_to") - F.col("_c") <= i) & (i < F.col("below") + F.col("_to")), F.col("_v")))
    i = F.col("_i")
    r = inside.groupBy(*by, "k").agg(at(i).alias("_a"), at(i + 1).alias("_b"), F.max("prev").alias("prev"), F.max("next").alias("next"), F.max(F.col("_pos") - i).alias("_f"), F.max("n").alias("n"))
    # A rank next to the bracket is the value next to it.
    a, b = F.coalesce("_a", "prev"), F.coalesce("_b", "next", "_a")
    r = r.select(*by, "n", "k", (a + F.col("_f") * (F.when(F.col("_f") > 0, b).otherwise(a) - a)).alias("_q"))
    out = r.groupBy(*by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("k", "_q"))), lambda x: x["_q"]).alias(name))
    return out.select("_by.*", "n", name) if by else out.select(F.coalesce("n", F.lit(0)).alias("n"), F.when(F.size(name) > 0, F.col(name)).alias(name))

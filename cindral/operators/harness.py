"""Evaluation harnesses composed of the operators: reference draws, comparisons of models, early detection, next-day and spread forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cindral.operators.models import conditional_quantiles
from cindral.operators.quantiles import exact_quantiles
from cindral.operators.raster import arrival_times, buffered, burn_probability, calibrated_scale, ignition_cells, rate_of_spread
from cindral.operators.scores import apply_temperature, average_precision, calibration_error, confusion, crps, fit_temperature, paired_bootstrap, probability_scores, ratios
from cindral.operators.series import far_threshold, harmonic_fit
from cindral.session import checked, cut


def above(index: Column, threshold: float, greater: bool = True) -> Column:
    """Mask of a continuous index by a threshold; null counts as unset."""
    return F.coalesce(index > threshold if greater else index < threshold, F.lit(False)).cast("int")


def persistent(mask: Column) -> Column:
    """Tomorrow's mask is today's."""
    return F.coalesce(mask > 0, F.lit(False)).cast("int")


def stratified_confusion(df: DataFrame, truth: str, pred: str, draws: dict[int, int], key: str, by: list[str] | None = None, seed: int = 0) -> DataFrame:
    """(by, map_class, ref_class, n) of a reference draw: of each mapped class (0, 1) so many cells, by hash order."""
    by = by or []
    d = df.select(*by, (F.col(pred) > 0).cast("int").alias("map_class"), (F.col(truth) > 0).cast("int").alias("ref_class"), F.xxhash64(key, F.lit(seed)).alias("_h"), F.col(key).alias("_k"))
    wanted = F.when(F.col("map_class") == 1, draws.get(1, 0)).otherwise(draws.get(0, 0))
    rank = F.row_number().over(W.partitionBy(*by, "map_class").orderBy("_h", "_k"))
    top = d.withColumn("_i", rank).where(F.col("_i") <= max(draws.values(), default=0)).where(F.col("_i") <= wanted)  # the constant bound prunes before the shuffle
    return top.groupBy(*by, "map_class", "ref_class").agg(F.count("*").alias("n"))


def head_to_head(skills: DataFrame, order: list[str], draws: int = 10_000, seed: int = 0) -> DataFrame:
    """(a, b, n, mean_a, mean_b, mean_diff, ci_low, ci_high, p_a_better) of each two models that share fires. skills: model, fire, skill; order: models, the most able first."""
    means = skills.groupBy("model").agg(F.avg("skill").alias("m"))
    out = None
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            side = lambda m, n: skills.where(F.col("model") == m).select("fire", F.col("skill").alias(n))
            both = cut(side(a, "a").join(side(b, "b"), "fire"))
            r = paired_bootstrap(both, "a", "b", "fire", draws, seed).crossJoin(both.agg(F.count("*").alias("n"))).where("n > 0")
            mean = lambda m, n: means.where(F.col("model") == m).select(F.col("m").alias(n))
            r = r.crossJoin(mean(a, "mean_a")).crossJoin(mean(b, "mean_b")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "n", "mean_a", "mean_b", "mean_diff", "ci_low", "ci_high", "p_a_better")
            out = r if out is None else out.unionByName(r)
    return out


def early_detection(df: DataFrame, far: float = 0.01, cadence_min: float = 5.0, order: int = 2, value: str = "bt") -> DataFrame:
    """One row: minutes from onset to detection by the residual from each pixel's diurnal cycle and by the value itself, at the same rate of false alarms, and the lead.

    df: pixel, idx, t, the value, fire (whether the row's pixel is the one that burns), onset (its first burning idx). Thresholds come from the
    other pixels. The cycle is fitted to rows before the onset where a pixel burns, to all rows elsewhere. Not detected: null.
    """
    clear = df.where(~F.col("fire") | (F.col("idx") < F.col("onset")))
    fit = harmonic_fit(clear, ["pixel"], value, order=order)
    h = (F.hour("t") + F.minute("t") / 60.0 + F.second("t") / 3600.0) * (2 * 3.141592653589793 / 24.0)
    cycle = F.get("coef", F.lit(0))
    for k in range(1, order + 1):
        cycle = cycle + F.get("coef", F.lit(2 * k - 1)) * F.sin(k * h) + F.get("coef", F.lit(2 * k)) * F.cos(k * h)
    d = cut(df.join(fit, "pixel").withColumn("residual", F.col(value) - cycle).drop("coef"))
    out = None
    for name in ("residual", value):
        cutoff = far_threshold(d.where(~F.col("fire")), name, far)
        first = d.where("fire AND idx >= onset").crossJoin(F.broadcast(cutoff)).where(F.col(name) > F.col("threshold"))
        m = first.agg(F.min((F.col("idx") - F.col("onset")) * cadence_min).alias("residual_min" if name == "residual" else "absolute_min"))
        out = m if out is None else out.crossJoin(m)
    return out.withColumn("lead_min", F.col("absolute_min") - F.col("residual_min"))


def forecast_scores(df: DataFrame, prob: str, by: list[str], threshold: float = 0.5) -> DataFrame:
    """(by, n, base_rate, ap, f1, iou, brier) over the cells that do not burn yet and are valid. df: fire_t, fire_t1, valid, prob."""
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(prob).cast("double")))
    d = cut(df.where(~F.coalesce("fire_t", F.lit(False)) & F.coalesce("valid", F.lit(False))).select(*by, F.coalesce("fire_t1", F.lit(False)).cast("int").alias("y"), p.alias("p"), (p > threshold).cast("int").alias("c")))
    s = probability_scores(d, "y", "p", by).select(*by, "n", "base_rate", "brier")
    c = ratios(confusion(d, "y", "c", by)).select(*by, F.coalesce("f1", F.lit(0.0)).alias("f1"), F.coalesce("iou", F.lit(0.0)).alias("iou"))
    return s.join(c, by).join(average_precision(d, "y", "p", by=by).withColumnRenamed("average_precision", "ap"), by)


def pooled_calibration_error(df: DataFrame, prob: str) -> DataFrame:
    """(n, ece) of the same cells, over all fires together."""
    d = df.where(~F.coalesce("fire_t", F.lit(False)) & F.coalesce("valid", F.lit(False))).select(F.coalesce("fire_t1", F.lit(False)).cast("int").alias("y"), F.col(prob).alias("p"))
    return calibration_error(d, "y", "p").crossJoin(d.agg(F.count("*").alias("n")))


def physics_prior(cells: DataFrame, keys: list[str], horizon: float = 12.0) -> DataFrame:
    """cells (keys, row, col, fire_t, fuel, wind, slope) with `prior`: chance that the front from today's fire is there by the horizon."""
    d = cells.withColumns({"ros": rate_of_spread(F.col("fuel"), F.col("wind"), F.col("slope")), "_seed": F.coalesce("fire_t", F.lit(False))})
    a = arrival_times(d, keys, seed="_seed")
    return a.withColumn("prior", burn_probability(F.col("arrival"), F.col("_seed"), horizon)).drop("_seed", "ros", "arrival")


def next_day(cells: DataFrame, folds: DataFrame, fire: str, rows: int, cols: int, horizon: float = 12.0, radius: float = 2.0) -> DataFrame:
    """(model, fire, scores): today's fire widened, and the physics prior with the temperature fitted on the other folds' fires, on the cells that burn anew.

    cells: fire, row, col, fire_t, fire_t1, valid, fuel, wind, slope. folds: fire, fold (each fire tests in one).
    """
    d = cut(physics_prior(cells, [fire], horizon).join(folds, fire))
    wide = buffered(d.withColumn("_on", F.coalesce("fire_t", F.lit(False)).cast("int")), "_on", radius, rows, cols, [fire]).select(fire, "row", "col", F.col("prob").alias("widened"))
    d = cut(d.join(wide, [fire, "row", "col"], "left").fillna({"widened": 0.0}))
    out = forecast_scores(d, "widened", [fire]).withColumn("model", F.lit("persistence_buffer"))
    anew = d.where(~F.coalesce("fire_t", F.lit(False)) & F.coalesce("valid", F.lit(False))).withColumn("_y", F.coalesce("fire_t1", F.lit(False)).cast("int"))
    for k in sorted(r["fold"] for r in folds.select("fold").distinct().collect()):  # one number for each fold
        t = fit_temperature(anew.where(F.col("fold") != k), "_y", "prior").first()["temperature"]
        s = forecast_scores(d.where(F.col("fold") == k).withColumn("_p", apply_temperature(F.col("prior"), t)), "_p", [fire])
        out = out.unionByName(s.withColumn("model", F.lit("physics")))
    return out


def assimilated(cells: DataFrame, keys: list[str], early: float = 0.5, seed_quantile: float = 0.05) -> DataFrame:
    """(keys, k, dice, pod, far, n_early, n_late): the speed of a fire calibrated on its early detections, and the cells it says burn by the last one against those detected.

    cells: keys, row, col, ros, time (hours of the first detection in a cell, null where none). Fires of fewer than two detected cells are left out.
    """
    seen = cut(cells.where("time IS NOT NULL").select(*keys, "row", "col", "time"))
    cutoff = exact_quantiles(seen, "time", [early], keys).where("n >= 2").select(*keys, F.get("q", F.lit(0)).alias("_split"))
    last = seen.groupBy(*keys).agg(F.max("time").alias("_last"))
    sides = cut(cutoff.join(last, keys))
    seeds = ignition_cells(seen, "time", seed_quantile, keys).select(*keys, "row", "col", F.lit(True).alias("seed"))
    d = cells.join(checked(sides, 64), keys).join(seeds, [*keys, "row", "col"], "left").fillna({"seed": False})
    a = cut(arrival_times(d, keys))
    k = calibrated_scale(a.withColumn("_obs", F.when(F.col("time") <= F.col("_split"), F.col("time"))), keys, "arrival", "_obs")
    a = a.join(checked(cut(k)), keys)
    pred = F.coalesce(F.col("arrival") / F.greatest("k", F.lit(1e-6)) <= F.col("_last"), F.lit(False)).cast("int")
    a = a.withColumns({"_pred": pred, "_truth": F.col("time").isNotNull().cast("int"), "_early": (F.col("time") <= F.col("_split"))})
    n = a.groupBy(*keys).agg(F.first("k").alias("k"), F.count_if("_early").alias("n_early"), F.count_if(~F.col("_early")).alias("n_late"))
    s = ratios(confusion(a, "_truth", "_pred", keys)).select(*keys, F.col("f1").alias("dice"), F.col("recall").alias("pod"), "far")
    return n.join(s, keys)


def tail_of(exceed: Column) -> tuple[Column, Column]:
    """(shape, scale) of a generalised Pareto tail from the mean and variance of the excesses (aggregates)."""
    m, v = F.avg(exceed), F.var_samp(exceed)
    r = F.try_divide(m * m, v)
    return 0.5 * (1.0 - r), 0.5 * m * (r + 1.0)


def tail_level(frac: float, shape: Column, scale: Column) -> Column:
    """Level of the tail that a share `frac` of the excesses stays below."""
    import math

    log = -math.log(1.0 - frac)
    return F.when(F.abs(shape) < 1e-9, scale * log).otherwise(scale / shape * (F.exp(shape * log) - 1.0))


def burned_area_quantiles(train: DataFrame, by: list[str], value: str, taus: list[float], tail_from: float = 0.9, least: int = 30, within: list[str] | None = None) -> DataFrame:
    """(by, n, q): conditional quantiles of log(1 + area), those above tail_from from one generalised Pareto tail of all cells' excesses over it
    (one for each value of `within`, some of by).

    The tail is fitted by moments in one aggregation where it has `least` excesses, else the empirical quantiles stay.
    """
    y = F.log1p(F.col(value).cast("double"))
    j = taus.index(tail_from)
    within = within or []
    q = cut(conditional_quantiles(train, by, value, taus, within=within))
    over = train.where(F.col(value).isNotNull()).join(checked(q), by).select(*within, (y - F.log1p(F.get("q", F.lit(j)))).alias("e")).where("e > 0")
    shape, scale = tail_of(F.col("e"))
    tail = over.groupBy(*within).agg(F.count("*").alias("_n"), shape.alias("_c"), scale.alias("_s"))
    base = F.log1p(F.get("q", F.lit(j)))
    parts = []
    for i, t in enumerate(taus):
        own = F.get("q", F.lit(i))
        level = F.expm1(base + tail_level((t - tail_from) / (1 - tail_from), F.col("_c"), F.col("_s"))) if t > tail_from else own
        parts.append(F.when((F.col("_n") >= least) & (F.col("_s") > 0), level).otherwise(own))
    both = q.join(tail, within, "left") if within else q.crossJoin(F.broadcast(tail))
    return both.select(*by, "n", F.array_sort(F.array(*parts)).alias("q"))


def evaluate_burned_area(df: DataFrame, folds: DataFrame, by: list[str], value: str, taus: list[float], uid: str = "uid") -> DataFrame:
    """(fold, n, crps, crps_climatology, skill, rmse): quantiles of each fold's training cells against the constant quantiles of its training rows. folds: fold, split_name, uid."""
    d = cut(df.where(F.col(value).isNotNull()).join(folds.select("fold", "split_name", uid), uid))
    train, test = d.where("split_name = 'train'"), d.where("split_name = 'test'")
    model = burned_area_quantiles(train, ["fold", *by], value, taus, within=["fold"]).select("fold", *by, F.col("q").alias("_q"))
    flat = exact_quantiles(train, value, taus, ["fold"], name="_all").select("fold", "_all")
    t = test.join(checked(cut(flat), 128), "fold").join(checked(cut(model), 256), ["fold", *by], "left").withColumn("_q", F.coalesce("_q", "_all"))
    t = cut(t.select("fold", F.col(value).cast("double").alias("_y"), *(F.get("_q", F.lit(i)).alias(f"_m{i}") for i in range(len(taus))), *(F.get("_all", F.lit(i)).alias(f"_c{i}") for i in range(len(taus)))))
    m = crps(t, "_y", {tau: f"_m{i}" for i, tau in enumerate(taus)}, ["fold"])
    c = crps(t, "_y", {tau: f"_c{i}" for i, tau in enumerate(taus)}, ["fold"]).withColumnRenamed("crps", "crps_climatology")
    mid = min(range(len(taus)), key=lambda i: abs(taus[i] - 0.5))
    e = t.groupBy("fold").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.pow(F.col("_y") - F.col(f"_m{mid}"), F.lit(2.0)))).alias("rmse"))
    return e.join(m, "fold").join(c, "fold").withColumn("skill", 1.0 - F.try_divide("crps", "crps_climatology"))


def grouped_folds(fires: DataFrame, k: int, fire: str = "fire", seed: int = 0) -> DataFrame:
    """(fire, fold): whole fires dealt to k folds of equal size (within one) in hash order. Raises unless 2 <= k <= fires."""
    from cindral.operators.ordered import running_sums

    d = fires.select(fire).where(F.col(fire).isNotNull()).distinct().withColumn("_h", F.xxhash64(fire, F.lit(seed)))
    n = d.count()
    if not 2 <= k <= n:
        raise ValueError(f"{k} folds of {n} fires")
    d = running_sums(d, [F.col("_h"), F.col(fire)], {"_i": F.lit(1)})
    return d.select(fire, F.pmod(F.col("_i") - 1, F.lit(k)).cast("int").alias("fold"))


def grouped_split(fires: DataFrame, val: float = 0.15, test: float = 0.15, fire: str = "fire", seed: int = 0) -> DataFrame:
    """(fire, split_name): whole fires in hash order, the first share to test, the next to val (at least one each), the rest to train."""
    from cindral.operators.ordered import running_sums

    d = fires.select(fire).where(F.col(fire).isNotNull()).distinct().withColumn("_h", F.xxhash64(fire, F.lit(seed)))
    n = d.count()
    n_test, n_val = max(1, round(n * test)), max(1, round(n * val))
    d = running_sums(d, [F.col("_h"), F.col(fire)], {"_i": F.lit(1)})
    return d.select(fire, F.when(F.col("_i") <= n_test, "test").when(F.col("_i") <= n_test + n_val, "val").otherwise("train").alias("split_name"))

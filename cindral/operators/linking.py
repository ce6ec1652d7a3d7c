"""Links in space and time, connected groups, coincidence and one-to-one matching.

Distance joins are equi-joins on grid cells: one side looks into the cells around it, the exact condition follows. No cross joins.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cindral.session import cut


def _cell(c: str, size: float) -> Column:
    return F.floor(F.col(c) / size)


def _around(c: Column) -> Column:
    return F.explode(F.sequence(c - 1, c + 1))


def _near(d: DataFrame, gap: int) -> DataFrame:
    """(a, b): pairs of nodes that hold rows at most the larger of their tolerances and gap microseconds apart.

    d: k, x, y, lo, hi, tol. A node is what was seen at one place within one bucket of time of width gap, from lo to hi. Tolerances differ by
    sensor and view angle; each node is put into a class of tolerance (by powers of 2), and pairs of classes are joined on cells of the
    larger one's size, so a few wide tolerances do not coarsen the grid of all.
    """
    d = d.withColumn("cls", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("tol"), F.lit(1.0))))).cast("int"))
    classes = d.groupBy("cls").count().select("cls")  # one row for each power of 2
    right = d.select(*(F.col(c).alias(f"{c}2") for c in d.columns))
    # The row of the wider class (ties: any) sets the cell size: 2**cls; the narrower row is put into the cells of every wider class.
    # Pairs of one class meet in one of two opposite steps, so half the steps do where no narrower class exists; 0 is the row's own cell.
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    way = lambda s: F.lit((s > (0, 0, 0)) - (s < (0, 0, 0)))
    step = lambda few: F.array(*(F.struct(F.lit(s[0]).alias("i"), F.lit(s[1]).alias("j"), F.lit(s[2]).alias("k"), way(s).alias("way")) for s in few))
    left = d.join(F.broadcast(classes.agg(F.min("cls").alias("least"))), F.lit(True)).withColumn("size", F.pow(F.lit(2.0), "cls"))
    left = left.withColumn("s", F.explode(F.when(F.col("cls") > F.col("least"), step(steps)).otherwise(step([s for s in steps if s >= (0, 0, 0)]))))
    cells = ((F.floor(F.col(c) / w) + F.col(f"s.{i}")).alias(n) for n, c, w, i in (("cx", "x", F.col("size"), "i"), ("cy", "y", F.col("size"), "j"), ("ct", "lo", F.lit(gap), "k")))
    left = left.select("k", "x", "y", "lo", "hi", "tol", "cls", F.col("s.way").alias("way"), *cells)
    wider = F.broadcast(classes.withColumnRenamed("cls", "cls_w"))  # powers of 2
    right = right.join(wider, F.col("cls2") <= F.col("cls_w")).withColumn("size2", F.pow(F.lit(2.0), "cls_w"))
    right = right.select("k2", "x2", "y2", "lo2", "hi2", "tol2", "cls2", F.col("cls_w").alias("cls"), F.floor(F.col("x2") / F.col("size2")).alias("cx"), F.floor(F.col("y2") / F.col("size2")).alias("cy"), F.floor(F.col("lo2") / gap).alias("ct"))
    p = left.join(right, ["cls", "cx", "cy", "ct"]).where((F.col("cls2") < F.col("cls")) | (F.col("way") > 0) | ((F.col("way") == 0) & (F.col("k") < F.col("k2"))))
    far = F.greatest("tol", "tol2")
    # Rows of one bucket are within gap of each other; of neighbouring buckets the last of one and the first of the other are nearest.
    same = F.floor(F.col("lo") / gap) == F.floor(F.col("lo2") / gap)
    in_time = same | (F.greatest("lo", "lo2") - F.least("hi", "hi2") <= gap)
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    return p.where(in_time & (dx * dx + dy * dy <= far * far)).select(F.least("k", "k2").alias("a"), F.greatest("k", "k2").alias("b"))


def _timed(det: DataFrame, key: str, tolerance: str, extra_m: float) -> DataFrame:
    placed = det.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("t").isNotNull())
    return placed.withColumns({"_k": F.col(key), "_u": F.unix_micros("t"), "_tol": (F.col(tolerance) + extra_m).cast("double")})


def links(det: DataFrame, key: str = "det_id", tolerance: str = "tolerance_m", max_gap_s: float = 12 * 3600.0, extra_m: float = 0.0) -> DataFrame:
    """(a, b), a < b: all pairs of detections at most the larger of their tolerances (plus extra_m) and max_gap_s apart. det: key, x, y, t,
    tolerance. For groups use `clustered`, which needs no pairs within a place."""
    d = _timed(det, key, tolerance, extra_m)
    return _near(d.select(F.col("_k").alias("k"), "x", "y", F.col("_u").alias("lo"), F.col("_u").alias("hi"), F.col("_tol").alias("tol")), int(max_gap_s * 1e6))


def _smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, smallest vertex of their group) for the edges (a, b)."""
    names, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = both[: len(a)], both[len(a) :]
    low = np.arange(len(names))
    while len(i):
        m = np.minimum(low[i], low[j])
        np.minimum.at(low, low[i], m)
        np.minimum.at(low, low[j], m)
        while (low[low] != low).any():
            low = low[low]
        left = low[i] != low[j]
        i, j = i[left], j[left]
    return names, names[low]


def _contracted(edges: DataFrame, most: int = 500_000) -> DataFrame:
    """Edges (a, b) replaced by (smallest of the group, member) within parts of a partition of about `most` edges (any parts of the edges
    may be joined by themselves): fewer edges with the same groups, in bounded memory."""

    def run(batches):
        import pandas as pd

        def done(parts):
            v, low = _smallest(*(np.concatenate(c) for c in zip(*parts)))
            return pd.DataFrame({"a": low, "b": v})[low != v]

        parts, n = [], 0
        for x in batches:
            parts.append((x["a"].to_numpy(), x["b"].to_numpy()))
            n += len(x)
            if n >= most:
                yield done(parts)
                parts, n = [], 0
        if parts:
            yield done(parts)

    return edges.mapInPandas(run, edges.schema)


def groups(vertices: DataFrame, pairs: DataFrame, key: str, rounds: int = 60, local_edges: int = 1_000_000) -> DataFrame:
    """(key, root): the smallest key of each connected group; unlinked vertices are their own group. Keys are whole numbers.

    Edges are first contracted within their partitions. Up to local_edges of them (a bound on one task) the rest is one local step;
    beyond it alternating stars: neighbours are hung on the smallest, large and small stars in turn, until the edges no longer change,
    in a number of rounds that grows with the logarithm of the longest chain.
    """
    e = pairs.where("a <> b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"))
    e = cut(_contracted(e).distinct())
    n = e.count()
    if 0 < n <= local_edges:
        e = _contracted(e.repartition(1), local_edges)
        n = 0
    state = None
    for _ in range(rounds):
        if not n:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), F.col("b").alias("b")).where("a <> b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.col("m").alias("x"), "a", "b")
        e = cut(small.select(F.col("x").alias("a"), "b").unionByName(small.where("a <> x").select(F.col("x").alias("a"), F.col("a").alias("b"))).distinct())
        new = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("groups did not stabilise")
    root = e.groupBy(F.col("b").alias(key)).agg(F.min("a").alias("root"))
    return vertices.select(key).distinct().join(root, key, "left").select(key, F.coalesce("root", key).alias("root"))


def clustered(det: DataFrame, key: str = "det_id", tolerance: str = "tolerance_m", max_gap_s: float = 12 * 3600.0, extra_m: float = 0.0, within: list[str] | None = None, local_edges: int = 1_000_000) -> DataFrame:
    """det with `root`, the smallest key of its fire event. within: columns across which nothing is linked (tiles, coarse cells).

    Rows at one place in one bucket of time (of width max_gap_s) are within reach of each other, so they are one node with its first and last
    time, named by its smallest key; only nodes are paired. A fixed pixel that burns for hours is a few nodes, however many readings.
    """
    within, gap = within or [], int(max_gap_s * 1e6)
    det = cut(det)
    d = _timed(det, key, tolerance, extra_m).withColumn("_bucket", F.floor(F.col("_u") / gap))
    d = d.withColumn("_own", F.when(F.col("_tol").isNull(), F.col("_k")))  # without tolerance nothing is linked
    node = ["x", "y", "_tol", "_bucket", "_own", *within]
    nodes = cut(d.groupBy(*node).agg(F.min("_k").alias("k"), F.min("_u").alias("lo"), F.max("_u").alias("hi")))
    pairs = _near(nodes.select("k", "x", "y", "lo", "hi", F.col("_tol").alias("tol")), gap)
    if within:
        side = nodes.select("k", F.struct(*within).alias("w"))
        pairs = pairs.join(side.withColumnsRenamed({"k": "a", "w": "wa"}), "a").join(side.withColumnsRenamed({"k": "b", "w": "wb"}), "b").where(F.col("wa").eqNullSafe(F.col("wb"))).select("a", "b")
    roots = nodes.join(groups(nodes, pairs, "k", local_edges=local_edges), "k").select(*(F.col(c).alias(f"n_{c}") for c in node), "root")
    same = [F.col(c).eqNullSafe(F.col(f"n_{c}")) for c in node]
    out = d.join(roots, same).select(*(F.col(c) for c in det.columns), "root")
    alone = det.where(F.col("x").isNull() | F.col("y").isNull() | F.col("t").isNull())
    return out.unionByName(alone.withColumn("root", F.col(key)))


def thinned(det: DataFrame, degrees: float = 0.02, minutes: int = 60, key: str = "det_id") -> DataFrame:
    """The first row of each lon/lat cell and time bin (by time, then key): partial aggregation, no window over a cell."""
    cell = [F.bround(F.col("lon") / degrees).cast("long").alias("_i"), F.bround(F.col("lat") / degrees).cast("long").alias("_j"), F.floor(F.unix_micros("t") / (minutes * 60_000_000)).alias("_b")]
    d = det.where("lon IS NOT NULL AND lat IS NOT NULL AND t IS NOT NULL")
    row = F.struct(*d.columns)
    return d.groupBy(*cell).agg(F.min_by(row, F.struct("t", key)).alias("_r")).select("_r.*")


def event_features(det: DataFrame, event: str = "root") -> DataFrame:
    """The 18 features of each event, in one aggregation.

    det: event, x, y, t, sensor, frp_mw, bt_mir_k, bt_tir_k, view_zenith_deg, confidence, static_anomaly, landcover (missing ones count as null).
    """
    kind = {"sensor": "string", "landcover": "string", "static_anomaly": "boolean"}
    for c in ("frp_mw", "bt_mir_k", "bt_tir_k", "view_zenith_deg", "confidence", "static_anomaly", "landcover", "sensor"):
        if c not in det.columns:
            det = det.withColumn(c, F.lit(None).cast(kind.get(c, "double")))
    hours = F.unix_micros("t") / 3.6e9
    d = det.withColumn("_h", hours).withColumn("_hf", F.when(F.col("frp_mw").isNotNull(), hours)).withColumn("_f", F.col("frp_mw").cast("double")).withColumn("_dt", F.col("bt_mir_k") - F.col("bt_tir_k")).withColumn("_lc", F.coalesce("landcover", F.lit("other")))
    # Times from a fixed origin keep the regression's sums small; the slope does not depend on the origin.
    origin = F.lit(0.0)
    covers = ("forest", "crop", "grass", "shrub", "other")
    first_seen = [F.min(F.when(F.col("_lc") == c, F.unix_micros("t"))).alias(f"_s_{c}") for c in covers]
    g = d.groupBy(event).agg(
        F.count("*").alias("n_detections"), F.count_distinct(F.lower("sensor")).alias("n_sensors"), (F.max("_h") - F.min("_h")).alias("duration_h"), F.max("_f").alias("peak_frp_mw"), F.sum("_f").alias("total_frp_mw"),
        F.regr_slope("_f", F.col("_hf") - origin).alias("_slope"), F.count("_f").alias("_nf"), (F.max("_hf") - F.min("_hf")).alias("_span"), F.avg("_dt").alias("mean_dt_mir_tir_k"), F.max("_dt").alias("max_dt_mir_tir_k"),
        F.avg(F.col("view_zenith_deg").cast("double")).alias("mean_view_zenith_deg"), F.avg(F.col("confidence").cast("double")).alias("mean_confidence"), F.sqrt(F.greatest(F.var_pop("x"), F.lit(0.0)) + F.greatest(F.var_pop("y"), F.lit(0.0))).alias("spatial_spread_m"),
        F.avg(F.coalesce("static_anomaly", F.lit(False)).cast("double")).alias("static_anomaly_fraction"), F.avg("x").alias("centroid_x"), F.avg("y").alias("centroid_y"), F.min("t").alias("start"), F.max("t").alias("end"),
        *(F.count_if(F.col("_lc") == c).alias(f"_n_{c}") for c in covers), *first_seen,
    )
    # Dominant land cover: most rows, among equals the one seen first.
    best = F.array_max(F.array(*(F.struct(F.col(f"_n_{c}").alias("n"), (-F.coalesce(F.col(f"_s_{c}"), F.lit(0))).alias("s"), F.lit(c).alias("c")) for c in covers)))["c"]
    g = g.withColumn("_best", best)
    return g.select(
        event, "n_detections", "n_sensors", (F.col("n_sensors") > 1).cast("double").alias("multi_sensor_agreement"), "duration_h", (F.col("n_detections") / F.greatest("duration_h", F.lit(0.001))).alias("detections_per_hour"), "peak_frp_mw", "total_frp_mw",
        F.when((F.col("_nf") >= 3) & (F.col("_span") >= 0.5), F.col("_slope")).alias("frp_growth_mw_per_h"), "mean_dt_mir_tir_k", "max_dt_mir_tir_k", "mean_view_zenith_deg", "mean_confidence", "spatial_spread_m", "static_anomaly_fraction",
        *((F.col("_best") == c).cast("double").alias(f"landcover_{c}") for c in ("forest", "crop", "grass", "shrub")), "centroid_x", "centroid_y", "start", "end",
    )


def coincidence(a: DataFrame, b: DataFrame, key: str, cell_m: float, window_s: float) -> DataFrame:
    """(key, gap_s): rows of a with a row of b in the same or a neighbouring cell within window_s, and the smallest time gap.

    Rows of b are one for each cell and time before the join.
    """
    w = int(window_s * 1e6)
    right = b.where("x IS NOT NULL AND y IS NOT NULL AND t IS NOT NULL").select(_cell("x", cell_m).alias("cx"), _cell("y", cell_m).alias("cy"), F.unix_micros("t").alias("u2")).distinct().withColumn("ct", F.floor(F.col("u2") / w))
    left = a.where("x IS NOT NULL AND y IS NOT NULL AND t IS NOT NULL").select(F.col(key), F.unix_micros("t").alias("u"), _cell("x", cell_m).alias("px"), _cell("y", cell_m).alias("py"))
    left = left.withColumn("cx", _around(F.col("px"))).withColumn("cy", _around(F.col("py"))).withColumn("ct", _around(F.floor(F.col("u") / w)))
    gap = F.abs(F.col("u") - F.col("u2"))
    return left.join(right, ["cx", "cy", "ct"]).where(gap <= w).groupBy(key).agg((F.min(gap) / 1e6).alias("gap_s"))


def coincidence_scores(goes: DataFrame, viirs: DataFrame, key: str, cell_m: float = 4000.0, window_s: float = 1800.0) -> DataFrame:
    """One row: n_viirs (within the box of goes), tp, pod, median_gap_min."""
    box = goes.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    inside = viirs.join(F.broadcast(box), (F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1"))).drop("x0", "x1", "y0", "y1")
    hit = coincidence(inside, goes, key, cell_m, window_s)
    r = inside.select(key).join(hit, key, "left").agg(F.count("*").alias("n_viirs"), F.count("gap_s").alias("tp"), F.percentile(F.col("gap_s") / 60.0, 0.5).alias("median_gap_min"))
    return r.withColumn("pod", F.try_divide("tp", "n_viirs"))


def precision_far_scores(goes: DataFrame, viirs: DataFrame, key: str, cell_m: float = 4000.0, coverage_m: float = 50_000.0, window_s: float = 1800.0, seen: DataFrame | None = None) -> DataFrame:
    """One row: rows of goes that viirs could have seen (a row in the coarse cell), of these found in the fine cell (tp) or not (fp).

    seen: the coarse coincidence where it is known already, as for several fine cells.
    """
    seen = (coincidence(goes, viirs, key, coverage_m, window_s) if seen is None else seen).select(key, F.lit(1).alias("seen"))
    found = coincidence(goes, viirs, key, cell_m, window_s).select(key, F.lit(1).alias("found"))
    r = seen.join(found, key, "left").agg(F.count("*").alias("n_evaluable"), F.count("found").alias("tp")).withColumn("fp", F.col("n_evaluable") - F.col("tp"))
    return r.withColumn("precision", F.try_divide("tp", "n_evaluable")).withColumn("far", F.try_divide("fp", "n_evaluable"))


def labelled_samples(goes: DataFrame, viirs: DataFrame, key: str, cell_m: float = 4000.0, window_s: float = 1800.0) -> DataFrame:
    """goes with label 1 where viirs confirms a row."""
    return goes.join(coincidence(goes, viirs, key, cell_m, window_s).select(key, F.lit(1).alias("label")), key, "left").fillna({"label": 0})


def candidate_matches(pred: DataFrame, truth: DataFrame, tolerance: str | float, max_gap_s: float) -> DataFrame:
    """(pred_id, truth_id, distance_m, lead_min) of events near each other in place (pred's tolerance) and time (spans at most max_gap_s apart).

    pred, truth: event_id, x, y, start, end.
    """
    tol = F.lit(float(tolerance)) if isinstance(tolerance, (int, float)) else F.col(tolerance)
    p = pred.select(F.col("event_id").alias("pred_id"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("start").alias("ps"), F.col("end").alias("pe"), tol.alias("tol"))
    t = truth.select(F.col("event_id").alias("truth_id"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("start").alias("ts"), F.col("end").alias("te"))
    size = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("tol"), F.lit(1.0)))))
    p = p.withColumn("size", size)
    sizes = F.broadcast(p.select("size").distinct())  # powers of 2
    p = p.withColumn("cx", _around(F.floor(F.col("px") / F.col("size")))).withColumn("cy", _around(F.floor(F.col("py") / F.col("size"))))
    t = t.crossJoin(sizes).withColumn("cx", F.floor(F.col("tx") / F.col("size"))).withColumn("cy", F.floor(F.col("ty") / F.col("size")))
    d = F.sqrt(F.pow(F.col("px") - F.col("tx"), 2) + F.pow(F.col("py") - F.col("ty"), 2))
    overlap = F.least(F.unix_micros("pe"), F.unix_micros("te")) - F.greatest(F.unix_micros("ps"), F.unix_micros("ts"))
    return p.join(t, ["size", "cx", "cy"]).where((d <= F.col("tol")) & (overlap >= -int(max_gap_s * 1e6))).select("pred_id", "truth_id", d.alias("distance_m"), ((F.unix_micros("ts") - F.unix_micros("ps")) / 6e7).alias("lead_min"))


def matched_one_to_one(candidates: DataFrame, rounds: int = 1000) -> DataFrame:
    """Greedy one-to-one matching by (distance, pred_id, truth_id): pairs that are best for both sides are taken, their other pairs dropped, and so on; the same result as taking the pairs in order."""
    left, taken = cut(candidates), None
    order = F.struct("distance_m", "pred_id", "truth_id")
    for _ in range(rounds):
        best_p = left.groupBy("pred_id").agg(F.min(order).alias("_p"))
        best_t = left.groupBy("truth_id").agg(F.min(order).alias("_t"))
        now = cut(left.join(best_p, "pred_id").join(best_t, "truth_id").where((F.col("_p") == order) & (F.col("_t") == order)).select(*candidates.columns))
        taken = now if taken is None else taken.unionByName(now)
        left = cut(left.join(now.select("pred_id"), "pred_id", "left_anti").join(now.select("truth_id"), "truth_id", "left_anti"))
        if left.isEmpty():
            return taken
    raise RuntimeError("matching did not end")


def detection_scores(pred: DataFrame, truth: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, pod, far, precision, f1."""
    r = matches.agg(F.count("*").alias("tp")).crossJoin(pred.agg(F.count("*").alias("_p"))).crossJoin(truth.agg(F.count("*").alias("_t")))
    r = r.select("tp", (F.col("_p") - F.col("tp")).alias("fp"), (F.col("_t") - F.col("tp")).alias("fn"))
    return r.select("tp", "fp", "fn", F.try_divide("tp", F.col("tp") + F.col("fn")).alias("pod"), F.try_divide("fp", F.col("tp") + F.col("fp")).alias("far"), F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def latency(matches: DataFrame) -> DataFrame:
    """Median and quartiles of the lead, and the share of matches in which pred came first."""
    q = F.percentile("lead_min", [0.25, 0.5, 0.75])
    return matches.agg(F.count("*").alias("n"), q.alias("q"), F.avg((F.col("lead_min") > 0).cast("double")).alias("frac_earlier")).select("n", F.get("q", F.lit(0)).alias("p25_lead_min"), F.get("q", F.lit(1)).alias("median_lead_min"), F.get("q", F.lit(2)).alias("p75_lead_min"), "frac_earlier")


def top_rows(det: DataFrame, by: list[str], n: int, value: str = "frp_mw", key: str = "det_id") -> DataFrame:
    """The n strongest rows of each group (nulls last, ties by key); Spark keeps n rows of a group in each task before the shuffle."""
    w = W.partitionBy(*by).orderBy(F.desc_nulls_last(value), key)
    return det.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")

"""The label registry's rules of use, candidates of mapping activations, sample and chip frames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindral.functions.codes import parse_centroid
from cindral.functions.grids import REGION_CRS, project
from cindral.operators.splits import reporting_weight

# Sources kept for evaluation; labels of the 30 climate classes in order.
EVALUATION_ONLY = ("copernicus_ems", "nirops", "cbi")
CLIMATES = "Af Am Aw BWh BWk BSh BSk Csa Csb Csc Cwa Cwb Cwc Cfa Cfb Cfc Dsa Dsb Dsc Dsd Dwa Dwb Dwc Dwd Dfa Dfb Dfc Dfd ET EF".split()


def evaluation_only(source: Column) -> Column:
    return F.coalesce(F.lower(source).isin(*EVALUATION_ONLY), F.lit(False))


def _outline_only() -> Column:
    return F.col("geometry_path").isNotNull() & F.col("interior_mask_path").isNull()


def training_records(records: DataFrame, require_interior_mask: bool = True) -> DataFrame:
    """Records that may train: not of an evaluation source, and no bare outline where an interior is required. records: source, geometry_path, interior_mask_path."""
    r = records.where(~evaluation_only(F.col("source")))
    return r.where(~_outline_only()) if require_interior_mask else r


def evaluation_records(records: DataFrame) -> DataFrame:
    return records.where(evaluation_only(F.col("source")))


def assert_trainable(records: DataFrame, key: str = "event_id") -> DataFrame:
    """records, unless one is kept for evaluation or is an outline without interior (raises, naming it)."""
    why = F.when(evaluation_only(F.col("source")), "is reserved for evaluation").when(_outline_only(), "has an outline but no interior mask")
    bad = records.select(key, why.alias("why")).where("why IS NOT NULL").orderBy(key).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0][0]} {bad[0][1]}")
    return records


def climate_name(code: Column) -> Column:
    """Label of a climate class 1..30; `?` for others and none."""
    return F.coalesce(F.get(F.array(*(F.lit(c) for c in CLIMATES)), code.cast("int") - 1), F.lit("?"))


def wildfire_candidates(activations: DataFrame, year_min: int = 2017, year_max: int = 2100, min_products: int = 1, closed_only: bool = True) -> DataFrame:
    """Wildfire activations with a place in the years wanted: code, name, event_date (text), lon, lat, n_products, closed.

    activations: code, name, category, eventTime, centroid (point text), n_products, closed, as the service's replies have them.
    """
    lon, lat = parse_centroid("centroid")
    day = F.substring(F.coalesce("eventTime", F.lit("")), 1, 10)
    d = activations.where((F.col("category") == "Wildfire") & (F.coalesce("n_products", F.lit(0)) >= min_products))
    d = d.where(F.coalesce("closed", F.lit(False))) if closed_only else d
    d = d.select("code", "name", day.alias("event_date"), lon.alias("lon"), lat.alias("lat"), F.coalesce("n_products", F.lit(0)).alias("n_products"), F.coalesce("closed", F.lit(False)).alias("closed"))
    return d.where(F.substring("event_date", 1, 4).try_cast("int").between(year_min, year_max) & F.col("lon").isNotNull())


def event_dates(candidates: DataFrame) -> DataFrame:
    """(code, event_date) of a candidates table; of repeated codes the last line's in order of the date."""
    ok = (F.coalesce("code", F.lit("")) != "") & (F.coalesce("event_date", F.lit("")) != "")
    return candidates.where(ok).groupBy("code").agg(F.max("event_date").alias("event_date"))


def sample_cells(cells: DataFrame, predictor: str, reference: str, reference_valid: str | None = None, nodata: float | None = None) -> DataFrame:
    """cells with a float predictor, a boolean reference, and `valid`: finite, not the no-data value, and valid in the reference."""
    p = F.col(predictor).cast("float")
    ok = p.isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf"))
    ok = ok & (p != F.lit(nodata).cast("float")) if nodata is not None else ok
    ok = ok & F.coalesce(F.col(reference_valid).cast("boolean"), F.lit(False)) if reference_valid else ok
    return cells.withColumns({predictor: p, reference: F.coalesce(F.col(reference).cast("boolean"), F.lit(False)), "valid": F.coalesce(ok, F.lit(False))})


def target_windows(records: DataFrame, region: str, res_m: float = 30.0, factor: float = 2.5, least_half_m: float = 15_000.0, most_half_m: float = 30_000.0) -> DataFrame:
    """records (lon, lat, area_ha) with the window of each fire on the region's equal-area grid: x0, y0, x1, y1 snapped to res_m, width, height.

    Half the window is `factor` radii of the fire's area, within limits.
    """
    x, y = project("lon", "lat", REGION_CRS[region])
    radius = F.sqrt(F.greatest(F.coalesce(F.col("area_ha").cast("double"), F.lit(0.0)), F.lit(0.0)) * 1e4 / math.pi)
    half = F.least(F.lit(most_half_m), F.greatest(F.lit(least_half_m), radius * factor))
    d = records.withColumns({"_x": x, "_y": y, "_h": half})
    down, up = (lambda c: F.floor(c / res_m) * res_m), (lambda c: F.ceil(c / res_m) * res_m)
    d = d.withColumns({"x0": down(F.col("_x") - F.col("_h")), "y0": down(F.col("_y") - F.col("_h")), "x1": up(F.col("_x") + F.col("_h")), "y1": up(F.col("_y") + F.col("_h"))})
    size = lambda a, b: F.bround((F.col(b) - F.col(a)) / res_m).cast("int")
    return d.withColumns({"width": size("x0", "x1"), "height": size("y0", "y1")}).drop("_x", "_y", "_h")


def stitched(chips: DataFrame, manifest: DataFrame) -> DataFrame:
    """(event_id, row, col, burned) of the cells that any chip predicts: chips (stem, row, col, value) placed by manifest (stem, event_id, y0,
    x0, height, width); cells beyond the fire's raster and chips without entry are left out, overlaps take the larger value."""
    d = chips.join(manifest, "stem").select("event_id", (F.col("y0") + F.col("row")).alias("row"), (F.col("x0") + F.col("col")).alias("col"), (F.col("value") > 0).cast("int").alias("v"), "height", "width")
    return d.where((F.col("row") >= 0) & (F.col("row") < F.col("height")) & (F.col("col") >= 0) & (F.col("col") < F.col("width"))).groupBy("event_id", "row", "col").agg(F.max("v").alias("burned"))


def ignition_frames(presence: DataFrame, candidates: DataFrame, features: list[str], degrees: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """Presence and candidate frames with what the sampling needs: stratum (0 where missing), cause (`unknown`), weight (reports nearby)."""
    have = lambda d, c, other: F.col(c) if c in d.columns else other.alias(c)
    base = lambda d: [F.col("id"), F.col("lon").cast("double"), F.col("lat").cast("double"), F.col("year"), have(d, "stratum", F.lit(0).cast("long")), *(F.col(f).cast("double") for f in features)]
    p = presence.select(*base(presence), F.coalesce(have(presence, "cause", F.lit("unknown")), F.lit("unknown")).alias("cause"))
    if "weight" in candidates.columns:
        return p, candidates.select(*base(candidates), F.col("weight").cast("double"))
    c = candidates.select(*base(candidates))
    return p, reporting_weight(c, p, degrees)


def cause_rows(samples: DataFrame, cause: str) -> DataFrame:
    """The rows of one cause's model: its positives and every background row."""
    return samples.where((F.col("cause") == cause) | (F.col("y") == 0))

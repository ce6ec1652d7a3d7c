"""The 35 physics features of a candidate pixel, without coordinates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindral.functions import geometry as g
from cindral.functions import radiative as r
from cindral.functions._num import div

# Names that must not be features.
FORBIDDEN = frozenset("lat latitude lon long longitude x y easting northing row col i j tile_x tile_y grid_x grid_y h v geohash h3 s2_cell quadkey".split())
#: Inputs and what they count as where a frame has no such column.
DEFAULTS = {"aod_550": 0.0, "emissivity_mir": 0.98, "emissivity_tir": 0.98, "elevation_m": 0.0, "ndvi": None, "swir_16_um": None, "swir_22_um": None, "persistence_count": 0.0, "persistence_days": 0.0, "temporal_anomaly_z": None}


def assert_allowed(names: list[str]) -> None:
    bad = {n.lower() for n in names} & FORBIDDEN
    if bad:
        raise ValueError(f"coordinates as features: {sorted(bad)}")


def physics_features(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the 35 features. df: bt_mir_k, bt_tir_k, bt_mir_background_k, bt_tir_background_k, longitude_deg, day_of_year, utc_hour, view and solar zenith and azimuth, tcwv_kg_m2, and the optional inputs of DEFAULTS."""
    c = {n: F.col(n).cast("double") if n in df.columns else F.lit(v).cast("double") for n, v in DEFAULTS.items()}
    v = {n: F.col(n).cast("double") for n in ("bt_mir_k", "bt_tir_k", "bt_mir_background_k", "bt_tir_background_k", "view_zenith_deg", "view_azimuth_deg", "solar_zenith_deg", "solar_azimuth_deg", "tcwv_kg_m2")}
    dt, dt_bg = v["bt_mir_k"] - v["bt_tir_k"], v["bt_mir_background_k"] - v["bt_tir_background_k"]
    em, et = v["bt_mir_k"] - v["bt_mir_background_k"], v["bt_tir_k"] - v["bt_tir_background_k"]
    lst = g.local_solar_time_hours("longitude_deg", "utc_hour")
    ds, dc = g.day_of_year_encoding("day_of_year")
    mir = F.greatest(v["bt_mir_k"], F.lit(1e-6))
    out = {
        "bt_mir_k": v["bt_mir_k"], "bt_tir_k": v["bt_tir_k"], "dt_mir_tir_k": dt, "dt_mir_tir_anomaly_k": dt - dt_bg, "bt_mir_excess_k": em, "bt_tir_excess_k": et, "mir_tir_excess_ratio": F.when(F.abs(et) > 0.05, div(em, et)),
        "planck_b_mir": r.planck_sensitivity_exponent(3.9, v["bt_mir_k"]), "planck_b_tir": r.planck_sensitivity_exponent(11.0, v["bt_tir_k"]), "solar_zenith_deg": v["solar_zenith_deg"], "view_zenith_deg": v["view_zenith_deg"],
        "glint_angle_deg": g.glint_angle_deg(v["solar_zenith_deg"], v["view_zenith_deg"], v["solar_azimuth_deg"], v["view_azimuth_deg"]), "relative_azimuth_deg": F.pmod(v["solar_azimuth_deg"] - v["view_azimuth_deg"], F.lit(360.0)),
        "air_mass_factor": r.air_mass_factor(v["view_zenith_deg"]), "pixel_area_growth": g.pixel_area_growth(v["view_zenith_deg"]), "is_night": (v["solar_zenith_deg"] > 90.0).cast("double"), "local_solar_time_h": lst,
        "solar_hour_sin": F.sin(2 * math.pi * lst / 24.0), "solar_hour_cos": F.cos(2 * math.pi * lst / 24.0), "doy_sin": ds, "doy_cos": dc, "tcwv_kg_m2": v["tcwv_kg_m2"], "aod_550": c["aod_550"],
        "transmittance_mir": r.transmittance_mir(v["tcwv_kg_m2"], v["view_zenith_deg"], c["aod_550"]), "elevation_km": c["elevation_m"] / 1000.0, "emissivity_mir": c["emissivity_mir"], "emissivity_tir": c["emissivity_tir"],
        "emissivity_contrast": c["emissivity_mir"] - c["emissivity_tir"], "ndvi": c["ndvi"], "swir16_mir_ratio": c["swir_16_um"] / mir, "swir22_mir_ratio": c["swir_22_um"] / mir, "has_swir": c["swir_16_um"].isNotNull().cast("double"),
        "persistence_count": c["persistence_count"], "persistence_days": c["persistence_days"], "temporal_anomaly_z": c["temporal_anomaly_z"],
    }
    assert_allowed(list(out))
    return df.select(*keys, *(e.alias(n) for n, e in out.items()))


def feature_names() -> list[str]:
    return "bt_mir_k bt_tir_k dt_mir_tir_k dt_mir_tir_anomaly_k bt_mir_excess_k bt_tir_excess_k mir_tir_excess_ratio planck_b_mir planck_b_tir solar_zenith_deg view_zenith_deg glint_angle_deg relative_azimuth_deg air_mass_factor pixel_area_growth is_night local_solar_time_h solar_hour_sin solar_hour_cos doy_sin doy_cos tcwv_kg_m2 aod_550 transmittance_mir elevation_km emissivity_mir emissivity_tir emissivity_contrast ndvi swir16_mir_ratio swir22_mir_ratio has_swir persistence_count persistence_days temporal_anomaly_z".split()


def with_missingness(df: DataFrame, names: list[str]) -> DataFrame:
    """df with `missing__x` for every named column that has a null anywhere (one aggregation to find them)."""
    any_null = df.agg(*(F.max(F.col(n).isNull().cast("int")).alias(n) for n in names)).first()
    return df.withColumns({f"missing__{n}": F.col(n).isNull().cast("double") for n in names if any_null[n]})


def standardized(df: DataFrame, stats: dict[str, tuple[float, float]], eps: float = 1e-6) -> DataFrame:
    return df.withColumns({n: (F.col(n) - m) / (s + eps) for n, (m, s) in stats.items()})

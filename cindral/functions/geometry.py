"""Sun, view and footprint geometry; the geostationary fixed grid; matching tolerances."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cindral.functions._num import Number, at_least, at_most, clip, col, div, lookup

# Matching tolerance in metres by sensor, geostationary sensors, growth of a fire front by land cover.
SENSOR_TOLERANCE_M = {"viirs": 1125.0, "modis": 3000.0, "goes": 6000.0, "fci": 3000.0, "slstr": 3000.0, "landsat": 90.0, "sentinel2": 60.0}
GEO_SENSORS = ("goes", "abi", "fci", "seviri", "ahi")
LANDCOVER_BUFFER_M = {"forest": 5000.0, "shrub": 2000.0, "grass": 1500.0, "crop": 1000.0, "other": 1000.0}
DEFAULT_TOLERANCE_M, DEFAULT_BUFFER_M, DEFAULT_ELEVATION_M = 2000.0, 1000.0, 1000.0
GOES_EAST_LON, GOES_WEST_LON = -75.0, -137.0


def solar_position(lat: Number, lon: Number, day_of_year: Number, utc_hour: Number) -> tuple[Column, Column]:
    """Zenith and azimuth in degrees (the almanac's series in the fractional year)."""
    p, doy, h = F.radians(col(lat)), col(day_of_year), col(utc_hour)
    g = 2.0 * math.pi / 365.0 * (doy - 1.0 + (h - 12.0) / 24.0)
    # Coefficients of the equation of time (minutes) and of the declination (radians).
    minutes = 229.18 * (7.5e-05 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))
    decl = 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
    ha = F.radians((h * 60.0 + minutes + 4.0 * col(lon)) / 4.0 - 180.0)
    cz = clip(F.sin(p) * F.sin(decl) + F.cos(p) * F.cos(decl) * F.cos(ha), -1.0, 1.0)
    ca = clip(F.coalesce(div(F.sin(decl) - F.sin(p) * cz, F.cos(p) * F.sin(F.acos(cz))), F.lit(0.0)), -1.0, 1.0)
    return F.degrees(F.acos(cz)), F.when(ha > 0, 360.0 - F.degrees(F.acos(ca))).otherwise(F.degrees(F.acos(ca)))


def glint_angle_deg(solar_zenith: Number, view_zenith: Number, solar_azimuth: Number, view_azimuth: Number) -> Column:
    s, v, r = F.radians(col(solar_zenith)), F.radians(col(view_zenith)), F.radians(col(solar_azimuth) - col(view_azimuth))
    return F.degrees(F.acos(clip(F.cos(s) * F.cos(v) - F.sin(s) * F.sin(v) * F.cos(r), -1.0, 1.0)))


def local_solar_time_hours(lon: Number, utc_hour: Number) -> Column:
    return F.pmod(col(utc_hour) + col(lon) / 15.0, F.lit(24.0))


def day_of_year_encoding(day_of_year: Number) -> tuple[Column, Column]:
    a = 2.0 * math.pi * col(day_of_year) / 365.25
    return F.sin(a), F.cos(a)


def _growth(view_zenith: Column, radius: float, altitude: float) -> Column:
    """Growth of a pixel's area from nadir: slant range squared over the cosine of the zenith angle."""
    z = F.radians(view_zenith)
    inner = z - F.asin(clip(radius * F.sin(z) / (radius + altitude), -1.0, 1.0))
    slant = F.when(z > 0, div((radius + altitude) * F.sin(inner), altitude * F.sin(z))).when(z.isNotNull(), F.lit(1.0))
    return slant * slant / F.cos(z)


def pixel_area_growth(view_zenith_deg: Number, orbit_altitude_km: float = 833.0) -> Column:
    return _growth(clip(col(view_zenith_deg), 0.0, 80.0), 6371.0, orbit_altitude_km)


def viirs_pixel_area_m2(view_zenith_deg: Number, nominal_m: float = 375.0) -> Column:
    return nominal_m**2 * at_most(pixel_area_growth(view_zenith_deg), 4.0)


def geo_leo_tolerance_m(view_zenith_deg: Number, elevation_m: Number = DEFAULT_ELEVATION_M, nominal_pixel_m: float = 2000.0, floor_m: float = 1000.0, orbit_altitude_km: float = 35786.0) -> Column:
    """Half the diagonal of a grown pixel plus the parallax of the terrain."""
    v = clip(col(view_zenith_deg), 0.0, 80.0)
    half = nominal_pixel_m * F.sqrt(pixel_area_growth(v, orbit_altitude_km)) * math.sqrt(2.0) / 2.0
    return at_least(half + F.coalesce(col(elevation_m), F.lit(DEFAULT_ELEVATION_M)) * F.tan(F.radians(v)), floor_m)


def tolerance_m(sensor: Column, landcover: Column | None = None, view_zenith_deg: Column | None = None, elevation_m: Column | None = None, mode: str = "fusion") -> Column:
    """Matching tolerance of a detection.

    fusion: geostationary sensors with a view angle by geometry, others by table, at least the land cover's buffer. serving: any sensor
    with a view angle by geometry, without land cover.
    """
    flat = F.coalesce(lookup(F.lower(sensor), SENSOR_TOLERANCE_M), F.lit(DEFAULT_TOLERANCE_M))
    if view_zenith_deg is not None:
        geo = geo_leo_tolerance_m(view_zenith_deg, elevation_m if elevation_m is not None else DEFAULT_ELEVATION_M)
        use = view_zenith_deg.isNotNull() & (F.lower(sensor).isin(*GEO_SENSORS) if mode == "fusion" else F.lit(True))
        flat = F.when(use, geo).otherwise(flat)
    if mode == "serving" or landcover is None:
        return flat if mode == "serving" else F.greatest(flat, F.lit(DEFAULT_BUFFER_M))
    return F.greatest(flat, F.coalesce(lookup(landcover, LANDCOVER_BUFFER_M), F.lit(DEFAULT_BUFFER_M)))


def serving_tolerance_m(sensor_family: Column, view_zenith_deg: Column) -> Column:
    """Matching radius of a served detection: by its view angle over terrain of 1,000 m where that is known, else the sensor family's; at least 1,000 m."""
    flat = F.coalesce(lookup(sensor_family, SENSOR_TOLERANCE_M), F.lit(DEFAULT_TOLERANCE_M))
    return at_least(F.when(view_zenith_deg.isNotNull(), geo_leo_tolerance_m(view_zenith_deg, 1000.0)).otherwise(flat), 1000.0)


def parallax_offset_m(fire_height_m: Number, satellite_lon: Number, lon: Number, lat: Number) -> Column:
    """Shift of a target at some height as seen from a geostationary satellite."""
    q = 6378137.0 / 42164000.0
    c = clip(F.cos(F.radians(col(lat))) * F.cos(F.radians(col(lon) - col(satellite_lon))), -1.0, 1.0)
    s = div(F.sqrt(at_least(1.0 - c * c, 0.0)), F.sqrt(1.0 + q * q - 2.0 * q * c))
    return col(fire_height_m) * F.tan(F.least(F.asin(clip(s, 0.0, 1.0)), F.lit(math.radians(85.0))))


@dataclass(frozen=True)
class FixedGrid:
    """Geostationary fixed grid (scan angles in radians)."""

    lon_origin_deg: float = -75.0
    height_m: float = 35786023.0
    semi_major_m: float = 6378137.0
    semi_minor_m: float = 6356752.31414

    @property
    def distance_m(self) -> float:
        return self.height_m + self.semi_major_m

    def to_latlon(self, x: Number, y: Number) -> tuple[Column, Column]:
        """Latitude and longitude; null off the disk."""
        x, y, h, q = col(x), col(y), self.distance_m, (self.semi_major_m / self.semi_minor_m) ** 2
        a = F.sin(x) * F.sin(x) + F.cos(x) * F.cos(x) * (F.cos(y) * F.cos(y) + q * F.sin(y) * F.sin(y))
        b = -2.0 * h * F.cos(x) * F.cos(y)
        disc = b * b - 4.0 * a * (h**2 - self.semi_major_m**2)
        r = F.when(disc >= 0, (-b - F.sqrt(at_least(disc, 0.0))) / (2.0 * a))
        sx, sy, sz = r * F.cos(x) * F.cos(y), -r * F.sin(x), r * F.cos(x) * F.sin(y)
        return F.degrees(F.atan(div(q * sz, F.sqrt((h - sx) * (h - sx) + sy * sy)))), self.lon_origin_deg - F.degrees(F.atan(div(sy, h - sx)))

    def to_scan_angles(self, lat: Number, lon: Number) -> tuple[Column, Column]:
        """Scan angles; null where the place cannot be seen."""
        a, b, h = self.semi_major_m, self.semi_minor_m, self.distance_m
        dl = F.radians(col(lon) - self.lon_origin_deg)
        pc = F.atan((b / a) ** 2 * F.tan(F.radians(col(lat))))
        rc = b / F.sqrt(1.0 - (1.0 - (b / a) ** 2) * F.cos(pc) * F.cos(pc))
        sx, sy, sz = h - rc * F.cos(pc) * F.cos(dl), -rc * F.cos(pc) * F.sin(dl), rc * F.sin(pc)
        seen = h * (h - sx) >= sy * sy + (a / b) ** 2 * sz * sz
        return F.when(seen, F.asin(-sy / F.sqrt(sx * sx + sy * sy + sz * sz))), F.when(seen, F.atan(sz / sx))

    def view_zenith_deg(self, lat: Number, lon: Number) -> Column:
        q = self.semi_major_m / self.distance_m
        c = clip(F.cos(F.radians(col(lat))) * F.cos(F.radians(col(lon) - self.lon_origin_deg)), -1.0, 1.0)
        return F.degrees(F.asin(clip(div(F.sin(F.acos(c)), F.sqrt(1.0 + q * q - 2.0 * q * c)), -1.0, 1.0)))

    def pixel_area_m2(self, lat: Number, lon: Number, nominal_m: float = 2000.0) -> Column:
        return nominal_m**2 * _growth(clip(self.view_zenith_deg(lat, lon), 0.0, 85.0), self.semi_major_m, self.height_m)

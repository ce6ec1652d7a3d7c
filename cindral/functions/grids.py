"""Analysis grids, map projections, lon/lat rasters and cell keys."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cindral.functions._num import Number, col

# Regions with their projection and bounds (metres), cell size, cells to a tile, cells of halo.
REGION_CRS = {"conus": "EPSG:5070", "canada": "EPSG:3979", "europe": "EPSG:3035"}
REGION_BOUNDS = {"conus": (-2400000.0, 200000.0, 2300000.0, 3200000.0), "canada": (-2800000.0, -1000000.0, 3200000.0, 3900000.0), "europe": (2400000.0, 1300000.0, 7400000.0, 5500000.0)}
RESOLUTION_M, TILE_CELLS, HALO_CELLS = 375.0, 256, 32
TILE_M = RESOLUTION_M * TILE_CELLS
# Ellipsoid GRS80, metres to a degree used for cell sizes.
GRS80_A, GRS80_E2 = 6378137.0, 0.006694380022903416
M_PER_DEG = 111320.0


@dataclass(frozen=True)
class AnalysisGrid:
    """Tiles of 96 km, their origin snapped down and their extent up to whole tiles."""

    region: str = "conus"

    @property
    def origin(self) -> tuple[float, float]:
        return tuple(math.floor(v / TILE_M) * TILE_M for v in REGION_BOUNDS[self.region][:2])

    @property
    def size(self) -> tuple[int, int]:
        x, y = self.origin
        _, _, east, north = REGION_BOUNDS[self.region]
        return math.ceil((east - x) / TILE_M), math.ceil((north - y) / TILE_M)

    def index(self, x: Number, y: Number) -> tuple[Column, Column]:
        ox, oy = self.origin
        return F.floor((col(x) - ox) / TILE_M).cast("int"), F.floor((col(y) - oy) / TILE_M).cast("int")

    def tile_id(self, x: Number, y: Number, outside: str | None = "") -> Column:
        """`region/x0031_y0072`; `outside` beyond the grid, null for a null position."""
        ix, iy = self.index(x, y)
        nx, ny = self.size
        name = F.concat(F.lit(f"{self.region}/x"), F.lpad(ix.cast("string"), 4, "0"), F.lit("_y"), F.lpad(iy.cast("string"), 4, "0"))
        return F.when(ix.between(0, nx - 1) & iy.between(0, ny - 1), name).when(ix.isNotNull() & iy.isNotNull(), F.lit(outside))

    def bounds(self, ix: Number, iy: Number, halo: bool = False) -> tuple[Column, Column, Column, Column]:
        ox, oy = self.origin
        pad = HALO_CELLS * RESOLUTION_M if halo else 0.0
        x0, y0 = ox + col(ix) * TILE_M, oy + col(iy) * TILE_M
        return x0 - pad, y0 - pad, x0 + TILE_M + pad, y0 + TILE_M + pad

    def tiles_for_bounds(self, df: DataFrame, west: str, south: str, east: str, north: str) -> DataFrame:
        """One row for each tile that a row's box meets, within the grid: adds ix, iy and tile_id."""
        nx, ny = self.size
        (x0, y0), (x1, y1) = self.index(west, south), self.index(east, north)
        lo, hi = lambda v: F.greatest(F.lit(0), v), lambda v, n: F.least(F.lit(n - 1), v)
        span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
        out = df.withColumn("ix", F.explode(span(lo(x0), hi(x1, nx)))).withColumn("iy", F.explode(span(lo(y0), hi(y1, ny))))
        return out.withColumn("tile_id", F.concat(F.lit(f"{self.region}/x"), F.lpad(F.col("ix").cast("string"), 4, "0"), F.lit("_y"), F.lpad(F.col("iy").cast("string"), 4, "0")))

    def tiles(self, spark: SparkSession) -> DataFrame:
        """All tiles with their bounds."""
        nx, ny = self.size
        df = spark.range(nx * ny).select((F.col("id") % nx).cast("int").alias("ix"), F.floor(F.col("id") / nx).cast("int").alias("iy"))
        b = self.bounds(F.col("ix"), F.col("iy"))
        return df.select("ix", "iy", *(c.alias(n) for c, n in zip(b, ("west", "south", "east", "north"))))


def parse_tile_id(tile_id: Number | str) -> tuple[Column, Column, Column]:
    """Region, ix and iy of a tile identifier; null if it is not one."""
    t = col(tile_id)
    part = lambda g: F.nullif(F.regexp_extract(t, r"^(\w+)/x(\d+)_y(\d+)$", g), F.lit(""))
    return part(1), part(2).cast("int"), part(3).cast("int")


def _q(s: Column | float, e: float, py: bool = False):
    log = math.log if py else F.ln
    return (1 - e * e) * (s / (1 - e * e * s * s) - 1 / (2 * e) * log((1 - e * s) / (1 + e * s)))


def albers(lon: Number, lat: Number, lat1: float = 29.5, lat2: float = 45.5, lat0: float = 23.0, lon0: float = -96.0) -> tuple[Column, Column]:
    """Albers equal area on GRS80 (EPSG:5070 by default)."""
    e = math.sqrt(GRS80_E2)
    s0, s1, s2 = (math.sin(math.radians(v)) for v in (lat0, lat1, lat2))
    m = lambda s: math.sqrt((1 - s * s) / (1 - GRS80_E2 * s * s))
    q0, q1, q2 = (_q(s, e, True) for s in (s0, s1, s2))
    n = (m(s1) ** 2 - m(s2) ** 2) / (q2 - q1)
    c = m(s1) ** 2 + n * q1
    r0 = GRS80_A * math.sqrt(c - n * q0) / n
    r = GRS80_A * F.sqrt(F.greatest(c - n * _q(F.sin(F.radians(col(lat))), e), F.lit(0.0))) / n
    a = n * F.radians(F.pmod(col(lon) - lon0 + 180.0, F.lit(360.0)) - 180.0)
    return F.when(col(lat).isNotNull() & col(lon).isNotNull(), r * F.sin(a)), F.when(col(lat).isNotNull() & col(lon).isNotNull(), r0 - r * F.cos(a))


def lambert_conic(lon: Number, lat: Number, lat1: float = 49.0, lat2: float = 77.0, lat0: float = 49.0, lon0: float = -95.0) -> tuple[Column, Column]:
    """Lambert conformal conic on GRS80 (EPSG:3979 by default)."""
    e = math.sqrt(GRS80_E2)
    m = lambda p: math.cos(p) / math.sqrt(1 - GRS80_E2 * math.sin(p) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    p0, p1, p2 = (math.radians(v) for v in (lat0, lat1, lat2))
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    f = m(p1) / (n * t(p1) ** n)
    p = F.radians(col(lat))
    tp = F.tan(math.pi / 4 - p / 2) / F.pow((1 - e * F.sin(p)) / (1 + e * F.sin(p)), F.lit(e / 2))
    r, r0 = GRS80_A * f * F.pow(tp, F.lit(n)), GRS80_A * f * t(p0) ** n
    a = n * F.radians(F.pmod(col(lon) - lon0 + 180.0, F.lit(360.0)) - 180.0)
    return r * F.sin(a), r0 - r * F.cos(a)


def lambert_azimuthal(lon: Number, lat: Number, lat0: float = 52.0, lon0: float = 10.0, x0: float = 4321000.0, y0: float = 3210000.0) -> tuple[Column, Column]:
    """Lambert azimuthal equal area on GRS80 (EPSG:3035 by default)."""
    e = math.sqrt(GRS80_E2)
    qp = _q(1.0, e, True)
    s0 = math.sin(math.radians(lat0))
    b0 = math.asin(_q(s0, e, True) / qp)
    rq = GRS80_A * math.sqrt(qp / 2)
    d = GRS80_A * (math.cos(math.radians(lat0)) / math.sqrt(1 - GRS80_E2 * s0 * s0)) / (rq * math.cos(b0))
    b = F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), _q(F.sin(F.radians(col(lat))), e) / qp)))
    dl = F.radians(col(lon) - lon0)
    k = rq * F.sqrt(F.try_divide(F.lit(2.0), 1 + math.sin(b0) * F.sin(b) + math.cos(b0) * F.cos(b) * F.cos(dl)))
    return x0 + k * d * F.cos(b) * F.sin(dl), y0 + k / d * (math.cos(b0) * F.sin(b) - math.sin(b0) * F.cos(b) * F.cos(dl))


PROJECTIONS = {"EPSG:5070": albers, "EPSG:3979": lambert_conic, "EPSG:3035": lambert_azimuthal}


def project(lon: Number, lat: Number, crs: str = "EPSG:5070") -> tuple[Column, Column]:
    return PROJECTIONS[crs](lon, lat)


def block_key(lon: Number, lat: Number, degrees: float = 5.0, factor: int = 100_000) -> Column:
    """One number for a lon/lat block (factor 1000 for the classifier's variant)."""
    return F.floor(col(lon) / degrees) * factor + F.floor(col(lat) / degrees)


@dataclass(frozen=True)
class RasterSpec:
    """Lon/lat raster: west, south, east, north and rows, columns; row 0 is the north."""

    west: float
    south: float
    east: float
    north: float
    rows: int
    cols: int

    @classmethod
    def of(cls, west: float, south: float, east: float, north: float, cell_deg: float) -> "RasterSpec":
        return cls(west, south, east, north, max(1, round((north - south) / cell_deg)), max(1, round((east - west) / cell_deg)))

    def cell(self, lon: Number, lat: Number) -> tuple[Column, Column, Column]:
        """Row, column and whether they are inside."""
        c = F.floor((col(lon) - self.west) / (self.east - self.west) * self.cols).cast("int")
        r = F.floor((self.north - col(lat)) / (self.north - self.south) * self.rows).cast("int")
        return r, c, c.between(0, self.cols - 1) & r.between(0, self.rows - 1)

    def cell_size_m(self) -> tuple[float, float]:
        mid = math.radians((self.south + self.north) / 2)
        return (self.north - self.south) / self.rows * M_PER_DEG, (self.east - self.west) / self.cols * M_PER_DEG * math.cos(mid)


def crop_to_core(df: DataFrame, row: str = "row", column: str = "col", halo: int = HALO_CELLS) -> DataFrame:
    """Cells of a chip without its halo, numbered from 0."""
    inside = F.col(row).between(halo, halo + TILE_CELLS - 1) & F.col(column).between(halo, halo + TILE_CELLS - 1)
    return df.where(inside).withColumn(row, F.col(row) - halo).withColumn(column, F.col(column) - halo)

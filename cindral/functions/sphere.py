"""Distances and cell codes on the sphere, as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius of the sphere in metres.
EARTH_M = 6_371_008.8


def great_circle_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Haversine distance in metres; longitudes may use either convention."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def wrap_lon(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


# --- equal-height rows with a whole number of cells each: neighbours are found at any latitude and across 180 ---


def row_of(lat: Column, height_deg: float) -> Column:
    return F.least(F.lit(math.ceil(180.0 / height_deg) - 1), F.floor((lat + 90.0) / height_deg).cast("int"))


def cells_in_row(row: Column, height_deg: float) -> Column:
    """Cells of a row: about as wide as high at the row's edge that is nearer to a pole, at least one."""
    south = row * height_deg - 90.0
    far = F.least(F.lit(90.0), F.greatest(F.abs(south), F.abs(south + height_deg)))
    return F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(far)) / height_deg).cast("int"))


def cell_of(lon: Column, lat: Column, height_deg: float) -> Column:
    """Cell code (row and column in one long) of a position."""
    row = row_of(lat, height_deg)
    n = cells_in_row(row, height_deg)
    col = F.least(n - 1, F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * n).cast("int"))
    return row.cast("long") * F.lit(1 << 24) + col


def cells_within(lon: Column, lat: Column, radius_m: float, height_deg: float) -> Column:
    """Array of the codes of all cells that the disc of radius_m around a position can touch."""
    d = radius_m / EARTH_M * (1 + 1e-9) + 1e-12
    dd = math.degrees(d)
    first = F.greatest(F.lit(0), row_of(lat - dd, height_deg))
    last = row_of(lat + dd, height_deg)
    polar = F.abs(lat) + dd >= 90.0
    span = F.when(polar, F.lit(180.0)).otherwise(
        F.degrees(F.asin(F.least(F.lit(1.0), math.sin(d) / F.greatest(F.lit(1e-12), F.cos(F.radians(lat))))))
    )
    x = F.pmod(lon + 180.0, F.lit(360.0))

    def in_row(row: Column) -> Column:
        n = cells_in_row(row, height_deg)
        lo = F.floor((x - span) / 360.0 * n).cast("int")
        hi = F.floor((x + span) / 360.0 * n).cast("int")
        whole = (hi - lo + 1 >= n) | polar
        cols = F.when(whole, F.sequence(F.lit(0), n - 1)).otherwise(F.sequence(lo, hi))
        return F.transform(cols, lambda c: row.cast("long") * F.lit(1 << 24) + F.pmod(c, n))

    return F.array_distinct(F.flatten(F.transform(F.sequence(first, last), in_row)))


# --- Morton (Z-order) codes ---


def _spaced(c: Column) -> Column:
    """The low 24 bits of c with a zero bit after each."""
    # The masks of the usual bit-spreading steps.
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return c


def morton(lon: Column, lat: Column, level: int) -> Column:
    """Z-order code of the cell of a position in a 2**level by 2**level grid over lon [-180, 180) and lat [-90, 90]."""
    n = 1 << level
    x = F.least(F.lit(n - 1), F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * n)).cast("long")
    y = F.least(F.lit(n - 1), F.floor((lat + 90.0) / 180.0 * n)).cast("long")
    return _spaced(x).bitwiseOR(F.shiftleft(_spaced(y), 1))

"""Spectral indices and burn severity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cindral.functions._num import Number, at_least, col, digitize, div

# Severity breakpoints and labels; scene classes that count as clear.
SEVERITY_BREAKS = (100.0, 270.0, 440.0, 660.0)
SEVERITY_LABELS = ("unburned_or_regrowth", "low", "moderate_low", "moderate_high", "high")
CLEAR_CLASSES = (4, 5, 6, 7, 11)


def normalized_difference(a: Number, b: Number, eps: float = 1e-8) -> Column:
    """(a - b) / (a + b), null where the sum is about 0."""
    a, b = col(a), col(b)
    return F.when(F.abs(a + b) >= eps, (a - b) / (a + b))


def nbr(nir: Number, swir2: Number) -> Column:
    return normalized_difference(nir, swir2)


def ndvi(nir: Number, red: Number) -> Column:
    return normalized_difference(nir, red)


def ndmi(nir: Number, swir1: Number) -> Column:
    return normalized_difference(nir, swir1)


def ndwi(green: Number, nir: Number) -> Column:
    return normalized_difference(green, nir)


def dnbr(pre: Number, post: Number, scaled: bool = True) -> Column:
    return (col(pre) - col(post)) * (1000.0 if scaled else 1.0)


def rdnbr(pre: Number, post: Number, scaled: bool = True) -> Column:
    return dnbr(pre, post, scaled) / F.sqrt(at_least(F.abs(col(pre)), 0.001))


def rbr(pre: Number, post: Number, scaled: bool = True) -> Column:
    return div(dnbr(pre, post, scaled), col(pre) + 1.001)


def classify_severity(index: Number, breaks: tuple[float, ...] = SEVERITY_BREAKS) -> Column:
    """0 .. number of breaks; -1 for null."""
    return F.coalesce(digitize(col(index), breaks), F.lit(-1)).cast("smallint")


def severity_label(index: Number) -> Column:
    return F.element_at(F.array(*(F.lit(s) for s in SEVERITY_LABELS)), F.nullif(classify_severity(index).cast("int"), F.lit(-1)) + 1)


def scene_clear(scene_class: Number, keep: tuple[int, ...] = CLEAR_CLASSES) -> Column:
    return col(scene_class).isin(*keep)


def rbr_from_windows(nir_pre: Number, swir_pre: Number, nir_post: Number, swir_post: Number) -> Column:
    return rbr(nbr(nir_pre, swir_pre), nbr(nir_post, swir_post))


def post_fire_nbr(nir: Number, swir: Number) -> Column:
    """Burn ratio of one post-fire scene; null where the bands nearly cancel."""
    total = col(nir) + col(swir)
    return F.when(F.abs(total) > 1e-6, (col(nir) - col(swir)) / total)

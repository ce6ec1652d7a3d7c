"""Canadian fire-weather codes, danger classes and spread risk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cindral.functions._num import InColumns, Number, at_least, clip, col, digitize

# Codes at the start of a season, day lengths by month (duff: hours; drought: factor), class edges and labels, risk bands.
START_FFMC, START_DMC, START_DC = 85.0, 6.0, 15.0
DMC_NORTH = (6.5, 7.5, 9.0, 12.8, 13.9, 13.9, 12.4, 10.9, 9.4, 8.0, 7.0, 6.0)
DMC_EQUATOR = 9.0
DC_NORTH = (-1.6, -1.6, -1.6, 0.9, 3.8, 5.8, 6.4, 5.0, 2.4, 0.4, -1.6, -1.6)
DC_EQUATOR = 1.4
EFFIS_EDGES = (5.2, 11.2, 21.3, 38.0, 50.0, 70.0)
EFFIS_LABELS = ("very_low", "low", "moderate", "high", "very_high", "extreme", "very_extreme")
SERVING_EDGES = (5.0, 12.0, 21.0, 38.0)
SERVING_LABELS = ("Low", "Moderate", "High", "Very high", "Extreme")
RISK_BANDS = ((0.0, "Low", "#2E9E5B"), (25.0, "Moderate", "#E0B43A"), (50.0, "High", "#E8552B"), (75.0, "Extreme", "#B71C1C"))
UNKNOWN_RISK = ("Unknown", "#8A8F98")


def _day_length(month: Column, lat: Column, north: tuple[float, ...], equator: float) -> Column:
    values = F.array(*(F.lit(v) for v in north))
    m = month.cast("int")
    south = F.pmod(m - 1 + 6, F.lit(12)) + 1
    return F.when(F.abs(lat) <= 10.0, F.lit(equator)).otherwise(F.element_at(values, F.when(lat > 0, m).otherwise(south)))


def day_length_dmc(month: Number, lat: Number = 46.0) -> Column:
    return _day_length(col(month), col(lat), DMC_NORTH, DMC_EQUATOR)


def day_length_dc(month: Number, lat: Number = 46.0) -> Column:
    return _day_length(col(month), col(lat), DC_NORTH, DC_EQUATOR)


def _moisture(code: Column) -> Column:
    return 147.2 * (101.0 - code) / (59.5 + code)


# The three codes that are carried from day to day are written once, in operations o that exist for Columns and for arrays.


def next_ffmc(o, t, h, w, r, previous):
    h, w, r = o.clip(h, 0.0, 100.0), o.at_least(w, 0.0), o.at_least(r, 0.0)
    m0, rf = _moisture(previous), r - 0.5
    soaked = m0 + 42.5 * rf * o.exp(-100.0 / (251.0 - m0)) * (1.0 - o.exp(o.div(-6.93 + 0.0 * rf, rf)))
    soaked = soaked + o.pick(m0 > 150.0, 0.0015 * (m0 - 150.0) * (m0 - 150.0) * o.sqrt(o.at_least(rf, 0.0)), 0.0)
    m = o.pick(r > 0.5, o.at_most(soaked, 250.0), m0)
    shared = 0.18 * (21.1 - t) * (1.0 - o.exp(-0.115 * h))
    steam = o.exp((h - 100.0) / 10.0)
    ed = 0.942 * o.power(h, 0.679) + 11.0 * steam + shared
    ew = 0.618 * o.power(h, 0.753) + 10.0 * steam + shared

    def rate(share):
        k = 0.424 * (1.0 - o.power(share, 1.7)) + 0.0694 * o.sqrt(w) * (1.0 - o.power(share, 8.0))
        return o.power(10.0, -(k * 0.581 * o.exp(0.0365 * t)))

    m = o.pick(m > ed, ed + (m - ed) * rate(h / 100.0), o.pick(m < ew, ew - (ew - m) * rate((100.0 - h) / 100.0), m))
    m = o.clip(m, 0.0, 250.0)
    return o.clip(59.5 * (250.0 - m) / (147.2 + m), 0.0, 101.0)


def next_dmc(o, t, h, r, previous, day_length):
    t, h, r, p = o.at_least(t, -1.1), o.clip(h, 0.0, 100.0), o.at_least(r, 0.0), o.at_least(previous, 0.0)
    log_p = o.ln(o.at_least(p, 1e-6))
    b = o.pick(p <= 33.0, 100.0 / (0.5 + 0.3 * p), o.pick(p <= 65.0, 14.0 - 1.3 * log_p, 6.2 * log_p - 17.2))
    rw = 0.92 * r - 1.27
    wet = 280.0 / o.exp(0.023 * p) + o.div(1000.0 * rw, 48.77 + b * rw)
    after = o.pick(r > 1.5, 43.43 * (5.6348 - o.ln(o.at_least(wet, 1e-6))), p)
    return o.at_least(o.at_least(after, 0.0) + 1.894 * (t + 1.1) * (100.0 - h) * day_length * 0.0001, 0.0)


def next_dc(o, t, r, previous, factor):
    t, r, d = o.at_least(t, -2.8), o.at_least(r, 0.0), o.at_least(previous, 0.0)
    store = o.at_least(800.0 * o.exp(-d / 400.0), 1e-9)
    after = o.pick(r > 2.8, d - 400.0 * o.ln(o.at_least(1.0 + 3.937 * (0.83 * r - 1.27) / store, 1e-300)), d)
    return o.at_least(o.at_least(after, 0.0) + o.at_least((0.36 * (t + 2.8) + factor) / 2.0, 0.0), 0.0)


def ffmc(temp: Number, rh: Number, wind: Number, rain: Number, previous: Number) -> Column:
    """Fine fuel moisture code of a day from that of the day before."""
    return next_ffmc(InColumns, col(temp), col(rh), col(wind), col(rain), col(previous))


def dmc(temp: Number, rh: Number, rain: Number, previous: Number, month: Number, lat: Number = 46.0) -> Column:
    """Duff moisture code."""
    return next_dmc(InColumns, col(temp), col(rh), col(rain), col(previous), day_length_dmc(month, lat))


def dc(temp: Number, rain: Number, previous: Number, month: Number, lat: Number = 46.0) -> Column:
    """Drought code."""
    return next_dc(InColumns, col(temp), col(rain), col(previous), day_length_dc(month, lat))


def isi(ffmc_value: Number, wind: Number) -> Column:
    m = _moisture(col(ffmc_value))
    return 0.208 * F.exp(0.05039 * at_least(col(wind), 0.0)) * 91.9 * F.exp(-0.1386 * m) * (1.0 + F.pow(m, F.lit(5.31)) / 49300000.0)


def bui(dmc_value: Number, dc_value: Number) -> Column:
    p, d = at_least(col(dmc_value), 0.0), at_least(col(dc_value), 0.0)
    total = F.when(p + 0.4 * d > 0, p + 0.4 * d).otherwise(1e-9)
    return at_least(F.when(p <= 0.4 * d, 0.8 * p * d / total).otherwise(p - (1.0 - 0.8 * d / total) * (0.92 + F.pow(0.0114 * p, F.lit(1.7)))), 0.0)


def fwi(isi_value: Number, bui_value: Number) -> Column:
    i, u = at_least(col(isi_value), 0.0), at_least(col(bui_value), 0.0)
    b = 0.1 * i * F.when(u <= 80.0, 0.626 * F.pow(at_least(u, 1e-9), F.lit(0.809)) + 2.0).otherwise(1000.0 / (25.0 + 108.64 * F.exp(-0.023 * u)))
    return at_least(F.when(b > 1.0, F.exp(2.72 * F.pow(0.434 * F.ln(at_least(b, 1.0)), F.lit(0.647)))).otherwise(b), 0.0)


def dsr(fwi_value: Number) -> Column:
    return 0.0272 * F.pow(at_least(col(fwi_value), 0.0), F.lit(1.77))


def effis_class(fwi_value: Number) -> Column:
    return digitize(col(fwi_value), EFFIS_EDGES).cast("smallint")


def _label(n: Column, labels: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*(F.lit(s) for s in labels)), n.cast("int") + 1)


def effis_label(fwi_value: Number) -> Column:
    return _label(effis_class(fwi_value), EFFIS_LABELS)


def serving_class(fwi_value: Number) -> Column:
    """The five-class scale of the served events (its edges differ from EFFIS)."""
    return _label(digitize(col(fwi_value), SERVING_EDGES), SERVING_LABELS)


def spread_risk_score(temp_c: Number, rh_pct: Number, wind_ms: Number) -> Column:
    """0..100 with one decimal; null if all three are null, missing ones take neutral values."""
    t, h, w = col(temp_c), col(rh_pct), col(wind_ms)
    part = lambda v: clip(v, 0.0, 1.0)
    wind, dry, heat = part(F.coalesce(w, F.lit(0.0)) / 15.0), part((45.0 - F.coalesce(h, F.lit(50.0))) / 45.0), part((F.coalesce(t, F.lit(20.0)) - 15.0) / 25.0)
    return F.when(t.isNotNull() | h.isNotNull() | w.isNotNull(), F.bround(100.0 * (0.55 * wind + 0.3 * dry + 0.15 * heat), 1))


def _band(score: Column, i: int) -> Column:
    out = F.lit(RISK_BANDS[0][i])
    for band in RISK_BANDS[1:]:
        out = F.when(score >= band[0], F.lit(band[i])).otherwise(out)
    return F.when(score.isNull(), F.lit(UNKNOWN_RISK[i - 1])).otherwise(out)


def risk_class(score: Number) -> Column:
    return _band(col(score), 1)


def risk_color(score: Number) -> Column:
    return _band(col(score), 2)

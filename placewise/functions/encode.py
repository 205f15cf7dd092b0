"""Cleaning, normalising, decoding and labelling of single values."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from placewise import dims
from placewise.functions.rounding import clamp, half_even, half_up, squeeze, truncate

# --- cleaning ------------------------------------------------------------------------------------


def valid_or_null(value: Column, nodata: float | None) -> Column:
    """NULL where the value is NaN or within 0.1 + 1e-5*|nodata| of the nodata marker."""
    finite = F.when(~F.isnan(value), value)
    if nodata is None or math.isnan(nodata):
        return finite
    return F.when(F.abs(value - F.lit(float(nodata))) > F.lit(0.1 + 1e-5 * abs(nodata)), finite)


def positive_only(value: Column) -> Column:
    return F.when(~F.isnan(value) & (value > 0), value)


def zero_fill(value: Column) -> Column:
    """Missing, NaN, infinite and negative values become 0."""
    finite = F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), F.lit(0.0)).otherwise(value)
    return F.greatest(F.coalesce(finite, F.lit(0.0)), F.lit(0.0))


def number_or_null(text: Column) -> Column:
    """Trimmed text to DOUBLE; blank, '.' and anything unparsable become NULL."""
    cleaned = F.nullif(F.nullif(F.trim(text), F.lit("")), F.lit("."))
    return cleaned.try_cast("double")


def is_country(iso3: Column) -> Column:
    return F.length(F.trim(iso3)) == 3


def is_alpha_code(iso3: Column) -> Column:
    return F.trim(iso3).rlike("^[A-Za-z]{3}$")


# --- bytes ---------------------------------------------------------------------------------------


def to_byte(value: Column, lo, hi, log: bool = False, invert: bool = False) -> Column:
    """0 for missing, else 1..255 linear between the bounds (log1p of both when ``log``).

    ``lo`` and ``hi`` are numbers or columns already on the scale of ``value``; with ``log`` they are
    log1p'd here under the same sign rule as plain numbers.
    """
    scaled_value = F.when(value > 0, F.log1p(value)).otherwise(F.lit(0.0)) if log else value
    lo_c = lo if isinstance(lo, Column) else F.lit(_log_bound(lo, lo >= 0) if log else float(lo))
    hi_c = hi if isinstance(hi, Column) else F.lit(_log_bound(hi, hi > 0) if log else float(hi))
    top = F.when(hi_c <= lo_c, lo_c + 1.0).otherwise(hi_c)
    share = squeeze((scaled_value - lo_c) / (top - lo_c), 0.0, 1.0)
    return share_to_byte(value, F.lit(1.0) - share if invert else share)


def share_to_byte(value: Column, share: Column) -> Column:
    """0..1 to 1..255; 0 where ``value``, which the share was made from, is missing or no number."""
    return F.when(value.isNotNull() & ~F.isnan(value), truncate(squeeze(share * 254.0 + 1.0, 1.0, 255.0))).otherwise(F.lit(0))


def _log_bound(bound: float, apply: bool) -> float:
    return math.log1p(bound) if apply else float(bound)


def stretch(value: Column, cap: float, kind: str, gamma: float = 1.0) -> Column:
    clipped = clamp(value, 0.0, float(cap))
    if kind == "gamma":
        return F.pow(clipped / cap, F.lit(gamma)) * cap
    if kind == "sqrt":
        return F.sqrt(clipped / cap) * cap
    return clipped


def unstretch(share: Column, cap: float, kind: str, gamma: float = 1.0) -> Column:
    n = clamp(share, 0.0, 1.0)
    if kind == "gamma":
        return F.pow(n, F.lit(1.0 / gamma)) * cap
    if kind == "sqrt":
        return n * n * cap
    return n * cap


def decode(axis: str, byte: Column) -> Column:
    """Byte to physical value; 0 is missing."""
    enc = dims.ENCODING[axis]
    n = F.when(byte > 0, byte.cast("double") / 255.0)
    lo, hi = enc["lo"] or 0.0, enc["hi"]
    if axis in dims.STRETCH:
        kind, gamma = dims.STRETCH[axis]
        return unstretch(F.lit(1.0) - n, hi, kind, gamma)
    if enc["log"]:
        return F.expm1(n * math.log1p(hi))
    if enc["invert"]:
        return (F.lit(1.0) - n) * hi
    return F.lit(lo) + n * (hi - lo)


# --- units, labels ---------------------------------------------------------------------------------

MPH_PER_MPS = 2.23694
KMH_PER_MPS = 3.6


def convert_unit(value: Column, source: str, target: str) -> Column:
    rules = {
        ("C", "F"): lambda v: v * 9.0 / 5.0 + 32.0,
        ("dC", "dF"): lambda v: v * 9.0 / 5.0,
        ("m/s", "mph"): lambda v: v * MPH_PER_MPS,
        ("m/s", "km/h"): lambda v: v * KMH_PER_MPS,
        ("kbps", "Mbps"): lambda v: v / 1000.0,
    }
    return value if source == target else rules[source, target](value)


def band(name: str, value: Column) -> Column:
    """Label of the first band whose threshold exceeds the value; NULL in, NULL out."""
    label = F.when(value.isNull(), F.lit(None).cast("string"))
    for threshold, text in dims.BANDS[name]:
        if threshold is None:
            return label.otherwise(F.lit(text))
        label = label.when(value < F.lit(float(threshold)), F.lit(text))
    return label


def odds(rate: Column) -> Column:
    """Deaths per million per year as odds text."""
    one_in = half_up(F.lit(1e6) / F.when(rate > 0, rate))
    millions = F.format_string("1 in %s million per year", _fixed1(one_in.cast("double") / 1e6))
    thousands = F.format_string("1 in %d thousand per year", half_up(one_in.cast("double") / 1000.0))
    return (
        F.when(rate <= 0, F.lit("~0"))
        .when(one_in >= 1_000_000, millions)
        .when(one_in >= 1000, thousands)
        .otherwise(F.concat(F.lit("1 in "), one_in.cast("string"), F.lit(" per year")))
    )


def _fixed1(value: Column) -> Column:
    """One decimal, half up, built from whole tenths so no locale or float formatting is involved."""
    tenths = half_up(value * 10.0)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"))


def rate_text(rate: Column) -> Column:
    return (
        F.when(rate <= 0, F.lit("<0.05"))
        .when(rate < 0.1, F.lit("<0.1"))
        .when(rate < 10, _fixed1(rate))
        .otherwise(half_up(rate).cast("string"))
    )


def balance_label(share: Column) -> Column:
    """Energy balance share 0..1 to a signed label."""
    net = half_up(share * 100.0) - 50
    kind = (
        F.when(net > 20, F.lit("Major exporter"))
        .when(net > 5, F.lit("Net exporter"))
        .when(net < -20, F.lit("Major importer"))
        .when(net < -5, F.lit("Net importer"))
        .otherwise(F.lit("Balanced"))
    )
    sign = F.when(net >= 0, F.lit("+")).otherwise(F.lit(""))
    return F.concat(sign, net.cast("string"), F.lit(" ("), kind, F.lit(")"))


def minutes_label(minutes: Column) -> Column:
    """Travel minutes as '34 min', '1 hr' or '5 hrs'."""
    mins = half_up(minutes)
    hours = half_up(mins / 60.0)
    plural = F.when(hours > 1, F.lit("s")).otherwise(F.lit(""))
    return F.when(mins < 60, F.concat(mins.cast("string"), F.lit(" min"))).otherwise(
        F.concat(hours.cast("string"), F.lit(" hr"), plural)
    )


def fixed(value: Column, decimals: int) -> Column:
    """A non-negative or negative number with fixed decimals, half up."""
    scaled = half_up(F.abs(value) * float(10 ** decimals))
    digits = scaled.cast("string")
    if decimals:
        unit = F.lit(10 ** decimals)
        digits = F.concat(F.floor(scaled / unit).cast("string"), F.lit("."), F.lpad(F.pmod(scaled, unit).cast("string"), decimals, "0"))
    return F.concat(F.when((value < 0) & (scaled > 0), F.lit("-")).otherwise(F.lit("")), digits)


def value_text(axis: str, byte: Column, unit: str | None = None) -> Column:
    """'Label: value (band)' of an axis byte; NULL where there is no data.

    ``unit`` may be F for temperatures and m/s or km/h for cyclones.
    """
    n = F.when(byte > 0, byte.cast("double") / 255.0)
    if axis == "energy":
        return F.concat(F.lit("Energy bal.: "), balance_label(n))
    if axis in dims.HAZARD_TEXT:
        return _hazard_value_text(axis, byte, unit)
    label, lo, hi, inverted, log, prefix, suffix, decimals = dims.VALUE_TEXT[axis]
    share = F.lit(1.0) - n if inverted else n
    value = F.expm1(share * math.log1p(hi)) if log else F.lit(lo) + share * (hi - lo)
    if axis == "inet":
        value = convert_unit(value, "kbps", "Mbps")
    whole = half_up(value)
    kind = band("plant" if axis.startswith("e_") and axis != "e_consume" else axis, value if axis in dims.BAND_ON_EXACT else whole)
    if unit == "F" and axis in ("temp", "tvar"):
        value, suffix = convert_unit(value, "C" if axis == "temp" else "dC", "F" if axis == "temp" else "dF"), suffix.replace("C", "F")
        whole = half_up(value)
    if axis == "travel":
        shown = minutes_label(value)
    elif decimals:
        shown = fixed(value, decimals)
    elif axis in dims.THOUSANDS_AXES:
        shown = F.format_number(whole, 0)
    else:
        shown = whole.cast("string")
    return F.concat(F.lit(f"{label}: {prefix}"), shown, F.lit(f"{suffix} ("), kind, F.lit(")"))


def _hazard_value_text(axis: str, byte: Column, unit: str | None) -> Column:
    label, suffix, decimals, factor = dims.HAZARD_TEXT[axis]
    native = decode(axis, byte)
    kind = band(axis, native * MPH_PER_MPS if axis == "cyclone" else native)
    if axis == "cyclone" and unit in ("m/s", "km/h"):
        suffix, factor = f" {unit}", KMH_PER_MPS if unit == "km/h" else 1.0
    return F.concat(F.lit(f"{label}: "), fixed(native * factor, decimals), F.lit(f"{suffix} ("), kind, F.lit(")"))


def lookup_tenths(value: Column) -> Column:
    """Lookup quantisation: tenths, half-even, clipped to 0..65000."""
    return clamp(half_even(value * 10.0).cast("int"), 0, 65000)

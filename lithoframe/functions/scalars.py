"""Scalar formulas as columns. Missing values are NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def num(x: float) -> Column:
    return F.lit(float(x))


def r6(x: Column, digits: int = 6) -> Column:
    """Rounded for reports; no negative zero."""
    return F.round(x, digits) + num(0)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0; NULL where either is."""
    return F.when(b != 0, a / F.nullif(b, num(0))).when(b == 0, num(0))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(num(lo), F.least(num(hi), x)))


def no_nan(x: Column) -> Column:
    """NaN as NULL, for sources."""
    return F.when(~F.isnan(x), x)


def zero_if_null(x: Column) -> Column:
    return F.coalesce(x, num(0))


def sigmoid(x: Column) -> Column:
    return num(1) / (num(1) + F.exp(-x))


def tobler_kmh(slope: Column) -> Column:
    return num(C.TOBLER_KMH) * F.exp(num(C.TOBLER_SLOPE) * F.abs(slope + num(C.TOBLER_SHIFT)))


def walking_seconds(dist: Column, climb: Column) -> Column:
    """Time over an edge of length dist with height difference climb; unknown heights walk at the fallback speed."""
    slope = F.when(dist > 0, climb / F.nullif(dist, num(0))).otherwise(num(0))
    speed = tobler_kmh(slope) / num(C.TOBLER_KMH_TO_MS)
    return F.when(climb.isNotNull() & (speed > 0), dist / speed).otherwise(dist / num(C.FALLBACK_MS))


def cell_cost(dx: Column, dy: Column, built: Column) -> Column:
    """Cost of a cell by its gradient, plus the obstacle's where a building stands."""
    speed = tobler_kmh(F.sqrt(dx * dx + dy * dy)) / num(C.TOBLER_KMH_TO_MS)
    return num(C.COST_FACTOR) / F.greatest(speed, num(C.MIN_SPEED)) + F.when(built, num(C.OBSTACLE)).otherwise(num(0))


def ratio(a: Column, b: Column) -> Column:
    return safe_div(a - b, a + b)


def indices(band: dict[str, Column]) -> dict[str, Column]:
    """The seven indices of the bands blue, green, red, rededge, nir1, nir2."""
    b, g, r, e, n1, n2 = (band[k] for k in ("blue", "green", "red", "rededge", "nir1", "nir2"))
    return {"ndvi": ratio(n1, r), "ndwi": ratio(g, n1), "ndre": ratio(n1, e), "bsi": ratio(r + b, n1 + g), "cbi": ratio(n2, e), "gndvi": ratio(n1, g), "fdi": e - (r + (n1 - b) * num(0.5))}


def spectral_angle(x: list[Column], ref: list[Column]) -> Column:
    """Degrees between two spectra."""
    dot = lambda p, q: sum((a * b for a, b in zip(p, q, strict=True)), num(0))
    return F.degrees(F.acos(clip(dot(x, ref) / (F.sqrt(dot(x, x)) * F.sqrt(dot(ref, ref)) + num(1e-12)), -1, 1)))


def confidence(score: Column) -> Column:
    return F.when(score >= C.CONFIDENCE_HIGH, "high").when(score >= C.CONFIDENCE_MODERATE, "moderate").otherwise("speculative")


def over_max(x: Column, most: Column) -> Column:
    """x over a column's maximum, clipped to 0..1; 0 where the maximum isn't positive."""
    return F.when(most > 0, clip(x / F.nullif(most, num(0)), 0, 1)).otherwise(num(0))


def normalise_directions(raw: Column) -> Column:
    """Compass codes in order of first mention: brackets go, whole words count, everything else is ignored."""
    words = F.regexp_extract_all(F.upper(F.trim(F.regexp_replace(raw, r"\(.*?\)", ""))), F.lit(r"\b(NORTH|SOUTH|EAST|WEST|N|S|E|W)\b"), 1)
    return F.coalesce(F.array_distinct(F.transform(words, lambda w: F.left(w, F.lit(1)))), F.array().cast("array<string>"))


def parse_direction_text(text: Column) -> Column:
    """Codes of a tuple that was written as text, such as ('N', 'E'); empty parts go."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\[\]()'\"\s]", ""), ",")
    return F.filter(parts, lambda x: x != "")


def id_stem(key: Column) -> Column:
    """A key without what follows its first dot."""
    return F.substring_index(key.cast("string"), ".", 1)


def export_text(x: Column) -> Column:
    """Text for sinks: the spellings of missing values become empty."""
    return F.when(x.isNull() | x.isin("None", "nan"), "").otherwise(x)


def class_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in C.CLASS_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, code), F.lit(C.CLASS_DEFAULT))

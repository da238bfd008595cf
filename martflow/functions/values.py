"""Scalar helpers used by the marts.  All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_price(text: Column | str, precision: int = 10, scale: int = 2) -> Column:
    """``$1,200.00`` -> 1200.00; empty or malformed text -> NULL."""
    bare = F.translate(_col(text), "$,", "")
    return bare.try_cast(f"decimal({precision},{scale})")


def non_zero(number: Column | str, default: int = 1) -> Column:
    """Replace 0 by ``default``; NULL stays NULL."""
    n = _col(number)
    return F.when(n == 0, F.lit(default)).otherwise(n)


def fraction(part: Column | str, whole: Column | str) -> Column:
    """part / whole as double; 0 when there is nothing to divide by."""
    p, w = F.coalesce(_col(part), F.lit(0)), F.coalesce(_col(whole), F.lit(0))
    return F.when(w > 0, p.cast("double") / w).otherwise(F.lit(0.0))


def percent(part: Column | str, whole: Column | str, digits: int = 2) -> Column:
    """part / whole in percent, rounded; 0 when there is nothing to divide by."""
    p, w = F.coalesce(_col(part), F.lit(0)), F.coalesce(_col(whole), F.lit(0))
    rate = F.round(p / w.cast("double") * 100, digits)
    return F.when(w > 0, rate).otherwise(F.lit(0.0))


def full_name(first: Column | str, last: Column | str) -> Column:
    """Two names with a blank between; NULL if either is NULL."""
    return F.concat(_col(first), F.lit(" "), _col(last))


def text_date_part(yyyymmdd: Column | str, part: str) -> Column:
    """``year``, ``month`` or ``day`` of an ``yyyyMMdd`` text, zero-padded text."""
    start, length = {"year": (1, 4), "month": (5, 2), "day": (7, 2)}[part]
    return F.substring(_col(yyyymmdd), start, length)


def json_value(text: Column | str) -> Column:
    """Semi-structured value of a JSON text (variant); malformed text -> NULL."""
    return F.try_parse_json(_col(text))


def json_field(text: Column | str, path: str, type_: str) -> Column:
    """One typed field of a JSON text; missing or malformed -> NULL."""
    return F.try_variant_get(json_value(text), path, type_)


def route_name(topic: Column | str, pattern: str, replacement: str = "$1") -> Column:
    """Table name of a topic: ``pattern`` must match the whole topic, else NULL."""
    t = _col(topic)
    return F.when(t.rlike(f"^(?:{pattern})$"), F.regexp_replace(t, f"^(?:{pattern})$", replacement))

"""Sizes and durations: parsing and display."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes in a unit, days in a unit.
UNITS = {"b": 1, "kb": 1024, "mb": 1024**2, "gb": 1024**3}
DAYS = {"d": 1, "day": 1, "days": 1, "w": 7, "week": 7, "weeks": 7, "m": 30, "month": 30, "months": 30}


def parse_size(value: int | str) -> int:
    """Bytes of ``1.5GB`` and the like; a plain number is bytes. Fractions of a byte are cut."""
    if isinstance(value, int):
        return value
    number, unit = _parts(value, UNITS, "size")
    return int(number * UNITS[unit or "b"])


def parse_days(value: int | str) -> int:
    """Whole days of ``2w``, ``1 month`` (30 days) and the like; a plain number is days."""
    if isinstance(value, int):
        return value
    number, unit = _parts(value, DAYS, "duration")
    return int(number * DAYS[unit or "d"])


def _grammar(units) -> str:
    """A decimal number and, after blanks or none, one of the units or nothing; the same in Python and in Spark."""
    digits = "[0-9]+"
    return f"({digits}(?:[.]{digits})?)[ ]*({'|'.join(sorted(units, key=len, reverse=True))}|)"


def _parts(value, units, what: str) -> tuple[float, str]:
    found = re.fullmatch(_grammar(units), str(value).strip().lower())
    if not found:
        raise ValueError(f"not a {what}: {value!r}")
    return float(found[1]), found[2]


def size_of(text: Column) -> Column:
    """Bytes of a size text; null where it is none."""
    folded, grammar = F.lower(F.trim(text)), F.lit(f"^{_grammar(UNITS)}$")
    number, unit = (F.regexp_extract(folded, f"^{_grammar(UNITS)}$", i) for i in (1, 2))
    factors = F.create_map(*[F.lit(x) for pair in (UNITS | {"": 1}).items() for x in (pair[0], float(pair[1]))])
    return F.when(F.regexp_like(folded, grammar), F.floor(number.try_cast("double") * F.element_at(factors, unit)))


def fixed(x: Column, digits: int) -> Column:
    """Decimal text of a non-negative double, correctly rounded from its binary value, ties to even.

    The part of x * 10**digits that a double product loses is recovered by splitting x.
    """
    scale = F.lit(10.0**digits)
    product = x * scale
    big = x * F.lit(134217729.0)
    high = big - (big - x)
    lost = (high * scale - product) + (x - high) * scale
    whole = F.floor(product)
    over = (product - whole - F.lit(0.5)) + lost
    up = (over > 0) | ((over == 0) & (whole % 2 == 1))
    return F.format_string(f"%.{digits}f", (whole + F.when(up, 1).otherwise(0)) / scale)


def human(size: Column) -> Column:
    """GB, MB or KB with one decimal."""
    scaled = lambda unit, by: F.concat(fixed(size / F.lit(float(by)), 1), F.lit(f" {unit}"))
    return F.when(size >= 1024**3, scaled("GB", 1024**3)).when(size >= 1024**2, scaled("MB", 1024**2)).otherwise(scaled("KB", 1024))


def whole_mb(size: Column) -> Column:
    return F.floor(size / F.lit(1024.0 * 1024.0)).cast("long")

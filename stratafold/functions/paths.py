"""Path columns. One internal separator, ``/``; a drive root is written ``X:``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(path: Column) -> Column:
    """Backslashes become slashes, repeated and closing slashes go; a bare ``/`` stays."""
    p = F.regexp_replace(F.trim(path), r"[\\/]+", "/")
    return F.when(p == "/", p).otherwise(F.regexp_replace(p, "/$", ""))


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """The path above; null for one without a separator."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", ""))


def drive(path: Column) -> Column:
    return F.when(path.rlike("^[A-Za-z]:"), F.upper(F.substring(path, 1, 2))).otherwise("")


def n_parts(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def ancestors(path: Column, least: int = 1, itself: bool = True) -> Column:
    """Array of the path's prefixes with at least ``least`` parts, shortest first."""
    parts = F.split(path, "/")
    top = F.size(parts) if itself else F.size(parts) - 1
    made = F.transform(F.sequence(F.lit(least), F.greatest(top, F.lit(least))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.when(top >= least, made).otherwise(F.array().cast("array<string>"))


def suffix(filename: Column) -> Column:
    """The lower-cased last suffix with its dot; '' for none and for names that only start with a dot."""
    return F.lower(F.regexp_extract(filename, r".(\.[^.]+)$", 1))


def under(path: Column, root: Column) -> Column:
    """Whether the path is the root or below it; exact and separator-aware."""
    return (path == root) | path.startswith(F.concat(root, F.lit("/")))


def relative(path: Column, root: Column) -> Column:
    """The path below the root; the bare name where it is not below."""
    return F.when(path.startswith(F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + 2)).otherwise(name(path))


def shortened(path: Column, most: int = 68, tail: int = 65) -> Column:
    """Long paths keep their end behind three dots."""
    return F.when(F.length(path) > most, F.concat(F.lit("..."), F.right(path, F.lit(tail)))).otherwise(path)


def safe_filename(text: Column) -> Column:
    """Characters that a Windows file name forbids become underscores."""
    return F.regexp_replace(text, r'[\\/:*?"<>|]', "_")

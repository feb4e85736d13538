"""Column helpers that keep to Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """A top-level column by its exact name, dots and slashes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_column(c: Column | str) -> Column:
    return named(c) if isinstance(c, str) else c


def last(items: Column | str) -> Column:
    """Last element, null for an empty or null array."""
    return F.try_element_at(as_column(items), F.lit(-1))


def list_join(items: Column | str, sep: str = "; ") -> Column:
    """Elements joined by ``sep``; null elements are skipped."""
    return F.array_join(as_column(items), sep)


def parent_dir(path: Column | str) -> Column:
    """Name of the directory a path lies in; null if there is none."""
    return F.try_element_at(F.split(as_column(path), "/"), F.lit(-2))


def stem(path: Column | str) -> Column:
    """File name up to its first dot."""
    return F.try_element_at(F.split(F.try_element_at(F.split(as_column(path), "/"), F.lit(-1)), r"\."), F.lit(1))


def with_suffix(path: Column | str, old: str, new: str) -> Column:
    """The path with a trailing ``old`` replaced by ``new``; unchanged if it ends otherwise."""
    import re

    return F.regexp_replace(as_column(path), re.escape(old) + "$", new)


def file_uri(path: Column | str) -> Column:
    """``file:/abs`` and ``/abs`` as ``file:///abs``; other schemes stay."""
    return F.regexp_replace(as_column(path), r"^(file:/+|/)", "file:///")


def finite(items: Column | str) -> Column:
    """Whether all numbers of an array are neither null, NaN nor infinite."""
    return F.forall(as_column(items), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def gather(items: Column | str, places: tuple[int, ...]) -> Column:
    """Elements at the given places, from 0."""
    c = as_column(items)
    return F.transform(F.array(*map(F.lit, places)), lambda i: F.try_element_at(c, i + 1))

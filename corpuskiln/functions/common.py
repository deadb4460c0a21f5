"""Small column helpers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F


def strip(c: Column) -> Column:
    """Trim white space of every kind at both ends."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_contained(text: Column, cases: Mapping[str, str] | Iterable[tuple[str, str]], default: str) -> Column:
    """The value of the first key, in order, that text contains."""
    pairs = list(cases.items()) if isinstance(cases, Mapping) else list(cases)
    out = F.lit(default)
    for key, value in reversed(pairs):
        out = F.when(F.contains(text, F.lit(key)), F.lit(value)).otherwise(out)
    return out


def lookup(key: Column, table: Mapping[str, str], default: str) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))

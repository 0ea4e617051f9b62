"""Text rules for paths and clip names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot is not a suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """Lower-cased last suffix without the dot, empty when there is none."""
    return F.lower(F.regexp_extract(base_name(path), r".\.([^.]+)$", 1))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def first_match(text: Column, rules: Iterable[tuple[str, object]]) -> Column:
    """Value of the first rule whose keyword occurs in ``text``; NULL when none does."""
    result = None
    for keyword, value in rules:
        hit = text.contains(keyword)
        result = F.when(hit, F.lit(value)) if result is None else result.when(hit, F.lit(value))
    return result


def whole_number(text: Column) -> Column:
    """Integer reading of a text, NULL when it is not one."""
    return F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text).try_cast("bigint"))


def last_field(text: Column) -> Column:
    return F.substring_index(text, "_", -1)

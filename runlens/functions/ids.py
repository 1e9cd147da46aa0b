"""Instance ids ``<repo>-<digits>`` and code scopes as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.functions.text import strip

_ID = r"(?s)^(.+)-([0-9]+)$"


def repo_of(instance_id: Column) -> Column:
    """The repository, or the whole id where it has no number."""
    text = strip(instance_id)
    return F.when(text.rlike(_ID), F.regexp_extract(text, _ID, 1)).otherwise(text)


def number_of(instance_id: Column) -> Column:
    """The number (64 bits; null beyond), or 0 where there is none."""
    text = strip(instance_id)
    return F.when(text.rlike(_ID), F.regexp_extract(text, _ID, 2).try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def scope_key(path: Column, class_name: Column, function: Column) -> Column:
    return F.concat_ws("::", path, class_name, function)


def scope_kind(class_name: Column, function: Column) -> Column:
    return F.when(function.isNotNull(), "function").when(class_name.isNotNull(), "class").otherwise("file")


def file_of(api_path: Column) -> Column:
    return F.substring_index(api_path, "::", 1)

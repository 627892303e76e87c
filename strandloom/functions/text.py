"""String helpers as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_str(value: Column, separator: str) -> Column:
    """The fields between separators; empty ones are left out."""
    return F.filter(F.split(value, re.escape(separator)), lambda x: x != "")


def join_str(fields: Column, separator: str) -> Column:
    return F.array_join(fields, separator)


def swapped(items: Column, i: Column, j: Column) -> Column:
    """The array with the items at two places (from 0) exchanged; as it is where one place doesn't exist."""
    both = (F.greatest(i, j) < F.size(items)) & (i != j)
    at = lambda k: F.get(items, k)
    return F.when(both, F.transform(items, lambda x, k: F.when(k == i, at(j)).when(k == j, at(i)).otherwise(x))).otherwise(items)

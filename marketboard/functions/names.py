from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_map(entries: Mapping[str, str]) -> Column:
    """A constant string map; Catalyst folds it into the plan."""
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def canonical_name(raw: Column, aliases: Mapping[str, str]) -> Column:
    """Alias of the lower-cased name, else the name in title case. Blanks are kept."""
    titled = F.initcap(raw)
    if not aliases:
        return titled
    return F.coalesce(literal_map(aliases)[F.lower(raw)], titled)


def same_name(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)

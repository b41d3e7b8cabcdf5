from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd"


def parsed_date(text: Column, formats: Sequence[str] = (ISO,)) -> Column:
    """The date under the first format that fits exactly, else NULL.

    ISO dates take the cast, which is several times cheaper than a format parser; the pattern keeps
    out what the cast would accept beyond the format.
    """
    def one(fmt: str) -> Column:
        if fmt == ISO:
            return F.when(text.rlike(r"^\d{4}-\d\d-\d\d$"), text.try_cast("date"))
        return F.try_to_date(text, fmt)

    return F.coalesce(*[one(f) for f in formats])


def days_after(start: Column, count: Column) -> Column:
    """Array of the `count` dates that follow `start`; empty when count is below 1."""
    return F.when(
        count >= 1, F.transform(F.sequence(F.lit(1), count), lambda i: F.date_add(start, i))
    ).otherwise(F.array().cast("array<date>"))

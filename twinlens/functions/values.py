"""Expressions that bring raw values into one missing-value convention (SQL NULL)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def to_number(column: Column) -> Column:
    """DOUBLE value of a column; text that is no number, and NaN, become NULL.

    A cast also takes the type suffixes of program text (``1d``, ``2f``), which are no part of a number here. The type is
    known when the query is planned, so the test of the text costs other columns nothing.
    """
    none = F.lit(None).cast("double")
    suffixed = (F.typeof(column) == "string") & column.cast("string").rlike(r"[0-9.][dDfF]\s*$")
    return F.when(suffixed, none).otherwise(F.nanvl(column.try_cast("double"), none))


def code(column: Column) -> Column:
    """INT value of a coded column; anything unreadable becomes NULL."""
    return to_number(column).try_cast("int")


def lookup(mapping: dict, column: Column) -> Column:
    """Value of a fixed mapping, NULL where the key is absent."""
    pairs = [F.lit(part) for entry in mapping.items() for part in entry]
    return F.try_element_at(F.create_map(*pairs), column)


def first_of(frame_columns: list[str], *candidates: str) -> str | None:
    """The first candidate that exists among the columns."""
    return next((c for c in candidates if c in frame_columns), None)

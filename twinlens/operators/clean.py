"""Cleaning and imputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.ranks import exact_median, wide_medians
from ..functions.values import to_number
from ..model import quoted
from ..runtime import broadcast_if_small, durable


def _replace(df: DataFrame, new: dict) -> DataFrame:
    """Replaces columns in place, in one projection."""
    return df.select(*[new[c].alias(c) if c in new else quoted(c) for c in df.columns])


def _present(df: DataFrame, columns) -> list[str]:
    return [c for c in columns if c in df.columns]


def fill_absent_categories(df: DataFrame, columns, fill: str = "None") -> DataFrame:
    """A missing category means that the thing is absent."""
    return _replace(df, {c: F.coalesce(quoted(c).cast("string"), F.lit(fill)) for c in _present(df, columns)})


def fill_absent_numbers(df: DataFrame, columns, fill: float = 0.0) -> DataFrame:
    """A missing amount means that there is none."""
    return _replace(df, {c: F.coalesce(to_number(quoted(c)), F.lit(fill)) for c in _present(df, columns)})


def coerce_numbers(df: DataFrame, columns) -> DataFrame:
    """Reads columns as numbers; what cannot be read becomes NULL."""
    return _replace(df, {c: to_number(quoted(c)) for c in _present(df, columns)})


def drop_missing_ids(df: DataFrame, columns) -> DataFrame:
    """Drops rows without a usable id and casts the ids to whole numbers."""
    ids = _present(df, columns)
    whole = lambda c: F.coalesce(quoted(c).try_cast("bigint"), to_number(quoted(c)).try_cast("bigint"))
    numbers = _replace(df, {c: whole(c) for c in ids})
    return numbers.dropna(subset=ids)


def fill_group_id(df: DataFrame, column: str, default: int = 1) -> DataFrame:
    """A missing group id gets the default group."""
    if column not in df.columns:
        return df
    return _replace(df, {column: F.coalesce(to_number(quoted(column)).cast("int"), F.lit(default))})


def column_medians(df: DataFrame, columns) -> dict[str, float]:
    """Exact median per column, in two scans of the table; a column without any value is left out."""
    return wide_medians(df, {c: to_number(quoted(c)) for c in columns})[0]


def column_modes(df: DataFrame, columns) -> dict:
    """Most frequent value per column, the smallest one on ties; counts are combined before each shuffle."""
    modes = {}
    by_type: dict[str, list[str]] = {}
    for c in columns:
        by_type.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    for names in by_type.values():
        values = [F.struct(F.lit(c).alias("name"), quoted(c).alias("v")) for c in names]
        rows = df.select(F.explode(F.array(*values)).alias("s")).select("s.*").where(F.col("v").isNotNull())
        counts = rows.groupBy("name", "v").agg(F.count("*").alias("n"))
        best = counts.groupBy("name").agg(F.min(F.struct((-F.col("n")).alias("rank"), "v")).alias("best"))
        modes.update({r["name"]: r["best"]["v"] for r in best.collect()})
    return modes


def _fill_values(df: DataFrame, values: dict) -> DataFrame:
    """Fills missing values with one scalar per column; the scalars become literals of a plain projection."""
    new = {}
    for name, value in values.items():
        kept = quoted(name)
        if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
            kept = F.nanvl(kept, F.lit(None).cast("double"))
        new[name] = F.coalesce(kept, F.lit(value))
    return _replace(df, new)


def impute_medians(df: DataFrame, columns, fallback: float = 5.0) -> DataFrame:
    """Missing numbers get the median of their column."""
    names = _present(df, columns)
    medians = column_medians(df, names)
    return _fill_values(coerce_numbers(df, names), {c: float(medians.get(c, fallback)) for c in names})


def impute_modes(df: DataFrame, columns, fallback: int = 1) -> DataFrame:
    """Missing codes get the most frequent code of their column."""
    names = _present(df, columns)
    modes = column_modes(df, names)
    return _fill_values(df, {c: modes.get(c, fallback) for c in names})


def impute_generic(df: DataFrame, columns=None) -> DataFrame:
    """Numbers get their median (else 0), all other columns their mode (else ``'None'``)."""
    names = _present(df, columns if columns is not None else df.columns)
    numeric = [c for c in names if isinstance(df.schema[c].dataType, T.NumericType)]
    medians, gaps = wide_medians(df, {c: to_number(quoted(c)) for c in numeric}, {c: _missing(df, c) for c in names})
    numeric = [c for c in numeric if gaps[c]]
    other = [c for c in names if gaps[c] and c not in numeric]
    modes = column_modes(df, other)
    fills = {c: float(medians.get(c, 0.0)) for c in numeric} | {c: modes.get(c, "None") for c in other}
    return _fill_values(coerce_numbers(df, numeric), fills)


def _missing(df: DataFrame, name: str) -> Column:
    column = quoted(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.coalesce(F.isnan(column), F.lit(False)) | column.isNull()
    return column.isNull()


def impute_group_median(
    df: DataFrame, target: str, group: str, fallback: float = 60.0, broadcast_rows: int = 1_000_000
) -> DataFrame:
    """Missing numbers get the median of their group, else the median of the column, else the fallback.

    Rows without a group get the column median. The group medians are computed once and broadcast only up to
    ``broadcast_rows`` groups; beyond that they join by shuffle.
    """
    if target not in df.columns or group not in df.columns:
        return df
    clean = coerce_numbers(df, [target])
    overall = column_medians(clean, [target]).get(target, fallback)
    grouped = clean.where(quoted(group).isNotNull()).select(quoted(group).alias("median_of"), quoted(target).alias("v"))
    medians = durable(exact_median(grouped, ["median_of"], "v", "group_median", few_groups=False), "medians")
    joined = clean.join(broadcast_if_small(medians, broadcast_rows), quoted(group) == F.col("median_of"), "left")
    filled = F.coalesce(quoted(target), F.col("group_median"), F.lit(float(overall)))
    return joined.select(*[filled.alias(c) if c == target else quoted(c) for c in df.columns])

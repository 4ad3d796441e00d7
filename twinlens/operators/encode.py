"""Ordinal and one-hot encoding, column alignment and the numeric guard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.values import lookup, to_number
from ..model import quoted
from ..runtime import durable
from .clean import _present, _replace


def encode_ordinal(df: DataFrame, scales: dict[str, dict[str, int]]) -> DataFrame:
    """Quality words to numbers; unknown and missing words count as 0."""
    new = {}
    for name in _present(df, scales):
        new[name] = F.coalesce(lookup(scales[name], quoted(name).cast("string")).cast("double"), F.lit(0.0))
    return _replace(df, new)


def categories(df: DataFrame, columns=None, limit: int = 10_000) -> dict[str, list[str]]:
    """Sorted distinct values per text column.

    One column per category is only sensible while there are few of them: more than ``limit`` in a column is an
    error, raised before anything is fetched. Use :func:`encode_sparse` for such columns.
    """
    names = columns if columns is not None else [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    names = _present(df, names)
    if not names:
        return {}
    values = [F.struct(F.lit(c).alias("name"), quoted(c).cast("string").alias("v")) for c in names]
    rows = df.select(F.explode(F.array(*values)).alias("s")).select("s.*").where(F.col("v").isNotNull())
    found: dict[str, list[str]] = {c: [] for c in names}
    for r in rows.distinct().limit(limit * len(names) + 1).collect():
        found[r["name"]].append(r["v"])
    crowded = [c for c in names if len(found[c]) > limit]
    if crowded:
        raise ValueError(f"more than {limit} categories in {crowded}; encode these in long form")
    return {c: sorted(v) for c, v in found.items()}


def encode_onehot(df: DataFrame, columns=None, known: dict[str, list[str]] | None = None):
    """One 0/1 column ``<column>_<value>`` per category, no level dropped; returns the table and its lineage."""
    levels = known if known is not None else categories(df, columns)
    kept = [quoted(c) for c in df.columns if c not in levels]
    flags = [
        F.when(quoted(c).cast("string") == F.lit(v), 1.0).otherwise(0.0).alias(f"{c}_{v}")
        for c, values in levels.items()
        for v in values
    ]
    lineage = {c: [f"{c}_{v}" for v in values] for c, values in levels.items()}
    return df.select(*kept, *flags), lineage


def onehot_long(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The non-zero cells of a one-hot table as ``(key, feature)``, for columns with many categories."""
    cells = [F.struct(F.concat(F.lit(c + "_"), quoted(c).cast("string")).alias("feature")) for c in columns]
    rows = df.select(quoted(key), F.explode(F.array(*cells)).alias("s")).select(quoted(key), "s.feature")
    return rows.where(F.col("feature").isNotNull())


def category_index(cells: DataFrame, parts: int | None = None) -> DataFrame:
    """``(id_variable, feature)``: the distinct features of :func:`onehot_long`, numbered from 0 in their order.

    Features are dealt into ranges, and a range's first number is the total of those before it: no list of features is ever
    fetched, whatever their number.
    """
    spark = cells.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(cells.select("feature").distinct().repartitionByRange(parts, "feature").withColumn("part", F.spark_partition_id()), "features")
    first, starts = 0, []
    for r in sorted(ranged.groupBy("part").agg(F.count("*").alias("n")).collect(), key=lambda r: r["part"]):
        starts.append((r["part"], first))
        first += r["n"]
    offsets = F.broadcast(spark.createDataFrame(starts, "part int, start long"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("feature")) - 1
    numbered = ranged.withColumn("place", place).join(offsets, "part")
    return durable(numbered.select((F.col("start") + F.col("place")).cast("int").alias("id_variable"), "feature"), "index")


def encode_sparse(df: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """One-hot encoding of columns with any number of categories: ``(key, indices)`` and the index ``(id_variable, feature)``.

    ``indices`` are the numbers of a row's indicators that are 1, in order: at most one for each column. Rows and index meet by
    shuffle, where adaptive execution splits a frequent category. ``key`` identifies a row; one without any category has no row.
    """
    cells = onehot_long(df, key, columns)
    index = category_index(cells)
    found = cells.join(index, "feature").groupBy(quoted(key)).agg(F.sort_array(F.collect_list("id_variable")).alias("indices"))
    return found, index


def sparse_scaling(rows: DataFrame, total: int) -> DataFrame:
    """Mean and population standard deviation of every indicator ``(id_variable, mean, std)`` among ``total`` rows."""
    counts = rows.select(F.explode("indices").alias("id_variable")).groupBy("id_variable").agg(F.count("*").alias("n"))
    mean = F.col("n") / F.lit(total)
    return counts.select("id_variable", mean.alias("mean"), F.sqrt(mean * (1 - mean)).alias("std"))


def sparse_pearson(rows: DataFrame, total: int) -> DataFrame:
    """|Pearson r| ``(id_variable_1, id_variable_2, correlation_score)`` of all indicators that stand in one row somewhere.

    A row gives a pair for every two of its columns, so the work grows with rows, not with categories. Indicators that are
    constant, or never together, are left out.
    """
    both = rows.select(F.explode("indices").alias("id_variable_1"), "indices").select("id_variable_1", F.explode("indices").alias("id_variable_2"))
    both = both.where("id_variable_1 < id_variable_2").groupBy("id_variable_1", "id_variable_2").agg(F.count("*").alias("n"))
    scale = durable(sparse_scaling(rows, total).where("std > 0"), "scaling")
    side = lambda k: scale.select(F.col("id_variable").alias(f"id_variable_{k}"), F.col("mean").alias(f"mean_{k}"), F.col("std").alias(f"std_{k}"))
    met = both.join(side(1), "id_variable_1").join(side(2), "id_variable_2")
    score = F.abs((F.col("n") / F.lit(total) - F.col("mean_1") * F.col("mean_2")) / (F.col("std_1") * F.col("std_2")))
    return met.select("id_variable_1", "id_variable_2", F.least(score, F.lit(1.0)).alias("correlation_score"))


def drop_columns(df: DataFrame, columns) -> DataFrame:
    """Drops the listed columns that exist."""
    return df.drop(*_present(df, columns))


def align_union(x: DataFrame, y: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with all columns of either, in name order; a column absent on one side is 0."""
    names = sorted(set(x.columns) | set(y.columns))
    widen = lambda df: df.select(*[quoted(c) if c in df.columns else F.lit(0.0).alias(c) for c in names])
    return widen(x), widen(y)


def align_intersection(x: DataFrame, y: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with their common columns, in name order."""
    names = sorted(set(x.columns) & set(y.columns))
    return x.select(*map(quoted, names)), y.select(*map(quoted, names))


def numeric_guard(df: DataFrame, columns=None) -> DataFrame:
    """Every listed column as a number, missing values as 0."""
    names = _present(df, columns if columns is not None else df.columns)
    return _replace(df, {c: F.coalesce(to_number(quoted(c)), F.lit(0.0)) for c in names})

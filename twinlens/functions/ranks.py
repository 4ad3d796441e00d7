"""Exact order statistics over groups of any size.

A sorted group never sits in one task. Where a whole order is needed, values are counted per distinct value and cut
into ranges at approximate quantiles, so that each range holds about the same number of rows however the values are
spread; only inside a range are rows put in order. Where only the middle is needed, a sketch brackets it first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import broadcast_if_small, durable

CUT_VALUES_LIMIT = 1_000_000
SKETCH_ACCURACY = 2_000
BRACKET = 0.003
SLICES = 1024
HELD_VALUES = 1_000_000  # distinct values that a task counts before it passes them on


def cut_points(rows: DataFrame, value: str, by: str | None = None, ranges: int | None = None, groups: int = 1):
    """Approximate quantiles of ``value`` (per ``by``), fetched once so that every later use sees the same cuts.

    The result has ``groups * ranges`` numbers and is kept below one million of them.
    """
    spark = rows.sparkSession
    wanted = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(2, min(wanted, 4096, CUT_VALUES_LIMIT // max(groups, 1)))
    probabilities = [i / wanted for i in range(1, wanted)]
    cuts = F.percentile_approx(value, probabilities, 10 * wanted + 1000).alias("cuts")
    if by is None:
        return rows.agg(cuts).first()["cuts"] or []
    return {r[by]: r["cuts"] for r in rows.groupBy(by).agg(cuts).collect()}


def _range_of(cuts: Column, count: int, value: str) -> Column:
    """Number of cuts at or below the value, found by halving steps."""
    steps = [1 << p for p in reversed(range(max(count, 1).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(F.get(cuts, at + step - 1) <= F.col(value), at + step).otherwise(at),
    )


def with_range(rows: DataFrame, value: str, cuts, by: str | None = None, name: str = "range_id") -> DataFrame:
    """Adds the number of the value range a row falls into, and with ``by`` also the middle cut as ``centre``."""
    if by is None:
        literal = F.array(*[F.lit(c) for c in cuts]).cast("array<double>")
        return rows.withColumn(name, _range_of(literal, len(cuts), value))
    longest = max((len(c) for c in cuts.values()), default=0)
    key_type = rows.schema[by].dataType
    local = pa.table({by: list(cuts), "cuts": pa.array(list(cuts.values()), pa.list_(pa.float64()))})
    table = rows.sparkSession.createDataFrame(local).withColumn(by, F.col(by).cast(key_type))
    joined = rows.join(F.broadcast(table), by)
    middle = F.get("cuts", F.floor(F.size("cuts") / 2).cast("int")).alias("centre")
    return joined.select(*rows.columns, _range_of(F.col("cuts"), longest, value).alias(name), middle)


def exact_median(
    rows: DataFrame, group: list[str], value: str, name: str = "median", few_groups: bool = True, upper: bool = False
) -> DataFrame:
    """Exact median per group: ``(*group, name)``, the mean of the two middle values or the ``upper`` one of them.

    A quantile sketch with a guaranteed rank error brackets the middle of every group. A second scan counts the rows
    below the bracket and the values inside it, 0.6 % of a large group, so neither whole groups nor whole columns are
    shuffled. The bracket is cut into 1024 slices; their totals tell the slice that holds the middle, and only its
    values are put in order. A bracket that missed the middle would fail the query.

    ``few_groups`` states that the number of groups is bounded by the schema, not by the data; the brackets are then
    broadcast. Otherwise they are stored first and broadcast only while there are few.
    """
    rows = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*group, F.col(value).alias("v"))
    sketch = F.percentile_approx("v", [0.5 - BRACKET, 0.5 + BRACKET], SKETCH_ACCURACY).alias("near")
    found = rows.groupBy(*group).agg(F.count("*").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"), sketch)
    # in a small group the bracket is the whole group, so that it spans whole ranks
    edge = lambda at, end: F.when(F.col("total") < 1_000, F.col(end)).otherwise(F.col("near")[at])
    brackets = found.select(
        *[F.col(g).alias(f"of_{g}") for g in group], "total", edge(0, "lo").alias("low"), edge(1, "hi").alias("high")
    )
    if group:
        brackets = F.broadcast(brackets) if few_groups else broadcast_if_small(durable(brackets, "brackets"), 1_000_000)
        same = F.lit(True)
        for g in group:
            same = same & (F.col(g) == F.col(f"of_{g}"))
        near = rows.join(brackets, same).where(F.col("v") <= F.col("high"))
    else:
        only = brackets.first()
        near = rows.where(F.col("v") <= F.lit(only["high"])).withColumns({c: F.lit(only[c]) for c in ("total", "low", "high")})
    part = F.least(F.floor(F.try_divide(F.col("v") - F.col("low"), F.col("high") - F.col("low")) * SLICES), F.lit(SLICES - 1))
    inside = F.col("v") >= F.col("low")
    counts = near.groupBy(
        *group, "total", F.when(inside, F.coalesce(part, F.lit(0))).otherwise(-1).alias("slice"), F.when(inside, F.col("v")).alias("v")
    ).agg(F.count("*").alias("n"))

    return _middle_of(counts, group, name, few_groups, upper)


def _middle_of(counts: DataFrame, group: list[str], name: str, few_groups: bool, upper: bool = False) -> DataFrame:
    """``(*group, name)`` from counted values ``(*group, total, slice, v, n)``; slice -1 has what lies below the bracket."""
    middle = (F.col("total") - 1) / 2
    holds = lambda place: (place >= F.col("upto") - F.col("n")) & (place < F.col("upto"))
    running = lambda by, order: F.sum("n").over(Window.partitionBy(*by).orderBy(order))
    slices = counts.groupBy(*group, "total", "slice").agg(F.sum("n").alias("n")).withColumn("upto", running(group, "slice"))
    slices = slices.where(holds(F.floor(middle)) | holds(F.ceil(middle)))
    slices = slices.select(*group, "slice", (F.col("upto") - F.col("n")).alias("before"))
    # at most two slices per group
    joined = counts.join(F.broadcast(slices) if few_groups else slices, [*group, "slice"])
    ranked = joined.withColumn("upto", F.col("before") + running([*group, "slice"], "v"))
    hit = lambda place: F.max(F.when(holds(place), F.col("v")))
    picked = ranked.groupBy(*group).agg(hit(F.floor(middle)).alias("below"), hit(F.ceil(middle)).alias("above"))
    missed = F.raise_error(F.lit("the bracket of a median missed its middle")).cast("double")
    value_at = F.col("above") if upper else (F.col("below") + F.col("above")) / 2
    return picked.select(*group, F.coalesce(value_at, missed).alias(name))


def wide_medians(df: DataFrame, columns: dict[str, Column], flags: dict[str, Column] | None = None) -> tuple[dict[str, float], dict[str, bool]]:
    """Exact median of many numeric columns in two scans, and whether each of ``flags`` holds anywhere, from the first of them.

    Rows are never multiplied by columns: the first scan is one aggregate that holds a sketch per column, the second counts
    with one pass over column batches what lies below each bracket and which values stand inside. Columns without a value are
    left out.
    """
    flags = flags or {}
    values = {c: F.nanvl(column.cast("double"), F.lit(None).cast("double")) for c, column in columns.items()}
    near = lambda v: F.percentile_approx(v, [0.5 - BRACKET, 0.5 + BRACKET], SKETCH_ACCURACY)
    first = [a.alias(f"{kind}{i}") for i, v in enumerate(values.values()) for kind, a in (("n", F.count(v)), ("lo", F.min(v)), ("hi", F.max(v)), ("near", near(v)))]
    first += [F.max(F.coalesce(flag, F.lit(False))).alias(f"flag{i}") for i, flag in enumerate(flags.values())]
    if not first:
        return {}, {}
    found = df.agg(*first).first()
    held = {c: bool(found[f"flag{i}"]) for i, c in enumerate(flags)}
    brackets = {}
    for i, c in enumerate(values):
        total = found[f"n{i}"]
        if total:
            low, high = (found[f"lo{i}"], found[f"hi{i}"]) if total < 1_000 else found[f"near{i}"]
            brackets[c] = (total, low, high)
    medians = {c: low for c, (_, low, high) in brackets.items() if low == high}
    names = [c for c in brackets if c not in medians]
    if not names:
        return medians, held
    ends = [brackets[c] for c in names]

    def counted(batches):
        below = np.zeros(len(names), np.int64)
        inside: list[dict[float, int]] = [{} for _ in names]

        def flush():
            rows = [(i, ends[i][0], -1, None, int(n)) for i, n in enumerate(below) if n]
            for i, values_of in enumerate(inside):
                total, low, high = ends[i]
                rows += [(i, total, min(int((v - low) / (high - low) * SLICES), SLICES - 1), v, n) for v, n in values_of.items()]
                values_of.clear()
            below[:] = 0
            columns = list(zip(*rows)) or [()] * 5
            types = (pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["i", "total", "slice", "v", "n"])

        for batch in batches:
            for i, (_, low, high) in enumerate(ends):
                v = batch.column(i).to_numpy(zero_copy_only=False)
                below[i] += np.count_nonzero(v < low)
                for value, n in zip(*np.unique(v[(v >= low) & (v <= high)], return_counts=True)):
                    inside[i][float(value)] = inside[i].get(float(value), 0) + int(n)
            if sum(map(len, inside)) > HELD_VALUES:
                yield flush()
        yield flush()

    rows = df.select(*[values[c].alias(f"c{i}") for i, c in enumerate(names)])
    counts = rows.mapInArrow(counted, "i int, total long, slice int, v double, n long").groupBy("i", "total", "slice", "v").agg(F.sum("n").alias("n"))
    medians |= {names[r["i"]]: r["median"] for r in _middle_of(counts, ["i"], "median", True).collect()}
    return medians, held


def middle_value(rows: DataFrame, value: str):
    """The upper middle value of a column of any ordered type, None without a value.

    Distinct values are counted, dealt into ranges and stored; the totals of the ranges tell the one that holds the middle, and
    only that one is put in order.
    """
    spark = rows.sparkSession
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    parts = max(2, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4096))
    ranged = durable(counts.repartitionByRange(parts, "v").withColumn("part", F.spark_partition_id()), "ranges")
    # parts of a range partitioning are in order
    totals = sorted((r["part"], r["n"]) for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect())
    middle, before = sum(n for _, n in totals) // 2, 0
    for part, n in totals:
        if middle < before + n:
            upto = F.sum("n").over(Window.partitionBy("part").orderBy("v"))
            inside = ranged.where(F.col("part") == part).withColumn("upto", upto + F.lit(before))
            return inside.where(F.col("upto") > middle).agg(F.min("v")).first()[0]
        before += n
    return None

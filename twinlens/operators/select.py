"""Ranking variables by how strongly their distributions differ, and cutting the ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..model import TwoSample, is_x, is_y
from ..runtime import durable
from .stats import _whole

HISTOGRAM_BINS = 20
HELD_CELLS = 2_000_000  # that a task counts together
STRETCH = 65_536  # counts of one stretch, about


def value_counts(sample: TwoSample) -> DataFrame:
    """``(id_variable, v, nx, ny)``: how many X and Y rows have each value, as far as a task has counted them.

    A task counts column by column, so rows are never multiplied by columns; a value may come from several tasks.
    """
    d = len(sample.features)
    rows = sample.frame.where(is_x() | is_y()).select(is_x().alias("x"), sample.vector().alias("values"))
    schema = pa.schema([("id_variable", pa.int32()), ("v", pa.float64()), ("nx", pa.int64()), ("ny", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append((batch.column(0).to_numpy(zero_copy_only=False).astype(bool), batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)))
            if sum(len(x) for x, _ in held) * d >= HELD_CELLS:
                yield from counted(held)
                held = []
        if held:
            yield from counted(held)

    def counted(held) -> Iterator[pa.RecordBatch]:
        is_of_x, matrix = np.concatenate([x for x, _ in held]), np.concatenate([m for _, m in held])
        for i in range(d):
            there = ~np.isnan(matrix[:, i])
            values, place = np.unique(matrix[there, i] + 0.0, return_inverse=True)
            nx = np.bincount(place, weights=is_of_x[there], minlength=len(values)).astype("int64")
            n = np.bincount(place, minlength=len(values))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), i, "int32")), pa.array(values), pa.array(nx), pa.array(n - nx)], schema=schema)

    return rows.mapInArrow(count, "id_variable int, v double, nx long, ny long")


def _ordered_stretches(counts: DataFrame, ranges: int) -> DataFrame:
    """Counts in the order of variable and value, packed into stretches of one variable: totals, first value and mean of each,
    and the counts themselves as bytes."""
    numbers = ("sx", "sy", "n", "first", "mean", "m2")
    schema = pa.schema([("id_variable", pa.int32()), ("stretch", pa.int64()), *[(c, pa.float64()) for c in numbers], *[(c, pa.binary()) for c in ("v", "nx", "ny")]])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((4, 0))

        def given(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in np.unique(rows[0]):
                _, v, nx, ny = rows[:, rows[0] == i]
                starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
                v, nx, ny = v[starts], np.add.reduceat(nx, starts), np.add.reduceat(ny, starts)
                n = nx + ny
                mean = float(n @ v / n.sum())
                yield pa.RecordBatch.from_pylist([{
                    "id_variable": int(i), "stretch": 0, "sx": nx.sum(), "sy": ny.sum(), "n": n.sum(), "first": v[0], "mean": mean, "m2": float(n @ (v - mean) ** 2),
                    "v": v.tobytes(), "nx": nx.tobytes(), "ny": ny.tobytes(),
                }], schema)

        for batch in batches:
            held = np.hstack([held, np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])])
            if held.shape[1] > STRETCH:
                # all but the last value, whose counts may go on in the next batch
                cut = int(np.flatnonzero((held[0] != held[0, -1]) | (held[1] != held[1, -1])).max(initial=-1)) + 1
                yield from given(held[:, :cut])
                held = held[:, cut:]
        if held.shape[1]:
            yield from given(held)

    dealt = counts.repartitionByRange(ranges, "id_variable", "v").sortWithinPartitions("id_variable", "v")
    ddl = "id_variable int, stretch long, " + ", ".join(f"{c} double" for c in numbers) + ", v binary, nx binary, ny binary"
    return durable(dealt.mapInArrow(pack, ddl).withColumn("stretch", F.monotonically_increasing_id()), "stretches")


def wasserstein_weights(sample: TwoSample, scale: bool = True, ranges: int | None = None) -> DataFrame:
    """1-D Wasserstein distance of X and Y per variable ``(id_variable, name_variable, weight)``.

    The distance is the area between the two distribution functions. Values are counted per distinct value, dealt once into
    ranges of variable and value, and packed there into stretches in order. The totals of the stretches give the height at
    which both functions enter each; inside, running sums are one pass over arrays. ``scale`` gives the distance of the
    pooled z-scores, which is the raw distance over the pooled standard deviation.
    """
    spark = sample.frame.sparkSession
    counts = durable(value_counts(sample), "counts")
    stretches = _ordered_stretches(counts, ranges or int(spark.conf.get("spark.sql.shuffle.partitions")))
    in_order, whole = Window.partitionBy("id_variable").orderBy("first"), Window.partitionBy("id_variable")
    mean = F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole)
    spans = stretches.select("id_variable", "stretch", "sx", "sy", "n", "first", "mean", "m2").withColumn("off", F.col("mean") - mean)
    spans = spans.select(
        "stretch",
        (F.sum("sx").over(in_order) - F.col("sx")).alias("before_x"),
        (F.sum("sy").over(in_order) - F.col("sy")).alias("before_y"),
        F.sum("sx").over(whole).alias("total_x"),
        F.sum("sy").over(whole).alias("total_y"),
        F.lead("first").over(in_order).alias("next_first"),
        F.sqrt(F.sum(F.col("m2") + F.col("n") * F.col("off") * F.col("off")).over(whole) / F.sum("n").over(whole)).alias("std"),
    )

    def area(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # one stretch at a time, as a batch may hold many
            areas = []
            for r in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                v, nx, ny = (np.frombuffer(r[c], "float64") for c in ("v", "nx", "ny"))
                side = lambda n, before, total: (before + np.cumsum(n)) / total if total else np.zeros(len(n))
                gap = np.abs(side(nx, r["before_x"], r["total_x"]) - side(ny, r["before_y"], r["total_y"]))
                step = np.diff(v, append=v[-1] if r["next_first"] is None else r["next_first"])
                areas.append(float(gap @ step) / (r["std"] if scale and r["std"] >= 1e-8 else 1.0) if r["total_x"] and r["total_y"] else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("id_variable"), pa.array(areas, pa.float64())], ["id_variable", "area"])

    joined = stretches.select("id_variable", "stretch", "v", "nx", "ny").join(spans, "stretch")
    added = joined.mapInArrow(area, "id_variable int, area double").groupBy("id_variable").agg(F.sum("area").alias("area"))
    # a variable without any value has no row yet
    names = spark.range(len(sample.features)).select(F.col("id").cast("int").alias("id_variable"))
    rows = names.join(F.broadcast(added), "id_variable", "left")
    return rows.select("id_variable", sample.name_of("id_variable").alias("name_variable"), F.coalesce("area", F.lit(0.0)).alias("weight"))


def max_normalised(weights: DataFrame) -> DataFrame:
    """Weights relative to the largest, if that is positive."""
    top = F.max("weight").over(_whole())
    return weights.withColumn("weight", F.when(top > 0, F.col("weight") / top).otherwise(F.col("weight")))


def _valley(bins: Column) -> Column:
    """Number of the valley among histogram counts, NULL without one.

    The valley is the first empty bin above the first occupied one; without an empty bin, the emptiest bin strictly
    between the two fullest bins. This rule is ours.
    """
    numbered = F.transform(bins, lambda n, i: F.named_struct(F.lit("n"), n, F.lit("i"), i))
    place = lambda entry: entry["i"]
    first = F.array_min(F.transform(F.filter(numbered, lambda b: b["n"] > 0), place))
    empty = F.array_min(F.transform(F.filter(numbered, lambda b: (b["n"] == 0) & (b["i"] > first)), place))
    fullest = F.slice(F.array_sort(F.transform(numbered, lambda b: F.named_struct(F.lit("n"), -b["n"], F.lit("i"), b["i"]))), 1, 2)
    peaks = F.transform(fullest, place)
    between = F.filter(numbered, lambda b: (b["i"] > F.array_min(peaks)) & (b["i"] < F.array_max(peaks)))
    return F.coalesce(empty, F.get(F.array_sort(between), 0)["i"])


def select_variables(
    weights: DataFrame,
    approach: str = "hist_based",
    threshold: float = 0.1,
    top_k: int = 5,
    trim: bool = False,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Anchor variables ``(id_variable, name_variable, weight)`` from a table with one row per variable.

    ``threshold`` keeps weights at or above the cut. ``hist_based`` cuts at the upper edge of the valley in a histogram
    of 20 equal bins over [0, largest weight]. With nothing selected the ``top_k`` largest weights are taken. ``trim``
    also replaces an all-or-nothing selection by the ``top_k`` and cuts a longer one down to it. ``by`` names columns
    with one selection each.
    """
    if approach not in ("hist_based", "threshold"):
        raise ValueError(f"unknown detection approach {approach!r}")
    n = HISTOGRAM_BINS
    every = Window.partitionBy(*by)
    rows = weights.withColumn("top", F.max("weight").over(every))
    # a weight that sits on an edge up to rounding belongs to the upper bin
    rows = rows.withColumn("bin", F.least(F.floor(F.try_divide("weight", "top") * n + 1e-9), F.lit(n - 1)))
    bins = F.array(*[F.count_if(F.col("bin") == i) for i in range(n)])
    table = rows.groupBy(*by).agg(F.max("top").alias("top"), bins.alias("bins"), F.collect_list(F.struct("id_variable", "name_variable", "weight")).alias("all"))
    edge = F.when(F.col("top") > 0, (_valley(F.col("bins")) + 1) / n * F.col("top"))
    cut = F.lit(float(threshold)) if approach == "threshold" else edge
    rows = table.select(*by, cut.alias("cut"), F.inline("all"))
    # a cut that equals a weight up to rounding keeps it
    rows = rows.withColumn("hit", F.coalesce(F.col("weight") >= F.col("cut") - 1e-12, F.lit(False)))
    best = every.orderBy(F.col("weight").desc(), "id_variable")
    rows = rows.select(
        "*",
        F.row_number().over(best).alias("place"),
        F.count_if("hit").over(every).alias("hits"),
        F.count("*").over(every).alias("d"),
    )
    among_best = F.col("place") <= top_k
    # the hits are the largest weights, so the best hits are the best rows
    kept = F.col("hit") & among_best if trim else F.col("hit")
    fallback = (F.col("hits") == 0) | ((F.col("hits") == F.col("d")) if trim else F.lit(False))
    return rows.where(F.when(fallback, among_best).otherwise(kept)).select(*by, "id_variable", "name_variable", "weight")


def wasserstein_select(
    sample: TwoSample,
    normalise: bool = True,
    approach: str = "hist_based",
    threshold: float = 0.1,
    top_k: int = 5,
) -> DataFrame:
    """Anchor variables by Wasserstein distance."""
    weights = wasserstein_weights(sample)
    return select_variables(max_normalised(weights) if normalise else weights, approach, threshold, top_k)

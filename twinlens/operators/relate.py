"""Pairwise relationship of variables on the pooled samples."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import hash_number
from ..functions.values import to_number
from ..model import TwoSample, quoted
from ..runtime import durable
from . import sparse
from .sparse import sparse_precision as _sparse_precision  # noqa: F401  its conditions are tested under this name
from .stats import scaled

WIDE_PAIR_COLUMNS = 16
MATRIX_BYTES_LIMIT = 256 << 20
CONSTANT = 1e-12  # variance, in units of the variable's own, below which it counts as constant

log = logging.getLogger(__name__)


def gram_sums(sample: TwoSample, by: str | None = None) -> DataFrame:
    """Sums of products ``(by, i, j, part, n)`` for i <= j; position d stands for the constant 1.

    Every partition is reduced to one d x d matrix with numpy before anything is shuffled. Missing values count
    as 0, the pooled mean of scaled data.
    """
    d = len(sample.features)
    group = F.col(by).cast("string") if by else F.lit("all")
    rows = sample.frame.select(group.alias("group"), sample.numbers().alias("values"))
    i, j = np.triu_indices(d + 1)
    schema = pa.schema([("group", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("part", pa.float64()), ("n", pa.int64())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        counts: dict[str, int] = {}
        for batch in batches:
            matrix = batch.column("values").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            matrix = np.hstack([matrix, np.ones((len(matrix), 1))])
            groups = batch.column("group").to_numpy(zero_copy_only=False)
            for name in pd.unique(groups):
                block = matrix[groups == name]
                sums[name] = sums.get(name, 0.0) + block.T @ block
                counts[name] = counts.get(name, 0) + len(block)
        for name, total in sums.items():
            size = len(i)
            columns = [[name] * size, i.astype("int32"), j.astype("int32"), total[i, j], np.full(size, counts[name])]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    parts = rows.mapInArrow(partial, "group string, i int, j int, part double, n bigint")
    return parts.groupBy("group", "i", "j").agg(F.sum("part").alias("part"), F.sum("n").alias("n"))


def pair_sums(sample: TwoSample, by: str | None = None) -> DataFrame:
    """``(group, i, j, n, x, y, xx, yy, xy)`` for i <= j over the rows that have both values.

    Like :func:`gram_sums`, each partition is reduced to d x d matrices before the shuffle; a missing value leaves a row out
    of its own pairs only.
    """
    d = len(sample.features)
    group = F.col(by).cast("string") if by else F.lit("all")
    rows = sample.frame.select(group.alias("group"), sample.vector().alias("values"))
    i, j = np.triu_indices(d)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            values = batch.column("values").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
            groups = batch.column("group").to_numpy(zero_copy_only=False)
            for name in pd.unique(groups):
                block = values[groups == name]
                there = ~np.isnan(block)
                block, mask = np.where(there, block, 0.0), there.astype(float)
                one, two = block.T @ mask, (block * block).T @ mask
                sums[name] = sums.get(name, 0.0) + np.stack([mask.T @ mask, one, one.T, two, two.T, block.T @ block])
        for name, total in sums.items():
            cells = pa.table({"group": [name] * len(i), "i": i, "j": j} | dict(zip(("n", "x", "y", "xx", "yy", "xy"), total[:, i, j])))
            yield from cells.to_batches()

    parts = rows.mapInArrow(partial, "group string, i long, j long, n double, x double, y double, xx double, yy double, xy double")
    totals = [F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")]
    return parts.groupBy("group", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j")).agg(*totals)


def absolute_pearson(sample: TwoSample) -> DataFrame:
    """|Pearson r| of all pairs ``(id_variable_1, id_variable_2, correlation_score)``, i < j.

    A pair is judged on the rows that have both values, whatever the number of variables. A variable that is constant
    there is related to nothing (0). Few variables are aggregated pair by pair inside one built-in aggregation, many
    through matrix sums per partition.
    """
    names = sample.features
    if len(names) > WIDE_PAIR_COLUMNS:
        sums = pair_sums(scaled(sample)).where("i < j")
        spread = lambda x, xx: F.col(xx) / F.col("n") - (F.col(x) / F.col("n")) ** 2
        both = F.col("xy") / F.col("n") - F.col("x") * F.col("y") / F.col("n") ** 2
        score = F.least(F.abs(both / F.sqrt(spread("x", "xx") * spread("y", "yy"))), F.lit(1.0))
        varied = (F.col("n") > 1) & (spread("x", "xx") > CONSTANT) & (spread("y", "yy") > CONSTANT)
        score = F.when(varied, score)
        return sums.select(F.col("i").alias("id_variable_1"), F.col("j").alias("id_variable_2"), F.coalesce(score, F.lit(0.0)).alias("correlation_score"))
    if len(names) < 2:
        return sample.frame.sparkSession.createDataFrame([], "id_variable_1 int, id_variable_2 int, correlation_score double")
    value = lambda k: to_number(quoted(names[k]))
    pairs = [(a, b) for a in range(len(names)) for b in range(a + 1, len(names))]
    beside = lambda a, b: F.stddev_pop(F.when(value(b).isNotNull(), value(a)))  # over the rows that have both
    aggregates = [
        c.alias(f"{name}{a}_{b}")
        for a, b in pairs
        for name, c in (("c", F.covar_pop(value(a), value(b))), ("s", beside(a, b)), ("t", beside(b, a)))
    ]
    ratio = lambda a, b: F.try_divide(F.col(f"c{a}_{b}"), F.col(f"s{a}_{b}") * F.col(f"t{a}_{b}"))
    score = lambda a, b: F.least(F.coalesce(F.abs(ratio(a, b)), F.lit(0.0)), F.lit(1.0))
    rows = [
        F.struct(F.lit(a).alias("id_variable_1"), F.lit(b).alias("id_variable_2"), score(a, b).alias("correlation_score"))
        for a, b in pairs
    ]
    return sample.frame.agg(*aggregates).select(F.inline(F.array(*rows)))


def edges(relation: DataFrame, cut: float = 0.2) -> DataFrame:
    """Pairs with a score at or above the cut."""
    return relation.where(F.col("correlation_score") >= cut)


def both_directions(relation: DataFrame) -> DataFrame:
    """Every pair seen from either end ``(id_variable, id_other, score)``."""
    end = lambda a, b: F.struct(F.col(a).alias("id_variable"), F.col(b).alias("id_other"))
    ends = F.array(end("id_variable_1", "id_variable_2"), end("id_variable_2", "id_variable_1"))
    return relation.select(F.inline(ends), F.col("correlation_score").alias("score"))


def fold_covariances(sample: TwoSample, folds: int = 5, seed: int = 42, width: int = sparse.TILE) -> sparse.Covariances:
    """Covariances of the scaled sample, whole and by fold; rows are dealt to folds by a hash of their key."""
    fold = hash_number(quoted(sample.key), seed, folds) if folds > 1 else F.lit(0)
    return sparse.covariances(scaled(sample), fold, folds, width)


def partial_correlation(
    sample: TwoSample, folds: int = 5, alphas: int = 4, refinements: int = 4, seed: int = 42, penalty: float | None = None
) -> DataFrame:
    """|Partial correlation| from a cross-validated sparse inverse covariance, in the form of :func:`absolute_pearson`.

    Rows are only touched to sum products per fold. Every (fold, penalty) falls into the components of its own cut covariance
    (``operators/sparse.py``), each fitted by a task of its own, and the grid is narrowed around the best penalty
    ``refinements`` times; a given ``penalty`` is taken as it is. The number of variables has no limit, but a component is
    fitted as one matrix. Only a fit that fails in its numbers falls back to the absolute Pearson correlation.
    """
    if len(sample.features) < 2:
        return absolute_pearson(sample)
    try:
        found = fold_covariances(sample, folds if penalty is None else 1, seed)
        best = _best_penalty(found, alphas, refinements) if penalty is None else penalty
        cells = durable(sparse.precision_cells(found, best), "precision").drop("precision")
        if cells.where(F.isnan("correlation_score")).isEmpty():
            return cells
        problem = "no fit of the whole sample"
    except (np.linalg.LinAlgError, FloatingPointError, ValueError) as failed:
        problem = failed
    log.warning("sparse inverse covariance failed (%s); using absolute correlation", problem)
    return absolute_pearson(sample)


def _best_penalty(found: sparse.Covariances, alphas: int, refinements: int) -> float:
    """The penalty of the highest mean likelihood over the folds."""
    top = sparse.largest_covariance(found)
    if not np.isfinite(top) or top == 0.0:
        raise ValueError("no pair of variables is related")
    splits = [k for k in found.train if k != sparse.WHOLE]
    if not splits:
        raise ValueError("folds need rows inside and outside of them")
    grid, scores = list(np.geomspace(0.01 * top, top, alphas)), {}
    for _ in range(refinements):
        cells = [sparse.Cell(s, float(a)) for a in grid if a not in scores for s in splits]
        reached = sparse.held_out_scores(found, cells)
        for alpha in {cell.alpha for cell in cells}:
            scores[alpha] = float(np.mean([r for cell, r in zip(cells, reached) if cell.alpha == alpha]))
        tried = sorted(scores)
        at = max(range(len(tried)), key=lambda k: (scores[tried[k]], tried[k]))
        low = tried[at - 1] if at > 0 else tried[at] * 0.1
        high = tried[at + 1] if at + 1 < len(tried) else tried[at]
        grid = [float(a) for a in np.geomspace(low, high, alphas + 2)[1:-1]]
    return tried[at]


def relationship(sample: TwoSample, method: str = "graphical_lasso") -> DataFrame:
    """Relationship of all pairs by the named method."""
    if method == "graphical_lasso":
        return partial_correlation(sample)
    return absolute_pearson(sample)

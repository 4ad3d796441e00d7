"""Themes around the anchor variables and the augmented variable set."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..model import TwoSample
from ..runtime import broadcast_if_small, discard, durable
from .relate import both_directions

MOST_MERGES = 1_000_000  # of one round, to be broadcast


def anchor_themes(
    relation: DataFrame, anchors: Sequence[int], collinear: float = 0.5, mode: str = "greedy"
) -> dict[int, int]:
    """Theme number (1..K) per anchor.

    ``greedy`` walks the anchors in their order; one joins the first theme that has a member related to it by
    ``collinear`` or more, else it opens a theme. ``components`` merges all themes it is related to. Only the strong
    pairs among the anchors are fetched.
    """
    if mode not in ("greedy", "components"):
        raise ValueError(f"unknown theme mode {mode!r}")
    wanted = list(dict.fromkeys(int(a) for a in anchors))
    if not wanted:
        return {}
    strong = relation.where(
        F.col("id_variable_1").isin(wanted) & F.col("id_variable_2").isin(wanted) & (F.col("correlation_score") >= collinear)
    )
    related: dict[int, set[int]] = {a: set() for a in wanted}
    for r in strong.collect():
        related[r["id_variable_1"]].add(r["id_variable_2"])
        related[r["id_variable_2"]].add(r["id_variable_1"])
    themes: list[set[int]] = []
    for a in wanted:
        touching = [t for t in themes if t & related[a]]
        if not touching:
            themes.append({a})
            continue
        touching[0].add(a)
        if mode == "components":
            for other in touching[1:]:
                touching[0].update(other)
                themes.remove(other)
    return {a: number for number, theme in enumerate(themes, 1) for a in theme}


def assign_variables(
    names: Sequence[str], relation: DataFrame, themes: dict[int, int], augment: float = 0.15
) -> DataFrame:
    """Cluster per variable ``(id_variable, name_variable, id_cluster, score_related)``.

    Anchors keep their theme with score 1. Another variable joins the theme holding the anchor it is most related
    to, the lowest number on ties, if that reaches ``augment``; else it is in cluster 0 without a score.
    """
    spark = relation.sparkSession
    variables = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id_variable int, name_variable string")
    known = spark.createDataFrame(list(themes.items()), "id_other int, theme int")
    affinity = both_directions(relation).join(F.broadcast(known), "id_other").where(~F.col("id_variable").isin(list(themes)))
    per_theme = affinity.groupBy("id_variable", "theme").agg(F.max("score").alias("rho"))
    best = per_theme.groupBy("id_variable").agg(F.min(F.struct((-F.col("rho")).alias("rank"), "theme", "rho")).alias("b"))
    best = best.where((F.col("b.rho") > 0) & (F.col("b.rho") >= augment))
    best = best.select("id_variable", F.col("b.theme").alias("id_cluster"), F.col("b.rho").alias("score_related"))
    seeds = known.select(F.col("id_other").alias("id_variable"), F.col("theme").alias("id_cluster"), F.lit(1.0).alias("score_related"))
    placed = best.unionByName(seeds)
    joined = variables.join(F.broadcast(placed), "id_variable", "left")
    return joined.select("id_variable", "name_variable", F.coalesce("id_cluster", F.lit(0)).alias("id_cluster"), "score_related")


def augmented_set(clusters: DataFrame) -> DataFrame:
    """All variables of a theme."""
    return clusters.where(F.col("id_cluster") > 0).select("id_variable", "name_variable")


def top_neighbours(relation: DataFrame, anchors: Sequence[int], k: int = 5) -> DataFrame:
    """The ``k`` variables most related to each anchor, other anchors included."""
    ends = both_directions(relation).where(F.col("id_variable").isin([int(a) for a in anchors]))
    order = Window.partitionBy("id_variable").orderBy(F.col("score").desc(), "id_other")
    ranked = ends.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return ranked.select(F.col("id_variable").alias("id_anchor"), F.col("id_other").alias("id_variable"), "score", "place")


def linkage_merges(size: int, relation: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """All ``size`` - 1 merges of complete linkage ``(*group, a, b, height)``: b joins a, each named by its smallest variable.

    Distances of clusters are rows. In every round all pairs of clusters that are nearest to each other merge at once; as the
    distance of a merged cluster is never less than that of its parts, these are merges of the one-by-one procedure too (Murtagh,
    1983). Of equal distances the smallest variables come first, as there. A pair without a score is at distance 1.
    """
    keys = list(group)
    score = F.greatest(F.lit(0.0), F.least(F.abs("correlation_score"), F.lit(1.0)))
    given = relation.select(*keys, F.least("id_variable_1", "id_variable_2").alias("a"), F.greatest("id_variable_1", "id_variable_2").alias("b"), (1.0 - score).alias("d"))
    spark = relation.sparkSession
    places = spark.range(size - 1).select(F.col("id").cast("int").alias("a"))
    if keys:
        places = relation.select(*keys).distinct().withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(size - 2))))
    every = places.withColumn("b", F.explode(F.sequence(F.col("a") + 1, F.lit(size - 1))))
    pairs = durable(every.join(given, [*keys, "a", "b"], "left").withColumn("d", F.coalesce("d", F.lit(1.0))), "distances")
    merges = None
    while not pairs.isEmpty():
        end = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
        ends = pairs.select(*keys, "d", F.inline(F.array(end("a", "b"), end("b", "a"))))
        nearest = ends.groupBy(*keys, "x").agg(F.min(F.struct("d", "y")).alias("n")).select(*keys, "x", F.col("n.y").alias("y"), F.col("n.d").alias("d"))
        back = nearest.select(*keys, F.col("x").alias("y"), F.col("y").alias("x"))
        merged = durable(nearest.where("x < y").join(back, [*keys, "x", "y"]).select(*keys, F.col("x").alias("a"), F.col("y").alias("b"), F.col("d").alias("height")), "merged")
        merges = merged if merges is None else merges.unionByName(merged)
        renamed = pairs
        for side in ("a", "b"):
            moved = broadcast_if_small(merged.select(*keys, F.col("b").alias(side), F.col("a").alias("into")), MOST_MERGES)
            renamed = renamed.join(moved, [*keys, side], "left").withColumn(side, F.coalesce("into", side)).drop("into")
        low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        renamed = renamed.where("a <> b").select(*keys, low, high, "d").groupBy(*keys, "a", "b").agg(F.max("d").alias("d"))
        last, pairs = pairs, durable(renamed, "distances")
        discard(last)
    return merges


def linkage_clusters(
    names: Sequence[str], relation: DataFrame, k: int | None = None, default_k: int = 5, segment: str | None = None
) -> DataFrame:
    """Fallback without anchors: ``k`` clusters by complete linkage, numbered by their smallest variable, no scores.

    A table of relations with a ``segment`` column gets one clustering per segment. The k clusters are what the lowest
    d - k merges leave.
    """
    d = len(names)
    wanted = max(1, min(k if k is not None else default_k, d))
    group = [segment] if segment else []
    schema = "".join(f"`{g}` {relation.schema[g].dataType.simpleString()}, " for g in group)
    schema += "id_variable int, name_variable string, id_cluster int, score_related double"
    if d <= 1:
        rows = [(i, n, 0, None) for i, n in enumerate(names)]
        return relation.sparkSession.createDataFrame(rows, schema)

    def cut(merges: pd.DataFrame) -> pd.DataFrame:
        merges = merges.sort_values(["height", "a", "b"])
        into = np.arange(d)
        for a, b in merges[["a", "b"]].to_numpy()[: d - wanted].tolist():
            into[into == into[b]] = into[a]
        out = pd.DataFrame({"id_variable": np.arange(d, dtype="int32"), "name_variable": list(names), "id_cluster": np.unique(into, return_inverse=True)[1].astype("int32")})
        out["score_related"] = None
        for g in group:
            out.insert(0, g, merges[g].iloc[0])
        return out

    return linkage_merges(d, relation, group).groupBy(*group).applyInPandas(cut, schema)  # one row for each variable


def cluster_variables(
    sample: TwoSample, relation: DataFrame, anchors: Sequence[int], k: int | None = None, collinear: float = 0.5,
    augment: float = 0.15, mode: str = "greedy",
) -> DataFrame:
    """Themes around the anchors, or the linkage fallback where there is no valid anchor."""
    valid = [int(a) for a in anchors if 0 <= a < len(sample.features)]
    if len(sample.features) <= 1 or not valid:
        return linkage_clusters(sample.features, relation, k)
    return assign_variables(sample.features, relation, anchor_themes(relation, valid, collinear, mode), augment)


def augmented_names(clusters: DataFrame, names: Sequence[str], anchors: Sequence[int]) -> list[str]:
    """Names of the augmented set in id order: theme members; without themes the valid anchors, else everything."""
    valid = sorted({int(a) for a in anchors if 0 <= a < len(names)})
    if len(names) > 1 and valid:
        return [r["name_variable"] for r in augmented_set(clusters).orderBy("id_variable").collect()]
    return [names[a] for a in valid] if list(anchors) else list(names)

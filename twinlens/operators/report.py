"""Report tables and chart data. All inputs but the samples have at most one row per variable or pair of variables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.values import to_number
from ..model import X, Y, TwoSample, quoted
from .relate import both_directions
from .sample import anchor_states
from .stats import (
    _whole, conditional_shift, discrete_shares, grouped_line, histogram, unpivot_numbers, variable_ranges,
)

MAX_DISCRETE = 5


def tag_anchors(variables: DataFrame, selection: DataFrame) -> DataFrame:
    """Adds ``is_anchor`` by membership in the selection."""
    marks = selection.select("id_variable", F.lit(True).alias("is_anchor"))
    joined = variables.join(F.broadcast(marks), "id_variable", "left")
    return joined.withColumn("is_anchor", F.coalesce("is_anchor", F.lit(False)))


def anchored_clusters(clusters: DataFrame, selection: DataFrame) -> DataFrame:
    """Members of clusters that hold an anchor, with the theme title made of the anchor names."""
    tagged = tag_anchors(clusters, selection)
    anchors = tagged.where("is_anchor").groupBy("id_cluster").agg(
        F.array_sort(F.collect_list(F.struct("id_variable", "name_variable"))).alias("anchors")
    )
    title = F.array_join(F.transform("anchors", lambda a: a["name_variable"]), " & ")
    return tagged.join(F.broadcast(anchors.select("id_cluster", title.alias("theme"))), "id_cluster")


def tornado(clusters: DataFrame, selection: DataFrame, limit: int = 10) -> DataFrame:
    """The ``limit`` best related variables of every anchored cluster."""
    members = anchored_clusters(clusters, selection).where(F.col("score_related").isNotNull())
    order = Window.partitionBy("id_cluster").orderBy(F.col("score_related").desc(), "id_variable")
    ranked = members.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    return ranked.select("id_cluster", "theme", "place", "id_variable", "name_variable", "score_related", "is_anchor")


def radar(
    clusters: DataFrame, selection: DataFrame, exemplars: DataFrame, type_subspace: str = "hat_S_augmented",
    max_axes: int = 8, min_axes: int = 3,
) -> DataFrame:
    """Best X and best Y row of the subspace on up to eight axes per anchored cluster, scaled to [0, 1] between the two.

    Anchors come first, then the best related others. Clusters with fewer than three axes are left out.
    """
    members = anchored_clusters(clusters, selection).where(F.col("is_anchor") | F.col("score_related").isNotNull())
    within = Window.partitionBy("id_cluster")
    other_score = F.when(~F.col("is_anchor"), F.col("score_related"))
    order = within.orderBy(F.col("is_anchor").desc(), other_score.desc_nulls_last(), "id_variable")
    axes = members.withColumn("axis", F.row_number().over(order)).where(F.col("axis") <= max_axes)
    axes = axes.withColumn("n_axes", F.count("*").over(within)).where(F.col("n_axes") >= min_axes)
    top = Window.partitionBy("label_class").orderBy(F.col("distance_score").desc(), "sample_key")
    best = exemplars.where(F.col("type_subspace") == type_subspace).withColumn("place", F.row_number().over(top))
    cells = best.where(F.col("place") == 1).select("label_class", F.explode("features").alias("name_variable", "v"))
    values = cells.groupBy("name_variable").agg(
        F.max(F.when(F.col("label_class") == X, F.col("v"))).alias("value_x"),
        F.max(F.when(F.col("label_class") == Y, F.col("v"))).alias("value_y"),
    )
    low, high = F.least("value_x", "value_y"), F.greatest("value_x", "value_y")
    unit = lambda c: F.when(high - low < 1e-8, 0.5).otherwise((F.col(c) - low) / (high - low))
    return axes.join(F.broadcast(values), "name_variable").select(
        "id_cluster", "theme", "axis", "name_variable", "is_anchor", "value_x", "value_y", unit("value_x").alias("unit_x"), unit("value_y").alias("unit_y")
    )


def heatmap_variables(relation: DataFrame, clusters: DataFrame, selection: DataFrame, limit: int = 35, few: int = 10) -> DataFrame:
    """The variables worth showing in a heatmap of at most ``limit``.

    All of them if they fit; else anchors and theme members. Too many theme members are cut by their strongest
    relation to an anchor; fewer than ``few`` are filled up with the variables of the highest mean relation.
    """
    tagged = tag_anchors(clusters, selection)
    ends = both_directions(relation)
    anchors = selection.select(F.col("id_variable").alias("id_other"), F.lit(True).alias("to_anchor"))
    strength = (
        ends.join(F.broadcast(anchors), "id_other", "left")
        .groupBy("id_variable")
        .agg(F.max(F.when(F.col("to_anchor"), F.col("score"))).alias("anchor_rel"), F.sum("score").alias("total_rel"))
    )
    group = F.when(F.col("is_anchor"), 0).when(F.col("id_cluster") > 0, 1).otherwise(2)
    rows = tagged.join(F.broadcast(strength), "id_variable", "left").withColumn("kind", group)
    every = _whole()
    rows = rows.select(
        "id_variable",
        "name_variable",
        "kind",
        F.count("*").over(every).alias("d"),
        F.count_if(F.col("kind") == 0).over(every).alias("n_anchors"),
        F.count_if(F.col("kind") < 2).over(every).alias("n_chosen"),
        F.row_number().over(Window.partitionBy("kind").orderBy(F.col("anchor_rel").desc_nulls_last(), "id_variable")).alias("by_anchor"),
        F.row_number().over(Window.partitionBy("kind").orderBy(F.col("total_rel").desc_nulls_last(), "id_variable")).alias("by_mean"),
    )
    kind, place = F.col("kind"), F.lit(limit)
    crowded = (kind == 0) | ((kind == 1) & (F.col("by_anchor") <= place - F.col("n_anchors")))
    sparse = (kind < 2) | (F.col("by_mean") <= place - F.col("n_chosen"))
    keep = (
        F.when(F.col("d") <= limit, F.lit(True))
        .when(F.col("n_chosen") > limit, crowded)
        .when(F.col("n_chosen") < few, sparse)
        .otherwise(kind < 2)
    )
    return rows.where(keep).select("id_variable", "name_variable")


def heatmap_cells(relation: DataFrame, shown: DataFrame) -> DataFrame:
    """All cells of the heatmap, the diagonal of ones included."""
    ids = shown.select("id_variable")
    ends = both_directions(relation).join(F.broadcast(ids), "id_variable", "left_semi")
    ends = ends.join(F.broadcast(ids.withColumnRenamed("id_variable", "id_other")), "id_other", "left_semi")
    diagonal = ids.select("id_variable", F.col("id_variable").alias("id_other"), F.lit(1.0).alias("score"))
    return ends.select("id_variable", "id_other", "score").unionByName(diagonal)


def network_nodes(clusters: DataFrame, selection: DataFrame) -> DataFrame:
    """One node per variable."""
    return tag_anchors(clusters, selection).select("id_variable", "name_variable", "is_anchor", "id_cluster")


def network_edges(edge_list: DataFrame) -> DataFrame:
    """One weighted edge per related pair."""
    return edge_list.select("id_variable_1", "id_variable_2", F.col("correlation_score").alias("weight"))


def marginals(sample: TwoSample, anchors: Sequence[str]) -> DataFrame:
    """Marginal distribution of every anchor on the raw scale, all anchors in one pass each for ranges and counts.

    Variables with at most five values give the share per value (``low`` = ``high`` = value), others a density
    histogram. Only finite values count; an anchor with an empty sample is left out.
    """
    part = sample.only(anchors)
    long = part.long().where(F.abs("v") < F.lit(float("inf")))
    ranges = variable_ranges(long, ["id_variable"]).where((F.col("n_x") > 0) & (F.col("n_y") > 0))
    discrete = ranges.where(F.col("n_distinct") <= MAX_DISCRETE)
    continuous = ranges.where(F.col("n_distinct") > MAX_DISCRETE)
    bars = histogram(long, continuous, ["id_variable"])
    position = Window.partitionBy("id_variable").orderBy("value")
    shares = discrete_shares(long, discrete, ["id_variable"]).withColumn("bin", F.row_number().over(position) - 1)
    columns = ["bin", "low", "high", "count_x", "count_y", "height_x", "height_y"]
    bars = bars.withColumnsRenamed({"density_x": "height_x", "density_y": "height_y"}).withColumn("kind", F.lit("density"))
    shares = shares.withColumns({"low": F.col("value"), "high": F.col("value"), "kind": F.lit("share")})
    shares = shares.withColumnsRenamed({"share_x": "height_x", "share_y": "height_y"})
    both = bars.select("id_variable", "kind", *columns).unionByName(shares.select("id_variable", "kind", *columns))
    return both.select(part.name_of("id_variable").alias("name_variable"), "kind", *columns)


def anchor_table(selection: DataFrame) -> DataFrame:
    """Anchors by falling weight."""
    return selection.orderBy(F.col("weight").desc(), "id_variable")


def theme_table(clusters: DataFrame, selection: DataFrame, top_k: int = 5) -> DataFrame:
    """Per cluster all anchors, then the ``top_k`` best other variables, with the source of each; scored rows only."""
    names = selection.select("name_variable")
    scored = clusters.where(F.col("score_related").isNotNull())
    chosen = scored.join(F.broadcast(names), "name_variable", "left_semi").withColumn("source", F.lit("Variable Selection"))
    others = scored.join(F.broadcast(names), "name_variable", "left_anti").withColumn("source", F.lit("Variable Augmentation"))
    order = Window.partitionBy("id_cluster").orderBy(F.col("score_related").desc(), "id_variable")
    others = others.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top_k)
    chosen = chosen.withColumn("place", F.row_number().over(order))
    return chosen.unionByName(others).select("id_cluster", "source", "place", "name_variable", "score_related")


def representative_table(exemplars: DataFrame, max_rows: int = 5) -> DataFrame:
    """The first rows per label, by subspace and then best first."""
    order = Window.partitionBy("label_class").orderBy("type_subspace", F.col("distance_score").desc(), "sample_key")
    ranked = exemplars.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max_rows)
    return ranked.select("label_class", "place", "sample_key", "is_prototype_for", "type_subspace", "distance_score")


def scope_summary(sample: TwoSample, scopes: dict[str, str], limit: int | None) -> DataFrame:
    """Rows used per stage and label, and whether that is a sub-sample or the whole sample."""
    counts = sample.frame.groupBy(F.col(sample.label).alias("label")).agg(F.count("*").alias("n_original"))
    stages = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(v).alias("scope")) for s, v in scopes.items()]))
    rows = counts.select("label", "n_original", stages.alias("s")).select("label", "n_original", "s.*")
    capped = F.when(F.col("scope") == "subset", F.least("n_original", F.lit(limit or 2**62))).otherwise(F.col("n_original"))
    source = F.when(capped < F.col("n_original"), "sub-sample").otherwise("whole sample")
    return rows.select("stage", "scope", "label", capped.cast("bigint").alias("n"), "n_original", source.alias("source"))


def label_descriptions(metadata: dict[str, str], x: str = "Distribution X", y: str = "Distribution Y") -> dict[str, str]:
    """Readable names of the two samples, from the metadata where it has them."""
    return {X: metadata.get("label_x_description", x), Y: metadata.get("label_y_description", y)}


def lineage_table(spark, lineage: Iterable[tuple[str, list[str], str]]) -> DataFrame:
    """Lineage records ``(feature, sources, type)``."""
    return spark.createDataFrame(list(lineage), "feature string, sources array<string>, type string")


def column_profile(sample: TwoSample) -> DataFrame:
    """Non-null count, exact distinct count and range per feature; values are counted in two steps."""
    counts = sample.long().groupBy("id_variable", "v").agg(F.count("*").alias("n"))
    profile = counts.groupBy("id_variable").agg(
        F.sum("n").alias("n_values"), F.count("*").alias("n_distinct"), F.min("v").alias("lowest"), F.max("v").alias("highest")
    )
    return profile.withColumn("feature", sample.name_of("id_variable")).drop("id_variable")


def feature_catalogue(sample: TwoSample, lineage: DataFrame) -> DataFrame:
    """Active features with their sources and profile, then the removed source columns."""
    active = lineage.where(F.col("type") != "removed")
    profiled = active.join(F.broadcast(column_profile(sample)), "feature", "left")
    used = active.select(F.explode("sources").alias("source")).distinct()
    gone = lineage.where(F.col("type") == "removed").withColumn("source", F.col("sources")[0])
    gone = gone.join(F.broadcast(used), "source", "left_anti").drop("source")
    both = profiled.unionByName(gone, allowMissingColumns=True)
    return both.orderBy(F.col("type") == "removed", "feature", "sources")


def _known(columns: Sequence[str], names: Sequence[str]) -> list[str]:
    return [n for n in dict.fromkeys(names) if n in columns]


def sweep_conditioned(df: DataFrame, conditions: Sequence[str], targets: Sequence[str], label: str = "label") -> DataFrame:
    """Conditional shift of every target under both states of every condition, all combinations in one job.

    Unknown names and a variable conditioned on itself are skipped.
    """
    conditions, targets = _known(df.columns, conditions), _known(df.columns, targets)
    rows = df.withColumn("label", F.col(label))
    states = anchor_states(rows, conditions, ["label", *targets])
    long = unpivot_numbers(states, targets, carry=("label", "anchor", "anchor_state"), name="target")
    long = long.where(F.col("anchor") != F.col("target"))
    return conditional_shift(long, ["anchor", "anchor_state", "target"])


def sweep_bivariate(
    df: DataFrame, xs: Sequence[str], ys: Sequence[str], anchors: Sequence[str], label: str = "label"
) -> DataFrame:
    """r and line of every (x, y) pair per anchor state and label, all combinations in one aggregation."""
    xs, ys, anchors = (_known(df.columns, names) for names in (xs, ys, anchors))
    carry = list(dict.fromkeys([*xs, *ys]))
    states = anchor_states(df.withColumn("label", F.col(label)), anchors, ["label", *carry])
    pairs = [(x, y) for x in xs for y in ys if x != y]
    cells = [
        F.struct(F.lit(x).alias("name_x"), F.lit(y).alias("name_y"), to_number(quoted(x)).alias("x"), to_number(quoted(y)).alias("y"))
        for x, y in pairs
    ]
    rows = states.select("label", "anchor", "anchor_state", F.inline(F.array(*cells)))
    return grouped_line(rows, "x", "y", ["label", "anchor", "anchor_state", "name_x", "name_y"])

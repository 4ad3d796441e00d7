"""Themes around anchors, exemplars and the tables drawn from them, on the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinlens.model import TwoSample
from twinlens.operators import cluster, exemplar, relate, report, select, stats
from twinlens.runtime import durable

from .base import LINE_FEATURES, SQL_LINES_LONG, SQL_VECTORS, SQL_WASSERSTEIN, lines, line_sample, query, rounded, sql_selection, vectors
from .relations import SQL_RELATION
from .statistics import SQL_HISTOGRAM

TOP, COLLINEAR, AUGMENT, CUT = 6, 0.05, 0.1, 0.12

SQL_ANCHORS = f"{SQL_VECTORS}, {SQL_WASSERSTEIN}, {sql_selection(approach='threshold', threshold=0.1, top_k=TOP, trim=True)}"

def sql_ends(collinear: float) -> str:
    """CTEs from SQL_RELATION and ``selection`` on: both ends of every pair, and the anchors with those strongly related to each."""
    return f"""{SQL_RELATION},
ends AS (SELECT id_variable_1 AS a, id_variable_2 AS b, correlation_score AS score FROM relation UNION ALL SELECT id_variable_2, id_variable_1, correlation_score FROM relation),
walk_order AS (SELECT s.id_variable AS a, row_number() OVER (ORDER BY s.id_variable) AS pos,
                      coalesce((SELECT list(e.b) FROM ends e WHERE e.a = s.id_variable AND e.score >= {collinear}), []) AS near FROM selection s)"""


#: Greedy walk over the anchors in id order; ``near`` lists the strongly related anchors.
SQL_GREEDY = """
walk AS (SELECT CAST(0 AS BIGINT) AS pos, CAST([] AS STRUCT(a INTEGER, t INTEGER)[]) AS members, 0 AS k
         UNION ALL
         SELECT n.pos, list_append(w.members, {'a': CAST(n.a AS INTEGER), 't': coalesce(list_min(list_transform(list_filter(w.members, lambda m: list_contains(n.near, m.a)), lambda m: m.t)), w.k + 1)}),
                greatest(w.k, coalesce(list_min(list_transform(list_filter(w.members, lambda m: list_contains(n.near, m.a)), lambda m: m.t)), w.k + 1))
         FROM walk w JOIN walk_order n ON n.pos = w.pos + 1),
themes AS (SELECT m.a AS a, m.t AS theme FROM (SELECT unnest(members) AS m FROM walk WHERE pos = (SELECT max(pos) FROM walk)))"""

#: Connected anchors, numbered by the smallest of each component.
SQL_COMPONENTS = """
reach AS (SELECT a, a AS b FROM walk_order UNION SELECT r.a, n.a FROM reach r JOIN walk_order w ON w.a = r.b JOIN walk_order n ON list_contains(w.near, n.a)),
themes AS (SELECT a, dense_rank() OVER (ORDER BY least_of) AS theme FROM (SELECT a, min(b) AS least_of FROM reach GROUP BY 1))"""


def sql_clusters(augment: float) -> str:
    """CTE ``clusters``: every variable with its theme, from ``themes``, ``ends`` and ``scaling``."""
    return f"""
affinity AS (SELECT e.a AS id_variable, t.theme, max(e.score) AS rho FROM ends e JOIN themes t ON e.b = t.a WHERE e.a NOT IN (SELECT a FROM themes) GROUP BY 1, 2),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id_variable ORDER BY rho DESC, theme) AS place FROM affinity) WHERE place = 1 AND rho > 0 AND rho >= {augment}),
clusters AS (SELECT s.id_variable, s.name_variable, CAST(coalesce(t.theme, b.theme, 0) AS INTEGER) AS id_cluster,
                    CASE WHEN t.a IS NOT NULL THEN CAST(1 AS DOUBLE) ELSE b.rho END AS score_related
             FROM scaling s LEFT JOIN themes t ON t.a = s.id_variable LEFT JOIN best b ON b.id_variable = s.id_variable)"""


SQL_THEMES = f"RECURSIVE {SQL_ANCHORS}, {sql_ends(COLLINEAR)}, {SQL_GREEDY}, {sql_clusters(AUGMENT)}"


def anchors_of(sample: TwoSample):
    weights = select.max_normalised(select.wasserstein_weights(sample))
    return durable(select.select_variables(weights, "threshold", 0.1, TOP, trim=True), "selection")


def ids(selection) -> list[int]:
    return [r["id_variable"] for r in selection.orderBy("id_variable").collect()]


def themed(spark, sf):
    """Selection, relation and clusters of the embeddings, the small tables stored once."""
    sample = vectors(spark, sf)
    selection = anchors_of(sample)
    relation = durable(relate.absolute_pearson(sample), "relation")
    clusters = cluster.cluster_variables(sample, relation, ids(selection), collinear=COLLINEAR, augment=AUGMENT)
    return selection, relation, clusters


@query("theme_assignment", f"""
WITH {SQL_THEMES}
SELECT id_variable, name_variable, id_cluster, round(score_related, 6) AS score_related FROM clusters""")
def theme_assignment(spark, sf):
    return rounded(themed(spark, sf)[2], "score_related")


@query("theme_components", f"""
WITH RECURSIVE {SQL_ANCHORS}, {sql_ends(COLLINEAR)}, {SQL_COMPONENTS}, {sql_clusters(AUGMENT)}
SELECT id_variable, name_variable, id_cluster, round(score_related, 6) AS score_related FROM clusters""")
def theme_components(spark, sf):
    """Anchors joined into connected components instead of greedy themes."""
    sample = vectors(spark, sf)
    relation = durable(relate.absolute_pearson(sample), "relation")
    clusters = cluster.cluster_variables(sample, relation, ids(anchors_of(sample)), collinear=COLLINEAR, augment=AUGMENT, mode="components")
    return rounded(clusters, "score_related")


@query("augmented_set", f"""
WITH {SQL_THEMES}
SELECT id_variable, name_variable FROM clusters WHERE id_cluster > 0""")
def augmented_set(spark, sf):
    return cluster.augmented_set(themed(spark, sf)[2])


@query("topk_neighbours", f"""
WITH {SQL_ANCHORS}, {SQL_RELATION},
ends AS (SELECT id_variable_1 AS a, id_variable_2 AS b, correlation_score AS score FROM relation UNION ALL SELECT id_variable_2, id_variable_1, correlation_score FROM relation),
ranked AS (SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS place FROM ends WHERE a IN (SELECT id_variable FROM selection))
SELECT a AS id_anchor, b AS id_variable, round(score, 6) AS score, CAST(place AS INTEGER) AS place FROM ranked WHERE place <= 5""")
def topk_neighbours(spark, sf):
    sample = vectors(spark, sf)
    return rounded(cluster.top_neighbours(relate.absolute_pearson(sample), ids(anchors_of(sample)), 5), "score")


@query("fallback_linkage")
def fallback_linkage(spark, sf):
    """No anchors: complete linkage; checked against a literal distance matrix in the tests."""
    sample = vectors(spark, sf)
    return cluster.cluster_variables(sample, relate.absolute_pearson(sample), [])


@query("anchor_membership", f"""
WITH {SQL_THEMES}
SELECT c.id_variable, c.id_cluster, c.id_variable IN (SELECT id_variable FROM selection) AS is_anchor FROM clusters c""")
def anchor_membership(spark, sf):
    selection, _, clusters = themed(spark, sf)
    return report.tag_anchors(clusters, selection).select("id_variable", "id_cluster", "is_anchor")


@query("tornado_data", f"""
WITH {SQL_THEMES},
titles AS (SELECT c.id_cluster, string_agg(c.name_variable, ' & ' ORDER BY c.id_variable) AS theme FROM clusters c JOIN selection s USING (id_variable) GROUP BY 1),
ranked AS (SELECT c.*, t.theme, row_number() OVER (PARTITION BY id_cluster ORDER BY score_related DESC, id_variable) AS place
           FROM clusters c JOIN titles t USING (id_cluster) WHERE score_related IS NOT NULL)
SELECT id_cluster, theme, CAST(place AS INTEGER) AS place, id_variable, name_variable, round(score_related, 6) AS score_related,
       id_variable IN (SELECT id_variable FROM selection) AS is_anchor FROM ranked WHERE place <= 10""")
def tornado_data(spark, sf):
    selection, _, clusters = themed(spark, sf)
    return rounded(report.tornado(clusters, selection), "score_related")


@query("theme_table", f"""
WITH {SQL_THEMES},
scored AS (SELECT *, name_variable IN (SELECT name_variable FROM selection) AS chosen FROM clusters WHERE score_related IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id_cluster, chosen ORDER BY score_related DESC, id_variable) AS place FROM scored)
SELECT id_cluster, CASE WHEN chosen THEN 'Variable Selection' ELSE 'Variable Augmentation' END AS source, CAST(place AS INTEGER) AS place,
       name_variable, round(score_related, 6) AS score_related FROM ranked WHERE chosen OR place <= 5""")
def theme_table(spark, sf):
    selection, _, clusters = themed(spark, sf)
    return rounded(report.theme_table(clusters, selection), "score_related")


@query("heatmap_subset", f"""
WITH {SQL_THEMES},
strength AS (SELECT a AS id_variable, max(score) FILTER (b IN (SELECT id_variable FROM selection)) AS anchor_rel, sum(score) AS total_rel FROM ends GROUP BY 1),
kinds AS (SELECT c.id_variable, CASE WHEN c.id_variable IN (SELECT id_variable FROM selection) THEN 0 WHEN id_cluster > 0 THEN 1 ELSE 2 END AS kind, anchor_rel, total_rel
          FROM clusters c JOIN strength USING (id_variable)),
placed AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY anchor_rel DESC NULLS LAST, id_variable) AS by_anchor,
                  row_number() OVER (PARTITION BY kind ORDER BY total_rel DESC, id_variable) AS by_mean,
                  count(*) FILTER (kind = 0) OVER () AS n_anchors, count(*) FILTER (kind < 2) OVER () AS n_chosen FROM kinds),
shown AS (SELECT id_variable FROM placed WHERE CASE WHEN n_chosen > 35 THEN kind = 0 OR (kind = 1 AND by_anchor <= 35 - n_anchors)
                                                    WHEN n_chosen < 10 THEN kind < 2 OR by_mean <= 35 - n_chosen ELSE kind < 2 END)
SELECT a AS id_variable, b AS id_other, round(score, 6) AS score FROM ends WHERE a IN (SELECT id_variable FROM shown) AND b IN (SELECT id_variable FROM shown)
UNION ALL SELECT id_variable, id_variable, CAST(1 AS DOUBLE) FROM shown""")
def heatmap_subset(spark, sf):
    selection, relation, clusters = themed(spark, sf)
    shown = report.heatmap_variables(relation, clusters, selection)
    return rounded(report.heatmap_cells(relation, shown), "score")


@query("network_nodes", f"""
WITH {SQL_THEMES}
SELECT id_variable, name_variable, id_variable IN (SELECT id_variable FROM selection) AS is_anchor, id_cluster FROM clusters""")
def network_nodes(spark, sf):
    selection, _, clusters = themed(spark, sf)
    return report.network_nodes(clusters, selection)


@query("network_edges", f"""
WITH {SQL_RELATION}
SELECT id_variable_1, id_variable_2, round(correlation_score, 6) AS weight FROM relation WHERE correlation_score >= {CUT}""")
def network_edges(spark, sf):
    return rounded(report.network_edges(relate.edges(relate.absolute_pearson(vectors(spark, sf)), CUT)), "weight")


@query("anchor_table", f"""
WITH {SQL_ANCHORS}
SELECT id_variable, name_variable, round(weight, 6) AS weight FROM selection""")
def anchor_table(spark, sf):
    return rounded(report.anchor_table(anchors_of(vectors(spark, sf))), "weight")


# ---- exemplars --------------------------------------------------------------------------------------------------

PAIR, PAIR_2, TRIPLE = ("e00", "e01"), ("e02", "e03"), ("e00", "e01", "e02")


def _sql_distances(names: tuple[str, ...], tag: str) -> str:
    """CTE ``dist_<tag>``: distances of every row to both centres, with the inverse matrix written out."""
    value = [f"CAST(embedding[{int(n[1:]) + 1}] AS DOUBLE)" for n in names]
    k = range(len(names))
    columns = ", ".join(f"{v} AS x{i}" for i, v in enumerate(value))
    moments = ", ".join(
        [f"avg(x{i}) FILTER (label = '{s}') AS m{i}{s}" for s in "XY" for i in k]
        + [f"covar_samp(x{i}, x{j}) FILTER (label = '{s}'){' + 1e-6' if i == j else ''} AS c{i}{j}{s}" for s in "XY" for i in k for j in k if i <= j]
    )

    def squared(s):
        d = [f"(x{i} - m{i}{s})" for i in k]
        c = lambda i, j: f"c{min(i, j)}{max(i, j)}{s}"
        if len(names) == 1:
            return f"{d[0]} * {d[0]} / {c(0, 0)}"
        if len(names) == 2:
            det = f"({c(0, 0)} * {c(1, 1)} - {c(0, 1)} * {c(0, 1)})"
            return f"({d[0]} * {d[0]} * {c(1, 1)} - 2 * {d[0]} * {d[1]} * {c(0, 1)} + {d[1]} * {d[1]} * {c(0, 0)}) / {det}"
        others = lambda i: [j for j in k if j != i]
        minor = lambda i, j: "({} * {} - {} * {})".format(
            c(others(i)[0], others(j)[0]), c(others(i)[1], others(j)[1]), c(others(i)[0], others(j)[1]), c(others(i)[1], others(j)[0])
        )
        sign = lambda i, j: "-" if (i + j) % 2 else "+"
        det = "(" + " ".join(f"{sign(0, j)} {c(0, j)} * {minor(0, j)}" for j in k) + ")"
        return "(" + " ".join(f"{sign(i, j)} {d[i]} * {d[j]} * {minor(i, j)}" for i in k for j in k) + f") / {det}"

    return f"""
pts_{tag} AS (SELECT vec_id, label, {columns} FROM vecs),
mom_{tag} AS (SELECT {moments} FROM pts_{tag}),
dist_{tag} AS (SELECT vec_id, label, {', '.join(f'x{i}' for i in k)}, sqrt(greatest({squared('X')}, 0)) AS to_x, sqrt(greatest({squared('Y')}, 0)) AS to_y FROM pts_{tag}, mom_{tag}),
score_{tag} AS (SELECT *, CASE WHEN label = 'X' THEN to_y - to_x ELSE to_x - to_y END AS score, CASE WHEN label = 'X' THEN -to_x ELSE -to_y END AS central FROM dist_{tag}),
top_{tag} AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS place FROM score_{tag})"""


@query("mahalanobis_scores", f"""
WITH {SQL_VECTORS}, {_sql_distances(('e05',), 'one')}
SELECT vec_id, label, round(score, 5) + 0.0 AS score, round(central, 5) + 0.0 AS central FROM score_one""")
def mahalanobis_scores(spark, sf):
    """One feature, both score modes, every row."""
    sample = vectors(spark, sf).only(["e05"])
    score = exemplar.prototype_scores(sample).select("vec_id", "label", "score")
    central = exemplar.prototype_scores(sample, "centroid").select("vec_id", F.col("score").alias("central"))
    return rounded(score.join(central, "vec_id"), "score", "central", digits=5)


@query("mahalanobis_topn", f"""
WITH {SQL_VECTORS}, {_sql_distances(PAIR, 'two')}
SELECT vec_id AS sample_key, label AS label_class, label AS is_prototype_for, round(score, 5) + 0.0 AS distance_score, 'hat_S' AS type_subspace,
       round(x0, 6) + 0.0 AS e00, round(x1, 6) + 0.0 AS e01 FROM top_two WHERE place <= 5""")
def mahalanobis_topn(spark, sf):
    best = exemplar.prototypes(vectors(spark, sf), PAIR, "hat_S")
    wide = best.select("*", F.col("features")["e00"].alias("e00"), F.col("features")["e01"].alias("e01")).drop("features")
    return rounded(rounded(wide, "distance_score", digits=5), "e00", "e01")


@query("exemplar_features", f"""
WITH {SQL_VECTORS}, {_sql_distances(TRIPLE, 'three')}
SELECT vec_id AS sample_key, label AS label_class, round(score, 5) + 0.0 AS distance_score, u.name AS feature,
       round(CASE u.name WHEN 'e00' THEN x0 WHEN 'e01' THEN x1 ELSE x2 END, 6) + 0.0 AS value
FROM top_three, (VALUES ('e00'), ('e01'), ('e02')) u(name) WHERE place <= 5""")
def exemplar_features(spark, sf):
    """The feature map of every exemplar, one row per entry."""
    best = exemplar.prototypes(vectors(spark, sf), TRIPLE, "hat_S")
    cells = best.select("sample_key", "label_class", "distance_score", F.explode("features").alias("feature", "value"))
    return rounded(rounded(cells, "distance_score", digits=5), "value")


def two_subspaces(spark, sf):
    sample = vectors(spark, sf)
    return durable(
        exemplar.prototypes(sample, PAIR, "hat_S").unionByName(exemplar.prototypes(sample, PAIR_2, "hat_S_augmented")), "exemplars"
    )


SQL_TWO = f"""{SQL_VECTORS}, {_sql_distances(PAIR, 'a')}, {_sql_distances(PAIR_2, 'b')},
exemplars AS (SELECT vec_id, label, score, 'hat_S' AS type_subspace, x0 AS e00, x1 AS e01, NULL AS e02, NULL AS e03 FROM top_a WHERE place <= 5
              UNION ALL SELECT vec_id, label, score, 'hat_S_augmented', NULL, NULL, x0, x1 FROM top_b WHERE place <= 5)"""


@query("representative_table", f"""
WITH {SQL_TWO}, ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY type_subspace, score DESC, vec_id) AS place FROM exemplars)
SELECT label AS label_class, CAST(place AS INTEGER) AS place, vec_id AS sample_key, label AS is_prototype_for, type_subspace, round(score, 5) + 0.0 AS distance_score
FROM ranked WHERE place <= 5""")
def representative_table(spark, sf):
    return rounded(report.representative_table(two_subspaces(spark, sf)), "distance_score", digits=5)


@query("exemplars_both_subspaces")
def exemplars_both_subspaces(spark, sf):
    """Exemplars on the anchors and on the augmented set; larger inverses are checked against numpy in the tests."""
    sample = vectors(spark, sf)
    selection, _, clusters = themed(spark, sf)
    scaled = stats.scaled(sample)
    hat = [sample.features[i] for i in ids(selection)]
    tilde = cluster.augmented_names(clusters, sample.features, ids(selection))
    return exemplar.prototypes(scaled, hat, "hat_S").unionByName(exemplar.prototypes(scaled, tilde, "hat_S_augmented"))


@query("radar_data", f"""
WITH {SQL_VECTORS}, {_sql_distances(TRIPLE, 'three')},
axes AS (SELECT 'e00' AS name_variable, 2.0 AS score, 0 AS id UNION ALL SELECT 'e01', abs(corr(x0, x1)), 1 FROM pts_three UNION ALL SELECT 'e02', abs(corr(x0, x2)), 2 FROM pts_three),
cells AS (SELECT label, u.name AS name_variable, CASE u.name WHEN 'e00' THEN x0 WHEN 'e01' THEN x1 ELSE x2 END AS v
          FROM top_three, (VALUES ('e00'), ('e01'), ('e02')) u(name) WHERE place = 1),
wide AS (SELECT name_variable, max(v) FILTER (label = 'X') AS vx, max(v) FILTER (label = 'Y') AS vy FROM cells GROUP BY 1)
SELECT 1 AS id_cluster, 'e00' AS theme, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS axis, name_variable, id = 0 AS is_anchor,
       round(vx, 6) + 0.0 AS value_x, round(vy, 6) + 0.0 AS value_y,
       CASE WHEN abs(vx - vy) < 1e-8 THEN 0.5 ELSE CAST(vx > vy AS DOUBLE) END AS unit_x, CASE WHEN abs(vx - vy) < 1e-8 THEN 0.5 ELSE CAST(vy > vx AS DOUBLE) END AS unit_y
FROM axes JOIN wide USING (name_variable)""")
def radar_data(spark, sf):
    """One anchor, two related variables: three axes, filled with the best X and Y row."""
    sample = vectors(spark, sf).only(TRIPLE)
    clusters = cluster.cluster_variables(sample, relate.absolute_pearson(sample), [0], augment=0.0)
    selection = spark.createDataFrame([(0, "e00", 1.0)], "id_variable int, name_variable string, weight double")
    best = exemplar.prototypes(sample, TRIPLE, "hat_S_augmented")
    return rounded(report.radar(clusters, selection, best), "value_x", "value_y", "unit_x", "unit_y")


# ---- marginals and sweeps ---------------------------------------------------------------------------------------


@query("marginals_all_anchors", f"""
WITH {SQL_LINES_LONG}, flags AS (SELECT label, 'is_open' AS name_variable, CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM lines),
continuous AS (SELECT label, name_variable, v FROM long WHERE name_variable IN ('l_extendedprice', 'l_quantity')),
{SQL_HISTOGRAM.format(by='name_variable', source='continuous')}
SELECT name_variable, 'density' AS kind, CAST(bin AS INTEGER) AS bin, low, high, count_x, count_y, density_x AS height_x, density_y AS height_y FROM histogram
UNION ALL SELECT name_variable, 'share', CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER), v, v, count(*) FILTER (label = 'X'), count(*) FILTER (label = 'Y'),
       round(count(*) FILTER (label = 'X') / (SELECT count(*) FROM flags WHERE label = 'X'), 8), round(count(*) FILTER (label = 'Y') / (SELECT count(*) FROM flags WHERE label = 'Y'), 8)
FROM flags GROUP BY name_variable, v""")
def marginals_all_anchors(spark, sf):
    rows = lines(spark, sf).withColumn("is_open", F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0))
    made = report.marginals(TwoSample(rows, (*LINE_FEATURES, "is_open")), ["l_extendedprice", "l_quantity", "is_open"])
    return rounded(rounded(made, "low", "high"), "height_x", "height_y", digits=8)


FLAGS = ("is_open", "is_returned")


def flagged_lines(spark, sf):
    return lines(spark, sf).select(
        "label",
        *LINE_FEATURES,
        F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0).alias("is_open"),
        F.when(F.col("l_returnflag") == "R", 1.0).when(F.col("l_returnflag") == "A", 0.0).alias("is_returned"),
    )


SQL_STATES = SQL_LINES_LONG + """,
flagged AS (SELECT *, CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END AS is_open, CASE WHEN l_returnflag = 'R' THEN 1.0 WHEN l_returnflag = 'A' THEN 0.0 END AS is_returned FROM lines),
states AS (SELECT 'is_open' AS anchor, CAST(is_open AS DOUBLE) AS anchor_state, * FROM flagged UNION ALL SELECT 'is_returned', CAST(is_returned AS DOUBLE), * FROM flagged WHERE is_returned IS NOT NULL)"""


@query("sweep_conditioned", f"""
WITH {SQL_STATES}, cells AS (SELECT label, anchor, anchor_state, 'l_quantity' AS target, l_quantity AS v FROM states UNION ALL SELECT label, anchor, anchor_state, 'l_extendedprice', l_extendedprice FROM states)
SELECT anchor, anchor_state, target, count(*) FILTER (label = 'X') AS n_x, round(avg(v) FILTER (label = 'X'), 4) AS mean_x, round(median(v) FILTER (label = 'X'), 4) AS median_x,
       count(*) FILTER (label = 'Y') AS n_y, round(avg(v) FILTER (label = 'Y'), 4) AS mean_y, round(median(v) FILTER (label = 'Y'), 4) AS median_y,
       round((avg(v) FILTER (label = 'Y') - avg(v) FILTER (label = 'X')) / avg(v) FILTER (label = 'X') * 100, 4) + 0.0 AS percent_shift FROM cells GROUP BY 1, 2, 3""")
def sweep_conditioned(spark, sf):
    swept = report.sweep_conditioned(flagged_lines(spark, sf), [*FLAGS, "absent"], ["l_quantity", "l_extendedprice"])
    return rounded(swept, "mean_x", "median_x", "mean_y", "median_y", "percent_shift", digits=4)


@query("sweep_bivariate", f"""
WITH {SQL_STATES}, cells AS (SELECT label, anchor, anchor_state, 'l_quantity' AS name_x, 'l_extendedprice' AS name_y, l_quantity AS x, l_extendedprice AS y FROM states
                             UNION ALL SELECT label, anchor, anchor_state, 'l_discount', 'l_extendedprice', l_discount, l_extendedprice FROM states
                             UNION ALL SELECT label, anchor, anchor_state, 'l_discount', 'l_quantity', l_discount, l_quantity FROM states)
SELECT label, anchor, anchor_state, name_x, name_y, count(*) AS n, round(corr(x, y), 6) + 0.0 AS r, round(covar_pop(x, y) / var_pop(x), 3) + 0.0 AS slope,
       round(avg(y) - covar_pop(x, y) / var_pop(x) * avg(x), 3) + 0.0 AS intercept FROM cells GROUP BY 1, 2, 3, 4, 5""")
def sweep_bivariate(spark, sf):
    swept = report.sweep_bivariate(flagged_lines(spark, sf), ["l_quantity", "l_discount"], ["l_extendedprice", "l_quantity"], FLAGS)
    return rounded(rounded(swept, "r"), "slope", "intercept", digits=3)


@query("feature_catalogue", f"""
WITH {SQL_LINES_LONG}, profile AS (SELECT name_variable AS feature, count(*) AS n_values, count(DISTINCT v) AS n_distinct, min(v) AS lowest, max(v) AS highest FROM long GROUP BY 1)
SELECT feature, feature AS source, 'float' AS type, n_values, n_distinct, lowest, highest FROM profile
UNION ALL SELECT 'removed', u.c, 'removed', NULL, NULL, NULL, NULL FROM (VALUES ('l_linenumber'), ('l_shipdate')) u(c)""")
def feature_catalogue(spark, sf):
    sample = line_sample(spark, sf)
    lineage = [(f, [f], "float") for f in LINE_FEATURES] + [("removed", [c], "removed") for c in ("l_linenumber", "l_shipdate")]
    made = report.feature_catalogue(sample, report.lineage_table(spark, lineage))
    return made.select("feature", F.col("sources")[0].alias("source"), "type", "n_values", "n_distinct", "lowest", "highest")

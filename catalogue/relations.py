"""Relationships between variables, themes and neighbours."""

from __future__ import annotations

import numpy as np

from twinlens.operators import relate, sparse

from .base import SQL_LINES, line_sample, query, rounded, vectors

SQL_RELATION = """
pooled AS (SELECT CAST(u.i AS INTEGER) - 1 AS id_variable, vec_id, CAST(embedding[u.i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i) u),
relation AS (SELECT a.id_variable AS id_variable_1, b.id_variable AS id_variable_2, abs(corr(a.v, b.v)) AS correlation_score
             FROM pooled a JOIN pooled b ON a.vec_id = b.vec_id AND a.id_variable < b.id_variable GROUP BY 1, 2)"""


@query("correlation_matrix", f"""
WITH {SQL_RELATION}
SELECT id_variable_1, id_variable_2, round(correlation_score, 6) AS correlation_score FROM relation""")
def correlation_matrix(spark, sf):
    """64 variables: matrix sums per partition."""
    return rounded(relate.absolute_pearson(vectors(spark, sf)), "correlation_score")


@query("correlation_pairs", f"""
WITH {SQL_LINES}
SELECT 0 AS id_variable_1, 1 AS id_variable_2, round(abs(corr(l_discount, l_extendedprice)), 6) AS correlation_score FROM lines
UNION ALL SELECT 0, 2, round(abs(corr(l_discount, l_quantity)), 6) FROM lines UNION ALL SELECT 0, 3, round(abs(corr(l_discount, l_tax)), 6) FROM lines
UNION ALL SELECT 1, 2, round(abs(corr(l_extendedprice, l_quantity)), 6) FROM lines UNION ALL SELECT 1, 3, round(abs(corr(l_extendedprice, l_tax)), 6) FROM lines
UNION ALL SELECT 2, 3, round(abs(corr(l_quantity, l_tax)), 6) FROM lines""")
def correlation_pairs(spark, sf):
    """Few variables: one built-in aggregation."""
    return rounded(relate.absolute_pearson(line_sample(spark, sf)), "correlation_score")


@query("correlation_edges", f"""
WITH {SQL_RELATION}
SELECT id_variable_1, id_variable_2, round(correlation_score, 6) AS correlation_score FROM relation WHERE correlation_score >= 0.1""")
def correlation_edges(spark, sf):
    return rounded(relate.edges(relate.absolute_pearson(vectors(spark, sf)), 0.1), "correlation_score")


@query("partial_correlation")
def partial_correlation(spark, sf):
    """Cross-validated sparse inverse covariance; iterative, so checked against numpy in the tests."""
    return relate.partial_correlation(vectors(spark, sf))


@query("partial_correlation_lines", f"""
WITH {SQL_LINES}, r AS (
SELECT 0 AS id_variable_1, 1 AS id_variable_2, abs(corr(l_discount, l_extendedprice)) AS r FROM lines
UNION ALL SELECT 0, 2, abs(corr(l_discount, l_quantity)) FROM lines UNION ALL SELECT 0, 3, abs(corr(l_discount, l_tax)) FROM lines
UNION ALL SELECT 1, 2, abs(corr(l_extendedprice, l_quantity)) FROM lines UNION ALL SELECT 1, 3, abs(corr(l_extendedprice, l_tax)) FROM lines
UNION ALL SELECT 2, 3, abs(corr(l_quantity, l_tax)) FROM lines)
SELECT id_variable_1, id_variable_2, round(greatest(r - 0.2, 0), 6) + 0.0 AS correlation_score FROM r""")
def partial_correlation_lines(spark, sf):
    """One penalty: only price and quantity are related beyond it, and two variables have a closed form, |r| less the penalty."""
    return rounded(relate.partial_correlation(line_sample(spark, sf), penalty=0.2), "correlation_score")


@query("sparse_components", f"""
WITH RECURSIVE {SQL_RELATION},
links AS (SELECT id_variable_1 AS a, id_variable_2 AS b FROM relation WHERE correlation_score > 0.1 UNION ALL SELECT id_variable_2, id_variable_1 FROM relation WHERE correlation_score > 0.1),
reach AS (SELECT DISTINCT id_variable AS a, id_variable AS b FROM pooled UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT a AS id_variable, min(b) AS component FROM reach GROUP BY 1""")
def sparse_components(spark, sf):
    """Components of the sparse inverse's own zero pattern: by theorem those of the correlations cut at the penalty."""
    cells = relate.partial_correlation(vectors(spark, sf), penalty=0.1).where("correlation_score > 0")
    links = np.array([(r["id_variable_1"], r["id_variable_2"]) for r in cells.collect()], int).reshape(-1, 2)  # of 64 variables
    labels = sparse.labels_of(64, links)
    return spark.createDataFrame([(k, int(c)) for k, c in enumerate(labels)], "id_variable int, component int")

"""Variable selection."""

from __future__ import annotations

from twinlens.operators import select, stats

from .base import SQL_LINES_LONG, SQL_VECTORS, SQL_WASSERSTEIN, line_sample, query, rounded, sql_selection, vectors


@query("wasserstein_weights", f"""
WITH {SQL_LINES_LONG}, {SQL_WASSERSTEIN}
SELECT id_variable, name_variable, round(weight, 6) AS weight FROM weights""")
def wasserstein_weights(spark, sf):
    return rounded(select.wasserstein_weights(line_sample(spark, sf)), "weight")


@query("wasserstein_select", f"""
WITH {SQL_LINES_LONG}, {SQL_WASSERSTEIN}, {sql_selection()}
SELECT id_variable, name_variable, round(weight, 6) AS weight FROM selection""")
def wasserstein_select(spark, sf):
    return rounded(select.wasserstein_select(line_sample(spark, sf)), "weight")


@query("wasserstein_select_vectors", f"""
WITH {SQL_VECTORS}, {SQL_WASSERSTEIN}, {sql_selection()}
SELECT id_variable, name_variable, round(weight, 6) AS weight FROM selection""")
def wasserstein_select_vectors(spark, sf):
    return rounded(select.wasserstein_select(vectors(spark, sf)), "weight")


@query("wasserstein_threshold", f"""
WITH {SQL_VECTORS}, {SQL_WASSERSTEIN}, {sql_selection(approach='threshold', threshold=0.6)}
SELECT id_variable, name_variable, round(weight, 6) AS weight FROM selection""")
def wasserstein_threshold(spark, sf):
    return rounded(select.wasserstein_select(vectors(spark, sf), approach="threshold", threshold=0.6), "weight")


@query("weights_max_normalised", f"""
WITH {SQL_LINES_LONG}, {SQL_WASSERSTEIN}
SELECT id_variable, name_variable, round(weight, 6) AS weight FROM normed""")
def weights_max_normalised(spark, sf):
    return rounded(select.max_normalised(select.wasserstein_weights(line_sample(spark, sf))), "weight")


@query("topk_fallback", f"""
WITH {SQL_VECTORS}, {SQL_WASSERSTEIN}, {sql_selection(approach='threshold', threshold=2.0)}
SELECT id_variable, name_variable, round(weight, 6) AS weight FROM selection""")
def topk_fallback(spark, sf):
    """A cut above every weight selects nothing, so the five largest are taken."""
    return rounded(select.wasserstein_select(vectors(spark, sf), approach="threshold", threshold=2.0), "weight")


SQL_SHIFTS = """
shifts AS (SELECT id_variable, any_value(name_variable) AS name_variable,
                  abs(avg(v) FILTER (label = 'X') - avg(v) FILTER (label = 'Y')) AS shift FROM long GROUP BY 1),
normed AS (SELECT id_variable, name_variable, shift / (max(shift) OVER () + 1e-8) AS weight FROM shifts)"""


@query("mean_shift_weights", f"""
WITH {SQL_VECTORS}, {SQL_SHIFTS}
SELECT id_variable, name_variable, round(weight, 6) AS weight FROM normed""")
def mean_shift_weights(spark, sf):
    return rounded(stats.mean_shift_weights(vectors(spark, sf)), "weight")


@query("mean_shift_trimmed", f"""
WITH {SQL_VECTORS}, {SQL_SHIFTS}, {sql_selection(approach='threshold', threshold=0.1, trim=True)}
SELECT id_variable, name_variable, round(weight, 6) AS weight FROM selection""")
def mean_shift_trimmed(spark, sf):
    """More variables than five pass the cut; the five largest stay."""
    weights = stats.mean_shift_weights(vectors(spark, sf))
    return rounded(select.select_variables(weights, "threshold", 0.1, 5, trim=True), "weight")

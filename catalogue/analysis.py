"""Adapters, dataset reports and the whole analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinlens.plans.analysis import AnalysisOptions, run_all, run_analysis
from twinlens.plans.dating import INTERESTS, PREFERENCES, SELF_RATINGS, Dating
from twinlens.plans.housing import Housing
from twinlens.runtime import durable, fresh_folder
from twinlens.sources.tables import Warehouse

from .base import SQL_VECTORS, SQL_WASSERSTEIN, query, rounded, sql_selection, table, vectors
from .dating import ANSWERS, SQL_CARDS, cards
from .statistics import MOMENTS, PERCENTS, SQL_CATEGORY
from .themes import SQL_GREEDY, sql_clusters, sql_ends

# A housing table made of parts and lines would be made up; orders stand in for sales, with the columns the adapter
# looks for. Missing values follow from the keys.
SALES = {
    "Order": "o_orderkey",
    "YrSold": "CASE WHEN year(o_orderdate) BETWEEN 1996 AND 2000 THEN year(o_orderdate) + 10 END",
    "SalePrice": "o_totalprice",
    "GrLivArea": "o_totalprice / 100 + o_custkey % 500",
    "LotFrontage": "CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_custkey % 90 + 30 AS DOUBLE) END",
    "GarageArea": "CASE WHEN o_orderkey % 8 <> 0 THEN CAST(o_custkey % 700 AS DOUBLE) END",
    "OverallQual": "o_custkey % 10 + 1",
    "OverallCond": "o_orderkey % 9 + 1",
    "PoolQC": "CASE o_orderkey % 50 WHEN 0 THEN 'Ex' WHEN 1 THEN 'Gd' END",
    "KitchenQual": "CASE o_orderkey % 4 WHEN 0 THEN 'Ex' WHEN 1 THEN 'Gd' WHEN 2 THEN 'TA' ELSE 'Fa' END",
    "Neighborhood": "CASE WHEN o_orderkey % 17 <> 0 THEN concat('N', CAST(o_custkey % 12 AS STRING)) END",
    "BldgType": "o_orderpriority",
    "SaleType": "CASE WHEN o_orderkey % 13 <> 0 THEN o_orderstatus END",
}
SQL_SALES = "sales AS (SELECT " + ", ".join(f'{text} AS "{name}"' for name, text in SALES.items()) + " FROM orders)"
SQL_SALES_SPLIT = SQL_SALES + """,
split AS (SELECT *, CASE WHEN "YrSold" IN (2006, 2007) THEN 'X' WHEN "YrSold" IN (2009, 2010) THEN 'Y' ELSE 'T' END AS label FROM sales)"""


def sales(spark, sf):
    return table(spark, sf, "orders").select(*[F.expr(text).alias(name) for name, text in SALES.items()])


_NAMES = [f"N{i}" for i in range(12)]
_TYPES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SQL_HOUSING = f"""
WITH {SQL_SALES}, medians AS (SELECT "Neighborhood" AS g, median("LotFrontage") AS m FROM sales WHERE "Neighborhood" IS NOT NULL GROUP BY 1),
fills AS (SELECT (SELECT median("LotFrontage") FROM sales) AS lot, (SELECT "Neighborhood" FROM sales WHERE "Neighborhood" IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS hood,
                 (SELECT "SaleType" FROM sales WHERE "SaleType" IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS kind,
                 (SELECT median("YrSold") FROM sales) AS yr),
filled AS (SELECT s.*, coalesce(s."LotFrontage", m, lot) AS lot_frontage, coalesce("Neighborhood", hood) AS hood2, coalesce("SaleType", kind) AS kind2, coalesce("YrSold", yr) AS yr2
           FROM sales s LEFT JOIN medians ON g = "Neighborhood", fills)
SELECT "Order" AS sample_key, CASE WHEN yr2 IN (2006, 2007) THEN 'X' ELSE 'Y' END AS label, CAST("GrLivArea" AS DOUBLE) AS "GrLivArea", CAST(lot_frontage AS DOUBLE) AS "LotFrontage",
       coalesce("GarageArea", 0.0) AS "GarageArea", CAST("OverallQual" AS DOUBLE) AS "OverallQual", CAST("OverallCond" AS DOUBLE) AS "OverallCond",
       CAST(CASE "PoolQC" WHEN 'Ex' THEN 5 WHEN 'Gd' THEN 4 ELSE 0 END AS DOUBLE) AS "PoolQC",
       CAST(CASE "KitchenQual" WHEN 'Ex' THEN 5 WHEN 'Gd' THEN 4 WHEN 'TA' THEN 3 ELSE 2 END AS DOUBLE) AS "KitchenQual",
       {', '.join(f"CAST(hood2 = '{n}' AS DOUBLE) AS {chr(34)}Neighborhood_{n}{chr(34)}" for n in _NAMES)},
       {', '.join(f"CAST({chr(34)}BldgType{chr(34)} = '{n}' AS DOUBLE) AS {chr(34)}BldgType_{n}{chr(34)}" for n in _TYPES)},
       {', '.join(f"CAST(kind2 = '{n}' AS DOUBLE) AS {chr(34)}SaleType_{n}{chr(34)}" for n in 'FOP')}
FROM filled WHERE yr2 IN (2006, 2007, 2009, 2010)"""


@query("housing_features", SQL_HOUSING)
def housing_features(spark, sf):
    """The whole adapter; indicator columns of the dropped sale type stay."""
    made = Housing().features(sales(spark, sf))
    return made.frame.select("sample_key", "label", *made.features)


def _report_sql(names: str) -> str:
    cells = " UNION ALL ".join(f"""SELECT label, '{n}' AS name_metric, CAST("{n}" AS DOUBLE) AS v FROM split""" for n in names.split())
    sides = ", ".join(
        f"""round(avg(v) FILTER (label = '{s}'), 4) AS mean_{s.lower()}, round(stddev_samp(v) FILTER (label = '{s}'), 4) AS std_{s.lower()},
        round(median(v) FILTER (label = '{s}'), 4) AS median_{s.lower()}, round(min(v) FILTER (label = '{s}'), 4) AS min_{s.lower()}, round(max(v) FILTER (label = '{s}'), 4) AS max_{s.lower()}"""
        for s in "XY"
    )
    shift = "avg(v) FILTER (label = 'Y') - avg(v) FILTER (label = 'X')"
    return f"""cells AS ({cells}) SELECT name_metric, {sides}, round({shift}, 4) + 0.0 AS delta_mean,
       round(({shift}) / abs(avg(v) FILTER (label = 'X')) * 100, 4) + 0.0 AS percentage_change_mean FROM cells GROUP BY 1"""


def _housing_report(spark, sf, name):
    return Housing().report(sales(spark, sf))[name]


@query("report_amounts", f"WITH {SQL_SALES_SPLIT}, {_report_sql('SalePrice GrLivArea GarageArea LotFrontage')}")
def report_amounts(spark, sf):
    return rounded(_housing_report(spark, sf, "amounts"), *MOMENTS, digits=4)


@query("report_ratings", f"WITH {SQL_SALES_SPLIT}, {_report_sql('OverallQual OverallCond')}")
def report_ratings(spark, sf):
    return rounded(_housing_report(spark, sf, "ratings"), *MOMENTS, digits=4)


SHARES = ("proportion_x", "proportion_y", "delta_percentage_points")


@query("report_neighborhoods", f"WITH {SQL_SALES_SPLIT}, " + SQL_CATEGORY.format(column='"Neighborhood"', source="split", top=12))
def report_neighborhoods(spark, sf):
    return rounded(_housing_report(spark, sf, "Neighborhood"), *SHARES)


@query("report_sale_types", f"WITH {SQL_SALES_SPLIT}, " + SQL_CATEGORY.format(column='"SaleType"', source="split", top=6))
def report_sale_types(spark, sf):
    return rounded(_housing_report(spark, sf, "SaleType"), *SHARES)


def _missing_sql(names: str, source: str = "split", top: int = 15) -> str:
    cells = " UNION ALL ".join(f"""SELECT label, '{n}' AS name_column, "{n}" IS NULL AS gone FROM {source}""" for n in names.split())
    count = lambda on: f"count(*) FILTER (gone{on})"
    rate = lambda on, of: f"round(100.0 * {count(on)} / count(*){of}, 6)"
    x, y = " AND label = 'X'", " AND label = 'Y'"
    return f"""cells AS ({cells})
SELECT name_column, {count('')} AS count_missing_total, {rate('', '')} AS percentage_missing_total, {count(x)} AS count_missing_x, {rate(x, " FILTER (label = 'X')")} AS percentage_missing_x,
       {count(y)} AS count_missing_y, {rate(y, " FILTER (label = 'Y')")} AS percentage_missing_y
FROM cells GROUP BY 1 HAVING {count('')} > 0 ORDER BY count_missing_total DESC, name_column LIMIT {top}"""


@query("report_missingness", f"WITH {SQL_SALES_SPLIT}, {_missing_sql(' '.join(SALES))}")
def report_missingness(spark, sf):
    return rounded(_housing_report(spark, sf, "missingness"), *PERCENTS)


@query("report_absence", f"WITH {SQL_SALES_SPLIT}, {_missing_sql('PoolQC GarageArea')}")
def report_absence(spark, sf):
    return rounded(_housing_report(spark, sf, "absence"), *PERCENTS)


@query("report_overview", f"""
WITH {SQL_SALES_SPLIT}, counts AS (SELECT label, count(*) AS n FROM split GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM split)
SELECT label, n, round(100.0 * n / (SELECT count(*) FROM split), 6) AS share, CAST({len(SALES)} AS BIGINT) AS n_columns FROM counts""")
def report_overview(spark, sf):
    return rounded(_housing_report(spark, sf, "overview"), "share")


SQL_CARDS_SPLIT = SQL_CARDS + ", split AS (SELECT *, CASE WHEN dec = 1 AND dec_o = 1 THEN 'X' ELSE 'Y' END AS label FROM cards)"


@query("report_dating_habits", f"WITH {SQL_CARDS_SPLIT}, {_report_sql('age imprace imprelig date go_out')}")
def report_dating_habits(spark, sf):
    """Scorecards without a match flag: both decisions count."""
    return rounded(_dating_report(spark, sf, "habits"), *MOMENTS, digits=4)


@query("report_dating_goal", f"WITH {SQL_CARDS_SPLIT}, " + SQL_CATEGORY.format(column="CAST(goal AS VARCHAR)", source="split", top=7))
def report_dating_goal(spark, sf):
    return rounded(_dating_report(spark, sf, "goal"), *SHARES)


def _dating_report(spark, sf, name):
    return Dating().report(cards(spark, sf), [name])[name]


@query("report_dating_interests", f"WITH {SQL_CARDS_SPLIT}, {_report_sql(' '.join(INTERESTS))}")
def report_dating_interests(spark, sf):
    return rounded(_dating_report(spark, sf, "interests"), *MOMENTS, digits=4)


@query("report_dating_self_ratings", f"WITH {SQL_CARDS_SPLIT}, {_report_sql(' '.join(SELF_RATINGS))}")
def report_dating_self_ratings(spark, sf):
    return rounded(_dating_report(spark, sf, "self_ratings"), *MOMENTS, digits=4)


@query("report_dating_preferences", f"WITH {SQL_CARDS_SPLIT}, {_report_sql(' '.join(PREFERENCES))}")
def report_dating_preferences(spark, sf):
    return rounded(_dating_report(spark, sf, "preferences"), *MOMENTS, digits=4)


@query("report_dating_race", f"WITH {SQL_CARDS_SPLIT}, " + SQL_CATEGORY.format(column="CAST(race AS VARCHAR)", source="split", top=6))
def report_dating_race(spark, sf):
    return rounded(_dating_report(spark, sf, "race"), *SHARES)


@query("report_dating_missingness", f"WITH {SQL_CARDS_SPLIT}, {_missing_sql(' '.join(ANSWERS))}")
def report_dating_missingness(spark, sf):
    return rounded(_dating_report(spark, sf, "missingness"), *PERCENTS)


@query("report_dating_overview", f"""
WITH {SQL_CARDS_SPLIT}, counts AS (SELECT label, count(*) AS n FROM split GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM split)
SELECT label, n, round(100.0 * n / (SELECT count(*) FROM split), 6) AS share, CAST({len(ANSWERS)} AS BIGINT) AS n_columns FROM counts""")
def report_dating_overview(spark, sf):
    return rounded(_dating_report(spark, sf, "overview"), "share")


@query("full_analysis", f"""
WITH RECURSIVE {SQL_VECTORS}, {SQL_WASSERSTEIN}, {sql_selection(approach="hist_based", threshold=0.1, top_k=5)}, {sql_ends(0.5)}, {SQL_GREEDY}, {sql_clusters(0.1)}
SELECT c.id_variable, c.name_variable, c.id_cluster, round(c.score_related, 6) AS score_related, round(s.weight, 6) AS weight
FROM clusters c LEFT JOIN selection s USING (id_variable)""")
def full_analysis(spark, sf):
    """One call on the embeddings: Wasserstein anchors, absolute correlation, all rows. Returns the clusters with anchor marks."""
    options = AnalysisOptions(
        selector="wasserstein", relation="pearson", edge_cut=0.1, augment=0.1, selection_scope="whole", analysis_scope="whole"
    )
    result = run_analysis(vectors(spark, sf), options)
    chosen = result.selection.select("id_variable", "weight")
    return rounded(result.clusters.join(F.broadcast(chosen), "id_variable", "left"), "score_related", "weight")


@query("full_analysis_mmd")
def full_analysis_mmd(spark, sf):
    """The default call: MMD anchors, sparse partial correlation, all rows; returns the exemplars."""
    options = AnalysisOptions()
    result = run_analysis(vectors(spark, sf), options, edge_cut=0.01, augment=0.001)
    return result.exemplars


@query("staged_analysis")
def staged_analysis(spark, sf):
    """All stages over a warehouse; returns the report tables' row counts."""
    store = Warehouse(spark, fresh_folder(spark, "warehouse"))
    options = AnalysisOptions(selector="wasserstein", relation="pearson", edge_cut=0.1, augment=0.1)
    tables = run_all(vectors(spark, sf), store, options, {"dataset_name": "embeddings"})
    counts = None
    for name, rows in tables.items():
        part = rows.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"))
        counts = part if counts is None else counts.unionByName(part)
    return counts


@query("dating_analysis")
def dating_analysis(spark, sf):
    """Scorecards to themes: adapter, selection and clusters of the pair features."""
    made = Dating(limit=None).features(durable(cards(spark, sf), "cards"))
    pairs = made.with_frame(durable(made.frame, "pairs"))
    options = AnalysisOptions(selector="wasserstein", relation="pearson", selection_scope="whole", analysis_scope="whole")
    return run_analysis(pairs, options).clusters

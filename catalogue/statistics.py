"""Comparison statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinlens.operators import stats
from twinlens.operators.sample import split_by_values, split_three_way

from .base import (
    LINE_FEATURES, SQL_LINES, SQL_LINES_LONG, SQL_ORDERS, YEARS_X, YEARS_Y, line_sample, lines, orders, query, rounded, table,
)

MOMENTS = "mean_x std_x median_x min_x max_x mean_y std_y median_y min_y max_y delta_mean percentage_change_mean".split()


@query("numeric_comparison", f"""
WITH {SQL_LINES_LONG}, m AS (
  SELECT name_variable AS name_metric,
         avg(v) FILTER (label = 'X') AS mx, stddev_samp(v) FILTER (label = 'X') AS sx, median(v) FILTER (label = 'X') AS dx,
         min(v) FILTER (label = 'X') AS lx, max(v) FILTER (label = 'X') AS hx,
         avg(v) FILTER (label = 'Y') AS my, stddev_samp(v) FILTER (label = 'Y') AS sy, median(v) FILTER (label = 'Y') AS dy,
         min(v) FILTER (label = 'Y') AS ly, max(v) FILTER (label = 'Y') AS hy FROM long GROUP BY 1)
SELECT name_metric, round(mx, 4) AS mean_x, round(sx, 4) AS std_x, round(dx, 4) AS median_x, round(lx, 4) AS min_x, round(hx, 4) AS max_x,
       round(my, 4) AS mean_y, round(sy, 4) AS std_y, round(dy, 4) AS median_y, round(ly, 4) AS min_y, round(hy, 4) AS max_y,
       round(my - mx, 4) + 0.0 AS delta_mean, round((my - mx) / abs(mx) * 100, 4) + 0.0 AS percentage_change_mean FROM m""")
def numeric_comparison(spark, sf):
    return rounded(stats.numeric_comparison(lines(spark, sf), LINE_FEATURES), *MOMENTS, digits=4)


SQL_CATEGORY = """
counts AS (SELECT coalesce({column}, 'Missing') AS name_category, count(*) FILTER (label = 'X') AS count_x, count(*) FILTER (label = 'Y') AS count_y
           FROM {source} WHERE label IN ('X', 'Y') GROUP BY 1),
totals AS (SELECT greatest(count(*) FILTER (label = 'X'), 1) AS tx, greatest(count(*) FILTER (label = 'Y'), 1) AS ty FROM {source})
SELECT name_category, count_x, round(count_x / tx, 6) AS proportion_x, count_y, round(count_y / ty, 6) AS proportion_y,
       round((count_y / ty - count_x / tx) * 100, 6) + 0.0 AS delta_percentage_points
FROM counts, totals ORDER BY count_x + count_y DESC, name_category LIMIT {top}"""


@query("category_comparison", """
WITH parts AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'X' ELSE 'Y' END AS label, CASE WHEN value >= 5 THEN event_type END AS kind FROM events), """
       + SQL_CATEGORY.format(column="kind", source="parts", top=4))
def category_comparison(spark, sf):
    parts = table(spark, sf, "events").select(
        F.when(F.col("user_id") % 2 == 0, "X").otherwise("Y").alias("label"), F.when(F.col("value") >= 5, F.col("event_type")).alias("kind")
    )
    compared = stats.category_comparison(parts, "kind", 4)
    return rounded(compared, "proportion_x", "proportion_y", "delta_percentage_points")


SQL_HOLES = """
holes AS (SELECT CASE WHEN year(o_orderdate) IN (1996, 1997) THEN 'X' WHEN year(o_orderdate) IN (1999, 2000) THEN 'Y' ELSE 'T' END AS label,
                 o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS priority,
                 CASE WHEN o_custkey % 7 <> 0 THEN o_totalprice END AS price, CASE WHEN o_custkey % 3 = 0 THEN o_orderstatus END AS status FROM orders),
cells AS (SELECT 'o_orderkey' AS name_column, label, o_orderkey IS NULL AS gone FROM holes UNION ALL SELECT 'priority', label, priority IS NULL FROM holes
          UNION ALL SELECT 'price', label, price IS NULL FROM holes UNION ALL SELECT 'status', label, status IS NULL FROM holes),
missing AS (SELECT name_column, count(*) FILTER (gone) AS count_missing_total, round(100.0 * count(*) FILTER (gone) / count(*), 6) AS percentage_missing_total,
                   count(*) FILTER (gone AND label = 'X') AS count_missing_x, round(100.0 * count(*) FILTER (gone AND label = 'X') / count(*) FILTER (label = 'X'), 6) AS percentage_missing_x,
                   count(*) FILTER (gone AND label = 'Y') AS count_missing_y, round(100.0 * count(*) FILTER (gone AND label = 'Y') / count(*) FILTER (label = 'Y'), 6) AS percentage_missing_y
            FROM cells GROUP BY 1 HAVING count(*) FILTER (gone) > 0)"""
PERCENTS = ("percentage_missing_total", "percentage_missing_x", "percentage_missing_y")


def _holes(spark, sf):
    rows = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    return split_three_way(rows, "year", YEARS_X, YEARS_Y).select(
        "label",
        "o_orderkey",
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("priority"),
        F.when(F.col("o_custkey") % 7 != 0, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderstatus")).alias("status"),
    )


@query("missingness", f"WITH {SQL_HOLES} SELECT * FROM missing")
def missingness(spark, sf):
    return rounded(stats.missingness(_holes(spark, sf)), *PERCENTS)


@query("missingness_top", f"WITH {SQL_HOLES} SELECT * FROM missing ORDER BY count_missing_total DESC, name_column LIMIT 2")
def missingness_top(spark, sf):
    return rounded(stats.top_missing(stats.missingness(_holes(spark, sf)), 2), *PERCENTS)


@query("absence_rates", f"WITH {SQL_HOLES} SELECT * FROM missing WHERE name_column IN ('priority', 'price')")
def absence_rates(spark, sf):
    return rounded(stats.missingness(_holes(spark, sf), ["priority", "price", "garage"]), *PERCENTS)


@query("overview", """
WITH named AS (SELECT CASE WHEN year(o_orderdate) IN (1996, 1997) THEN 'X' WHEN year(o_orderdate) IN (1999, 2000) THEN 'Y' ELSE 'T' END AS label FROM orders),
counts AS (SELECT label, count(*) AS n FROM named GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM named)
SELECT label, n, round(100.0 * n / (SELECT count(*) FROM named), 6) AS share, CAST(7 AS BIGINT) AS n_columns FROM counts""")
def overview(spark, sf):
    rows = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    return rounded(stats.overview(split_three_way(rows, "year", YEARS_X, YEARS_Y)), "share")


@query("zscore_pooled", f"""
WITH {SQL_ORDERS}, fit AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM ords)
SELECT o_orderkey, label, round((o_totalprice - m) / s, 6) + 0.0 AS o_totalprice, CAST(0 AS DOUBLE) AS constant FROM ords, fit""")
def zscore_pooled(spark, sf):
    from twinlens.model import TwoSample

    rows = orders(spark, sf).select("o_orderkey", "label", "o_totalprice", F.lit(3.0).alias("constant"))
    return rounded(stats.scaled(TwoSample.of(rows, "o_orderkey")).frame, "o_totalprice", "constant")


@query("scaling_vectors", """
SELECT CAST(u.i AS INTEGER) - 1 AS id_variable, 'l_' || u.name AS name_variable, round(avg(CASE u.i WHEN 1 THEN l_discount WHEN 2 THEN l_extendedprice WHEN 3 THEN l_quantity ELSE l_tax END), 4) AS mean,
       round(stddev_pop(CASE u.i WHEN 1 THEN l_discount WHEN 2 THEN l_extendedprice WHEN 3 THEN l_quantity ELSE l_tax END), 4) AS std
FROM lineitem, (VALUES (1, 'discount'), (2, 'extendedprice'), (3, 'quantity'), (4, 'tax')) u(i, name)
WHERE year(l_shipdate) IN (1996, 1997, 1999, 2000) GROUP BY 1, 2""")
def scaling_vectors(spark, sf):
    return rounded(stats.scaling(line_sample(spark, sf)), "mean", "std", digits=4)


@query("group_moments", f"""
WITH {SQL_LINES}
SELECT label, 0 AS i, 1 AS j, round(avg(l_extendedprice), 4) AS mean_i, round(avg(l_quantity), 4) AS mean_j, round(covar_samp(l_extendedprice, l_quantity), 2) + 0.0 AS covariance FROM lines GROUP BY 1
UNION ALL SELECT label, 0, 0, round(avg(l_extendedprice), 4), round(avg(l_extendedprice), 4), round(var_samp(l_extendedprice), 2) FROM lines GROUP BY 1
UNION ALL SELECT label, 1, 1, round(avg(l_quantity), 4), round(avg(l_quantity), 4), round(var_samp(l_quantity), 2) FROM lines GROUP BY 1""")
def group_moments(spark, sf):
    moments = stats.group_moments(line_sample(spark, sf).only(["l_extendedprice", "l_quantity"]))
    return rounded(rounded(moments, "mean_i", "mean_j", digits=4), "covariance", digits=2)


@query("grouped_corr_ols", f"""
WITH {SQL_LINES}, g AS (SELECT label, l_returnflag AS state, l_quantity AS x, l_extendedprice AS y FROM lines
                        UNION ALL SELECT label, 'constant', 1.0, l_extendedprice FROM lines)
SELECT label, state, count(*) AS n, CASE WHEN stddev_pop(x) > 1e-5 THEN round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 6) + 0.0 END AS r,
       CASE WHEN stddev_pop(x) > 1e-5 THEN round(covar_pop(x, y) / var_pop(x), 4) + 0.0 END AS slope,
       CASE WHEN stddev_pop(x) > 1e-5 THEN round(avg(y) - covar_pop(x, y) / var_pop(x) * avg(x), 3) + 0.0 END AS intercept FROM g GROUP BY 1, 2""")
def grouped_corr_ols(spark, sf):
    rows = lines(spark, sf).select("label", F.col("l_returnflag").alias("state"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    flat = rows.select("label", F.lit("constant").alias("state"), F.lit(1.0).alias("x"), "y")
    fitted = stats.grouped_line(rows.unionByName(flat), "x", "y", ["label", "state"])
    return rounded(rounded(rounded(fitted, "r"), "slope", digits=4), "intercept", digits=3)


@query("conditional_shift", f"""
WITH {SQL_ORDERS}, g AS (SELECT label, o_orderstatus AS state, o_totalprice AS v FROM ords)
SELECT state, count(*) FILTER (label = 'X') AS n_x, round(avg(v) FILTER (label = 'X'), 4) AS mean_x, round(median(v) FILTER (label = 'X'), 4) AS median_x,
       count(*) FILTER (label = 'Y') AS n_y, round(avg(v) FILTER (label = 'Y'), 4) AS mean_y, round(median(v) FILTER (label = 'Y'), 4) AS median_y,
       round((avg(v) FILTER (label = 'Y') - avg(v) FILTER (label = 'X')) / avg(v) FILTER (label = 'X') * 100, 4) + 0.0 AS percent_shift FROM g GROUP BY 1""")
def conditional_shift(spark, sf):
    rows = orders(spark, sf).select("label", F.col("o_orderstatus").alias("state"), F.col("o_totalprice").alias("v"))
    shifted = stats.conditional_shift(rows, ["state"])
    return rounded(shifted, "mean_x", "median_x", "mean_y", "median_y", "percent_shift", digits=4)


SQL_HISTOGRAM = """
plan AS (SELECT {by}, min(v) AS low, (max(v) - min(v)) / 24 AS width, count(*) FILTER (label = 'X') AS n_x, count(*) FILTER (label = 'Y') AS n_y FROM {source} GROUP BY ALL),
near AS (SELECT s.*, p.low, p.width, least(floor((v - low) / width), 23) AS k FROM {source} s JOIN plan p USING ({by})),
placed AS (SELECT *, CASE WHEN v < low + k * width THEN k - 1 WHEN v >= low + (k + 1) * width AND k < 23 THEN k + 1 ELSE k END AS bin FROM near),
tallies AS (SELECT {by}, CAST(bin AS INTEGER) AS bin, count(*) FILTER (label = 'X') AS cx, count(*) FILTER (label = 'Y') AS cy FROM placed GROUP BY ALL),
spine AS (SELECT p.*, CAST(b.bin AS INTEGER) AS bin FROM plan p, (SELECT unnest(range(0, 24)) AS bin) b),
histogram AS (SELECT {by}, bin, round(low + bin * width, 6) AS low, round(low + (bin + 1) * width, 6) AS high, coalesce(cx, 0) AS count_x, coalesce(cy, 0) AS count_y,
       round(coalesce(cx, 0) / (n_x * width), 8) AS density_x, round(coalesce(cy, 0) / (n_y * width), 8) AS density_y FROM spine LEFT JOIN tallies USING ({by}, bin))"""


@query("histogram_two_sample", f"""
WITH {SQL_LINES_LONG}, {SQL_HISTOGRAM.format(by='id_variable', source='long')}
SELECT * FROM histogram""")
def histogram_two_sample(spark, sf):
    long = line_sample(spark, sf).long()
    made = stats.histogram(long, stats.variable_ranges(long, ["id_variable"]), ["id_variable"])
    return rounded(rounded(made, "low", "high"), "density_x", "density_y", digits=8)


@query("discrete_shares", f"""
WITH {SQL_LINES}, cells AS (SELECT label, 'linenumber' AS name, CAST(l_linenumber AS DOUBLE) AS v FROM lines UNION ALL SELECT label, 'tax', l_tax FROM lines
                            UNION ALL SELECT label, 'status', CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END FROM lines
                            UNION ALL SELECT label, 'flag', CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 2.0 ELSE 3.0 END FROM lines),
few AS (SELECT name, count(*) FILTER (label = 'X') AS nx, count(*) FILTER (label = 'Y') AS ny FROM cells GROUP BY 1 HAVING count(DISTINCT v) <= 5)
SELECT name, v AS value, count(*) FILTER (label = 'X') AS count_x, count(*) FILTER (label = 'Y') AS count_y,
       round(count(*) FILTER (label = 'X') / any_value(nx), 6) AS share_x, round(count(*) FILTER (label = 'Y') / any_value(ny), 6) AS share_y
FROM cells JOIN few USING (name) GROUP BY 1, 2""")
def discrete_shares(spark, sf):
    rows = lines(spark, sf).select(
        "label",
        F.col("l_linenumber").alias("linenumber"),
        F.col("l_tax").alias("tax"),
        F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0).alias("status"),
        F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "N", 2.0).otherwise(3.0).alias("flag"),
    )
    cells = stats.unpivot_numbers(rows, ["linenumber", "tax", "status", "flag"], name="name")
    return rounded(stats.discrete_shares(cells, stats.variable_ranges(cells, ["name"]), ["name"]), "share_x", "share_y")


@query("kde_grid", f"""
WITH {SQL_LINES}, pts AS (SELECT label, l_extendedprice AS v FROM lines),
fit AS (SELECT label, count(*) AS n, stddev_samp(v) * pow(count(*), -0.2) AS h FROM pts GROUP BY 1),
span AS (SELECT min(v) AS lo, max(v) AS hi FROM pts),
grid AS (SELECT CAST(i AS INTEGER) AS point, lo + i * (hi - lo) / 199 AS at FROM span, (SELECT unnest(range(0, 200)) AS i))
SELECT p.label, g.point, round(g.at, 4) AS at, round(sum(exp(-0.5 * pow((g.at - p.v) / f.h, 2))) / (any_value(f.n) * any_value(f.h) * sqrt(2 * pi())), 10) AS density
FROM grid g, pts p JOIN fit f USING (label) GROUP BY 1, 2, g.at""")
def kde_grid(spark, sf):
    grid = stats.density_grid(lines(spark, sf), "l_extendedprice")
    return rounded(rounded(grid, "at", digits=4), "density", digits=10)


@query("split_text_values", """
SELECT CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 'X' ELSE 'Y' END AS label, count(*) AS n, round(avg(c_acctbal), 4) AS mean
FROM customer WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD', 'MACHINERY') GROUP BY 1""")
def split_text_values(spark, sf):
    """A split by text values."""
    split = split_by_values(table(spark, sf, "customer"), "c_mktsegment", ["BUILDING", "HOUSEHOLD"], ["MACHINERY"])
    return rounded(split.groupBy("label").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("mean")), "mean", digits=4)

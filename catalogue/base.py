"""Registry of catalogue queries, the samples they share, and the same samples in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from twinlens.model import TwoSample
from twinlens.operators.sample import split_by_values
from twinlens.runtime import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

YEARS_X, YEARS_Y = [1996, 1997], [1999, 2000]
LINE_FEATURES = ("l_discount", "l_extendedprice", "l_quantity", "l_tax")
DIMENSIONS = 64
VECTOR_FEATURES = tuple(f"e{i:02d}" for i in range(DIMENSIONS))


def query(name: str, sql: str | None = None):
    """Registers a query under a name, with the SQL that gives the same rows."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(column: Column | str, digits: int = 6) -> Column:
    """Rounded value; adding zero turns -0.0 into 0.0."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, digits) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*[r(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def _by_year(df: DataFrame, date: str) -> DataFrame:
    """Year column behind a date range that the scan can use to skip row groups."""
    inside = (F.col(date) >= F.lit("1996-01-01").cast("timestamp")) & (F.col(date) < F.lit("2001-01-01").cast("timestamp"))
    return spread(df.where(inside)).withColumn("year", F.year(date))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items shipped in 1996-97 (X) and 1999-2000 (Y)."""
    return split_by_values(_by_year(table(spark, sf, "lineitem"), "l_shipdate"), "year", YEARS_X, YEARS_Y)


def line_sample(spark: SparkSession, sf: str) -> TwoSample:
    return TwoSample(lines(spark, sf), LINE_FEATURES)


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders placed in 1996-97 (X) and 1999-2000 (Y)."""
    return split_by_values(_by_year(table(spark, sf, "orders"), "o_orderdate"), "year", YEARS_X, YEARS_Y)


def vectors(spark: SparkSession, sf: str) -> TwoSample:
    """Embeddings with one column per dimension; labels below 5 are X, the others Y."""
    raw = table(spark, sf, "embeddings")
    names = [f"CAST(embedding[{i}] AS DOUBLE) AS {n}" for i, n in enumerate(VECTOR_FEATURES)]
    frame = raw.selectExpr("vec_id", "CASE WHEN label < 5 THEN 'X' ELSE 'Y' END AS label", *names)
    return TwoSample(frame, VECTOR_FEATURES, key="vec_id")


# ---- the same samples in SQL ------------------------------------------------------------------------------------

SQL_LINES = """
lines AS (SELECT *, year(l_shipdate) AS yr, CASE WHEN year(l_shipdate) IN (1996, 1997) THEN 'X' ELSE 'Y' END AS label
          FROM lineitem WHERE year(l_shipdate) IN (1996, 1997, 1999, 2000))"""

SQL_LINES_LONG = SQL_LINES + """,
long AS (SELECT label, 0 AS id_variable, 'l_discount' AS name_variable, l_discount AS v FROM lines
         UNION ALL SELECT label, 1, 'l_extendedprice', l_extendedprice FROM lines
         UNION ALL SELECT label, 2, 'l_quantity', l_quantity FROM lines
         UNION ALL SELECT label, 3, 'l_tax', l_tax FROM lines)"""

SQL_ORDERS = """
ords AS (SELECT *, CASE WHEN year(o_orderdate) IN (1996, 1997) THEN 'X' ELSE 'Y' END AS label
         FROM orders WHERE year(o_orderdate) IN (1996, 1997, 1999, 2000))"""

SQL_VECTORS = """
vecs AS (SELECT vec_id, CASE WHEN label < 5 THEN 'X' ELSE 'Y' END AS label, embedding FROM embeddings),
long AS (SELECT vec_id, label, CAST(u.i AS INTEGER) - 1 AS id_variable, 'e' || lpad(CAST(u.i - 1 AS VARCHAR), 2, '0') AS name_variable,
                CAST(embedding[u.i] AS DOUBLE) AS v
         FROM vecs, (SELECT unnest(range(1, 65)) AS i) u)"""

# pooled mean and standard deviation per variable of the CTE ``long``
SQL_SCALING = """
scaling AS (SELECT id_variable, any_value(name_variable) AS name_variable, avg(v) AS mean, stddev_pop(v) AS std FROM long GROUP BY 1)"""

# 1-D Wasserstein distance of the pooled z-scores per variable of ``long``
SQL_WASSERSTEIN = SQL_SCALING + """,
counts AS (SELECT id_variable, v, count(*) FILTER (label = 'X') AS nx, count(*) FILTER (label = 'Y') AS ny FROM long GROUP BY 1, 2),
steps AS (SELECT id_variable,
                 abs(CAST(sum(nx) OVER w AS DOUBLE) / sum(nx) OVER a - CAST(sum(ny) OVER w AS DOUBLE) / sum(ny) OVER a) AS gap,
                 lead(v) OVER w - v AS step
          FROM counts WINDOW w AS (PARTITION BY id_variable ORDER BY v ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY id_variable)),
weights AS (SELECT s.id_variable, s.name_variable, sum(gap * step) / CASE WHEN any_value(std) < 1e-8 THEN 1 ELSE any_value(std) END AS weight
            FROM steps JOIN scaling s USING (id_variable) GROUP BY 1, 2),
normed AS (SELECT id_variable, name_variable, weight / max(weight) OVER () AS weight FROM weights)"""


def sql_selection(source: str = "normed", approach: str = "hist_based", threshold: float = 0.1, top_k: int = 5, trim: bool = False) -> str:
    """CTE ``selection``: anchors cut from ``source (id_variable, name_variable, weight)``."""
    if approach == "threshold":
        cut = f"cutoff AS (SELECT CAST({threshold} AS DOUBLE) AS cut)"
    else:
        cut = f"""
bins AS (SELECT i, (SELECT count(*) FROM {source} WHERE least(floor(weight / (SELECT max(weight) FROM {source}) * 20 + 1e-9), 19) = i) AS n
         FROM (SELECT unnest(range(0, 20)) AS i)),
peaks AS (SELECT min(i) AS lo, max(i) AS hi FROM (SELECT i FROM bins ORDER BY n DESC, i LIMIT 2)),
valley AS (SELECT coalesce(
             (SELECT min(i) FROM bins WHERE n = 0 AND i > (SELECT min(i) FROM bins WHERE n > 0)),
             (SELECT i FROM bins, peaks WHERE i > lo AND i < hi ORDER BY n, i LIMIT 1)) AS i),
cutoff AS (SELECT (i + 1) / 20.0 * (SELECT max(weight) FROM {source}) AS cut FROM valley)"""
    trimmed = f"OR (NOT (SELECT bool_and(hit) FROM marked) AND hit AND hit_place <= {top_k}) OR ((SELECT bool_and(hit) FROM marked) AND place <= {top_k})" if trim else "OR hit"
    return f"""{cut},
marked AS (SELECT *, row_number() OVER (ORDER BY weight DESC, id_variable) AS place, row_number() OVER (PARTITION BY hit ORDER BY weight DESC, id_variable) AS hit_place
           FROM (SELECT *, coalesce(weight >= (SELECT cut FROM cutoff) - 1e-12, false) AS hit FROM {source})),
selection AS (SELECT id_variable, name_variable, weight FROM marked
              WHERE (NOT (SELECT bool_or(hit) FROM marked) AND place <= {top_k}) {trimmed})"""

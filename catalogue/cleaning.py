"""Cleaning, imputation and encoding. Missing values are derived from the tables, which have none."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinlens.operators import clean, encode

from .base import SQL_ORDERS, orders, query, rounded, table

SQL_GAPS = """
gaps AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS priority,
                CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price,
                CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS status,
                CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_custkey % 4 AS INTEGER) END AS code FROM orders)"""


def _gaps(spark, sf):
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        key,
        F.when(key % 5 != 0, F.col("o_orderpriority")).alias("priority"),
        F.when(key % 7 != 0, F.col("o_totalprice")).alias("price"),
        F.when(key % 3 != 0, F.col("o_orderstatus")).alias("status"),
        F.when(key % 11 != 0, (F.col("o_custkey") % 4).cast("int")).alias("code"),
    )


@query("absence_fill", f"""
WITH {SQL_GAPS}
SELECT o_orderkey, coalesce(priority, 'None') AS priority, coalesce(price, 0.0) AS price FROM gaps""")
def absence_fill(spark, sf):
    filled = clean.fill_absent_categories(_gaps(spark, sf), ["priority", "not_there"])
    return clean.fill_absent_numbers(filled, ["price"]).select("o_orderkey", "priority", "price")


@query("numeric_coercion", """
WITH texts AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'n/a' WHEN event_id % 10 = 0 THEN 'nan'
                                     ELSE regexp_extract(props, '[0-9]+') END AS k FROM events)
SELECT event_id, CASE WHEN isnan(TRY_CAST(k AS DOUBLE)) THEN NULL ELSE TRY_CAST(k AS DOUBLE) END AS k FROM texts""")
def numeric_coercion(spark, sf):
    event = F.col("event_id")
    text = F.when(event % 9 == 0, "n/a").when(event % 10 == 0, "nan").otherwise(F.regexp_extract("props", "[0-9]+", 0))
    return clean.coerce_numbers(table(spark, sf, "events").select("event_id", text.alias("k")), ["k"])


@query("drop_missing_ids", """
SELECT event_id, CAST(user_id AS BIGINT) AS iid, CASE WHEN event_id % 4 = 0 THEN 1 ELSE CAST(event_id % 21 AS INTEGER) END AS wave
FROM events WHERE event_id % 6 <> 0""")
def drop_missing_ids(spark, sf):
    event = F.col("event_id")
    cards = table(spark, sf, "events").select(
        event,
        F.when(event % 6 != 0, F.concat(F.col("user_id").cast("string"), F.lit(".0"))).alias("iid"),
        F.when(event % 4 != 0, (event % 21).cast("double")).alias("wave"),
    )
    return clean.fill_group_id(clean.drop_missing_ids(cards, ["iid"]), "wave")


SQL_PARTS = """
parts AS (SELECT p_partkey, CASE WHEN p_partkey % 13 <> 0 THEN p_brand END AS brand,
                 CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_size AS DOUBLE) END AS size FROM part)"""


@query("impute_group_median", f"""
WITH {SQL_PARTS}, per_brand AS (SELECT brand, median(size) AS m FROM parts WHERE brand IS NOT NULL GROUP BY 1)
SELECT p_partkey, brand, coalesce(size, m, (SELECT median(size) FROM parts), 60.0) AS size FROM parts LEFT JOIN per_brand USING (brand)""")
def impute_group_median(spark, sf):
    key = F.col("p_partkey")
    parts = table(spark, sf, "part").select(
        key, F.when(key % 13 != 0, F.col("p_brand")).alias("brand"), F.when(key % 7 != 0, F.col("p_size").cast("double")).alias("size")
    )
    return clean.impute_group_median(parts, "size", "brand")


@query("impute_median", f"""
WITH {SQL_GAPS}
SELECT o_orderkey, round(coalesce(price, (SELECT median(price) FROM gaps)), 4) AS price, 5.0::DOUBLE AS absent FROM gaps""")
def impute_median(spark, sf):
    rows = _gaps(spark, sf).select("o_orderkey", "price", F.lit(None).cast("double").alias("absent"))
    return rounded(clean.impute_medians(rows, ["price", "absent"]), "price", digits=4)


@query("impute_mode", f"""
WITH {SQL_GAPS}, best AS (SELECT code FROM gaps WHERE code IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, code LIMIT 1)
SELECT o_orderkey, coalesce(code, (SELECT code FROM best)) AS code, 1 AS absent FROM gaps""")
def impute_mode(spark, sf):
    rows = _gaps(spark, sf).select("o_orderkey", "code", F.lit(None).cast("int").alias("absent"))
    return clean.impute_modes(rows, ["code", "absent"])


@query("impute_generic", f"""
WITH {SQL_GAPS}, best AS (SELECT status FROM gaps WHERE status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, status LIMIT 1)
SELECT o_orderkey, round(coalesce(price, (SELECT median(price) FROM gaps)), 4) AS price, coalesce(status, (SELECT status FROM best)) AS status FROM gaps""")
def impute_generic(spark, sf):
    rows = clean.impute_generic(_gaps(spark, sf).select("o_orderkey", "price", "status"))
    return rounded(rows, "price", digits=4)


PRIORITIES = {"1-URGENT": 5, "2-HIGH": 4, "3-MEDIUM": 3, "5-LOW": 1}


@query("ordinal_encode", f"""
WITH {SQL_GAPS}
SELECT o_orderkey, CAST(CASE priority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 1 ELSE 0 END AS DOUBLE) AS priority
FROM gaps""")
def ordinal_encode(spark, sf):
    """One priority is left out of the scale and some are missing; both count as 0."""
    return encode.encode_ordinal(_gaps(spark, sf).select("o_orderkey", "priority"), {"priority": PRIORITIES})


@query("onehot_encode", f"""
WITH {SQL_GAPS}
SELECT o_orderkey, CAST(coalesce(status = 'F', false) AS DOUBLE) AS "status_F", CAST(coalesce(status = 'O', false) AS DOUBLE) AS "status_O",
       CAST(coalesce(status = 'P', false) AS DOUBLE) AS "status_P" FROM gaps""")
def onehot_encode(spark, sf):
    table_, _ = encode.encode_onehot(_gaps(spark, sf).select("o_orderkey", "status"))
    return table_


@query("onehot_long", """
SELECT doc_id, 'lang_' || lang AS feature FROM documents UNION ALL SELECT doc_id, 'source_' || source FROM documents""")
def onehot_long(spark, sf):
    return encode.onehot_long(table(spark, sf, "documents"), "doc_id", ["lang", "source"])


SPARSE = ["o_custkey", "o_orderpriority", "o_orderstatus"]
SQL_SPARSE = """
cells AS (SELECT o_orderkey, concat(name, '_', v) AS feature FROM (SELECT o_orderkey, 'o_custkey' AS name, CAST(o_custkey AS VARCHAR) AS v FROM orders
  UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders UNION ALL SELECT o_orderkey, 'o_orderstatus', o_orderstatus FROM orders) WHERE v IS NOT NULL),
ids AS (SELECT feature, CAST(row_number() OVER (ORDER BY feature) - 1 AS INTEGER) AS id_variable FROM (SELECT DISTINCT feature FROM cells)),
sparse AS (SELECT o_orderkey, id_variable FROM cells JOIN ids USING (feature)),
scale AS (SELECT id_variable, count(*) / (SELECT count(*) FROM orders) AS mean FROM sparse GROUP BY 1)"""


@query("onehot_sparse", f"WITH {SQL_SPARSE} SELECT o_orderkey, id_variable FROM sparse")
def onehot_sparse(spark, sf):
    """A category per customer: as many columns as there are customers, in one sparse one."""
    rows, _ = encode.encode_sparse(table(spark, sf, "orders"), "o_orderkey", SPARSE)
    return rows.select("o_orderkey", F.explode("indices").alias("id_variable"))


@query("onehot_sparse_scaling", f"WITH {SQL_SPARSE} SELECT id_variable, round(mean, 8) + 0.0 AS mean, round(sqrt(mean * (1 - mean)), 8) + 0.0 AS std FROM scale")
def onehot_sparse_scaling(spark, sf):
    sales = table(spark, sf, "orders")
    rows, _ = encode.encode_sparse(sales, "o_orderkey", SPARSE)
    return rounded(encode.sparse_scaling(rows, sales.count()), "mean", "std", digits=8)


@query("onehot_sparse_pearson", f"""
WITH {SQL_SPARSE}, both_ AS (SELECT a.id_variable AS id_variable_1, b.id_variable AS id_variable_2, count(*) / (SELECT count(*) FROM orders) AS share
  FROM sparse a JOIN sparse b ON a.o_orderkey = b.o_orderkey AND a.id_variable < b.id_variable GROUP BY 1, 2)
SELECT id_variable_1, id_variable_2, round(least(abs(share - p.mean * q.mean) / sqrt(p.mean * (1 - p.mean) * q.mean * (1 - q.mean)), 1), 6) + 0.0 AS correlation_score
FROM both_ JOIN scale p ON p.id_variable = id_variable_1 JOIN scale q ON q.id_variable = id_variable_2 WHERE p.mean < 1 AND q.mean < 1""")
def onehot_sparse_pearson(spark, sf):
    sales = table(spark, sf, "orders")
    rows, _ = encode.encode_sparse(sales, "o_orderkey", SPARSE)
    return rounded(encode.sparse_pearson(rows, sales.count()), "correlation_score")


@query("leakage_drop", """
SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders""")
def leakage_drop(spark, sf):
    return encode.drop_columns(table(spark, sf, "orders"), ["o_orderdate", "o_custkey", "o_orderstatus", "Id"])


SQL_SIDES = SQL_ORDERS + """,
x AS (SELECT o_orderkey, o_totalprice, CAST(o_orderstatus = 'F' AS DOUBLE) AS status_f FROM ords WHERE label = 'X'),
y AS (SELECT o_orderkey, o_totalprice, CAST(o_orderstatus = 'O' AS DOUBLE) AS status_o FROM ords WHERE label = 'Y')"""


def _sides(spark, sf):
    both = orders(spark, sf)
    status = lambda s: (F.col("o_orderstatus") == s).cast("double")
    x = both.where(F.col("label") == "X").select("o_orderkey", "o_totalprice", status("F").alias("status_f"))
    y = both.where(F.col("label") == "Y").select("o_orderkey", "o_totalprice", status("O").alias("status_o"))
    return x, y


@query("align_columns_union", f"""
WITH {SQL_SIDES}
SELECT o_orderkey, o_totalprice, status_f, CAST(0 AS DOUBLE) AS status_o FROM x
UNION ALL SELECT o_orderkey, o_totalprice, CAST(0 AS DOUBLE), status_o FROM y""")
def align_columns_union(spark, sf):
    x, y = encode.align_union(*_sides(spark, sf))
    return x.unionByName(y)


@query("align_columns_intersection", f"""
WITH {SQL_SIDES}
SELECT o_orderkey, o_totalprice FROM x UNION ALL SELECT o_orderkey, o_totalprice FROM y""")
def align_columns_intersection(spark, sf):
    x, y = encode.align_intersection(*_sides(spark, sf))
    return x.unionByName(y)


@query("final_guard", f"""
WITH {SQL_GAPS}
SELECT coalesce(price, 0.0) AS price, coalesce(TRY_CAST(priority AS DOUBLE), 0.0) AS priority, CAST(coalesce(code, 0) AS DOUBLE) AS code FROM gaps""")
def final_guard(spark, sf):
    return encode.numeric_guard(_gaps(spark, sf).select("price", "priority", "code"))

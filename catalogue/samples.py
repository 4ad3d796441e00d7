"""Splits, caps, parts and scopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinlens.model import TwoSample
from twinlens.operators import sample

from .base import SQL_LINES, SQL_ORDERS, YEARS_X, YEARS_Y, lines, orders, query, r, rounded, table, vectors


@query("split_value_sets", f"""
WITH {SQL_LINES}
SELECT label, CAST(yr AS INTEGER) AS year, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lines GROUP BY 1, 2""")
def split_value_sets(spark, sf):
    return lines(spark, sf).groupBy("label", "year").agg(F.count("*").alias("n"), r(F.sum("l_quantity"), 2).alias("quantity"))


@query("split_flag", """
SELECT CASE WHEN l.quality = 1 THEN 'X' ELSE 'Y' END AS label, d.doc_id, d.lang, l.toxic
FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IN (0, 1)""")
def split_flag(spark, sf):
    rated = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return sample.split_by_flag(rated, "quality").select("label", "doc_id", "lang", "toxic")


@query("split_transition", """
SELECT CASE WHEN year(o_orderdate) IN (1996, 1997) THEN 'X' WHEN year(o_orderdate) IN (1999, 2000) THEN 'Y' ELSE 'T' END AS label,
       o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2""")
def split_transition(spark, sf):
    dated = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    split = sample.split_three_way(dated, "year", YEARS_X, YEARS_Y, key="o_orderkey")
    return split.groupBy("label", "o_orderstatus").agg(F.count("*").alias("n"))


@query("split_halves", """
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= (SELECT count(*) // 2 FROM orders) THEN 'X' ELSE 'Y' END AS label
FROM orders""")
def split_halves(spark, sf):
    """Without the split column the table falls into two halves of its keys."""
    halves = sample.split_three_way(table(spark, sf, "orders"), "no_such_column", YEARS_X, YEARS_Y, key="o_orderkey")
    return halves.select("o_orderkey", "label")


@query("split_halves_text", """
WITH d AS (SELECT doc_id, concat(lang, '/', source, '/', doc_id) AS key FROM documents)
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY key) <= (SELECT count(*) // 2 FROM d) THEN 'X' ELSE 'Y' END AS label FROM d""")
def split_halves_text(spark, sf):
    """Text keys, in the order of their bytes."""
    docs = table(spark, sf, "documents").select("doc_id", F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("key"))
    return sample.split_in_halves(docs, "key").select("doc_id", "label")


@query("split_halves_large", """
SELECT o_orderkey, CASE WHEN ntile(2) OVER (ORDER BY o_orderkey DESC) = 1 THEN 'Y' ELSE 'X' END AS label FROM orders""")
def split_halves_large(spark, sf):
    """Whole numbers beyond 2^53, which doubles would merge."""
    large = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") + F.lit(1 << 62)).alias("key"))
    return sample.split_in_halves(large, "key").select("o_orderkey", "label")


@query("capped_repeats", """
WITH c AS (SELECT label, count(*) AS n FROM (SELECT CASE WHEN year(o_orderdate) IN (1996, 1997) THEN 'X' ELSE 'Y' END AS label
  FROM orders WHERE year(o_orderdate) IN (1996, 1997, 1999, 2000)) GROUP BY 1)
SELECT label, least(n, 500) AS n FROM c""")
def capped_repeats(spark, sf):
    """A key that stands on many rows: the cap still takes no more than it was asked for."""
    repeated = orders(spark, sf).withColumn("key", (F.col("o_orderkey") % 7).cast("string"))
    return sample.capped(repeated, "key", 500).groupBy("label").agg(F.count("*").alias("n"))


SQL_CARDS_FLAG = """
flagged AS (SELECT event_id, user_id, value, CASE WHEN value >= 50 THEN 1 WHEN value >= 10 THEN 0 END AS match FROM events)"""


def _flagged(spark, sf):
    value = F.col("value")
    return table(spark, sf, "events").select("event_id", "user_id", "value", F.when(value >= 50, 1).when(value >= 10, 0).alias("match"))


@query("split_rest", f"""
WITH {SQL_CARDS_FLAG}
SELECT CASE WHEN match = 1 THEN 'X' ELSE 'Y' END AS label, match, count(*) AS n FROM flagged GROUP BY 1, 2""")
def split_rest(spark, sf):
    """Report split: rows without a flag belong to Y."""
    return sample.split_rest(_flagged(spark, sf)).groupBy("label", "match").agg(F.count("*").alias("n"))


@query("split_rest_decisions", f"""
WITH {SQL_CARDS_FLAG}, decided AS (SELECT event_id, match AS dec, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS dec_o FROM flagged)
SELECT CASE WHEN dec = 1 AND dec_o = 1 THEN 'X' ELSE 'Y' END AS label, dec, dec_o, count(*) AS n FROM decided GROUP BY 1, 2, 3""")
def split_rest_decisions(spark, sf):
    decided = _flagged(spark, sf).select(
        "event_id", F.col("match").alias("dec"), F.when(F.col("user_id") % 2 == 0, 1).otherwise(0).alias("dec_o")
    )
    return sample.split_rest(decided).groupBy("label", "dec", "dec_o").agg(F.count("*").alias("n"))


SQL_RANKED = SQL_ORDERS + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || o_orderkey), o_orderkey) AS place,
                  count(*) OVER (PARTITION BY label) AS total FROM ords)"""


@query("capped_sample", f"""
WITH {SQL_RANKED}
SELECT label, o_orderkey, o_totalprice, o_orderstatus FROM ranked WHERE place <= 500""")
def capped_sample(spark, sf):
    return sample.capped(orders(spark, sf), "o_orderkey", 500).select("label", "o_orderkey", "o_totalprice", "o_orderstatus")


@query("capped_sizes", f"""
WITH {SQL_ORDERS}
SELECT label, count(*) AS n_original, least(count(*), 500) AS n_kept FROM ords GROUP BY 1""")
def capped_sizes(spark, sf):
    return sample.capped_sizes(orders(spark, sf), 500)


@query("train_test_split", f"""
WITH {SQL_RANKED}, sized AS (SELECT *, greatest(5, CAST(floor(0.8 * total) AS BIGINT)) AS n_train FROM ranked)
SELECT label, o_orderkey, place <= n_train AS is_train, place > n_train OR total <= n_train AS is_test FROM sized""")
def train_test_split(spark, sf):
    return sample.train_test_parts(orders(spark, sf), "o_orderkey", 0.8).select("label", "o_orderkey", "is_train", "is_test")


@query("scoped_counts", f"""
WITH {SQL_ORDERS}, whole AS (SELECT label, count(*) AS n FROM ords GROUP BY 1)
SELECT s.stage, s.scope, w.label, CASE WHEN s.scope = 'subset' THEN least(n, 500) ELSE n END AS n, n AS n_original,
       CASE WHEN s.scope = 'subset' AND n > 500 THEN 'sub-sample' ELSE 'whole sample' END AS source
FROM whole w, (VALUES ('selection', 'subset'), ('analysis', 'subset'), ('report', 'whole')) s(stage, scope)""")
def scoped_counts(spark, sf):
    from twinlens.operators.report import scope_summary

    whole = TwoSample.of(orders(spark, sf).select("o_orderkey", "label", "o_totalprice"), "o_orderkey")
    return scope_summary(whole, {"selection": "subset", "analysis": "subset", "report": "whole"}, 500)


@query("scoped_scaling", """
WITH ranked AS (SELECT CASE WHEN label < 5 THEN 'X' ELSE 'Y' END AS label, CAST(embedding[1] AS DOUBLE) AS e, vec_id FROM embeddings),
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || vec_id), vec_id) AS place FROM ranked) WHERE place <= 100),
fit AS (SELECT avg(e) AS m, stddev_pop(e) AS s FROM capped)
SELECT label, vec_id, round((e - m) / s, 6) + 0.0 AS e00 FROM capped, fit""")
def scoped_scaling(spark, sf):
    """The scaler is fitted again on the capped scope."""
    from twinlens.operators.stats import scaled

    part = sample.in_scope(vectors(spark, sf).only(["e00"]), "subset", 100)
    return rounded(scaled(part).frame.select("label", "vec_id", "e00"), "e00")


@query("anchor_state_split", f"""
WITH {SQL_LINES}, flags AS (SELECT label, l_quantity, CASE WHEN l_returnflag = 'R' THEN 1.0 WHEN l_returnflag = 'A' THEN 0.0 END AS is_returned,
                                   CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END AS is_open FROM lines)
SELECT anchor, CAST(state AS DOUBLE) AS anchor_state, label, count(*) AS n, round(sum(l_quantity), 2) AS quantity
FROM (SELECT 'is_returned' AS anchor, is_returned AS state, label, l_quantity FROM flags UNION ALL SELECT 'is_open', is_open, label, l_quantity FROM flags)
WHERE state IN (0, 1) GROUP BY 1, 2, 3""")
def anchor_state_split(spark, sf):
    flags = lines(spark, sf).select(
        "label",
        "l_quantity",
        F.when(F.col("l_returnflag") == "R", 1.0).when(F.col("l_returnflag") == "A", 0.0).alias("is_returned"),
        F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0).alias("is_open"),
    )
    states = sample.anchor_states(flags, ["is_returned", "is_open"], ["label", "l_quantity"])
    return states.groupBy("anchor", "anchor_state", "label").agg(F.count("*").alias("n"), r(F.sum("l_quantity"), 2).alias("quantity"))


@query("pooled_union", """
SELECT label, count(*) AS n, round(sum(balance), 2) AS balance FROM (
  SELECT 'X' AS label, c_acctbal AS balance FROM customer UNION ALL SELECT 'Y', s_acctbal FROM supplier) GROUP BY 1""")
def pooled_union(spark, sf):
    x = table(spark, sf, "customer").select(F.col("c_acctbal").alias("balance"))
    y = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"))
    return sample.pooled(x, y).groupBy("label").agg(F.count("*").alias("n"), r(F.sum("balance"), 2).alias("balance"))

"""Scans, sinks and the warehouse: written to the shared folder, read back and compared with the source table."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinlens.operators import relate
from twinlens.runtime import fresh_folder
from twinlens.sources import tables

from .base import SQL_VECTORS, query, r, rounded, table, vectors
from .relations import SQL_RELATION
from .themes import SQL_THEMES, SQL_TWO, themed, two_subspaces


@query("csv_scan", """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS o_orderstatus, o_totalprice,
       CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_custkey % 7 AS BIGINT) END AS code FROM orders""")
def csv_scan(spark, sf):
    """Header, inferred types, and two spellings of a missing value."""
    folder = fresh_folder(spark, "csv")
    key = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.when(key % 3 != 0, F.col("o_orderstatus")).otherwise("NA").alias("o_orderstatus"), "o_totalprice",
        F.when(key % 4 != 0, (F.col("o_custkey") % 7).cast("string")).otherwise("n/a").alias("code"),
    )
    rows.write.option("header", True).csv(folder)
    return tables.read_csv(spark, folder)


def _stored(spark, sf):
    store = tables.Warehouse(spark, fresh_folder(spark, "warehouse"))
    store.write_features(vectors(spark, sf).only(["e00", "e01", "e02"]), {"dataset_name": "embeddings"})
    return store


@query("warehouse_roundtrip", f"""
WITH {SQL_VECTORS}
SELECT vec_id AS sample_id, label, CAST(embedding[1] AS DOUBLE) AS e00, CAST(embedding[2] AS DOUBLE) AS e01, CAST(embedding[3] AS DOUBLE) AS e02 FROM vecs""")
def warehouse_roundtrip(spark, sf):
    return _stored(spark, sf).read_features().frame.select("sample_id", "label", "e00", "e01", "e02")


@query("warehouse_side", f"""
WITH {SQL_VECTORS}
SELECT vec_id AS sample_id, CAST(embedding[1] AS DOUBLE) AS e00 FROM vecs WHERE label = 'X'""")
def warehouse_side(spark, sf):
    """Only the directory of one label is read."""
    return _stored(spark, sf).read_side("X").select("sample_id", "e00")


@query("array_roundtrip", f"""
WITH {SQL_VECTORS}
SELECT vec_id AS key, label, CAST(embedding[1] AS DOUBLE) AS e00, CAST(embedding[64] AS DOUBLE) AS e63 FROM vecs""")
def array_roundtrip(spark, sf):
    store = tables.Warehouse(spark, fresh_folder(spark, "arrays"))
    store.write_arrays("matrices", vectors(spark, sf))
    return store.read_arrays("matrices").frame.select("key", "label", "e00", "e63")


@query("metadata_upsert", """
WITH log AS (SELECT event_type || '-' || (user_id % 50) AS key, CAST(event_id AS VARCHAR) AS value, event_id FROM events),
old AS (SELECT key, arg_max(value, event_id) AS value FROM log WHERE event_id % 2 = 0 GROUP BY 1),
new AS (SELECT key, arg_max(value, event_id) AS value FROM log WHERE event_id % 5 = 0 GROUP BY 1)
SELECT key, coalesce(n.value, o.value) AS value FROM old o FULL JOIN new n USING (key)""")
def metadata_upsert(spark, sf):
    log = table(spark, sf, "events").select(
        F.concat_ws("-", "event_type", (F.col("user_id") % 50).cast("string")).alias("key"), F.col("event_id").cast("string").alias("value"), F.col("event_id").alias("seq")
    )
    old, new = (tables.latest_by_key(log.where(F.col("seq") % step == 0)) for step in (2, 5))
    return tables.upsert(old, new)


@query("metadata_log", """
SELECT 'dataset_name' AS key, 'embeddings' AS value UNION ALL SELECT 'scope_report', 'whole' UNION ALL SELECT 'num_features', '3'
UNION ALL SELECT 'n_samples_x', CAST(count(*) FILTER (label < 5) AS VARCHAR) FROM embeddings
UNION ALL SELECT 'n_samples_y', CAST(count(*) FILTER (label >= 5) AS VARCHAR) FROM embeddings""")
def metadata_log(spark, sf):
    store = _stored(spark, sf)
    store.put_metadata({"scope_report": "subset", "num_features": "0"})
    store.put_metadata({"scope_report": "whole", "num_features": "3"})
    return store.metadata()


@query("warehouse_sql", f"""
WITH {SQL_RELATION}, edges AS (SELECT * FROM relation WHERE correlation_score >= 0.1)
SELECT id_variable_1, count(*) AS n, round(max(correlation_score), 6) AS strongest FROM edges GROUP BY 1""")
def warehouse_sql(spark, sf):
    store = tables.Warehouse(spark, fresh_folder(spark, "warehouse"))
    store.write_result("analysis_variable_correlation", relate.edges(relate.absolute_pearson(vectors(spark, sf)), 0.1))
    return store.sql(
        "SELECT id_variable_1, count(*) AS n, round(max(correlation_score), 6) AS strongest FROM analysis_variable_correlation GROUP BY id_variable_1"
    )


@query("supplement_join", """
SELECT o.o_orderkey, o.o_totalprice, o.o_orderpriority, o.o_orderstatus FROM orders o""")
def supplement_join(spark, sf):
    raw = table(spark, sf, "orders")
    return tables.supplement(raw.select("o_orderkey", "o_totalprice"), raw, "o_orderkey", ["o_orderpriority", "o_orderstatus", "not_there"])


def _results(spark, sf):
    """All four result tables, written and read back."""
    store = tables.Warehouse(spark, fresh_folder(spark, "warehouse"))
    selection, relation, clusters = themed(spark, sf)
    store.write_result("analysis_variable_selection", selection)
    store.write_result("analysis_variable_correlation", relate.edges(relation, 0.1))
    store.write_result("analysis_variable_clustering", clusters)
    store.write_prototypes(two_subspaces(spark, sf))
    return store


@query("cluster_export", f"""
WITH {SQL_THEMES}
SELECT id_variable, name_variable, id_cluster, round(score_related, 6) AS score_related FROM clusters""")
def cluster_export(spark, sf):
    store = tables.Warehouse(spark, fresh_folder(spark, "warehouse"))
    store.write_result("analysis_variable_clustering", themed(spark, sf)[2])
    return rounded(tables.cluster_export(store.table("analysis_variable_clustering")), "score_related")


@query("exemplar_export", f"""
WITH {SQL_TWO}
SELECT CAST(vec_id AS VARCHAR) AS id_sample, label AS label_class, label AS is_prototype_for, round(score, 5) + 0.0 AS distance_score, type_subspace,
       round(e00, 6) + 0.0 AS e00, round(e01, 6) + 0.0 AS e01, round(e02, 6) + 0.0 AS e02, round(e03, 6) + 0.0 AS e03 FROM exemplars""")
def exemplar_export(spark, sf):
    store = tables.Warehouse(spark, fresh_folder(spark, "warehouse"))
    store.write_prototypes(two_subspaces(spark, sf))
    wide = tables.exemplar_export(store.table("analysis_representative_samples"))
    return rounded(rounded(wide, "distance_score", digits=5), "e00", "e01", "e02", "e03")


@query("sorted_sheets", f"""
WITH {SQL_THEMES}
SELECT 'Anchor Variables' AS sheet, CAST(row_number() OVER (ORDER BY weight DESC, id_variable) AS INTEGER) AS place, name_variable AS entry, round(weight, 6) AS score FROM selection
UNION ALL SELECT 'Cluster Themes', CAST(row_number() OVER (ORDER BY id_cluster, score_related DESC NULLS LAST, id_variable) AS INTEGER), name_variable, round(score_related, 6) FROM clusters
UNION ALL SELECT 'Pairwise Correlations', CAST(row_number() OVER (ORDER BY correlation_score DESC, id_variable_1, id_variable_2) AS INTEGER), id_variable_1 || '-' || id_variable_2,
       round(correlation_score, 6) FROM relation WHERE correlation_score >= 0.1""")
def sorted_sheets(spark, sf):
    """The sheets in their own order; the place is the position in the sorted sheet."""
    sheets = tables.workbook_sheets(_results(spark, sf))
    place = F.row_number().over
    from pyspark.sql import Window

    order = {
        "Anchor Variables": (["name_variable"], "weight", [F.col("weight").desc(), F.col("id_variable")]),
        "Cluster Themes": (["name_variable"], "score_related", [F.col("id_cluster"), F.col("score_related").desc_nulls_last(), F.col("id_variable")]),
        "Pairwise Correlations": (["id_variable_1", "id_variable_2"], "correlation_score", [F.col("correlation_score").desc(), F.col("id_variable_1"), F.col("id_variable_2")]),
    }
    rows = None
    for name, (entry, score, by) in order.items():
        part = sheets[name].select(
            F.lit(name).alias("sheet"), place(Window.orderBy(*by)).alias("place"), F.concat_ws("-", *entry).alias("entry"), r(score).alias("score")
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows

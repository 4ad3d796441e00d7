"""Scans, warehouse and the staged analysis."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_numbers import two_sample
from twinlens.functions.values import to_number
from twinlens.operators import stats
from twinlens.plans.analysis import AnalysisOptions, analyse_stage, analysis_tables, report_stage, run_all, run_analysis, scoped
from twinlens.plans.dating import Dating
from twinlens.runtime import durable, fresh_folder, shared_folder
from twinlens.sources import tables


@pytest.fixture
def store(spark):
    return tables.Warehouse(spark, fresh_folder(spark, "test"))


def test_csv_in_both_encodings(spark, tmp_path):
    text = "id,name,score,note\n1,Zoë,1.5,NA\n2,,7,\n3,Ana,n/a,x\n"
    for encoding in ("utf-8", "latin-1"):
        path = tmp_path / f"{encoding}.csv"
        path.write_bytes(text.encode(encoding))
        rows = tables.read_csv(spark, str(path)).orderBy("id").collect()
        assert [tuple(r) for r in rows] == [(1, "Zoë", 1.5, None), (2, None, 7.0, None), (3, "Ana", None, "x")]
    typed = tables.read_csv(spark, str(path), "id int, score string")
    assert typed.dtypes == [("id", "int"), ("score", "string")]


def test_csv_with_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "breaks.csv"
    path.write_bytes(b'id,note,size\n1,"two\nlines",1\n2,"a ""word""",2f\n3,plain,3\n')
    rows = tables.read_csv(spark, str(path)).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "two\nlines", "1"), (2, 'a "word"', "2f"), (3, "plain", "3")]


def test_numbers_have_no_type_suffix(spark):
    told = spark.createDataFrame([("1d",), ("2F ",), ("3.",), (" 4e1",), ("-Infinity",), ("inf",), ("x",), (None,)], "v string")
    found = [r[0] for r in told.select(to_number(told["v"])).collect()]
    assert found == [None, None, 3.0, 40.0, float("-inf"), float("inf"), None, None]
    assert [r[0] for r in spark.range(2).select(to_number(F.col("id"))).collect()] == [0.0, 1.0]


def test_result_tables_are_replaced(spark, store):
    chosen = spark.createDataFrame([(0, "var_a", 1.25), (2, "var_c", 0.85)], tables.RESULT_TABLES["analysis_variable_selection"])
    for rows, n in ((chosen, 2), (chosen.limit(1), 1)):
        store.write_result("analysis_variable_selection", rows)
        assert store.table("analysis_variable_selection").count() == n
    assert store.sql("SELECT count(*) AS n FROM analysis_variable_selection WHERE weight > 1").first()["n"] == 1
    with pytest.raises(KeyError):
        store.write_result("unknown", chosen)


def test_metadata(spark, store):
    store.put_metadata({"a": "1", "b": "1"})
    store.put_metadata({"b": "2"})
    store.put_metadata({"b": "3", "c": "3"})
    assert {r["key"]: r["value"] for r in store.metadata().collect()} == {"a": "1", "b": "3", "c": "3"}


def test_exports(spark, store):
    clusters = [(0, "a", 1, 0.2), (1, "b", 1, 1.0), (2, "c", 0, None), (3, "d", 0, 0.1)]
    store.write_result("analysis_variable_clustering", spark.createDataFrame(clusters, tables.RESULT_TABLES["analysis_variable_clustering"]))
    ordered = tables.cluster_export(store.table("analysis_variable_clustering"))
    assert [r["name_variable"] for r in ordered.collect()] == ["d", "c", "b", "a"]
    best = spark.createDataFrame(
        [(10, "X", "X", 2.5, "hat_S", {"var_a": 1.0, "var_c": 0.5}), (11, "Y", "Y", 1.5, "hat_S_augmented", {"var_d": 2.0})],
        "sample_key int, label_class string, is_prototype_for string, distance_score double, type_subspace string, features map<string,double>",
    )
    store.write_prototypes(best)
    wide = tables.exemplar_export(store.table("analysis_representative_samples")).collect()
    assert [(r["id_sample"], r["var_a"], r["var_d"]) for r in wide] == [("10", 1.0, None), ("11", None, 2.0)]
    path = fresh_folder(spark, "csv")
    tables.write_csv(ordered, path)
    assert spark.read.csv(path, header=True).count() == 4


def test_supplement_by_key(spark):
    features = spark.createDataFrame([(2, 1.0), (1, 2.0)], "k int, f double")
    raw = spark.createDataFrame([(1, "one", 9), (2, "two", 8)], "k int, word string, f int")
    joined = {r["k"]: (r["f"], r["word"]) for r in tables.supplement(features, raw, "k", ["word", "f", "gone"]).collect()}
    assert joined == {1: (2.0, "one"), 2: (1.0, "two")}


def test_stored_tables_end_the_lineage(spark):
    stored = durable(spark.range(5))
    assert shared_folder(spark).removeprefix("file:") in stored.inputFiles()[0]


@pytest.fixture(scope="module")
def grouped(spark):
    draw = np.random.default_rng(12)
    base = draw.normal(size=(160, 8))
    base[:, 1] = base[:, 0] + 0.3 * draw.normal(size=160)
    base[:, 2] = base[:, 0] + 0.3 * draw.normal(size=160)
    base[80:, 0:3] += 2.0
    return two_sample(spark, base[:80], base[80:])


WASSERSTEIN = AnalysisOptions(selector="wasserstein", relation="pearson")


def test_one_call(grouped):
    result = run_analysis(grouped, WASSERSTEIN)
    assert {"f00", "f01", "f02"} <= set(result.anchors) <= set(result.augmented)
    assert result.exemplars.count() == 20 and result.edges.count() >= 3
    sheets = analysis_tables(grouped, result, WASSERSTEIN)
    assert all(table.count() > 0 for table in sheets.values())


def test_stages_match_the_call(grouped, store):
    with pytest.raises(ValueError, match="anchors"):
        store.write_features(grouped)
        analyse_stage(store, WASSERSTEIN)
    with pytest.raises(ValueError, match="incomplete"):
        report_stage(store, WASSERSTEIN)
    sheets = run_all(grouped, store, WASSERSTEIN, {"dataset_name": "blocks"})
    result = run_analysis(grouped, WASSERSTEIN)
    assert {r["name_variable"] for r in sheets["anchors"].collect()} == set(result.anchors)
    values = {r["key"]: r["value"] for r in store.metadata().collect()}
    assert (values["dataset_name"], values["n_samples_selection_x"], values["scope_report"]) == ("blocks", "80", "whole")
    assert [name for name in tables.workbook_sheets(store)] == ["Anchor Variables", "Cluster Themes", "Pairwise Correlations", "Representative Exemplars"]


def test_default_call(grouped):
    """MMD anchors and partial correlation, with caps that bind."""
    options = AnalysisOptions(limit=60)
    result = run_analysis(grouped, options)
    assert result.p_value is not None and set(result.anchors) & {"f00", "f01", "f02"}
    assert {r["label_class"]: r["count"] for r in result.exemplars.groupBy("label_class").count().collect()} == {"X": 10, "Y": 10}


def test_whole_samples_by_default(spark):
    """Without options every row counts; the cap is for those who ask for it."""
    draw = np.random.default_rng(13)
    large = two_sample(spark, draw.normal(size=(620, 2)), draw.normal(size=(510, 2)))
    sizes = lambda options, scope: stats.label_totals(scoped(large, scope, options).frame, large.label)
    options = AnalysisOptions()
    for scope in (options.selection_scope, options.analysis_scope, options.report_scope):
        assert sizes(options, scope) == {"X": 620, "Y": 510}
    assert sizes(AnalysisOptions(limit=60), "subset") == {"X": 60, "Y": 60}
    assert Dating().limit is None

"""Literal cases for cleaning, encoding, pairs and reports."""

import pytest
from pyspark.sql import functions as F

from twinlens.operators import clean, encode, pairs, report, sample, stats
from twinlens.plans import dating, housing

SALES = "Order int, PID int, YrSold int, MoSold int, SalePrice double, PoolQC string, GarageArea double, Neighborhood string, LotFrontage double, KitchenQual string, HouseStyle string"
SALE_ROWS = [
    (1, 101, 2006, 5, 200000.0, None, None, "CollgCr", 60.0, "TA", "1Story"),
    (2, 102, 2007, 6, 250000.0, "Ex", 400.0, "CollgCr", None, "Gd", "2Story"),
    (3, 103, 2008, 7, 180000.0, None, 500.0, "Veenker", 80.0, "Ex", "1Story"),
    (4, 104, 2009, 8, 220000.0, "Gd", None, "Veenker", None, "Fa", "2Story"),
]


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(SALE_ROWS, SALES)


def rows_of(df, key):
    return {r[key]: r for r in df.collect()}


def test_absence_and_group_median(sales):
    filled = clean.fill_absent_numbers(clean.fill_absent_categories(sales, housing.ABSENT_CATEGORIES), housing.ABSENT_AMOUNTS)
    found = rows_of(clean.impute_group_median(filled, "LotFrontage", "Neighborhood"), "Order")
    assert [found[i]["PoolQC"] for i in (1, 2)] == ["None", "Ex"]
    assert found[1]["GarageArea"] == 0.0
    assert [found[i]["LotFrontage"] for i in (2, 4)] == [60.0, 80.0]


def test_group_median_falls_back(spark):
    rows = spark.createDataFrame([("a", None), ("b", 10.0), ("b", 20.0), (None, None)], "g string, v double")
    found = [(r["g"], r["v"]) for r in clean.impute_group_median(rows, "v", "g").collect()]
    assert sorted(found, key=str) == sorted([("a", 15.0), ("b", 10.0), ("b", 20.0), (None, 15.0)], key=str)
    empty = clean.impute_group_median(rows.withColumn("v", F.lit(None).cast("double")), "v", "g")
    assert {r["v"] for r in empty.collect()} == {60.0}


def test_ordinal_scale(sales):
    found = rows_of(encode.encode_ordinal(sales, housing.SCALES), "Order")
    assert [found[i]["KitchenQual"] for i in (1, 2, 3, 4)] == [3.0, 4.0, 5.0, 2.0]


def test_housing_adapter(sales):
    made, lineage = housing.Housing().prepare(sales)
    counts = {r["label"]: r["count"] for r in made.frame.groupBy("label").count().collect()}
    assert counts == {"X": 2, "Y": 1}
    assert {"HouseStyle_1Story", "HouseStyle_2Story"} <= set(made.features)
    assert not {"YrSold", "SalePrice", "Order", "PID"} & set(made.features)
    assert list(made.features) == sorted(made.features)
    by_name = {name: (sources, kind) for name, sources, kind in lineage if kind != "removed"}
    assert by_name["LotFrontage"] == (["LotFrontage", "Neighborhood"], "float")
    assert by_name["KitchenQual"][1] == "int" and by_name["HouseStyle_1Story"] == (["HouseStyle"], "category")
    assert [s[0] for _, s, kind in lineage if kind == "removed"] == ["MoSold", "Order", "PID", "SalePrice", "YrSold"]
    assert made.frame.select(*[F.max(F.isnull(f)).alias(f) for f in made.features]).first().asDict() == {f: False for f in made.features}


def test_housing_cap_and_dropped_indicators(spark):
    rows = [(i, 2006 if i % 2 else 2009, "WD" if i % 3 else "New", float(i)) for i in range(60)]
    raw = spark.createDataFrame(rows, "Order int, YrSold int, SaleType string, LotArea double")
    kept = housing.Housing(limit=10).features(raw)
    assert {r["label"]: r["count"] for r in kept.frame.groupBy("label").count().collect()} == {"X": 10, "Y": 10}
    assert "SaleType_WD" in kept.features
    assert "SaleType_WD" not in housing.Housing(drop_by_lineage=True).features(raw).features


CARD_ROWS = [
    dict(iid=1, pid=2, gender=1, wave=1, match=1, dec=1, dec_o=1, age=28, race=2, imprace=5, imprelig=4, date=3, go_out=2, goal=1, field_cd=1, career_c=1, zipcode="10025",
         sports=8, dining=7, art=6, yoga=5, attr3_1=8, sinc3_1=7, intel3_1=8, fun3_1=8, amb3_1=7, attr1_1=20, sinc1_1=20, intel1_1=20, fun1_1=20, amb1_1=10, shar1_1=10),
    dict(iid=2, pid=1, gender=0, wave=1, match=1, dec=1, dec_o=1, age=25, race=2, imprace=6, imprelig=5, date=4, go_out=3, goal=1, field_cd=2, career_c=5, zipcode="10028",
         sports=6, dining=9, art=8, yoga=9, attr3_1=7, sinc3_1=8, intel3_1=9, fun3_1=7, amb3_1=8, attr1_1=25, sinc1_1=15, intel1_1=20, fun1_1=20, amb1_1=10, shar1_1=10),
    dict(iid=3, pid=4, gender=1, wave=1, match=0, dec=0, dec_o=1, age=30, race=4, imprace=8, imprelig=7, date=2, go_out=1, goal=2, field_cd=3, career_c=2, zipcode="90210",
         sports=5, dining=6, art=4, yoga=3, attr3_1=6, sinc3_1=6, intel3_1=7, fun3_1=6, amb3_1=6, attr1_1=30, sinc1_1=10, intel1_1=20, fun1_1=20, amb1_1=10, shar1_1=10),
    dict(iid=4, pid=3, gender=0, wave=1, match=0, dec=1, dec_o=0, age=26, race=2, imprace=7, imprelig=6, date=5, go_out=4, goal=3, field_cd=3, career_c=7, zipcode="30301",
         sports=4, dining=8, art=7, yoga=8, attr3_1=8, sinc3_1=8, intel3_1=8, fun3_1=8, amb3_1=7, attr1_1=20, sinc1_1=20, intel1_1=20, fun1_1=20, amb1_1=10, shar1_1=10),
]


@pytest.fixture(scope="module")
def card_table(spark):
    return spark.createDataFrame(CARD_ROWS)


def test_dating_pairs(card_table):
    cleaned = dating.clean_cards(card_table)
    assert cleaned.count() == 4
    joined = pairs.reciprocal_pairs(cleaned)
    table, lineage = pairs.pair_features(joined, dating.INTERESTS, dating.PREFERENCES + dating.SELF_RATINGS, dating.SURVEY_FIELDS, dating.IMPORTANCES)
    first, second = (table.orderBy(F.col("match").desc()).collect())
    expected = {
        "Same_region": (1.0, 0.0), "Diff_age": (3.0, 4.0), "Same_Race": (1.0, 0.0), "Race_Preference_Conflict": (0.0, 7.5), "Same_Goal": (1.0, 0.0),
        "Same_Field": (0.0, 1.0), "Field_Similarity": (0.0, 1.0), "career_group_male": (1.0, 3.0), "career_group_female": (2.0, 1.0),
        "Delta_Male_Attr_Align": (5.5, 4.0), "Delta_Female_Attr_Align": (5.0, 5.0),
    }
    assert {name: (first[name], second[name]) for name in expected} == expected
    cosine = (8 * 6 + 7 * 9 + 6 * 8 + 5 * 9) / ((64 + 49 + 36 + 25) ** 0.5 * (36 + 81 + 64 + 81) ** 0.5)
    assert first["Interest_Cosine_Sim"] == pytest.approx(cosine)
    assert ("Race_Preference_Conflict", ["race", "imprace"], "float") in lineage


def test_dating_adapter(card_table):
    made, lineage = dating.Dating().prepare(card_table)
    assert {r["label"]: r["count"] for r in made.frame.groupBy("label").count().collect()} == {"X": 1, "Y": 1}
    assert "match" not in made.frame.columns
    assert [s for _, s, kind in lineage if kind == "removed"] == [[c] for c in ("dec", "dec_o", "gender", "iid", "match", "pid", "wave")]


def test_forty_nine_features_of_the_full_survey(spark):
    columns = dating.MEDIAN_COLUMNS + dating.MODE_COLUMNS + ["zipcode", "iid", "pid", "gender", "wave", "dec"]
    raw = spark.createDataFrame([], ", ".join(f"`{c}` double" for c in columns))
    joined = pairs.reciprocal_pairs(raw)
    _, lineage = pairs.pair_features(joined, dating.INTERESTS, dating.PREFERENCES + dating.SELF_RATINGS, dating.SURVEY_FIELDS, dating.IMPORTANCES)
    assert len(lineage) == 49


def test_pair_id_and_match(spark):
    ids = spark.createDataFrame([(7, 12), (12, 7)], "iid_male long, iid_female long").select(pairs.pair_id("iid_male", "iid_female").alias("h"))
    assert len({r["h"] for r in ids.collect()}) == 1 and len(ids.first()["h"]) == 16
    flags = spark.createDataFrame([(1.0, 1.0), (1.0, None), (0.0, 1.0)], "dec_male double, dec_female double")
    assert [r[0] for r in flags.select(pairs.mutual_match(flags.columns)).collect()] == [1, 0, 0]


ZIPS = {
    "06268": "Northeast", "6,268": "Northeast", "10025": "Northeast", "10025-1234": "Northeast", "20878": "Mid-Atlantic", "35223": "Southeast", "45243": "Southeast",
    "52803": "Northern Plains", "60521": "Central Plains", "60,521": "Central Plains", "77096": "South Central", "807931": "Mountain West", "94022": "Pacific West",
    "": "Unknown", None: "Unknown", "6268.0": "Northeast", " 94022 ": "Pacific West", "ABCDE": "Other", "+1234": "Other", "+12345": "Other",
}


def test_zip_regions(spark):
    table = spark.createDataFrame([(z,) for z in ZIPS], "z string")
    assert {r["z"]: r["region"] for r in table.select("z", pairs.zip_region(F.col("z")).alias("region")).collect()} == ZIPS
    both = spark.createDataFrame([("06268", "10025"), ("10025", "94022"), ("60,521", "60521"), (None, "")], "a string, b string")
    assert [r[0] for r in both.select(pairs.same_region(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 1.0, 1.0]


def test_field_similarity(spark):
    table = spark.createDataFrame([(2.0, 4.0), (1.0, 2.0), (12.0, 12.0), (None, 3.0), (14.0, 14.0), (7.0, 16.0), (99.0, 99.0)], "a double, b double")
    found = [r[0] for r in table.select(pairs.field_similarity(F.col("a"), F.col("b"))).collect()]
    assert found == [0.5, 0.0, 0.0, 0.0, 1.0, 0.5, 1.0]


@pytest.fixture(scope="module")
def small(spark):
    x = [("X", 100.0, "A", 1.0), ("X", 200.0, "A", None), ("X", 300.0, "B", 3.0)]
    y = [("Y", 150.0, "A", None), ("Y", 250.0, "B", None), ("Y", 350.0, "B", 3.0)]
    return spark.createDataFrame(x + y, "label string, Price double, Category string, MissingCol double")


def test_report_statistics(small):
    price = stats.numeric_comparison(small, ["Price", "not_there"]).collect()
    assert len(price) == 1
    assert (price[0]["mean_x"], price[0]["mean_y"], price[0]["delta_mean"], price[0]["percentage_change_mean"]) == (200.0, 250.0, 50.0, 25.0)
    assert (price[0]["std_x"], price[0]["median_y"]) == (100.0, 250.0)
    first = stats.category_comparison(small, "Category").collect()[0]
    assert (first["name_category"], first["count_x"], first["count_y"]) == ("A", 2, 1) and first["delta_percentage_points"] < 0
    missing = stats.missingness(small).collect()
    assert [(r["name_column"], r["count_missing_total"]) for r in missing] == [("MissingCol", 3)]


def test_numeric_comparison_edges(spark):
    rows = spark.createDataFrame([("X", 1.0, None), ("Y", 2.0, 5.0)], "label string, a double, b double")
    found = stats.numeric_comparison(rows, ["a", "b"]).collect()
    assert [r["name_metric"] for r in found] == ["a"] and found[0]["std_x"] == 0.0


def test_splits(spark):
    flags = spark.createDataFrame([(1, 1), (2, 0), (3, None)], "id int, match int")
    assert {(r["id"], r["label"]) for r in sample.split_by_flag(flags, "match").collect()} == {(1, "X"), (2, "Y")}
    assert {(r["id"], r["label"]) for r in sample.split_rest(flags).collect()} == {(1, "X"), (2, "Y"), (3, "Y")}
    with pytest.raises(KeyError):
        sample.split_by_flag(flags, "absent")
    odd = spark.range(7).withColumnRenamed("id", "key")
    assert {r["key"] for r in sample.split_in_halves(odd, "key").where("label = 'X'").collect()} == {0, 1, 2}


def test_too_many_categories_is_an_error(spark):
    with pytest.raises(ValueError):
        encode.categories(spark.range(30).select(F.col("id").cast("string").alias("c")), limit=10)


def test_theme_table(spark):
    scores = [(1, 0, None), (2, 0, None)] + [(3 + i, 1, 0.95 - 0.1 * i) for i in range(7)] + [(10, 2, 0.88), (11, 2, 0.72)]
    clusters = spark.createDataFrame([(i, f"v{i}", c, s) for i, c, s in scores], "id_variable int, name_variable string, id_cluster int, score_related double")
    nothing = spark.createDataFrame([], "id_variable int, name_variable string, weight double")
    found = report.theme_table(clusters, nothing).groupBy("id_cluster").count()
    assert {r["id_cluster"]: r["count"] for r in found.collect()} == {1: 5, 2: 2}


def test_chart_data(spark):
    rows = [(i, f"feat_{i}", 0, 1.0 - 0.1 * i) if i < 6 else (i, f"feat_{i}", 1, None) for i in range(12)]
    clusters = spark.createDataFrame(rows, "id_variable int, name_variable string, id_cluster int, score_related double")
    chosen = spark.createDataFrame([(0, "feat_0", 1.0)], "id_variable int, name_variable string, weight double")
    values = {f"feat_{i}": float(i) for i in range(6)}
    best = spark.createDataFrame(
        [(1, "X", 2.0, "hat_S_augmented", values), (2, "Y", 1.0, "hat_S_augmented", {k: -v for k, v in values.items()}), (3, "X", 1.0, "hat_S_augmented", values)],
        "sample_key int, label_class string, distance_score double, type_subspace string, features map<string,double>",
    )
    bars = report.tornado(clusters, chosen).collect()
    assert {r["id_cluster"] for r in bars} == {0} and len(bars) == 6 and {r["theme"] for r in bars} == {"feat_0"}
    axes = report.radar(clusters, chosen, best).orderBy("axis").collect()
    assert len(axes) == 6 and axes[0]["name_variable"] == "feat_0"
    assert (axes[0]["unit_x"], axes[1]["unit_x"], axes[1]["unit_y"]) == (0.5, 1.0, 0.0)

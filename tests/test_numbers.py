"""Operators against direct numpy formulas on small matrices, skewed inputs included."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from twinlens.functions.ranks import exact_median
from twinlens.model import TwoSample
from twinlens.operators import cluster, exemplar, mmd, relate, report, sample, select, stats


def two_sample(spark, x, y):
    names = [f"f{i:02d}" for i in range(x.shape[1])]
    frame = pd.DataFrame(np.vstack([x, y]), columns=names)
    frame.insert(0, "label", ["X"] * len(x) + ["Y"] * len(y))
    frame.insert(0, "key", range(len(frame)))
    return TwoSample.of(spark.createDataFrame(frame), "key")


def weights_of(df):
    return [r["weight"] for r in df.orderBy("id_variable").collect()]


def matrix_of(relation, d):
    out = np.eye(d)
    for r in relation.collect():
        out[r["id_variable_1"], r["id_variable_2"]] = out[r["id_variable_2"], r["id_variable_1"]] = r["correlation_score"]
    return out


@pytest.fixture(scope="module")
def shifted(spark):
    draw = np.random.default_rng(1)
    x, y = draw.normal(size=(60, 5)), draw.normal(size=(60, 5))
    y[:, 0] += 3
    y[:, 2] += 2
    return x, y, two_sample(spark, x, y)


def wasserstein(a, b):
    points = np.sort(np.concatenate([a, b]))
    share = lambda v: np.searchsorted(np.sort(v), points[:-1], side="right") / len(v)
    return float(np.sum(np.abs(share(a) - share(b)) * np.diff(points)))


def test_scaler(spark):
    draw = np.random.default_rng(0)
    made = stats.scaled(two_sample(spark, draw.normal(10, 2, (50, 4)), draw.normal(15, 3, (60, 4))))
    pooled = made.frame.select(*made.features).toPandas().to_numpy()
    assert np.abs(pooled.mean(0)).max() < 1e-6 and np.abs(pooled.std(0) - 1).max() < 1e-6


def test_wide_and_long_scaling_agree(spark):
    draw = np.random.default_rng(5)
    made = two_sample(spark, draw.normal(size=(30, 20)), draw.normal(size=(30, 20)))
    wide = {r["name_variable"]: r["std"] for n in (made.features[:10], made.features[10:]) for r in stats.scaling(made.only(n)).collect()}
    assert wide == pytest.approx({r["name_variable"]: r["std"] for r in stats.scaling(made).collect()})


@pytest.mark.parametrize("ranges", [2, 7, 64])
def test_wasserstein_formula(shifted, ranges):
    x, y, made = shifted
    expected = [wasserstein(x[:, i], y[:, i]) / np.concatenate([x[:, i], y[:, i]]).std() for i in range(5)]
    assert weights_of(select.wasserstein_weights(made, ranges=ranges)) == pytest.approx(expected)


def test_wasserstein_with_a_hot_value(spark):
    """A third of all rows share one value, the rest is spread over many magnitudes."""
    draw = np.random.default_rng(2)
    hot = lambda n: np.concatenate([np.full(n // 3, 7.0), draw.lognormal(0, 4, n - n // 3)])
    x, y = hot(900)[:, None], hot(600)[:, None]
    found = weights_of(select.wasserstein_weights(two_sample(spark, x, y), scale=False, ranges=9))
    assert found == pytest.approx([wasserstein(x[:, 0], y[:, 0])])


def test_selection_ranks_the_shifted_variable_first(shifted):
    chosen = select.wasserstein_select(shifted[2]).collect()
    assert "f00" in {r["name_variable"] for r in chosen}
    assert max(chosen, key=lambda r: r["weight"])["name_variable"] == "f00"
    assert all(0 <= r["weight"] <= 1 for r in chosen)


def chosen_of(spark, weights, **settings):
    table = spark.createDataFrame([(i, f"v{i}", float(w)) for i, w in enumerate(weights)], "id_variable int, name_variable string, weight double")
    return sorted(r["id_variable"] for r in select.select_variables(table, **settings).collect())


def test_cuts(spark):
    assert chosen_of(spark, [0.1, 0.12, 0.9, 1.0]) == [2, 3]
    assert chosen_of(spark, [0.05, 0.5, 0.2], approach="threshold") == [1, 2]
    assert chosen_of(spark, [0.3, 0.1, 0.2], approach="threshold", threshold=2.0, top_k=2) == [0, 2]
    assert chosen_of(spark, [0.3, 0.1, 0.2], approach="threshold", threshold=0.0, top_k=2, trim=True) == [0, 2]
    assert chosen_of(spark, [0.3, 0.1, 0.2, 0.0], approach="threshold", threshold=0.05, top_k=2, trim=True) == [0, 2]
    assert chosen_of(spark, [0.0, 0.0, 0.0], top_k=2) == [0, 1]
    # no empty bin: the emptiest bin between the two fullest ones
    full = [(i + 0.5) / 20 for i in range(19)] + [1.0] + [0.22] * 5 + [0.72] * 4
    assert min(full[i] for i in chosen_of(spark, full)) == pytest.approx(0.325)
    with pytest.raises(ValueError):
        chosen_of(spark, [1.0], approach="guess")


@pytest.mark.parametrize("size", [1, 2, 5, 998, 1001, 1002, 4000])
def test_exact_median(spark, size):
    draw = np.random.default_rng(size)
    values = np.where(draw.random(size) < 0.34, 3.0, draw.lognormal(0, 3, size))
    rows = spark.createDataFrame(pd.DataFrame({"g": np.arange(size) % 3 == 0, "v": values}))
    found = {r["g"]: r["median"] for r in exact_median(rows, ["g"], "v").collect()}
    expected = pd.Series(values).groupby(np.arange(size) % 3 == 0).median().to_dict()
    assert found == pytest.approx(expected)
    assert exact_median(rows, [], "v").first()["median"] == pytest.approx(np.median(values))


def test_cap_keeps_the_smallest_hashes(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "X").otherwise("Y").alias("label"))
    from pyspark.sql import Window

    order = Window.partitionBy("label").orderBy(F.md5(F.concat(F.lit("42|"), F.col("id").cast("string"))))
    for limit in (1, 17, 1600, 1667, 10**6):
        expected = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("id")
        found = sample.capped(rows, "id", limit).select("id")
        assert found.count() == expected.count() and found.exceptAll(expected).isEmpty()


def test_train_parts_of_small_labels(spark):
    rows = spark.createDataFrame([(i, "X" if i < 4 else "Y") for i in range(24)], "key int, label string")
    parts = sample.train_test_parts(rows, "key", 0.8).toPandas()
    assert parts.groupby("label")["is_train"].sum().to_dict() == {"X": 4, "Y": 16}
    assert parts.groupby("label")["is_test"].sum().to_dict() == {"X": 4, "Y": 4}


@pytest.mark.parametrize("d", [5, 20])
def test_correlation_formula(spark, d):
    draw = np.random.default_rng(3)
    data = draw.normal(size=(80, d))
    data[:, 1] += data[:, 0]
    data[:, 3] = 4.0
    made = two_sample(spark, data[:30], data[30:])
    with np.errstate(all="ignore"):
        expected = np.nan_to_num(np.abs(np.corrcoef(data, rowvar=False)))
    np.fill_diagonal(expected, 1.0)
    np.testing.assert_allclose(matrix_of(relate.absolute_pearson(made), d), expected, atol=1e-9)


def test_sparse_precision_meets_its_conditions():
    """Stationarity: the gradient is inverse(T) - S = alpha * sign(T) off the diagonal where T is not zero."""
    draw = np.random.default_rng(4)
    data = draw.normal(size=(200, 6))
    data[:, 1] += data[:, 0]
    covariance, alpha = np.cov(data, rowvar=False), 0.1
    dense, sparse = relate._sparse_precision(covariance, alpha)
    gap = np.linalg.inv(dense) - covariance
    np.testing.assert_allclose(np.diag(gap), 0, atol=1e-4)
    off = ~np.eye(6, dtype=bool)
    on = off & (sparse != 0)
    np.testing.assert_allclose(gap[on], alpha * np.sign(sparse[on]), atol=1e-4)
    assert np.abs(gap[off]).max() <= alpha + 1e-4


def test_partial_correlation_finds_the_chain(spark):
    draw = np.random.default_rng(6)
    a = draw.normal(size=400)
    b = a + 0.5 * draw.normal(size=400)
    c = b + 0.5 * draw.normal(size=400)
    data = np.column_stack([a, b, c, draw.normal(size=400)])
    found = matrix_of(relate.partial_correlation(two_sample(spark, data[:200], data[200:])), 4)
    assert min(found[0, 1], found[1, 2]) > 0.4 > 0.15 > found[0, 2]
    assert found[3, :3].max() < 0.15


def test_partial_correlation_falls_back(spark):
    flat = two_sample(spark, np.ones((10, 3)), np.ones((10, 3)))
    assert matrix_of(relate.partial_correlation(flat), 3) == pytest.approx(np.eye(3))


@pytest.fixture(scope="module")
def blocks(spark):
    draw = np.random.default_rng(7)
    base = draw.normal(size=(200, 6))
    for a, b in ((1, 0), (2, 0), (4, 3), (5, 3)):
        base[:, a] = base[:, b] + 0.1 * draw.normal(size=200)
    return two_sample(spark, base[:100], base[100:])


def test_blocks_around_an_anchor(blocks):
    relation = relate.absolute_pearson(blocks)
    found = {r["id_variable"]: r for r in cluster.cluster_variables(blocks, relation, [0]).collect()}
    assert [found[i]["id_cluster"] for i in range(3)] == [1, 1, 1]
    assert found[0]["score_related"] == 1.0 and found[1]["score_related"] > 0.9
    assert {"f00", "f01", "f02"} <= set(cluster.augmented_names(cluster.cluster_variables(blocks, relation, [0]), blocks.features, [0]))


def relation_of(spark, cells):
    return spark.createDataFrame([(i, j, s) for (i, j), s in cells.items()], "id_variable_1 int, id_variable_2 int, correlation_score double")


def test_greedy_themes_and_components(spark):
    relation = relation_of(spark, {(0, 1): 0.1, (0, 2): 0.6, (1, 2): 0.7, (0, 3): 0.0, (1, 3): 0.2, (2, 3): 0.1})
    assert cluster.anchor_themes(relation, [0, 1, 2]) == {0: 1, 2: 1, 1: 2}
    assert cluster.anchor_themes(relation, [2, 1, 0]) == {2: 1, 1: 1, 0: 1}
    assert cluster.anchor_themes(relation, [0, 1, 2], mode="components") == {0: 1, 1: 1, 2: 1}
    placed = {r["id_variable"]: (r["id_cluster"], r["score_related"]) for r in cluster.assign_variables("abcd", relation, {0: 1, 2: 1, 1: 2}).collect()}
    assert placed[3] == (2, 0.2)


def test_ties_go_to_the_lowest_theme(spark):
    relation = relation_of(spark, {(0, 1): 0.0, (0, 2): 0.4, (1, 2): 0.4, (0, 3): 0.1, (1, 3): 0.1, (2, 3): 0.0})
    placed = {r["id_variable"]: (r["id_cluster"], r["score_related"]) for r in cluster.assign_variables("abcd", relation, {0: 1, 1: 2}).collect()}
    assert placed == {0: (1, 1.0), 1: (2, 1.0), 2: (1, 0.4), 3: (0, None)}


def test_linkage(spark, blocks):
    labels = [r["id_cluster"] for r in cluster.linkage_clusters(blocks.features, relate.absolute_pearson(blocks), 2).orderBy("id_variable").collect()]
    assert labels == [0, 0, 0, 1, 1, 1]
    relation = relation_of(spark, {(0, 1): 0.9, (0, 2): 0.1, (1, 2): 0.8, (0, 3): 0.0, (1, 3): 0.0, (2, 3): 0.5})
    labels = lambda k: [r["id_cluster"] for r in cluster.linkage_clusters("abcd", relation, k).orderBy("id_variable").collect()]
    assert labels(2) == [0, 0, 1, 1] and labels(9) == [0, 1, 2, 3] and labels(1) == [0, 0, 0, 0]
    segments = relation.withColumn("part", F.explode(F.array(F.lit("p"), F.lit("q"))))
    assert cluster.linkage_clusters("abcd", segments, 2, segment="part").groupBy("part").count().count() == 2


def mahalanobis(rows, reference):
    cov = np.cov(reference, rowvar=False) + 1e-6 * np.eye(rows.shape[1])
    off = rows - reference.mean(0)
    return np.sqrt(np.maximum(np.einsum("ni,ij,nj->n", off, np.linalg.pinv(cov), off), 0))


@pytest.mark.parametrize("d", [4, 16])
def test_exemplars(spark, d):
    draw = np.random.default_rng(8)
    x, y = draw.normal(size=(40, d)), draw.normal(2, 1, size=(40, d))
    made = two_sample(spark, x, y)
    scores = exemplar.prototype_scores(made).orderBy("key").select("score").toPandas()["score"].to_numpy()
    expected = np.concatenate([mahalanobis(x, y) - mahalanobis(x, x), mahalanobis(y, x) - mahalanobis(y, y)])
    np.testing.assert_allclose(scores, expected, atol=1e-6)
    best = exemplar.prototypes(made, made.features[:2], "hat_S", 3).collect()
    assert len(best) == 6 and all(set(r["features"]) == set(made.features[:2]) for r in best)
    central = exemplar.prototype_scores(made, "centroid").orderBy("key").select("score").toPandas()["score"].to_numpy()
    np.testing.assert_allclose(central[:40], -mahalanobis(x, x), atol=1e-6)


def test_histogram_and_density(spark):
    draw = np.random.default_rng(9)
    x, y = draw.normal(size=200), draw.normal(1, 2, size=150)
    made = two_sample(spark, x[:, None], y[:, None])
    long = made.long()
    bars = stats.histogram(long, stats.variable_ranges(long, ["id_variable"]), ["id_variable"]).orderBy("bin").toPandas()
    edges = np.linspace(min(x.min(), y.min()), max(x.max(), y.max()), 25)
    np.testing.assert_allclose(bars["density_x"], np.histogram(x, edges, density=True)[0])
    np.testing.assert_allclose(bars["density_y"], np.histogram(y, edges, density=True)[0])
    curve = stats.density_grid(made.frame, "f00").where("label = 'X'").orderBy("point").toPandas()
    width = x.std(ddof=1) * len(x) ** -0.2
    expected = np.exp(-0.5 * ((curve["at"].to_numpy()[:, None] - x) / width) ** 2).sum(1) / (len(x) * width * np.sqrt(2 * np.pi))
    np.testing.assert_allclose(curve["density"], expected)


def test_constant_and_one_sided_histograms(spark):
    rows = spark.createDataFrame([("X", 0, 2.0), ("Y", 0, 2.0), ("X", 1, 1.0), ("X", 1, 3.0)], "label string, id_variable int, v double")
    bars = stats.histogram(rows, stats.variable_ranges(rows, ["id_variable"]), ["id_variable"]).toPandas()
    assert bars.groupby("id_variable").size().to_dict() == {0: 9, 1: 20}
    constant = bars[bars["id_variable"] == 0]
    assert (constant["low"].min(), constant["high"].max(), constant["count_x"].sum()) == (1.0, 3.0, 1)
    assert bars[bars["id_variable"] == 1]["density_y"].isna().all()


def test_density_needs_four_values(spark):
    rows = spark.createDataFrame([("X", float(i % 3)) for i in range(9)] + [("Y", float(i)) for i in range(9)], "label string, v double")
    assert {r["label"] for r in stats.density_grid(rows, "v").select("label").distinct().collect()} == {"Y"}


def rbf(a, b, scales):
    return np.exp(-(((a[:, None] - b[None]) * scales) ** 2).sum(-1))


def brute_mmd(x, y, scales):
    xx, yy = rbf(x, x, scales), rbf(y, y, scales)
    n, m = len(x), len(y)
    return (xx.sum() - n) / (n * (n - 1)) + (yy.sum() - m) / (m * (m - 1)) - 2 * rbf(x, y, scales).mean()


def test_mmd_formula(spark, shifted):
    x, y, made = shifted
    found = mmd.mmd_squared(made, 2.0).first()
    assert found["n_blocks"] == 1
    assert found["mmd_squared"] == pytest.approx(brute_mmd(x, y, np.full(5, 0.5)))


def test_mmd_blocks_use_every_row(shifted):
    x, y, made = shifted
    packed = mmd.packed_blocks(made, block_rows=16).frame.toPandas()
    rows = sum(len(v) for v in packed["x"]) // (8 * 5), sum(len(v) for v in packed["y"]) // (8 * 5)
    assert len(packed) == 4 and rows == (60, 60)
    assert mmd.mmd_squared(made, 2.0, 16).first()["mmd_squared"] == pytest.approx(brute_mmd(x, y, np.full(5, 0.5)), abs=0.05)


def test_block_sums_on_executors_and_driver_agree(shifted, monkeypatch):
    packed = mmd.packed_blocks(shifted[2], block_rows=16)
    sums = lambda: mmd._sum_over_blocks(packed, 2, lambda b, run: mmd.kernel_sums(b, np.full(5, 0.5 + run), 0), 6)
    direct = sums()
    monkeypatch.setattr(mmd, "DIRECT_SUM_LIMIT", 0)
    np.testing.assert_allclose(sums(), direct)


def test_power_gradient():
    draw = np.random.default_rng(10)
    x, y = draw.normal(size=(12, 3)), draw.normal(0.5, 1.3, size=(15, 3))
    every = lambda v: np.ones((len(v), 1), dtype=bool)
    block = mmd.Block(0, x, y, every(x), every(y))
    spread, weights = np.array([1.0, 2.0, 0.7]), np.array([0.4, 0.6, 0.3])
    value = lambda w: mmd.power_and_gradient(mmd.power_sums(block, w, spread, 0), 3)
    power, gradient = value(weights)
    scales = weights / spread
    size = 12
    h = rbf(x, x, scales) + rbf(y[:size], y[:size], scales) - rbf(x, y[:size], scales) - rbf(x, y[:size], scales).T
    variance = 4 / size**3 * (h.sum(1) ** 2).sum() - 4 / size**4 * h.sum() ** 2
    assert power == pytest.approx(brute_mmd(x, y, scales) / np.sqrt(variance + 1e-8))
    for k in range(3):
        step = np.zeros(3)
        step[k] = 1e-6
        assert gradient[k] == pytest.approx((value(weights + step)[0] - value(weights - step)[0]) / 2e-6, rel=1e-4, abs=1e-7)


def test_mmd_selects_the_shifted_variable(spark):
    draw = np.random.default_rng(11)
    x, y = draw.normal(size=(60, 4)), draw.normal(size=(60, 4))
    y[:, 1] += 2.5
    made = stats.scaled(two_sample(spark, x, y))
    found = mmd.mmd_select(made, max_epochs=25, permutations=50, learning_rate=0.05)
    assert max(found.selection.collect(), key=lambda r: r["weight"])["name_variable"] == "f01"
    assert found.p_value <= 0.05
    folded = mmd.mmd_select(made, algorithm="mmd-cv", folds=3, max_epochs=10, permutations=20, learning_rate=0.05)
    frequency = {r["name_variable"]: r["weight"] for r in folded.weights.collect()}
    assert len(frequency) == 4 and frequency["f01"] == 1.0
    with pytest.raises(ValueError):
        mmd.mmd_select(made, algorithm="unknown")


def test_permutation_under_the_null(spark):
    values = []
    for seed in range(6):
        draw = np.random.default_rng(100 + seed)
        packed = mmd.packed_blocks(two_sample(spark, draw.normal(size=(40, 2)), draw.normal(size=(40, 2))))
        values.append(mmd.permutation_p_value(packed, np.full(2, 0.5), 0, 100, 1))
    assert min(values) > 0.005 and max(values) > 0.3


def test_heatmap_choice(spark):
    d = 50
    names = [f"v{i:02d}" for i in range(d)]
    pairs = {(i, j): 1.0 / (1 + i + j) for i in range(d) for j in range(i + 1, d)}
    relation = relation_of(spark, pairs)
    chosen = spark.createDataFrame([(40, "v40", 1.0)], "id_variable int, name_variable string, weight double")
    make = lambda members: spark.createDataFrame(
        [(i, n, 1 if i in members else 0, None) for i, n in enumerate(names)], "id_variable int, name_variable string, id_cluster int, score_related double"
    )
    shown = lambda members: {r["id_variable"] for r in report.heatmap_variables(relation, make(members), chosen).collect()}
    assert shown({40, *range(12)}) == {40, *range(12)}
    assert shown({40, 7}) == {40, 7} | set(range(7)) | set(range(8, 34))
    assert shown(set(range(45))) == {40} | set(range(34))


@pytest.mark.parametrize("d", [4, 20])
def test_pearson_uses_complete_pairs_at_every_width(spark, d):
    rng = np.random.default_rng(5)
    values = rng.normal(size=(300, d)) + rng.normal(size=(300, 1))
    frame = pd.DataFrame(values, columns=[f"f{k:02d}" for k in range(d)]).mask(rng.random((300, d)) < 0.3)
    rows = [(n, "X" if n % 2 else "Y", *[None if np.isnan(v) else float(v) for v in r]) for n, r in enumerate(frame.to_numpy())]
    schema = "id long, label string, " + ", ".join(f"{c} double" for c in frame.columns)
    sample = TwoSample.of(spark.createDataFrame(rows, schema), key="id")
    got = {(r[0], r[1]): r[2] for r in relate.absolute_pearson(sample).collect()}
    expected = frame.corr().abs().to_numpy()
    assert len(got) == d * (d - 1) // 2
    for (a, b), score in got.items():
        assert abs(score - expected[a, b]) < 1e-9


@pytest.mark.parametrize("block_rows", [16, 512])
def test_training_and_p_value_use_all_pairs(spark, block_rows):
    """Same numbers from one block and from many, with labels of unequal size."""
    draw = np.random.default_rng(12)
    x, y = draw.normal(size=(60, 3)), draw.normal(0.5, 1.3, size=(21, 3))
    packed = mmd.packed_blocks(two_sample(spark, x, y), block_rows=block_rows)
    assert packed.frame.count() == -(-60 // block_rows)
    spread, weights = np.array([1.0, 2.0, 0.7]), np.array([0.4, 0.6, 0.3])
    scales = weights / spread
    xx, yy, xy = rbf(x, x, scales), rbf(y, y, scales), rbf(x, y, scales)
    variance = 4 * 21 * ((xx.mean(1) - xy.mean(1)).var() / 60 + (yy.mean(1) - xy.mean(0)).var() / 21)
    steps = [weights] + [weights + s * np.eye(3)[k] * 1e-5 for k in range(3) for s in (1, -1)]
    found = mmd.whole_power(packed, spread, np.array(steps), [0] * 7, mmd.mask_sizes(packed))
    assert found[0][0] == pytest.approx(brute_mmd(x, y, scales) / np.sqrt(variance + 1e-8))
    slopes = [(found[1 + 2 * k][0] - found[2 + 2 * k][0]) / 2e-5 for k in range(3)]
    np.testing.assert_allclose(found[0][1], slopes, rtol=1e-4, atol=1e-7)
    values = mmd.permuted_values(packed, scales, 0, 30, 1)
    assert values[0] == pytest.approx(brute_mmd(x, y, scales)) and len(values) == 31 and abs(values[1:].mean()) < 0.03


@pytest.mark.parametrize("d", [4, 16])
def test_exemplars_with_missing_values_at_every_width(spark, d):
    draw = np.random.default_rng(14)
    values = draw.normal(size=(80, d))
    values[draw.random((80, d)) < 0.2] = np.nan
    rows = [(n, "X" if n < 40 else "Y", *[None if np.isnan(v) else float(v) for v in r]) for n, r in enumerate(values)]
    schema = "id long, label string, " + ", ".join(f"f{k:02d} double" for k in range(d))
    made = TwoSample.of(spark.createDataFrame(rows, schema), key="id")
    scores = exemplar.prototype_scores(made, "centroid").orderBy("id").select("score").toPandas()["score"].to_numpy()
    frame = pd.DataFrame(values[:40])
    inverse = np.linalg.pinv(frame.cov().to_numpy() + 1e-6 * np.eye(d))
    off = (frame - frame.mean()).fillna(0.0).to_numpy()
    np.testing.assert_allclose(scores[:40], -np.sqrt(np.maximum(np.einsum("ni,ij,nj->n", off, inverse, off), 0)), atol=1e-6)

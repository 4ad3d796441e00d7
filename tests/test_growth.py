"""Work that grows no faster than the input, or as little as the exact job allows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_numbers import brute_mmd, rbf, two_sample
from twinlens import runtime
from twinlens.model import TwoSample
from twinlens.operators import mmd, select
from twinlens.plans.dating import Dating


@pytest.mark.parametrize("chunk_rows", [512, 65_536])
def test_bandwidths_form_no_pairs(spark, monkeypatch, chunk_rows):
    """The lower median of all distances to the last bit, from values in order: repeated, close and constant ones too."""
    draw = np.random.default_rng(31)
    x, y = draw.normal(size=(301, 4)) / 3, draw.normal(0.1, 2, size=(160, 4)) / 3
    x[:, 1], y[:, 1] = draw.integers(0, 9, 301) / 7, draw.integers(0, 9, 160) / 7
    x[:, 2], y[:, 2] = 5.0 + x[:, 2] * 1e-14, 7.0 + y[:, 2] * 1e-14
    x[:, 3], y[:, 3] = 1.5, 1.5
    packed = mmd.packed_blocks(two_sample(spark, x, y), block_rows=64)

    def forbidden(*_, **__):
        raise AssertionError("pairs of rows were formed")

    monkeypatch.setattr(mmd, "_pair_frame", forbidden)
    found = mmd.pair_spreads(packed, 4, chunk_rows=chunk_rows)
    expected = [np.sort(np.abs(x[:, k, None] - y[None, :, k]).ravel())[(301 * 160 + 1) // 2 - 1] for k in range(3)]
    assert found.tolist() == [*expected, 1.0]


def test_a_report_computes_only_its_table(spark, monkeypatch):
    """One table of the dating report: no other is made, and wide stored results run in compiled methods."""
    cards = spark.createDataFrame([(k, k % 2, 1.0, float(k % 2), 20.0 + k, float(k % 3)) for k in range(40)], "iid long, wave int, dec double, dec_o double, age double, goal double")
    asked = {name: Dating().report(cards, [name]) for name in ("overview", "habits", "goal")}
    assert all(list(tables) == [name] for name, tables in asked.items())
    assert {r["label"]: r["n"] for r in asked["overview"]["overview"].collect()} == {"X": 20, "Y": 20, "total": 40}
    assert [(r["name_metric"], r["median_x"], r["median_y"]) for r in asked["habits"]["habits"].collect()] == [("age", 40.0, 39.0)]
    assert sum(r["count_x"] + r["count_y"] for r in asked["goal"]["goal"].collect()) == 40
    before, seen = spark.conf.get(runtime.METHOD_LIMIT), []
    with runtime.wide_columns(spark):
        seen.append(spark.conf.get(runtime.METHOD_LIMIT))
    assert seen == ["8000"] and spark.conf.get(runtime.METHOD_LIMIT) == before


def test_power_alone_takes_no_derivatives(spark, monkeypatch):
    """Held-out power and the query over all pairs need sums of kernels only."""
    draw = np.random.default_rng(32)
    made = two_sample(spark, draw.normal(size=(50, 3)), draw.normal(0.5, 1.2, size=(31, 3)))
    packed, spread, weights = mmd.packed_blocks(made, block_rows=16), np.array([1.0, 2.0, 0.7]), np.array([[0.4, 0.6, 0.3], [0.1, 0.0, 0.9]])
    sizes = mmd.mask_sizes(packed)
    expected = [power for power, _ in mmd.whole_power(packed, spread, weights, [0, 0], sizes)]
    assert all(len(row[0]) == 1 for row in mmd._power_sums(packed, spread, weights, [0, 0], sizes, slopes=False))
    np.testing.assert_allclose(mmd._held_out_power(packed, spread, weights, 0), expected)
    assert mmd.mmd_all_pairs(made, weights[0] / spread, 16).first()["power"] == pytest.approx(expected[0])


def test_counting_holds_little(spark):
    """A task counts at most 16 MB of values together and takes up one stretch at a time, whatever the rows are."""
    assert select.HELD_CELLS * 8 <= 16_000_000 and select.STRETCH * 24 <= 2_000_000
    rows = spark.range(160_000).selectExpr("CASE WHEN id % 2 = 0 THEN 'X' ELSE 'Y' END AS label", "CAST(id AS DOUBLE) + IF(id % 2 = 0, 0D, 1000D) AS a", "CAST(id % 7 AS DOUBLE) AS b")
    found = {r["name_variable"]: r["weight"] for r in select.wasserstein_weights(TwoSample(rows, ("a", "b")), scale=False, ranges=1).collect()}
    assert found["a"] == pytest.approx(1001.0) and found["b"] == pytest.approx(0.0, abs=1e-3)


def brute_power(x, y, scales):
    xx, yy, xy = rbf(x, x, scales), rbf(y, y, scales), rbf(x, y, scales)
    variance = 4 * min(len(x), len(y)) * ((xx.mean(1) - xy.mean(1)).var() / len(x) + (yy.mean(1) - xy.mean(0)).var() / len(y))
    return brute_mmd(x, y, scales) / np.sqrt(variance + 1e-8)


@pytest.mark.parametrize("limit", [0, mmd.DIRECT_SUM_LIMIT])
def test_a_training_step_needs_one_number_per_row(spark, monkeypatch, limit):
    """Power and slopes of several runs, with weights of 0 and masks, whether the rows' numbers stay on the driver or are stored."""
    draw = np.random.default_rng(33)
    x, y = draw.normal(size=(70, 4)), draw.normal(0.4, 1.3, size=(33, 4))
    made = two_sample(spark, x, y)
    even = made.with_frame(made.frame.withColumn("even", F.col("key") % 2 == 0))
    packed, sizes = mmd.packed_blocks(even, ["even"], block_rows=16), np.array([[70, 35], [33, 17]])
    monkeypatch.setattr(mmd, "DIRECT_SUM_LIMIT", limit)
    assert mmd.mask_sizes(packed).tolist() == sizes.tolist()
    spread, weights, masks = np.array([1.0, 2.0, 0.7, 1.5]), np.array([[0.4, 0.0, 0.3, 0.8], [0.5, 0.6, 0.2, 0.1]]), [0, 1]
    sums = mmd._power_sums(packed, spread, weights, masks, sizes)
    held = sums.kept.values() if limit else [r["shares"] for r in sums.kept.collect()]
    assert sum(len(v) for v in held) == 8 * (70 + 33 + 35 + 17)
    rows = [(x, y), (x[::2], y[::2])]
    power = lambda run, w: brute_power(*rows[run], w / spread)
    for run, (found, slope) in enumerate(mmd.whole_power(packed, spread, weights, masks, sizes)):
        assert found == pytest.approx(power(run, weights[run]))
        steps = [(power(run, weights[run] + s) - power(run, weights[run] - s)) / 2e-5 for s in 1e-5 * np.eye(4)]
        np.testing.assert_allclose(slope, steps, rtol=1e-4, atol=1e-7)


def test_kernels_leave_out_variables_without_weight():
    every, draw = np.ones((5, 1), bool), np.random.default_rng(34)
    block = mmd.Block(0, draw.normal(size=(5, 4)), draw.normal(size=(5, 4)), every, every)
    x, y = mmd._sides(block, np.ones(4), np.array([0.5, 0.0, 0.0, 2.0]), 0)
    assert x.rows.tolist() == block.x[:, [0, 3]].tolist() and y.left.shape == (5, 4)
    strips = [kernel.copy() for _, _, kernel in mmd._strips(x, y)]
    np.testing.assert_allclose(np.vstack(strips), rbf(block.x, block.y, np.array([0.5, 0.0, 0.0, 2.0])))


def test_a_rejected_step_takes_no_slopes(spark, monkeypatch):
    """Slopes are computed where a step is accepted; every fit still ends within the tolerance."""
    draw = np.random.default_rng(35)
    x, y = draw.normal(size=(60, 4)), draw.normal(size=(60, 4))
    y[:, 1] += 1.5
    packed, seen = mmd.packed_blocks(two_sample(spark, x, y)), {"_power_sums": [], "_power_slopes": []}

    def watch(name, runs):
        found = getattr(mmd, name)
        monkeypatch.setattr(mmd, name, lambda *a, **k: seen[name].append(runs(a)) or found(*a, **k))

    watch("_power_sums", lambda a: len(a[3]))
    watch("_power_slopes", lambda a: len(a[6]))
    trained = mmd.train_weights(packed, np.ones(4), [(0, 0.0), (0, 0.1)], mmd.Options(learning_rate=1.5))
    assert trained.residual.max() <= 1e-3 and sum(seen["_power_sums"]) == trained.steps.sum() > sum(seen["_power_slopes"])


def test_small_blocks_are_joined(spark):
    """As few pairs of blocks as keep all cores busy; every row stays in one block, and the spreads are the same."""
    draw = np.random.default_rng(36)
    x, y = draw.normal(size=(400, 2)), draw.normal(0.5, 1, size=(150, 2))
    made, splits = two_sample(spark, x, y), np.ceil(np.sqrt(3 * spark.sparkContext.defaultParallelism))
    packed = mmd.packed_blocks(made, block_rows=2)
    assert packed.frame.count() <= max(25, 3 * splits) and mmd.mask_sizes(packed).tolist() == [[400], [150]]
    assert mmd._pair_frame(packed.frame).count() == packed.frame.count() * (packed.frame.count() + 1) // 2
    assert mmd.pair_spreads(packed, 2).tolist() == mmd.pair_spreads(mmd.packed_blocks(made), 2).tolist()
    assert mmd.packed_blocks(made, block_rows=2, blocks=60).frame.count() == 60

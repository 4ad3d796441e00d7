"""Caps on repeated keys, writers without a lock, pair keys, medians of many columns, linear and permutation estimates."""

from threading import Thread

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from test_numbers import brute_mmd, rbf, two_sample
from twinlens.functions.ranks import middle_value, wide_medians
from twinlens.operators import mmd, pairs, sample, select
from twinlens.runtime import discard, durable
from twinlens.sources.tables import Warehouse


def test_caps_are_exact_on_repeated_keys(spark):
    rows = [(k % 3, "X", k) for k in range(100)] + [(k, "Y", k) for k in range(40)] + [(7, "Y", 100 + k) for k in range(60)]
    df = spark.createDataFrame(rows, "key long, label string, v int")
    for limit in (1, 5, 34, 99, 1000):
        counts = {r["label"]: r["count"] for r in sample.capped(df, "key", limit).groupBy("label").count().collect()}
        assert counts == {"X": min(limit, 100), "Y": min(limit, 100)}
    once = sorted(r["v"] for r in sample.capped(df, "key", 50).collect())
    assert once == sorted(r["v"] for r in sample.capped(df.repartition(5), "key", 50).collect())
    parts = sample.train_test_parts(df, "key", 0.8)
    assert parts.where("is_train").count() == 160 and parts.where("is_test").count() == 40


@pytest.mark.parametrize("kind,values", [("string", ["b", "a", "é", "aa", None, "c"]), ("bigint", [2**62 + k for k in (5, 1, 3, 2)]), ("date", [None])])
def test_middle_of_any_type(spark, kind, values):
    found = middle_value(spark.createDataFrame([(v,) for v in values], "k string" if kind == "date" else f"k {kind}").select(F.col("k").cast(kind)), "k")
    there = sorted((v for v in values if v is not None), key=lambda v: v.encode() if isinstance(v, str) else v)
    assert found == (there[len(there) // 2] if there else None)


def test_two_writers_lose_nothing(spark, tmp_path):
    store = Warehouse(spark, str(tmp_path / "w"))
    store.put_metadata({"a": "0", "b": "0"})
    threads = [Thread(target=lambda k=k: Warehouse(spark, store.folder).put_metadata({f"own{k}": str(k), "a": str(k)})) for k in (1, 2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    found = {r["key"]: r["value"] for r in store.metadata().collect()}
    assert found["own1"] == "1" and found["own2"] == "2" and found["b"] == "0" and found["a"] in "12"
    # even where both have drawn one number, every reader sees one of them win with all its keys
    for value in "xy":
        store._append_metadata({"p": value, "q": value}, mode="append", seq=99)
    seen = {tuple(sorted((r["key"], r["value"]) for r in store.metadata().collect() if r["key"] in "pq")) for _ in range(3)}
    assert len(seen) == 1 and len({v for _, v in next(iter(seen))}) == 1


def test_pair_keys_identify_rows(spark):
    rows = [(1, 2, 1, 1), (2, 1, 0, 1), (1, 2, 1, 1), (1, 2, 1, 2), (2, 1, 0, 2)]
    joined = pairs.with_pair_key(pairs.reciprocal_pairs(spark.createDataFrame(rows, "iid long, pid long, gender int, wave int")))
    keys = [r["pair_key"] for r in joined.collect()]
    assert len(keys) == 3 == len(set(keys)) and len({k.split("-")[0] for k in keys}) == 1


def test_medians_of_many_columns(spark):
    draw = np.random.default_rng(3)
    frame = pd.DataFrame({"a": draw.normal(size=5000), "b": draw.integers(0, 3, 5000).astype(float), "c": np.full(5000, 7.0), "d": np.full(5000, np.nan), "e": draw.exponential(size=5000) ** 5})
    frame.loc[draw.random(5000) < 0.2, ["a", "e"]] = np.nan
    df = spark.createDataFrame(frame).repartition(4)
    found, flags = wide_medians(df, {c: F.col(c) for c in frame}, {"gap": F.isnan("a"), "none": F.col("c") < 0})
    assert found == pytest.approx({c: frame[c].median() for c in "abce"}) and flags == {"gap": True, "none": False}
    assert wide_medians(df.limit(0), {"a": F.col("a")}) == ({}, {})
    few = df.limit(4)
    assert wide_medians(few, {"c": F.col("c")})[0] == {"c": 7.0}


def test_wasserstein_with_gaps_and_one_label(spark):
    x, y = np.array([[1.0, 1.0], [2.0, np.nan], [2.0, 3.0]]), np.array([[np.nan, 5.0], [np.nan, 6.0]])
    weights = [r["weight"] for r in select.wasserstein_weights(two_sample(spark, x, y), scale=False).orderBy("id_variable").collect()]
    assert weights == pytest.approx([0.0, 3.5])


def test_spreads_do_not_depend_on_blocks(spark):
    draw = np.random.default_rng(4)
    x, y = draw.normal(size=(50, 3)), draw.normal(1, 2, size=(33, 3))
    x[:, 2], y[:, 2] = draw.integers(0, 2, 50), draw.integers(0, 2, 33)
    expected = [np.sort(np.abs(x[:, k, None] - y[None, :, k]).ravel())[(50 * 33 + 1) // 2 - 1] for k in range(3)]
    for block_rows in (512, 7):
        found = mmd.pair_spreads(mmd.packed_blocks(two_sample(spark, x, y), block_rows=block_rows), 3)
        np.testing.assert_allclose(found, np.where(np.array(expected) < 1e-8, 1.0, expected))


def test_permutations_and_linear_estimate(spark):
    draw = np.random.default_rng(5)
    x, y = draw.normal(size=(40, 2)), draw.normal(size=(24, 2))
    made = two_sample(spark, x, y)
    values = [mmd.permuted_values(mmd.packed_blocks(made, block_rows=n), np.full(2, 0.5), 0, 20, 9) for n in (512, 11)]
    np.testing.assert_allclose(values[0], values[1])
    assert values[0][0] == pytest.approx(brute_mmd(x, y, np.full(2, 0.5)))
    found = mmd.mmd_linear(made, [0.5, 0.5]).first()
    assert found["n_pairs"] == 12 and found["z"] == pytest.approx(found["mmd_squared"] / found["std_error"])
    shifted = mmd.mmd_linear(two_sample(spark, draw.normal(size=(400, 2)), draw.normal(1.5, 1, size=(400, 2))), [0.5, 0.5], 128).first()
    far = draw.normal(1.5, 1, size=(400, 2))
    assert shifted["z"] > 3 and abs(shifted["mmd_squared"] - brute_mmd(draw.normal(size=(400, 2)), far, np.full(2, 0.5))) < 5 * shifted["std_error"]
    assert rbf(x, x, 1.0).shape == (40, 40)


def test_p_values_under_the_null(spark):
    """Weights and bandwidths come from train rows only, so the p-value of the test rows is one of a fair permutation test."""
    found = []
    for seed in range(5):
        draw = np.random.default_rng(200 + seed)
        made = two_sample(spark, draw.normal(size=(40, 2)), draw.normal(size=(40, 2)))
        found.append(mmd.mmd_select(made, max_epochs=6, search_steps=1, penalties=(0.1,), permutations=39).p_value)
    assert min(found) > 0.02 and max(found) > 0.3


def test_discard_deletes_what_was_stored(spark):
    kept, gone = durable(spark.range(5), "kept"), durable(spark.range(5), "gone")
    discard(gone)
    assert kept.count() == 5
    with pytest.raises(Exception):
        spark.read.parquet(gone._stored_at).count()

"""What the duplicate stage has on disk at once: no sets beside lists of tokens, and only those texts that a join may change; what training holds."""

import os
import random

import pytest
from pyspark.sql import functions as F

from twinlens import runtime
from twinlens.llm import jaccard, toxicity


def family_docs(spark, families=12, alone=400):
    """Unlike texts, and a few families: a text, an exact copy and an edited one."""
    rng = random.Random(3)
    new = lambda: [f"w{rng.randrange(100_000)}" for _ in range(60)]
    texts = [new() for _ in range(alone + families)]
    for text in texts[:families]:
        texts += [text, [*text[:30], "edit", *text[31:]]]
    return spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4).localCheckpoint()


def shuffled_rows(plan) -> int:
    """Rows that the exchanges of an executed plan have written."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return shuffled_rows(plan.executedPlan())
    if name.endswith("QueryStage"):
        return shuffled_rows(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
    return own + sum(shuffled_rows(plan.children().apply(k)) for k in range(plan.children().size()))


@pytest.fixture
def shuffled_joins(spark):
    """Tables of this size would be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sets_go_before_tokens_become_lists(spark, monkeypatch, shuffled_joins):
    there, made, store = [], {}, jaccard.durable

    def durable(df, name="stage"):
        if name == "shared":
            there.append(os.path.exists(made["sets"]._stored_at))
        made[name] = store(df, name)
        return made[name]

    monkeypatch.setattr(jaccard, "durable", durable)
    found = jaccard.jaccard_components(family_docs(spark), 80, 5).groupBy("component_id").count().where("count > 1").collect()
    assert sorted(map(tuple, found)) == [(k, 3) for k in range(12)]
    assert there == [False]


def test_texts_that_stay_are_not_dealt_out(spark, shuffled_joins):
    docs = family_docs(spark)
    repeated = docs.unionByName(docs.where("doc_id = 100"))
    for table in (docs, repeated):
        kept = jaccard.first_of_each(table, 80, 5)
        assert sorted(r.doc_id for r in kept.collect()) == list(range(412))
        assert shuffled_rows(kept._jdf.queryExecution().executedPlan()) < 300


@pytest.mark.parametrize("bits", [26, 6])
def test_sifted_rows_are_whole(spark, monkeypatch, bits):
    """Also where a sieve is too small to tell anything."""
    monkeypatch.setattr(runtime, "SIEVE_BITS", bits)
    rows = spark.range(3000).select(F.when(F.col("id") % 7 > 0, F.col("id") % 1500).alias("word"), F.lit("x").alias("bits"))
    for keys in (rows.where("word < 300 OR word IS NULL"), rows.limit(0)):
        wanted = keys.select(F.col("word").alias("key"))
        near, rest = runtime.sifted(rows, F.xxhash64(rows["word"]), wanted, F.xxhash64("key"))
        assert near.columns == rest.columns == rows.columns
        assert rest.join(wanted.distinct(), rest["word"].eqNullSafe(F.col("key")), "left_semi").count() == 0
        assert sorted(map(repr, near.unionByName(rest).collect())) == sorted(map(repr, rows.collect()))
        if bits == 26:
            assert near.count() == keys.count()


def test_counts_of_stems_are_handed_on_in_parts(spark, monkeypatch):
    """A training task holds few stems at a time; what is learned is the same."""
    rng = random.Random(5)
    texts = [(" ".join(rng.choice(["vilely", "vileness", "calm", "green", "tables", "walking"]) for _ in range(20)), 0) for _ in range(60)]
    texts += [(" ".join(f"{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}x scumbags" for _ in range(12)), 1) for _ in range(60)] + [(None, 0), ("", 1)]
    train, found = spark.createDataFrame(texts, "text string, toxic int"), []
    for most in (1, 20, 10**9):
        monkeypatch.setattr(toxicity, "TALLIED_STEMS", most)
        found.append(toxicity.learn_stems(train))
    assert found[0] == found[1] == found[2] and any("scumbags".startswith(s) for s in found[0])

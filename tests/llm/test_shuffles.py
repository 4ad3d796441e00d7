"""What the duplicate stage deals out over the cluster: every token once, not once for its count and once for its rows."""

import re

from twinlens.llm import jaccard


def test_tokens_are_dealt_out_once(spark, monkeypatch):
    texts = [f"{k % 3} " + " ".join(f"w{(k // 4) * 50 + i}" for i in range(50)) for k in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plans, store = {}, jaccard.durable

    def durable(df, name="stage"):
        if name in ("tokens", "qualified"):
            df.collect()
            plans[name] = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        return store(df, name)

    monkeypatch.setattr(jaccard, "durable", durable)
    found = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs, 80, 5).collect()}
    assert set(found.values()) == set(range(0, 80, 4))
    assert len(re.findall(r"(?<!Reused)Exchange hashpartitioning\(token#", plans["tokens"])) == 1
    assert len(re.findall(r"(?<!Reused)Exchange hashpartitioning\(pivot#\d+L?, token#", plans["qualified"])) == 1

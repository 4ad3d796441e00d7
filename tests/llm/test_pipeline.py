"""Every stage of the corpus pipeline against plain Python, with repeated ids, nulls, empty texts and empty tables."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from twinlens.llm import decontaminate, jaccard, quality, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row int, component string"
SF = "/root/testdata/sf0.001"


def table(spark, rows):
    """Documents with two columns whose names the stages use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", None, -1, "x") for i, t in rows], SCHEMA)


def ids(df):
    return sorted(map(repr, ((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())))


def shingles(text, words):
    parts = (text or "").lower().split()
    return {tuple(parts[k : k + words]) for k in range(max(1, len(parts) - words + 1))} if parts else set()


def one_of_each(rows, percent, words):
    """Of (id, text) rows: the rows of each component with the smallest id; which of those with one id stays is the operator's choice."""
    sets = [shingles(t, words) for _, t in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    kept = {}
    for k, (doc, _) in enumerate(rows):
        kept.setdefault(root[k] if sets[k] else ("none", k), []).append((doc is None, doc or 0, k))
    return [[rows[k] for missing, i, k in group if (missing, i) == min(group)[:2]] for group in kept.values()]


def family(rng, count, length=60):
    base = [f"w{rng.randrange(400)}" for _ in range(length)]
    for _ in range(count):
        copy = list(base)
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            copy[rng.randrange(length)] = f"w{rng.randrange(400)}"
        yield " ".join(copy)


@pytest.mark.parametrize("percent,words", [(80, 5), (90, 3)])
def test_one_row_of_each_component_stays(spark, percent, words):
    rng = random.Random(percent)
    rows = [(1, "t u v w x y"), (2, "t u v w x y"), (2, "other text that stands nowhere else"), (5, "a b c d e f g"), (5, "a b c d e f g"), (None, None), (8, ""), (8, " \n"), (8, "")]
    rows += [(None, "only here without an id at all"), (None, "twice without an id at all"), (None, "twice without an id at all"), (None, "t u v w x y")]
    for size in (30, 12, 3):
        rows += [(rng.randrange(100, 140), t) for t in family(rng, size)]
    docs = table(spark, rows).coalesce(1)
    kept = jaccard.first_of_each(docs, percent, words)
    assert kept.columns == docs.columns
    left = [(r.doc_id, r.text) for r in kept.collect()]
    for choice in one_of_each(rows, percent, words):
        left.remove(next(row for row in left if row in choice))
    assert left == []
    assert jaccard.first_of_each(docs.limit(0), percent, words).count() == 0


def test_stages_keep_what_they_should(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    real = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, None), (1, None), (2, ""), (2, ""), (3, " \n"), (4, "A calm line. " * 20)]
    rows = [(r.doc_id, r.text) for r in real.orderBy("doc_id").collect()] + odd
    docs = table(spark, rows)

    model = toxicity.train_model(docs, labels)
    scored = toxicity.score_toxicity(docs, model).select("doc_id", "predicted").collect()
    marks = {}
    for r in scored:
        marks.setdefault(r.doc_id, set()).add(r.predicted)
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert clean.columns == docs.columns
    assert ids(clean) == sorted(repr((i, t)) for i, t in rows if 0 in marks[i] and (len(marks[i]) == 1 or t in (None, "")))

    judged = quality.apply_rules(docs).select("doc_id", "kept")
    assert docs.columns == corpus_pipeline.keep_quality(spark, docs, SF).columns
    good = corpus_pipeline.keep_quality(spark, docs, SF)
    assert good.count() == judged.where("kept").count() and {r.doc_id for r in good.collect()} == {r.doc_id for r in judged.where("kept").collect()}

    leaks = {(r.doc_id) for r in decontaminate.find_leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    left = corpus_pipeline.decontaminate_benchmark(spark, docs, SF)
    assert left.columns == docs.columns and leaks
    assert ids(left) == sorted(repr((i, t)) for i, t in rows if i not in leaks)

    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_run_is_its_stages_on_plain_rows(spark):
    """The whole pipeline: rows that remain are packed once, whole, without gaps, and are those of the stages one by one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    model = toxicity.train_model(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    fine = {r.doc_id for r in toxicity.score_toxicity(docs, model).where("predicted = 0").collect()}
    good = {r.doc_id for r in quality.apply_rules(docs).where("kept").collect()}
    rows = [choice[0] for choice in one_of_each([r for r in rows if r[0] in fine & good], 80, 5)]
    leaks = {r.doc_id for r in decontaminate.find_leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    rows = [r for r in rows if r[0] not in leaks]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}
    packed = corpus_pipeline.run(spark, SF).collect()
    lengths, places = {}, {}
    for r in packed:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert lengths == expected
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= -(-sum(expected.values()) // 4096) * 1.1 + 1

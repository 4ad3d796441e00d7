"""The training-data operators against plain Python on small tables, odd rows included."""

import random
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from compare import connect, differences
from twinlens.llm import decontaminate, jaccard, main_text, packing, quality, queries, resharding, token_counts, toxicity, url_filter

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", "  \n", "Hello <|endoftext|> world's", "é ñ  x\n\nß", "a b c a b c", "same", "same", "long " * 30_000]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k if k != 4 else None, t, "x", -1) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, score int")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows_as_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLE[name]) is None


def test_token_counts_are_the_tokenizers(spark, odd):
    file = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(file)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(odd, file).collect()}
    for k, text in enumerate(TEXTS):
        text = text or ""
        assert got[k if k != 4 else None] == (len(text.encode()), len(tokenizer.encode(text, add_special_tokens=False)))
    assert token_counts.count_tokens(odd.limit(0), file).count() == 0


def test_packing_is_gapless_and_whole(spark, odd):
    file = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(file)
    rows = packing.pack_documents(odd, file).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    for k in (0, 3, 8):
        ids = tokenizer.encode(TEXTS[k] or "", add_special_tokens=False).ids + [1]
        pieces = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == k)
        for piece, start, length, crc in pieces:
            assert crc == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[start : start + length]))
        assert sum(p[2] for p in pieces) == len(ids)


def test_flow_moves_the_fewest_bytes():
    blocks = resharding.transfers([90, 10, 20], 4)
    into = [sum(b - a for _, a, b, j in blocks if j == k) for k in range(4)]
    assert into == [30, 30, 30, 30]
    assert sum(b - a for i, a, b, j in blocks if i != j) == 60


def test_resharding_slots(spark, odd):
    placed = resharding.reshard(resharding.document_sizes(odd), F.lit(0), 3).collect()
    assert len(placed) == len(TEXTS)
    for shard in range(3):
        slots = sorted(r.slot for r in placed if r.shard == shard)
        assert slots == list(range(len(slots)))


@pytest.mark.parametrize("percent,words", [(90, 3), (80, 5)])
def test_components_against_brute_force(spark, percent, words):
    rng, texts = random.Random(percent), [None, ""]
    for length in (12, 60):
        base = [f"w{rng.randrange(300)}" for _ in range(length)]
        for _ in range(40):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 3, 6])):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(300)}"
            texts.append(" ".join(copy))
    sets = [{tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if (w := (t or "").split()) else set() for t in texts]
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    got = jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), percent, words).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(root))


def test_leaks_are_found_with_edits():
    rng = random.Random(5)
    items = [(k, " ".join(f"w{rng.randrange(500)}" for _ in range(30))) for k in range(40)]
    search = decontaminate.Items(items)
    texts = []
    for _, text in items:
        words = text.split()
        for _ in range(3):
            words[rng.randrange(len(words))] = "other"
        texts.append(" ".join(["before"] * 20 + words + ["after"] * 20))
    found = search.matches([*texts, None, "", "nothing here"])
    assert sum(any(m[0] == k for m in rows) for k, rows in enumerate(found[:40])) >= 36
    assert found[40:] == [[], [], []]


def test_main_text():
    page = "<body><nav><a href=x>menu</a></nav><article><h1>Title</h1><p>One &amp; two<br>three<p>Four</article><footer>end</footer>"
    assert main_text.main_text(page) == "Title One & two three Four"
    assert main_text.main_text(None) == main_text.main_text("") == ""


def test_grammar_marks_clauses():
    machine, lexicon = toxicity.grammar().compiled(), toxicity.Lexicon()
    marked = lambda text: {toxicity.HITS[k] for k, n in enumerate(toxicity.hits_of(text, lexicon, machine) or []) if n}
    assert marked("You idiot!") == {("insult", False, False, True)}
    assert marked("He said. Not an idiot") == {("insult", True, False, False)}
    assert marked("she said idiot") == {("insult", False, True, True)}
    assert marked("a fine day") == set()


def test_cascade_is_exact(spark):
    keys = spark.range(3000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = url_filter.Cascade(keys, bits_per_key=4)
    assert keys.where(cascade.contains(F.col("key")) != F.col("listed")).count() == 0


def test_rules_keep_columns(spark, odd):
    assert quality.keep_good(odd).columns == odd.columns
    assert quality.apply_rules(odd).where("kept").count() == 0


def test_packing_ids_of_cut_words():
    """Ids that come from the shared cache are those of the whole text, for plain texts, other scripts and special strings."""
    file = public_tokenizers.path("word_bpe_49k.json")
    rng, cached = random.Random(3), packing.WordIds(file)
    plain = [chr(c) for c in [*range(9, 14), *range(32, 127), *range(0xA1, 0x100)]] + ["'ll", "'re", " ", "<|endoftext|>"]
    other = plain + [chr(c) for c in range(0x250)] + list("ΣςİıŒœ　 ́")
    for n in range(3_000):
        text = "".join(rng.choices(other if n % 3 == 0 else plain, k=rng.randint(0, 40)))
        assert cached.text(text) == cached.encoded(text), repr(text)


def test_rewrite_keeps_what_it_does_not_change(spark, tmp_path):
    folder = str(tmp_path / "shards")
    old = [(k, k % 4) for k in range(40)]
    spark.createDataFrame(old, "doc_id long, shard int").write.partitionBy("shard").parquet(folder)
    files = lambda k: {p.name for p in (tmp_path / "shards" / f"shard={k}").glob("*.parquet")}
    before = {k: files(k) for k in range(4)}
    # all rows of shard 3 go to shard 2
    placed = [(doc, k, min(k, 2), doc) for doc, k in old]
    rows = spark.createDataFrame(placed, "doc_id long, old_shard int, shard int, slot long")
    assert resharding.rewrite(rows.withColumn("shard", F.col("old_shard")), folder) == []
    assert {k: files(k) for k in range(4)} == before
    assert resharding.rewrite(rows, folder) == [2, 3]
    assert files(0) == before[0] and files(1) == before[1] and not files(2) & before[2]
    assert not (tmp_path / "shards" / "shard=3").exists()
    assert sorted((r.doc_id, r.shard) for r in spark.read.parquet(folder).collect()) == [(doc, min(k, 2)) for doc, k in old]


@pytest.mark.parametrize("length", [60, 400])
def test_leaks_are_found_at_the_edits_allowed(length):
    """Long items too, for which no affordable number of walks reaches the target recall."""
    rng = random.Random(length)
    items = [(k, " ".join(f"w{rng.randrange(2000)}" for _ in range(length))) for k in range(40)]
    search = decontaminate.Items(items)
    texts = []
    for _, text in items:
        words = text.split()
        for at in rng.sample(range(length), length // 5):
            words[at] = f"w{rng.randrange(2000)}"
        texts.append(" ".join(["before"] * 20 + words + ["after"] * 20))
    assert sum(any(m[0] == k for m in rows) for k, rows in enumerate(search.matches(texts))) >= 39


def test_short_items_are_found_as_they_stand():
    items = [("one", "Zanzibar"), ("three", "so it goes"), ("seven", "a b c d e f g"), ("none", " ?! "), ("again", "So it goes!")]
    found = decontaminate.Items(items).matches(["x so it goes so it goes", "so it", "goes", None, "A b, c d e f g; zanzibar", "a b c d e f h"])
    assert found == [[("three", 0, 1, 3), ("again", 0, 1, 3)], [], [], [], [("one", 0, 7, 7), ("seven", 0, 0, 6)], []]


STORY = "<h1>Title</h1><p>" + "One long sentence of the story. " * 5 + "</p>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div id=page class='site has-sidebar'><article>{STORY}</article></div>",
        f"<body><main class='no-sidebar'>{STORY}</main>",
        f"<body><article class='with-comments'>{STORY}<section class=comments><article class=comment>I agree</article></section></article>",
        f"<body><div class='widget'><div class='inner'>{STORY}</div></div><div class=footer>end</div>",
        f"<body><div class=widget><main>{STORY}</main></div><div id=site-footer>end</div>",
        f"<body><article>{STORY}</article><div id=comments><p>{'I do not agree with any of it. ' * 20}</p></div>",
        f"<html><head><title>t</title><meta charset=utf-8><body><article>{STORY}</article></body>",
        f"<head><title>t</title><div>{STORY}</div>",
    ],
)
def test_main_text_is_not_cut_with_boilerplate(page):
    assert main_text.main_text(page) == " ".join(["Title"] + ["One long sentence of the story."] * 5)

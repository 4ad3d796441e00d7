"""Operators without SQL against plain twins, and odd rows, ties and empty tables for all of them."""

import datetime
import json
import random
from decimal import Decimal

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, decoders, models, normalizers, pre_tokenizers, trainers  # noqa: F401

from twinlens.llm import decontaminate, jaccard, licenses, main_text, packing, resharding, token_counts, toxicity, url_filter

SF = "/root/testdata/sf0.001"


def table(spark, rows, schema="doc_id long, text string"):
    """With columns that results use as well."""
    clash = ", score string, n_words int, component_id string, text_crc32 string"
    return spark.createDataFrame([(*r, "x", -1, "y", "z") for r in rows], schema + clash)


# decontamination


def best_edits(item, text):
    """Least word edits that turn the item into some stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, word in enumerate(item, 1):
        new = [i]
        for j, other in enumerate(text, 1):
            new.append(min(row[j - 1] + (word != other), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_leaks_are_those_of_plain_edit_distance():
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(60)}"
    items = [(k, " ".join(word() for _ in range(rng.choice([3, 8, 12, 20, 33])))) for k in range(30)] + [(90, "la la la " * 8), (91, "")]
    texts = [None, "", "la " * 50, "la la x " * 20]
    for _ in range(60):
        words = [word() for _ in range(rng.randrange(5, 60))]
        for k, text in rng.sample(items, rng.randrange(3)):
            copy = text.split()
            for _ in range(rng.randrange(1 + len(copy) // 4)):
                at = rng.randrange(len(copy) or 1)
                copy[at : at + rng.randrange(2)] = [word()] if rng.random() < 0.7 else []
            at = rng.randrange(len(words))
            words[at:at] = copy
        texts.append(" ".join(words))
    search = decontaminate.Items(items)
    expected, got = {}, {}
    for t, (text, rows) in enumerate(zip(texts, search.matches(texts))):
        words = (text or "").split()
        for k, item in items:
            distance = best_edits(item.split(), words) if item else 99
            allowed = int(0.2 * len(item.split()) + 1e-9) if len(item.split()) >= decontaminate.LEAST_WORDS else 0
            if distance <= allowed and words:
                expected[t, k] = distance
        for k, distance, first, last in rows:
            got[t, k] = distance
            assert best_edits(dict(items)[k].split(), words[first : last + 1]) == distance
    assert set(got) <= set(expected) and all(expected[x] == d for x, d in got.items())
    assert len(expected) > 40 and len(got) >= 0.97 * len(expected)


def test_equal_words_in_bounded_time():
    assert decontaminate.Items([(1, "long " * 400)]).matches(["long " * 30_000]) == [[(1, 0, 0, 399)]]


@pytest.mark.parametrize("kind,names", [("int", [3, 4]), ("string", ["a", "b"]), ("date", [datetime.date(2020, 1, 1), datetime.date(2021, 1, 1)]), ("decimal(9,2)", [Decimal("1.50"), Decimal("2.00")])])
def test_item_ids_of_any_type(spark, kind, names):
    passage = "one two three four five six seven eight nine ten"
    benchmark = spark.createDataFrame([(names[0], passage, 1), (names[1], "never found here at all not a bit of it", 2), (names[0], passage, 3), (None, None, 4)], f"item_id {kind}, text string, distance int")
    docs = table(spark, [(1, f"x {passage} y"), (1, f"x {passage} y"), (2, None), (3, ""), (None, passage), (4, "clean text " * 20_000)])
    found = decontaminate.find_leaks(docs, benchmark)
    assert found.schema["item_id"].dataType == benchmark.schema["item_id"].dataType
    assert sorted(map(repr, ((r.doc_id, r.item_id, r.distance) for r in found.collect()))) == sorted(map(repr, [(d, names[0], 0) for d in (1, 1, None) for _ in (1, 2)]))
    left = decontaminate.remove_leaks(docs, benchmark)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 4]
    assert decontaminate.find_leaks(docs.limit(0), benchmark).count() == decontaminate.find_leaks(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.remove_leaks(docs, benchmark.limit(0)).count() == 6


# main text

STORY = "<h1>Title</h1><p>" + "One long sentence of the story. " * 5 + "</p>"
TEXT = " ".join(["Title"] + ["One long sentence of the story."] * 5)


@pytest.mark.parametrize(
    "page",
    [
        f"<body><form id=aspnetForm><div>{STORY}</div></form>",
        f"<body><form id=f><nav>menu</nav><div>{STORY}</div><form class=search><label>Find</label><input></form></form>",
        f"<body><dialog open><article>{STORY}</article></dialog><form><label>Name</label><input></form>",
        f"<body><article>{STORY}</article><form><p>{'Leave a comment here. ' * 9}</p></form>",
        f"<body>{STORY}<!-- open <b>comment</b>",
        f"<body>{'</div></p></b>' * 30_000}{STORY}",
        f"<body>{'<div>' * 20_000}{'</span></li>' * 20_000}{STORY}",
        f"<body>{STORY}{'<a ' * 100_000}",
        f"<body><div x=1 {'a' * 300_000}>{STORY}",
    ],
)
def test_forms_and_broken_pages(page):
    assert main_text.main_text(page).startswith(TEXT)
    assert "comment" not in main_text.main_text(page)


def test_story_in_a_form_is_found():
    assert main_text.main_text("<body><form id=aspnetForm><div>story</div></form>") == "story"


def test_odd_pages(spark):
    rows = [(1, "u", f"<article>{STORY}</article>"), (1, "u", f"<article>{STORY}</article>"), (None, None, None), (2, "v", ""), (3, "w", "<p>" + "word " * 100_000)]
    pages = spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = main_text.extract_main_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(repr, got.collect())) == sorted(
        f"Row(page_id={i!r}, url={u!r}, text={t!r}, n_chars={len(t)})" for i, u, t in [(1, "u", TEXT)] * 2 + [(None, None, ""), (2, "v", ""), (3, "w", ("word " * 100_000).strip())]
    )
    assert main_text.extract_main_text(pages.limit(0)).count() == 0


# packing and resharding


def test_bitset_packer_is_plain_best_fit():
    rng = random.Random(2)
    for size, most in ((100, 5), (100, 40), (17, 3)):
        packer, bins, open_bins = packing.BestFit(size, most), [], []
        for length in [rng.randrange(1, size + 1) for _ in range(2_000)]:
            number, place = packer.place(length)
            fits = [size - bins[b] for b in open_bins if size - bins[b] >= length]
            if not fits:
                if len(open_bins) >= most:
                    fullest = max(bins[b] for b in open_bins)
                    left = {n for s, numbers in packer.bins.items() for n in numbers}
                    closed = [b for b in open_bins if b not in left]
                    assert len(closed) == 1 and bins[closed[0]] == fullest
                    open_bins.remove(closed[0])
                assert number == len(bins) and place == 0
                bins.append(0)
                open_bins.append(number)
            else:
                assert number in open_bins and size - bins[number] == min(fits) and place == bins[number]
            bins[number] += length
            if bins[number] == size:
                open_bins.remove(number)
        assert packer.still_open() == {b: bins[b] for b in open_bins}


def test_flow_moves_no_more_than_it_must():
    """Whatever a shard holds beyond its new capacity has to leave it, and nothing else."""
    rng = random.Random(3)
    for _ in range(200):
        old = [rng.randrange(200) * rng.randrange(2) for _ in range(rng.randrange(1, 9))]
        shards = rng.randrange(1, 9)
        capacity = resharding.equal_capacities(sum(old), shards)
        blocks = resharding.transfers(old, shards)
        moved = sum(b - a for i, a, b, j in blocks if i != j)
        assert moved == sum(max(0, n - (capacity[i] if i < shards else 0)) for i, n in enumerate(old))
        assert [sum(b - a for _, a, b, j in blocks if j == k) for k in range(shards)] == capacity


def test_odd_rows_are_resharded(spark):
    docs = table(spark, [(1, None), (2, ""), (None, "a"), (3, "same"), (3, "same"), (4, "long " * 50_000)])
    placed = resharding.reshard(resharding.document_sizes(docs), F.lit(0), 3)
    rows = placed.collect()
    assert len(rows) == 6 and sorted(r.size for r in rows) == [8, 8, 9, 12, 12, 250_008]
    assert resharding.reshard(resharding.document_sizes(docs.limit(0)), F.lit(0), 3).count() == 0


# token counts


def test_files_that_split_otherwise_are_counted_whole(spark, tmp_path):
    whole = json.loads(open(public_tokenizers.path("byte_bpe_50k.json")).read())
    docs = table(spark, [(1, "Hello  wORLD's 12 ñ"), (2, None), (2, ""), (None, "  x\n<|endoftext|> y"), (3, "long " * 20_000)])
    changes = [{}, {"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": whole["pre_tokenizer"] | {"add_prefix_space": True}}]
    changes.append({"added_tokens": [whole["added_tokens"][0] | {"lstrip": True}]})
    for k, change in enumerate(changes):
        file = f"{tmp_path}/{k}.json"
        with open(file, "w") as out:
            json.dump(whole | change, out)
        tokenizer = Tokenizer.from_file(file)
        assert token_counts.PreTokens(file).known == (not change)
        got = sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.count_tokens(docs, file).collect())
        assert got == sorted((r.doc_id or 0, len(tokenizer.encode(r.text or "", add_special_tokens=False))) for r in docs.collect())


# url filter


def test_cascade_is_small_where_few_are_listed(spark):
    keys = spark.range(1_000_000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 100_000 == 7).alias("listed"))
    cascade = url_filter.Cascade(keys)
    assert cascade.bits < 8 * 64 * 1024 and keys.where(cascade.contains(F.col("key")) != F.col("listed")).count() == 0
    assert url_filter.Cascade(keys.where("NOT listed")).levels == []


def test_odd_urls_and_block_list(spark):
    urls = [None, "", "no scheme", "http://Bad.Example/x", "http://bad.example/x", "http://bad.example/x", "http://good.example", "https://a.org/es/1", "http://" + "a" * 50_000, "http://sub.example.org/es/2?q#f"]
    pages = spark.createDataFrame([(k if k != 4 else None, u, "x", "y") for k, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    listed = spark.createDataFrame([("bad.example", 1), ("bad.example", 2), (None, 3), ("elsewhere.net", 4)], "host string, key int")
    expected = {0: "allow", 1: "allow", 2: "allow", 3: "block", None: "block", 5: "block", 6: "allow", 7: "allow", 8: "allow", 9: "block"}
    for most in (url_filter.MOST_BITS, 10):  # the cascade, and the join beyond its bits
        assert {r.page_id: r.verdict for r in url_filter.judge_urls(pages, most_bits=most, block_list=listed).collect()} == expected
    assert url_filter.judge_urls(pages.limit(0), block_list=listed).count() == 0


# toxicity, licenses, components


def plain_hits(text, lexicon, machine):
    return toxicity.hits_of(text, lexicon, machine) or [0] * len(toxicity.HITS)


def test_odd_rows_in_every_operator(spark):
    rows = [(1, None), (2, ""), (2, ""), (3, " \n\t"), (None, "You idiot! MIT License"), (4, "You idiot! MIT License"), (5, "calm words " * 40_000)]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (None, 1, 1), (2, None, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.train_model(docs, labels)
    scored = toxicity.score_toxicity(docs, model)
    assert scored.columns == ["doc_id", "score", "predicted", "n_hits"] and scored.count() == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored.collect())
    assert len({r.score for r in scored.where("doc_id IN (1, 2, 3)").collect()}) == 1
    lexicon, machine = toxicity.Lexicon(model.stems), toxicity.grammar().compiled()
    expected = {i: model.score(toxicity.hits_of(t or "", lexicon, machine)) for i, t in rows}
    assert {r.doc_id: r.score for r in scored.collect()} == pytest.approx(expected)
    for empty in (docs.limit(0), docs):
        assert toxicity.score_toxicity(empty, toxicity.train_model(empty, labels.limit(0))).count() == empty.count()

    found = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert len(found) == 6 - 1 + 1 and found[4].base_labels == found[None].base_labels == "mit" and found[1].n_words == 0
    assert licenses.scan_licenses(docs.limit(0)).count() == 0

    grouped = jaccard.jaccard_components(docs)
    assert grouped.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(repr, ((r.doc_id, r.component_id) for r in grouped.collect()))) == sorted(map(repr, [(1, 1), (2, 2), (2, 2), (3, 3), (None, 4), (4, 4), (5, 5)]))
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_toxicity_on_rows_it_has_not_seen(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = toxicity.score_toxicity(docs, toxicity.train_model(docs, labels)).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id")))
    rows = scored.select("predicted", "toxic").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.9 * len(rows)

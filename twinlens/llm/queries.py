"""One query for each operator, on whole tables, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, hard_negatives, jaccard, licenses, main_text, packing, periodic, quality, resharding, secrets, token_counts, toxicity, url_filter

SHARDS = 24
OLD_SHARDS = 16


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: more than 512 tokens."""
    counted = token_counts.count_tokens(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, the base counts and verdict, the method's verdict and ratios."""
    return quality.apply_rules(_table(spark, sf, "documents"))


def op3_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf, "documents"))


def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits."""
    docs = _table(spark, sf, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.train_model(docs, _table(spark, sf, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_hits")


def op5_main_text(spark: SparkSession, sf: str) -> DataFrame:
    return main_text.extract_main_text(_table(spark, sf, "pages"))


def op6_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_resharding(spark: SparkSession, sf: str) -> DataFrame:
    """The documents lie in 16 shards by source and go to 24 of equal bytes; the old shard follows the contract's columns."""
    docs = _table(spark, sf, "documents")
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(OLD_SHARDS)).cast("int")
    sized = resharding.document_sizes(docs, old.alias("from_shard"))
    placed = resharding.reshard(sized, F.col("from_shard"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op9_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """One row per document and benchmark item found in it."""
    return decontaminate.find_leaks(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op10_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf, "pages"))


def op11_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, counts and checksum of the base spans, all spans."""
    found = secrets.find_secrets(_table(spark, sf, "documents"))
    counts = [secrets.span_count(F.col("base"), kind).alias(f"n_{kind}") for kind in secrets.KINDS]
    checksum = F.sha2(secrets.span_text(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, checksum, secrets.span_text(secrets.merged_spans(F.col("base"), F.col("guessed"))).alias("spans"), F.size("guessed").cast("long").alias("n_guess"))


def op12_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of ids divisible by 7 carry the next label of ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(_table(spark, sf, "embeddings").select("vec_id", moved.alias("label"), "embedding"))


def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, the number of runs, the strongest of them, checksums of all runs and of the collapsed text; a tenth of the texts is looped first."""
    found = periodic.periodic_runs(periodic.looped(_table(spark, sf, "documents")))
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(periodic.run_lines(F.col("runs")).cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


QUALITY_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
grams AS (SELECT r, pos, words[pos] AS a, words[pos + 1] AS b, words[pos + 2] AS c
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS pos FROM w)),
twice AS (SELECT r, pos FROM (SELECT r, pos, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM grams) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT pos + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
s AS (SELECT doc_id, len(words)::BIGINT AS n_words, len(lines)::BIGINT AS n_lines, length(list_aggregate(words, 'string_agg', ''))::BIGINT AS chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(words, lambda x: lower(x) IN ({_quoted(quality.STOP_WORDS)})))::BIGINT AS n_stop_words,
  coalesce(list_max(list_transform(words, lambda x: length(x))), 0)::BIGINT AS longest_word
  FROM w LEFT JOIN covered USING (r)),
x AS (SELECT doc_id, n_words, n_lines, coalesce(chars, 0) AS word_chars, n_symbols, n_dup_lines, n_stop_words, longest_word, n_repeat_words,
  CASE WHEN n_words > 0 THEN coalesce(chars, 0) / n_words ELSE 0.0::DOUBLE END AS mean_word_chars,
  CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0.0::DOUBLE END AS symbols_per_word,
  CASE WHEN n_words > 0 THEN n_stop_words / n_words ELSE 0.0::DOUBLE END AS stop_word_share,
  CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0::DOUBLE END AS duplicate_line_share,
  CASE WHEN coalesce(chars, 0) > 0 THEN longest_word / chars ELSE 0.0::DOUBLE END AS longest_word_share FROM s),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM x)
SELECT *, NOT base_failed AND {" AND ".join(
    " AND ".join([f"{r.signal} >= {r.least}"] * (r.least is not None) + [f"{r.signal} <= {r.most}"] * (r.most is not None)) for r in quality.RULES
)} AS kept FROM f
"""


def _license_sql() -> str:
    gap, upper, lower = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", licenses.ASCII_UPPER, licenses.ASCII_LOWER
    phrases = ", ".join(f"('{phrase}', '{label}')" for phrase, label in licenses.PHRASES.items())
    templates = ", ".join(f"({k}, '{label}', {sorted(set(text.split()))})" for k, (label, text) in enumerate(licenses.TEMPLATES))
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') AS low FROM documents),
w AS (SELECT r, doc_id, low, list_filter(string_split_regex(low, '{gap}'), lambda x: x <> '') AS words FROM t),
p AS (SELECT string_split(phrase, ' ') AS parts, label FROM (VALUES {phrases}) AS v(phrase, label)),
places AS (SELECT r, label, pos - 1 AS pos FROM (SELECT r, words, label, parts, unnest(range(1, len(words) - len(parts) + 2)) AS pos
  FROM w, p WHERE contains(low, 'license')) WHERE words[pos:pos + len(parts) - 1] = parts),
base AS (SELECT r, count(*) AS n, min(pos) AS first_word, max(pos) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM places GROUP BY r),
tem AS (SELECT * FROM (VALUES {templates}) AS v(template, label, tokens)),
blocks AS (SELECT r, list_filter(string_split_regex(block, '{gap}'), lambda x: x <> '') AS block FROM
  (SELECT r, unnest(list_concat(string_split(low, chr(10)), string_split_regex(low, '\\n[ \\t\\r]*\\n'))) AS block FROM w)),
met AS (SELECT r, label, len(list_intersect(block, tokens)) / len(tokens) AS share FROM blocks, tem
  WHERE len(list_intersect(block, tokens)) >= ceil({licenses.THRESHOLD} * len(tokens) - 1e-9)),
best AS (SELECT r, max(share) AS share, list(DISTINCT label) AS labels FROM met GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(best.labels, [])))), ','), '') AS labels,
  CASE WHEN n > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN best USING (r)
"""


JACCARD_SQL = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM d),
classes AS (SELECT min(r) AS c, list_sort(s) AS k, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
g AS (SELECT c, n, unnest(k) AS g FROM classes),
shared AS (SELECT a.c AS a, b.c AS b, a.n AS n, b.n AS m, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.c < b.c
  AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * k >= 90 * (n + m - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT c AS a, c AS b FROM classes UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
members AS (SELECT classes.c, s.r, s.doc_id FROM s JOIN classes ON list_sort(s.s) = classes.k),
named AS (SELECT c, min(doc_id) AS first_id FROM members GROUP BY c),
component AS (SELECT reach.a AS c, min(first_id) AS component_id FROM reach JOIN named ON reach.b = named.c GROUP BY reach.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE component_id END AS component_id
FROM s LEFT JOIN members USING (r) LEFT JOIN component USING (c)
"""


def _url_sql() -> str:
    rules = ", ".join(f"('{rule}', '{rule[: rule.index('/')]}', '{rule[rule.index('/') :]}', '{verdict}')" for rule, verdict in url_filter.RULES.items())
    return f"""
WITH u AS (SELECT row_number() OVER () AS r, page_id,
  translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{url_filter.ASCII_UPPER}', '{url_filter.ASCII_LOWER}') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules AS (SELECT * FROM (VALUES {rules}) AS v(rule, h, p, verdict)),
fit AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM u JOIN rules
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host <> '' AND
  len(list_intersect(string_split_regex(host, '[.-]'), [{_quoted(url_filter.LISTED_WORDS)}])) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN fit USING (r)
"""


NEGATIVES_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
t AS (SELECT r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM v),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, a.label = b.label AS same, b.r AS b, b.vec_id AS other_id, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM t a JOIN t b ON a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (SELECT a, anchor_id, b, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, other_id, b) <= 5),
n AS (SELECT p.a, p.b, p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s ON p.a = s.a AND NOT same
  AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY a, b ORDER BY negative_score DESC, negative_id))::INTEGER AS rank, negative_id, positive_score, negative_score FROM n
QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY negative_score DESC, negative_id) <= 10
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_quality_rules, op3_license_scan, op4_toxicity, op5_main_text,
        op6_ngram_jaccard, op7_best_fit_packing, op8_resharding, op9_decontamination, op10_url_filter,
        op11_secret_scan, op12_hard_negatives, op13_periodic_runs,
    )
}

ORACLE = {
    "op2_quality_rules": QUALITY_SQL,
    "op3_license_scan": _license_sql(),
    "op6_ngram_jaccard": JACCARD_SQL,
    "op10_url_filter": _url_sql(),
    "op12_hard_negatives": NEGATIVES_SQL,
}

"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast hash table of frequent pre-tokens and their token counts. Pre-tokens that it misses are encoded
once per Python worker and remembered in a bounded cache that its tasks share, so no pre-token of the corpus is ever shuffled.
The table only saves work: whatever it holds, the counts are those of the tokenizer. A file that splits or changes texts in another
way than byte-level BPE does is not looked up by pre-tokens; its whole texts are encoded.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

#: The split of byte-level BPE, and the same split where a text is plain ASCII.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"

TABLE_SIZE = 65_536  # entries of the broadcast table
SAMPLE_ROWS = 4_096  # texts that the table is learned from, about
CACHE_SIZE = 300_000  # pre-tokens that a worker remembers
LONG_WORD = 64  # longer pre-tokens are encoded each time, so that caches stay small
RUN = 200_000  # pre-tokens held at once of a long text


def splits_as_known(file: dict) -> bool:
    """Does a tokenizer file split texts by ``SPLIT`` alone, and at special strings as they stand?"""
    first = file.get("pre_tokenizer") or {}
    split = first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and first.get("use_regex", True)
    flags = ("single_word", "lstrip", "rstrip", "normalized")
    plain = not any(token.get(flag) for token in file.get("added_tokens") or () for flag in flags)
    return bool(split and plain and not file.get("normalizer") and file.get("model", {}).get("type") == "BPE")


class PreTokens:
    """Splits texts as a byte-level tokenizer file does, special strings first."""

    def __init__(self, file: str):
        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known = splits_as_known(json.loads(self.tokenizer.to_str()))
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.any = regex.compile(SPLIT)
        self.ascii = re.compile(ASCII_SPLIT, re.ASCII)

    def parts(self, text: str) -> tuple[list[str], int]:
        """Stretches of ordinary text, and how many special strings stand between them."""
        if self.special is None or not self.special.search(text):
            return [text], 0
        parts = self.special.split(text)
        return parts, len(parts) - 1

    def runs(self, text: str) -> Iterator[list[str]]:
        split = self.ascii if text.isascii() else self.any
        if len(text) <= RUN:
            yield split.findall(text)
            return
        found = (m.group() for m in split.finditer(text))
        while run := list(islice(found, RUN)):
            yield run

    def length(self, word: str) -> int:
        return len(self.tokenizer.encode(word, add_special_tokens=False))


class WorkerCache(dict):
    """The second tier: encodes what it does not know and starts anew when full."""

    def __init__(self, words: PreTokens):
        super().__init__()
        self.words = words

    def __missing__(self, word: str) -> int:
        n = self.words.length(word)
        if len(word) <= LONG_WORD:
            if len(self) >= CACHE_SIZE:
                self.clear()
            self[word] = n
        return n


@cache
def worker_cache(file: str) -> WorkerCache:
    """One for each Python worker, whose tasks share it."""
    return WorkerCache(PreTokens(file))


def _count(text: str, words: PreTokens, table: dict[str, int], cache: WorkerCache) -> int:
    if not words.known:
        return words.length(text)
    parts, total = words.parts(text)
    for part in parts:
        for run in words.runs(part):
            known = list(map(table.get, run))
            total += sum(filter(None, known))
            if None in known:
                total += sum(map(cache.__getitem__, [w for w, n in zip(run, known) if n is None]))
    return total


def frequent_pre_tokens(docs: DataFrame, file: str, size: int = TABLE_SIZE, sample_rows: int = SAMPLE_ROWS) -> dict[str, int]:
    """The most frequent pre-tokens of about ``sample_rows`` texts, spread by hash, with their token counts.

    Only the vocabulary of that bounded sample is shuffled, and at most ``size`` entries reach the driver.
    """
    words = PreTokens(file)
    if not words.known:
        return {}
    every = max(1, docs.count() // sample_rows)
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).where("text IS NOT NULL").select("text")

    def tally(batches):
        words, found = worker_cache(file).words, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for part in words.parts(text)[0]:
                    for run in words.runs(part):
                        found.update(w for w in run if len(w) <= LONG_WORD)
        top = found.most_common(size)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    counted = sample.mapInArrow(tally, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "word").limit(size).collect()
    return {row.word: words.length(row.word) for row in top}


def count_tokens(docs: DataFrame, file: str, table_size: int = TABLE_SIZE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Tokens of every whole text, without begin, end or added special tokens.

    ``file`` is a file of ``tokenizers``, at the same path on every worker. Returns doc_id, n_bytes (UTF-8) and n_tokens, one row per input
    row: a null text counts as empty (0 and 0), repeated rows and null ids are kept, other columns are ignored, and an
    empty table gives an empty result. Texts are read whole, long ones in runs of pre-tokens. Special strings inside a text count one token each, as the library does by default.
    """
    docs = docs.select("doc_id", "text")
    table = docs.sparkSession.sparkContext.broadcast(frequent_pre_tokens(docs, file, table_size, sample_rows))

    def count(batches):
        cache = worker_cache(file)
        words = cache.words
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n_tokens = [_count(t, words, table.value, cache) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return sized.mapInArrow(count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")

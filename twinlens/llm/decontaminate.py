"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts and benchmark items are sequences of words. The CGK random walk maps a window to a longer string so that a small edit
distance becomes a small Hamming distance; sampled positions of that string are the LSH key. Every window of an item's
size class whose key equals an item's is a candidate, over as many independent walks as the target recall asks for at
the full share of edits. Where ``MOST_WALKS`` do not reach it, as with long items, all windows that pass the filters below
are candidates. Candidates are verified by the exact edit distance between the item and the best-fitting stretch of the
text. Items under ``LEAST_WORDS`` words are searched for as they stand, word by word.

Two filters that lose nothing pass windows over before they are embedded. A word outside the benchmark's vocabulary is an
edit, so a window may hold only as many as edits are allowed. And of e + 1 disjoint chunks of an item at least one survives
e edits whole, so a window must start where an item would whose chunk stands in the text, give or take e words.
"""

from __future__ import annotations

import math
import random
import string
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

EDIT_SHARE = 0.2  # word edits allowed, by item length
LEAST_WORDS = 8  # shorter items are found without edits only
TARGET_RECALL = 0.99  # of items with the most edits allowed
TRIES, TRIAL_WALKS = 256, 12  # edited items that the number of walks is set by, and walks of the first look
SAMPLED = 4  # positions of the embedding in one key
MOST_WALKS = 96  # where these are too few, every window is verified
BLOCK_BYTES = 4 << 20  # benchmark text that is searched for at once
WINDOW_RATIO = 1.25
RUN_WORDS = 1 << 19  # words of the texts that are searched at once
SLICE_ROWS = 1_000
SEED_WORDS = 3  # first words of a chunk; edits take at most one word in five, so no chunk is shorter
TABLE_BITS = 20

PLAIN = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case, ASCII punctuation left out."""
    return (text or "").lower().encode().translate(PLAIN).split()


class Walk(NamedTuple):
    """One CGK walk with its sampled positions: bits[word] >> step decides if the walk moves on."""

    bits: np.ndarray
    sampled: tuple[int, ...]


class SizeClass(NamedTuple):
    window: int
    walks: list[Walk]  # none where every window is verified
    keys: list[np.ndarray]  # for each walk the items' keys, sorted
    owners: list[np.ndarray]  # and their items


def walk_keys(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, walk: Walk) -> np.ndarray:
    """The LSH keys of the windows from ``starts`` to ``ends``; beyond its end a window reads the pad word -1."""
    place = starts.copy()
    key = np.zeros(len(starts), np.uint64)
    last = walk.sampled[-1]
    padded = np.append(words, -1)
    with np.errstate(over="ignore"):
        for step in range(last + 1):
            word = np.where(place < ends, padded[np.minimum(place, len(words))], -1)
            if step in walk.sampled:
                key = (key * np.uint64(0x9E3779B97F4A7C15)) ^ (word.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
                key ^= key >> np.uint64(29)
            place += (walk.bits[word] >> (step % 62)) & 1
    return key


def _item_keys(items: list[np.ndarray], window: int, walk: Walk) -> np.ndarray:
    bounds = np.cumsum([0, *map(len, items)])
    return walk_keys(np.concatenate(items), bounds[:-1], np.minimum(bounds[:-1] + window, bounds[1:]), walk)


def seed_hashes(words: np.ndarray) -> np.ndarray:
    """A number for every three consecutive words."""
    with np.errstate(over="ignore"):
        x = words.astype(np.uint64)
        x = (x[:-2] * np.uint64(0x9E3779B97F4A7C15) + x[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + x[2:]
        x *= np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(32))


def _walk(rng: random.Random, vocabulary: int, window: int) -> Walk:
    bits = np.array([rng.getrandbits(62) for _ in range(vocabulary + 2)], np.int64)  # by word id; the last one is the pad's
    return Walk(bits, tuple(sorted(rng.sample(range(2 * window), SAMPLED))))


def _edited(item: np.ndarray, edits: int, vocabulary: int, rng: random.Random) -> np.ndarray:
    words = item.tolist()
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = rng.randrange(vocabulary + 1)
        elif kind == 1:
            words.insert(at, rng.randrange(vocabulary + 1))
        elif len(words) > 1:
            del words[at]
    return np.array(words, np.int64)


class Items:
    """A block of benchmark items, ready to be searched for. Of a fixed size, so every task gets it."""

    def __init__(self, rows: list[tuple], recall: float = TARGET_RECALL, seed: int = 7, kind: pa.DataType | None = None):
        self.kind = kind  # of the items' ids, where they go into tables
        texts = [(name, words_of(text)) for name, text in rows]
        texts = [(name, words) for name, words in texts if words]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for _, words in texts for w in words}))}
        self.names = [name for name, _ in texts]
        self.words = [np.array([self.vocabulary[w] for w in words], np.int64) for _, words in texts]
        self.edits = [int(EDIT_SHARE * len(words) + 1e-9) for words in self.words]
        self.masks = [_bit_masks(words.tolist()) for words in self.words]
        self.backward = [_bit_masks(words.tolist()[::-1]) for words in self.words]
        rng = random.Random(seed)
        by_window: dict[int, list[int]] = {}
        for k, words in enumerate(self.words):
            if len(words) >= LEAST_WORDS:
                by_window.setdefault(_window(len(words)), []).append(k)
        self.classes = [self._size_class(w, members, recall, rng) for w, members in sorted(by_window.items())]
        self.exact_windows = np.array([c.window for c in self.classes if not c.walks], np.int64)
        self.short: dict[int, dict[tuple, list[int]]] = {}  # length -> words -> items
        for k, words in enumerate(self.words):
            if len(words) < LEAST_WORDS:
                self.short.setdefault(len(words), {}).setdefault(tuple(words.tolist()), []).append(k)
        self._seeds()

    def _seeds(self) -> None:
        """(hash, item, first and last place) of the first words of each item's e + 1 chunks, sorted by hash; equal ones are one seed."""
        rows: dict[tuple[int, int], list[int]] = {}
        for k, (words, edits) in enumerate(zip(self.words, self.edits)):
            if len(words) < LEAST_WORDS:
                continue
            hashes, chunk = seed_hashes(words), len(words) // (edits + 1)
            for place in range(0, (edits + 1) * chunk, chunk):
                rows.setdefault((int(hashes[place]), k), []).append(place)
        seeds = sorted((h, k, places[0], places[-1]) for (h, k), places in rows.items())
        self.seed_hash = np.array([r[0] for r in seeds], np.uint64)
        self.seed_item, self.seed_first, self.seed_last = (np.array([r[c] for r in seeds], np.int64) for c in (1, 2, 3))
        self.seed_table = np.zeros(1 << TABLE_BITS, bool)
        self.seed_table[self.seed_hash & np.uint64((1 << TABLE_BITS) - 1)] = True
        self.item_edits = np.array(self.edits, np.int64)
        self.item_window = np.array([_window(len(w)) for w in self.words], np.int64)

    def _size_class(self, window: int, members: list[int], recall: float, rng: random.Random) -> SizeClass:
        size = len(self.vocabulary)
        own = [self.words[k] for k in members]
        walks = self._walks(own, window, recall, rng)
        keys, owners = [], []
        for walk in walks:
            found_keys = _item_keys(own, window, walk)
            order = np.argsort(found_keys, kind="stable")
            keys.append(found_keys[order])
            owners.append(np.array(members)[order])
        return SizeClass(window, walks, keys, owners)

    def _walks(self, own: list[np.ndarray], window: int, recall: float, rng: random.Random) -> list[Walk]:
        """Walks that together find the target share of edited copies of the items; none if ``MOST_WALKS`` do not."""
        size = len(self.vocabulary)
        tries = own[:TRIES] * max(1, TRIES // len(own[:TRIES]))
        copies = [_edited(words, max(1, int(EDIT_SHARE * len(words) + 1e-9)), size, rng) for words in tries]
        walks, met, hits = [], np.zeros(len(tries), bool), 0.0
        while len(walks) < MOST_WALKS:
            walks.append(_walk(rng, size, window))
            same = _item_keys(tries, window, walks[-1]) == _item_keys(copies, window, walks[-1])
            met, hits = met | same, hits + np.mean(same)
            if len(walks) >= TRIAL_WALKS:
                if np.mean(met) >= recall:
                    return walks
                if 1 - (1 - hits / len(walks)) ** MOST_WALKS < recall:  # not even if all copies were as easy to find
                    break
        return []

    def windows(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window size, start) of the windows to embed, and (item, start) of those to verify without it; texts stand
        between ``bounds`` in ``words``."""
        if len(words) < SEED_WORDS or not len(self.seed_hash):
            return np.empty((2, 0), np.int64), np.empty((2, 0), np.int64)
        hashes = seed_hashes(words)
        at = np.flatnonzero(self.seed_table[hashes & np.uint64((1 << TABLE_BITS) - 1)])
        left, right = (np.searchsorted(self.seed_hash, hashes[at], side) for side in ("left", "right"))
        many = right - left
        rows = np.repeat(left, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at, item = np.repeat(at, many), self.seed_item[rows]
        text, edits = np.searchsorted(bounds, at, "right") - 1, self.item_edits[item]
        # a first word may be lost, and the text begin later
        low = np.maximum(at - self.seed_last[rows] - edits, bounds[text])
        high = np.minimum(at - self.seed_first[rows] + edits, bounds[text + 1] - 1)
        item, start = _places(item, text, low, high)
        text = np.searchsorted(bounds, start, "right") - 1
        size = self.item_window[item]
        end = np.minimum(start + size, bounds[text + 1])
        outside = np.concatenate([[0], np.cumsum(words == 0)])
        good = (start < end) & (outside[end] - outside[np.minimum(start, end)] <= self.item_edits[item])
        item, size, start = item[good], size[good], start[good]
        whole = np.isin(size, self.exact_windows)
        return np.unique(np.stack([size[~whole], start[~whole]]), axis=1), np.stack([item[whole], start[whole]])

    def candidates(self, words: np.ndarray, bounds: np.ndarray):
        """(item, start) of windows that share a key with an item, and of all windows of items that keys do not find well; of
        windows that one verification serves the first."""
        (sizes, starts), whole = self.windows(words, bounds)
        found = [whole]
        for size in self.classes:
            mine = starts[sizes == size.window]
            if not len(mine):
                continue
            ends = np.minimum(mine + size.window, bounds[np.searchsorted(bounds, mine, "right")])
            for walk, keys, owners in zip(size.walks, size.keys, size.owners):
                got = walk_keys(words, mine, ends, walk)
                left, right = np.searchsorted(keys, got), np.searchsorted(keys, got, "right")
                many = right - left
                rows = np.repeat(left, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                found.append(np.stack([owners[rows], np.repeat(mine, many)]))
        return self._spaced(np.unique(np.concatenate(found, axis=1), axis=1), bounds)

    def _spaced(self, pairs: np.ndarray, bounds: np.ndarray):
        """Of (item, start), sorted, those that matter: a verified region has ``edits`` words to spare before its start and
        as many behind it, so of starts in one text that are at most ``edits`` apart the first stands for all."""
        last = (-1, -1, -1)
        for k, start, text in zip(*pairs.tolist(), (np.searchsorted(bounds, pairs[1], "right") - 1).tolist()):
            if (k, text) != last[:2] or start - last[2] > self.edits[k]:
                last = (k, text, start)
                yield k, start

    def _short_matches(self, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, first word) of every place where an item under ``LEAST_WORDS`` words stands."""
        found = []
        for length, items in self.short.items():
            firsts = np.zeros(len(self.vocabulary) + 1, bool)
            firsts[[key[0] for key in items]] = True
            at = np.flatnonzero(firsts[words[: max(0, len(words) - length + 1)]])
            text = np.searchsorted(bounds, at, "right") - 1
            inside = at + length <= bounds[text + 1]
            at, text = at[inside], text[inside]
            for row, start, owner in zip(words[at[:, None] + np.arange(length)].tolist(), at.tolist(), text.tolist()):
                found += [(owner, k, start - int(bounds[owner])) for k in items.get(tuple(row), ())]
        return found

    def matches(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text (item, distance, first word, last word) of every item whose best stretch is near enough."""
        found, run, length = [], [], 0
        for text in texts:
            parts = words_of(text)
            run.append(np.fromiter(map(self.vocabulary.get, parts, repeat(0)), np.int64, len(parts)))
            length += len(parts)
            if length >= RUN_WORDS:
                found += self._matches(run)
                run, length = [], 0
        return found + self._matches(run)

    def _matches(self, run: list[np.ndarray]) -> list[list[tuple]]:
        found: list[dict[int, tuple]] = [{} for _ in run]
        words = np.concatenate([np.empty(0, np.int64), *run])
        bounds = np.cumsum([0, *map(len, run)])
        for k, start in self.candidates(words, bounds):
            text = int(np.searchsorted(bounds, start, "right")) - 1
            zero, edits, length = int(bounds[text]), self.edits[k], len(self.words[k])
            low = max(zero, start - edits)
            region = words[low : min(start + length + 2 * edits, int(bounds[text + 1]))].tolist()
            masks = self.masks[k]
            if sum(w in masks for w in region) < length - edits:
                continue
            distance, end = best_stretch(masks, length, region)
            if distance <= edits:
                _, back = best_stretch(self.backward[k], length, region[end::-1])
                row = (distance, low - zero + end - back, low - zero + end)
                found[text][k] = min(found[text].get(k, row), row)
        for text, k, first in self._short_matches(words, bounds):
            row = (0, first, first + len(self.words[k]) - 1)
            found[text][k] = min(found[text].get(k, row), row)
        return [[(self.names[k], *row) for k, row in sorted(rows.items())] for rows in found]


def _places(item: np.ndarray, text: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item, place) for all places from ``low`` to ``high``, those of overlapping stretches of one item and text once."""
    order = np.lexsort((low, text, item))
    item, text, low, high = item[order], text[order], low[order], high[order]
    new = np.r_[True, (item[1:] != item[:-1]) | (text[1:] != text[:-1])][: len(item)]
    group = np.cumsum(new) - 1
    span = int(high.max(initial=0)) + 2
    reach = np.maximum.accumulate(high + group * span)  # the furthest end so far; a later group is beyond any earlier one
    first = np.flatnonzero(np.r_[True, (low + group * span)[1:] > reach[:-1] + 1][: len(item)])
    last = np.r_[first[1:], len(item)][: len(first)] - 1
    begin, end, owner = low[first], reach[last] - group[last] * span, item[first]
    many = np.maximum(end - begin + 1, 0)
    return np.repeat(owner, many), np.repeat(begin, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def _window(length: int) -> int:
    """The largest size class that does not exceed an item's length."""
    window = LEAST_WORDS
    while (larger := max(window + 1, int(window * WINDOW_RATIO))) <= length:
        window = larger
    return window


def _bit_masks(words: list[int]) -> dict[int, int]:
    masks: dict[int, int] = {}
    for k, word in enumerate(words):
        masks[word] = masks.get(word, 0) | 1 << k
    return masks


def best_stretch(masks: dict[int, int], length: int, text: list[int]) -> tuple[int, int]:
    """Least edit distance between the item and any stretch of ``text``, and the first place where such a stretch ends.

    One column of the distance table is held as two bit vectors of differences; a stretch may start anywhere.
    """
    full, top = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score = full, 0, length
    best, end = length, 0
    for at, word in enumerate(text):
        same = masks.get(word, 0)
        diagonal = (((same & plus) + plus) ^ plus) | same | minus
        up = minus | ~(diagonal | plus) & full
        down = plus & diagonal
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = (down | ~(diagonal | up)) & full, up & diagonal
        if score < best:
            best, end = score, at
    return best, end


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[Items]:
    """The items, dealt by hash into blocks whose text is about ``block_bytes``; only one block is in use at a time."""
    rows = benchmark.select("item_id", "text").where("text IS NOT NULL")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    tables = [rows.where(part == k).toArrow() for k in range(blocks)]
    return [Items(sorted(zip(*(c.to_pylist() for c in t.columns)), key=repr), kind=t.schema.field("item_id").type) for t in tables]


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, distance, first_word, last_word: every benchmark item in every text, with its best stretch.

    A match has at most ``EDIT_SHARE`` word edits, and none if the item has under ``LEAST_WORDS`` words. Null and empty
    texts, null items and items without words match nothing; a row that is repeated gives repeated results; of equal stretches the
    earliest counts; other columns are ignored; an empty table on either side gives no rows. Ids may be of any type. Very long
    texts are searched whole; places that equal seeds open are merged before any window is looked at.
    """
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, distance int, first_word long, last_word long"
    found = None
    for items in benchmark_blocks(benchmark, block_bytes):
        part = docs.select("doc_id", "text").mapInArrow(_leak_rows(items), schema)
        found = part if found is None else found.unionByName(part)
    return found


def _leak_rows(items: Items):
    def rows(batches):
        for batch in batches:
            met = items.matches(batch.column(1).to_pylist())
            found = [(i, *m) for i, rows in zip(batch.column(0).to_pylist(), met) for m in rows]
            columns = list(zip(*found)) if found else [()] * 5
            arrays = [pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], items.kind)]
            arrays += [pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "distance", "first_word", "last_word"])

    return rows


def remove_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text holds no benchmark item as :func:`find_leaks` finds them.

    Null and empty texts hold none and stay, repeated rows stay or go together, and an empty table on either side changes nothing.
    """
    text = docs.columns.index("text")
    for items in benchmark_blocks(benchmark, block_bytes):

        def clean(batches, items=items):
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE_ROWS):  # so that few texts are Python strings at a time
                    part = batch.slice(at, SLICE_ROWS)
                    yield part.filter(pa.array([not m for m in items.matches(part.column(text).to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs

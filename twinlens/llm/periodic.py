"""Runs of periodic words, by seeds on diagonals.

A run with period q is a stretch of words that equals itself q words on, so it is a match along the diagonal of lag q. A run
of at least ``least`` words and ``times`` periods matches there in at least max(least, times * q) - q places. Lags are cut into
classes (0, a], (a, 2a], (2a, 4a], ...; the guaranteed overlap of a class, the least one of its lags, is the length of its
seeds. It is never shorter than the lags themselves: a run whose smallest period is q then has its first seed again q words
on and nowhere between, so that neighbouring occurrences are all the pairs that must be looked at, one for each place.

A pair is extended both ways along its diagonal. A table of the furthest place covered on each lag leaves out the pairs that
an extension has passed already.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .jaccard import FACTORS, mixed

LEAST = 24
TIMES = 3
GROUP_WORDS = 200_000  # documents are searched together up to about so many words
U = np.uint64
PARTS = ("start", "length", "period")
RUN = f"struct<{','.join(f'{p}:bigint' for p in PARTS)}>"
RUNS = pa.list_(pa.struct([(p, pa.int64()) for p in PARTS]))


class Numbers(dict):
    """Words -> their numbers, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def lag_classes(least: int, times: int, longest: int):
    """(lowest lag - 1, highest lag, seed length) of every class with a run that fits into ``longest`` words."""
    overlap = lambda q: max(least, times * q) - q
    low, high = 0, max(1, least // times)
    while max(least, times * (low + 1)) <= longest:
        yield low, high, min(overlap(q) for q in (low + 1, high, max(low + 1, min(high, least // times))))
        low, high = high, 2 * high


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(left * FACTORS[0] + right * FACTORS[1] + FACTORS[2])


class Seeds:
    """Hashes of the k words from each place on, for growing k; doubled lengths are kept from one k to the next."""

    def __init__(self, words: np.ndarray):
        self.width, self.hashes = 1, mixed(words.astype(U) + U(1))

    def of(self, k: int) -> np.ndarray:
        """One hash for each place from which k words are left in all."""
        while 2 * self.width <= k:
            self.hashes = _joined(self.hashes[: -self.width], self.hashes[self.width :])
            self.width *= 2
        rest = k - self.width
        return _joined(self.hashes[: len(self.hashes) - rest], self.hashes[rest:]) if rest else self.hashes


def _equal_from(words: np.ndarray, i: int, j: int, most: int) -> int:
    """In how many places words from i and j on agree, at most ``most``."""
    done, step = 0, 64
    while done < most:
        take = min(step, most - done)
        apart = np.flatnonzero(words[i + done : i + done + take] != words[j + done : j + done + take])
        if len(apart):
            return done + int(apart[0])
        done, step = done + take, 2 * step
    return most


def _equal_before(words: np.ndarray, i: int, j: int, most: int) -> int:
    """The same backwards, from i - 1 and j - 1 on."""
    done, step = 0, 64
    while done < most:
        take = min(step, most - done)
        apart = np.flatnonzero(words[i - done - take : i - done] != words[j - done - take : j - done])
        if len(apart):
            return done + take - 1 - int(apart[-1])
        done, step = done + take, 2 * step
    return most


def find_runs(words: np.ndarray, starts: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """Sorted (start, length, period) of each document.

    ``words`` are the word numbers of all documents one after another, document d has those from ``starts[d]`` to
    ``starts[d + 1]``.
    """
    sizes = np.diff(starts)
    found: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    if not len(words):
        return found
    doc = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(starts[1:], sizes) - np.arange(len(words))  # words from a place to the end of its document
    seeds, alive = Seeds(words), np.arange(len(words))
    for low, high, k in lag_classes(least, times, int(sizes.max())):
        alive = alive[left[alive] >= k]
        if not len(alive):
            break
        keys = mixed(seeds.of(k)[alive] ^ (doc[alive].astype(U) * FACTORS[1]))
        order = np.argsort(keys, kind="stable")
        again = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
        first, second = alive[order[again]], alive[order[again + 1]]
        # a longer seed that occurs twice has this one at its start
        alive = np.unique(np.r_[first, second])
        lag = second - first
        here = (lag > low) & (lag <= high)
        first, lag = first[here], lag[here]
        by_lag = np.lexsort((first, lag))
        first, lag = first[by_lag], lag[by_lag]
        heads = np.flatnonzero(np.r_[True, (lag[1:] != lag[:-1]) | (first[1:] != first[:-1] + 1)]) if len(lag) else []
        covered: dict[int, int] = {}
        for i, q in zip(first[heads].tolist(), lag[heads].tolist()):
            if i < covered.get(q, 0):
                continue
            d = int(doc[i])
            begin = i - _equal_before(words, i, i + q, i - int(starts[d]))
            end = i + _equal_from(words, i, i + q, int(starts[d + 1]) - i - q)
            covered[q] = end
            length = end - begin + q
            if length >= max(least, times * q):
                found[d].append((begin - int(starts[d]), length, q))
    for runs in found:
        runs.sort()
    return found


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most periods; of equal ones that which starts first, then that of the smallest period."""
    best = None
    for run in runs:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, one space between them, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    kept, at, reach = [], 0, 0
    for begin, end in sorted((s + q, s + n) for s, n, q in runs):
        begin = max(begin, reach)
        if begin < end:
            kept += words[at:begin]
            at = reach = end
    return b" ".join(kept + words[at:])


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs, strongest, collapsed of every row of ``docs``.

    Words are what ASCII white space separates. A run is a stretch of at least ``least`` words and ``times`` of its smallest
    period that no neighbouring word extends; ``runs`` lists (start, length, period) by start, then period, ``strongest``
    is the one with the most periods (ties: smallest start, then period; null without runs), ``collapsed`` the text
    without what runs repeat.

    A null text has no words, as an empty one: no run and an empty ``collapsed``. Repeated rows and null ids are kept, other
    columns are ignored, an empty table gives no rows. Texts are searched whole, in time of n log n for n words; a task
    holds about 200,000 words, or one text where that is longer.
    """
    if times < 3 or least < times:
        raise ValueError("runs of fewer than three periods have seeds shorter than their lags")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
            at = 0
            while at < len(ids):
                split, starts, end = [], [0], at
                while end < len(ids) and starts[-1] < GROUP_WORDS:
                    split.append((texts[end].as_py() or b"").split())
                    starts.append(starts[-1] + len(split[-1]))
                    end += 1
                numbers = Numbers()
                coded = np.fromiter((numbers[w] for words in split for w in words), np.int64, starts[-1])
                found = find_runs(coded, np.array(starts), least, times)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, end - at),
                        pa.array(map(len, split), pa.int64()),
                        pa.array([[dict(zip(PARTS, r)) for r in runs] for runs in found], RUNS),
                        pa.array([best and dict(zip(PARTS, best)) for best in map(strongest, found)], RUNS.value_type),
                        pa.array([collapsed(w, r).decode("utf-8", "replace") for w, r in zip(split, found)], pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "strongest", "collapsed"],
                )
                at = end

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(rows, f"doc_id {kind}, n_words long, runs array<{RUN}>, strongest {RUN}, collapsed string")


def run_lines(runs: Column) -> Column:
    """``start,length,period`` and a line feed for every run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def looped(docs: DataFrame) -> DataFrame:
    """doc_id, text: every text whose id's checksum is divisible by 10 repeats a stretch of its words from some word on.

    h is the crc32 of the decimal id, g = h // 10. In a text of n words, words from a = g % n on repeat those from a to a + p,
    p = 1 + (n - a) // (3 + g % 8). Texts of null ids, without words, and all others stay as they are.
    """
    words = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), h.alias("_h"))
    rows = rows.withColumn("_words", F.when(F.pmod("_h", F.lit(10)) == 0, words))
    n, g = F.size("_words"), F.floor(F.col("_h") / 10)
    rows = rows.withColumn("_n", n).withColumn("_a", F.when(F.col("_n") > 0, F.pmod(g, F.col("_n"))).cast("int")).withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.pmod(g, F.lit(8))))).cast("int"))
    left = F.col("_n") - F.col("_a")
    unit = F.slice("_words", F.col("_a") + 1, F.col("_p"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil(left / F.col("_p")).cast("int"))), F.lit(1), left)
    whole = F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a")), tail), " ")
    return rows.select("doc_id", F.when(F.col("_a").isNotNull(), whole).otherwise(F.col("text")).alias("text"))

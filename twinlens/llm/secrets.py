"""Secrets by patterns and by what a password guesser would pay for them.

Three patterns give the base: assignments to credential names, access keys and long hexadecimal strings. What stands where a
credential is given (after such a name, behind ``Bearer`` or ``Basic``, as the password of a URL) is priced besides: the
cheapest way to cut the value into words, dates, repeats, keyboard walks and brute-force spans, in powers of ten of guesses. A
dear value is a secret whatever its form; a cheap one (``changeme``, ``<your-password>``) is a placeholder.

Words are priced by their rank among the words of the corpus itself, counted over all documents.
"""

from __future__ import annotations

import re
from math import inf, log10
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

# The base patterns, as their contract has them.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: What the assignment pattern needs; in lower case.
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Places of credentials that the base does not know; the value is the last group.
# With each what a text has in lower case where the pattern can match.
CONTEXTS = (
    (("passw", "pwd", "passphrase", "passcode", "secret", "token", "credential", "key"), re.compile(
        r"(?:passwords?|passwd|pwd|passphrase|passcode|secret|token|credentials?|private_?key|access_?key|auth_?key|api_?key)"
        r"[\"']?\x20*(?::=|=>|[:=]|\x20is\x20)\x20*(?:\"([^\"\n]+)\"|'([^'\n]+)'|([^\s\"',;]+))", re.I | re.A)),
    (("bearer", "basic"), re.compile(r"\b(?:Bearer|Basic)\x20+([A-Za-z0-9+/_.~=-]+)")),
    (("://",), re.compile(r"[a-z][a-z0-9+.-]{0,30}://[^\s/:@\"']*:([^\s/@\"']+)@", re.I | re.A)),
)

# Costs, as powers of ten of guesses.
DEAR = 10.0
SEGMENT = 0.3  # for one more segment
LEET = 0.3  # for every replaced letter
CAPITALS = 0.3
MIXED_CASE = 1.0
DATE, YEAR = 4.6, 2.1  # 365 days of a century and more, a year of it
WALK_START, WALK_TURN = 1.7, 0.6
REPEAT, LONGEST_UNIT = 0.9, 4  # for any number of further copies
BRUTE = {"digit": 1.0, "lower": 1.42, "upper": 1.42, "other": 1.52}
LONGEST_WORD = 20
MOST_WORDS = 20_000
LEAST_DOCUMENTS = 3
PARTS = 16

LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)
# Usual substitutes of letters, rows of the keyboard, words that passwords and placeholders are made of.
SUBSTITUTES = str.maketrans("@013457$!", "aoieastsi")
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = str.maketrans("!@#$%^&*()_+{}:\"<>?", "1234567890-=[];',./")
COMMON = """
password pass admin root user guest test login welcome letmein master dragon monkey shadow sunshine princess football baseball iloveyou
trustno superman batman hello freedom whatever secret token key changeme change me your my the example sample dummy placeholder none null
true false default demo string value here insert replace todo fixme redacted hidden xxx abc api access account access private public
summer winter spring autumn january february march april may june july august september october november december
monday tuesday wednesday thursday friday saturday sunday love angel charlie michael jordan ashley jessica daniel thomas robert
""".split()

PLACES = {key: (row, column) for row, keys in enumerate(ROWS) for column, key in enumerate(keys)}
FULL_DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:0[1-9]|1[0-2])([-/._]?)(?:0[1-9]|[12]\d|3[01])\3(?:19|20)\d\d)")
ONE_YEAR = re.compile(r"(?:19|20)\d\d")


def _step(a: str, b: str) -> tuple[int, int] | None:
    """From key to neighbouring key, in rows and columns."""
    (r, c), (s, d) = PLACES.get(a, (9, 99)), PLACES.get(b, (-9, -99))
    return (s - r, d - c) if (r, c) != (s, d) and abs(s - r) <= 1 and abs(d - c) <= 1 else None


def _brute(char: str) -> float:
    kind = "digit" if char in "0123456789" else "lower" if "a" <= char <= "z" else "upper" if "A" <= char <= "Z" else "other"
    return BRUTE[kind]


class GuessCost:
    """The price of a value: the least sum over all ways to cut it into segments."""

    def __init__(self, ranks: dict[str, int]):
        self.words = {word: log10(rank + 1) for word, rank in ranks.items() if 1 < len(word) <= LONGEST_WORD}

    def _word(self, part: str, low: str, plain: str) -> float:
        """Of one word, or infinity; ``low`` is the part in lower case, ``plain`` without substitutes as well."""
        cost = self.words.get(low, inf)
        if plain != low and plain in self.words:
            cost = min(cost, self.words[plain] + LEET * sum(a != b for a, b in zip(low, plain)))
        if cost == inf or part == low:
            return cost
        return cost + (CAPITALS if part == part.upper() or part[1:] == low[1:] else MIXED_CASE)

    def cost(self, value: str, enough: float = inf) -> float:
        """log10 of the guesses for ``value``; at least ``enough`` where it is not below that.

        A step forward only needs what is open at a place: the best end there, the repeat and the walk that run through it,
        and the words and dates that reach it. So time grows with the length, and the search ends as soon as nothing that is
        open costs less than ``enough``.
        """
        n, low = len(value), value.translate(LOWER)
        folded, plain, words = low.translate(SHIFTED), low.translate(SUBSTITUTES), self.words
        best = [0.0] + [inf] * n
        walk, heading = inf, None  # cheapest way that ends with a walk through the last character
        brute = inf  # cheapest way that ends with brute force
        repeats: dict[int, float] = {}  # length of a unit -> cheapest way that ends with further copies of one
        for at in range(n):
            char, before = value[at], best[at]
            for to in range(at + 2, min(at + LONGEST_WORD, n) + 1):
                if low[at:to] in words or plain[at:to] in words:
                    best[to] = min(best[to], before + SEGMENT + self._word(value[at:to], low[at:to], plain[at:to]))
            for pattern, price in ((FULL_DATE, DATE), (ONE_YEAR, YEAR)):
                if char in "0123" and (found := pattern.match(value, at)):
                    best[found.end()] = min(best[found.end()], before + SEGMENT + price)
            step = _step(folded[at - 1], folded[at]) if at else None
            if step is None:
                walk, heading = inf, None
            else:
                begun = best[at - 1] + SEGMENT + WALK_START + WALK_TURN
                going = walk + (0.0 if step == heading else WALK_TURN)
                walk, heading = min(begun, going), step
            brute = min(brute, before + SEGMENT) + _brute(char)
            end = min(best[at + 1], brute, walk)
            for unit in range(1, LONGEST_UNIT + 1):
                if at >= unit and char == value[at - unit]:
                    repeats[unit] = min(repeats.get(unit, inf), before + SEGMENT + REPEAT)
                    end = min(end, repeats[unit])
                else:
                    repeats.pop(unit, None)
            best[at + 1] = end
            if end >= enough and min(before, walk, brute, *repeats.values(), *best[at + 1 : at + LONGEST_WORD + 2]) >= enough:
                return enough
        return best[n]


def word_ranks(docs: DataFrame, most: int = MOST_WORDS, least: int = LEAST_DOCUMENTS) -> dict[str, int]:
    """The ``most`` words (a-z, in lower case) that most different texts of the corpus hold, from rank 1 on; ties in alphabetical order.

    Words of fewer than ``least`` texts are left out: what stands in one text only may be a password itself. Only the ``most``
    words come to the driver. The usual words of passwords follow where the corpus does not have them.
    """
    words = F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))
    counted = docs.where("text IS NOT NULL").select(F.explode(words).alias("word")).where(F.length("word").between(2, LONGEST_WORD))
    counted = counted.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    # the best of a fixed number of parts are cut on executors, so that what the driver gets does not grow with their number
    part = Window.partitionBy(F.pmod(F.xxhash64("word"), F.lit(PARTS))).orderBy(F.desc("n"), "word")
    counted = counted.withColumn("place", F.row_number().over(part)).where(F.col("place") <= most)
    ranks = {row.word: k for k, row in enumerate(counted.orderBy(F.desc("n"), "word").limit(most).collect(), 1)}
    for word in COMMON:
        ranks[word] = min(ranks.get(word, most), 200)
    return ranks


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the base patterns find, by start, then kind as listed."""
    found, low = [], text.lower()
    if any(hint in low for hint in ASSIGN_HINTS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(*m.span(), "hex") for m in LONG_HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


#: Matches of HEX that are long enough: those start where no other hexadecimal character stands before.
LONG_HEX = re.compile(rf"(?<![0-9a-f])[0-9a-f]{{{LEAST_HEX},}}")


def guessed_spans(text: str, costs: GuessCost, dear: float = DEAR) -> list[tuple[int, int, str]]:
    """(start, end, "guess") of values in credential contexts that cost ``dear`` or more; of equal spans one."""
    low = text.lower()
    found = set()
    for hints, pattern in CONTEXTS:
        if any(hint in low for hint in hints):
            for m in pattern.finditer(text):
                if costs.cost(m[m.lastindex], dear) >= dear:
                    found.add((*m.span(m.lastindex), "guess"))
    return sorted(found)


def find_secrets(docs: DataFrame, ranks: dict[str, int] | None = None, dear: float = DEAR) -> DataFrame:
    """doc_id, base, guessed: the spans of every whole text, each as kind, start and end (code points, end exclusive).

    ``base`` has the matches of the base patterns, leftmost and without overlap for each kind, ``guessed`` the values in
    credential contexts whose guesses reach ten to the ``dear``; both by start, then kind as listed. ``ranks`` are the words to
    guess with, those of ``word_ranks(docs)`` by default.

    A null text counts as empty: no spans. Repeated rows and null ids are kept, other columns are ignored, an empty table gives
    no rows. Very long texts and values are read whole.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(word_ranks(docs) if ranks is None else ranks)
    span = "array<struct<kind:string,start:bigint,end:bigint>>"

    def rows(batches):
        costs = GuessCost(known.value)
        listed = lambda spans: [{"kind": kind, "start": a, "end": b} for a, b, kind in spans]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = pa.array([listed(base_spans(t)) for t in texts], kind)
            guessed = pa.array([listed(guessed_spans(t, costs, dear)) for t in texts], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), base, guessed], ["doc_id", "base", "guessed"])

    return docs.mapInArrow(rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {span}, guessed {span}")


def span_count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def span_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def merged_spans(base: Column, guessed: Column) -> Column:
    """All spans by start, then kind as listed, those of the method last."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, (*KINDS, "guess"))), s["kind"])
    keyed = F.transform(F.concat(base, guessed), lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.array_sort(keyed)

"""URL verdicts: path rules first, then exact membership of the host in a block list by a Bloom filter cascade.

Level 1 encodes the listed hosts. Level 2 encodes the hosts of the key universe that level 1 takes for listed although
they are not, level 3 the listed hosts that level 2 takes for false positives, and so on until a level makes no
mistake. The universe is every host of the table, so the cascade is exact on it; a lookup is a few bit tests in the
projection, without a join and without user functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import durable

#: Rules as host and path, with their verdicts.
RULES = {
    "org/": "allow",
    "example.org/es/": "block",
    "example.org/en/1": "block",
    "com/fr/": "allow",
    "com/de/": "block",
}

#: Words whose presence among the words of a host puts it on the block list of :func:`listed_hosts`.
LISTED_WORDS = ("ads", "adult", "bet", "bets", "betting", "casino", "pills", "poker", "porn", "spam", "track", "tracker", "viagra", "xxx")

LATER_RATE = 0.5  # false positives of the levels after the first
MOST_BITS = 1 << 24  # of all levels together: 2 MB that every task gets with the plan; 1.4 million listed hosts among 70 million
LEVELS = 64
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), ASCII_UPPER, ASCII_LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits: its host or a subdomain of it, and a path that starts with the rule's; else null."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):  # later, longer rules overrule
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        chosen = F.when(fits, F.lit(rule)).otherwise(chosen)
    return chosen


def _position(key: Column, level: int, k: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(f"{level}/{k}")), F.lit(bits))


class Level:
    """One Bloom filter: its bits as a constant array of 32-bit words."""

    def __init__(self, number: int, bits: int, hashes: int, words: dict[int, int]):
        self.number, self.bits, self.hashes = number, bits, hashes
        text = ",".join(str(words.get(i, 0)) for i in range((bits + 31) // 32))
        self.words = F.split(F.lit(text), ",").cast("array<bigint>")  # folded to one constant

    def contains(self, key: Column) -> Column:
        found = F.lit(True)
        for k in range(self.hashes):
            at = _position(key, self.number, k, self.bits)
            word = F.element_at(self.words, (F.floor(at / 32) + 1).cast("int"))
            found = found & (F.call_function("shiftright", word, (at % 32).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return found


def level_size(n: int, rate: float) -> tuple[int, int]:
    """Bits and hash functions of a filter that takes the share ``rate`` of other keys for one of its ``n``."""
    hashes = max(1, round(-math.log2(rate)))
    return max(64, math.ceil(n * hashes / math.log(2))), hashes


def _level(number: int, keys: DataFrame, bits: int, hashes: int) -> Level:
    at = F.explode(F.array(*(_position(F.col("key"), number, k, bits) for k in range(hashes)))).alias("at")
    words = keys.select(at).select(F.floor(F.col("at") / 32).alias("word"), F.expr("shiftleft(1L, cast(at % 32 AS int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()  # at most bits / 32 rows
    return Level(number, bits, hashes, {r.word: r.bits for r in found})


class Cascade:
    """Exact membership on a key universe.

    The first level is sized by the ratio of listed to other keys, so that about as many false positives get past it as there
    are listed keys; each later one lets half of its keys' opposites through (Larisch et al., 2017).
    """

    def __init__(self, universe: DataFrame, bits_per_key: int | None = None, most_bits: int = MOST_BITS):
        """``universe`` has distinct, non-null ``key`` and boolean ``listed``, and is read once for each level.

        ``bits_per_key`` fixes the size of all levels instead.
        """
        self.levels: list[Level] = []
        self.bits = 0
        taken = universe
        n, others = universe.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first()
        while len(self.levels) < LEVELS:
            if n == 0:
                return
            number = len(self.levels)
            # even levels hold listed keys, odd levels the others that got past every level so far
            mine = F.col("listed") == F.lit(number % 2 == 0)
            rate = LATER_RATE if number else min(LATER_RATE, n * math.sqrt(0.5) / max(1, others))
            rate = 0.5 ** max(1, round(bits_per_key * math.log(2))) if bits_per_key else rate
            bits, hashes = level_size(n, rate)
            self.bits += bits
            if self.bits > most_bits:
                raise CascadeTooLarge(f"{self.bits} bits")
            level = _level(number, taken.where(mine).select("key"), bits, hashes)
            self.levels.append(level)
            taken = taken.where(mine | level.contains(F.col("key")))
            n = taken.where(~mine).count()
        raise CascadeTooLarge(f"{LEVELS} levels")

    def contains(self, key: Column) -> Column:
        """True for the listed keys of the universe: the first level that says no is an odd one."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            answer = F.when(level.contains(key), answer).otherwise(F.lit(level.number % 2 == 1))
        return answer


class CascadeTooLarge(ValueError):
    """The listed keys need more bits than every task may be given."""


def listed_hosts(hosts: DataFrame, words: tuple[str, ...] = LISTED_WORDS) -> DataFrame:
    """key, listed: a host is listed if one of its words (between dots and hyphens) is in ``words``."""
    return hosts.withColumn("listed", F.arrays_overlap(F.split("key", "[.-]"), F.array(*map(F.lit, words))))


def judge_urls(
    pages: DataFrame, rules: dict[str, str] = RULES, words: tuple[str, ...] = LISTED_WORDS, most_bits: int = MOST_BITS, block_list: DataFrame | None = None
) -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict: the rule's, else block for a listed host, else allow.

    ``block_list`` is a table with the listed ``host``s in lower case; without one, hosts are listed by their ``words``.

    A null url or one without ``://`` has an empty host and path and is allowed. Repeated rows and null ids stay, other
    columns are ignored, an empty table gives no rows; urls are read whole. Two rules of one length cannot both be the longest for a url
    unless they are equal. Beyond ``most_bits`` bits of the cascade the hosts are joined by shuffle, with the same rows.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    hosts = urls.where("host <> ''").select(F.col("host").alias("key")).distinct()
    if block_list is None:
        hosts = listed_hosts(hosts, words)
    else:
        listed = block_list.select(F.col("host").alias("key"), F.lit(True).alias("listed")).distinct()
        hosts = hosts.join(listed, "key", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    universe = durable(hosts, "hosts")
    try:
        listed = Cascade(universe, most_bits=most_bits).contains(F.col("host"))
    except CascadeTooLarge:
        listed = F.coalesce("listed", F.lit(False))
        urls = urls.join(universe.where("listed").withColumnRenamed("key", "host"), "host", "left")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    by_rule = F.lit(None).cast("string")
    for name, verdict in rules.items():
        by_rule = F.when(F.col("rule") == name, F.lit(verdict)).otherwise(by_rule)
    by_host = F.when((F.col("host") != "") & listed, F.lit("block")).otherwise(F.lit("allow"))
    judged = urls.withColumn("rule", rule)
    return judged.select("page_id", "host", "path", "rule", F.coalesce(by_rule, by_host).alias("verdict"))

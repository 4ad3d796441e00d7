"""Quality rules: a table of thresholds compiled into one projection.

Every signal is a Spark expression over the words and lines of the whole text, so the projection runs without user
functions, joins or shuffles.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

#: White space between words, as a set for translate and as a pattern.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
SYMBOL = "[#*$%&|<>]"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = """
the of and to in is it that this with for as was on by are be at or an from not have
der die das und ist nicht ein eine zu den mit sich auf für von dem des im
le la les et est de un une que dans pour qui sur pas au du en
el los las y es una por con para se del al lo como no su
""".split()


class Rule(NamedTuple):
    """``signal`` must lie between ``least`` and ``most`` (null: no bound) or the text is rejected."""

    signal: str
    least: float | None
    most: float | None


#: The threshold table: length, symbol, stop-word and line ratios.
RULES = (
    Rule("mean_word_chars", 2.0, 12.0),
    Rule("symbols_per_word", None, 0.1),
    Rule("stop_word_share", 0.05, None),
    Rule("duplicate_line_share", None, 0.5),
    Rule("longest_word_share", None, 0.5),
)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_RUN), "")


def _lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.ltrim(line, F.lit(SPACES)) != "")


def with_repeated_words(docs: DataFrame, words: str, name: str) -> DataFrame:
    """Adds the number of words that lie in 3-word windows found twice or more in the array, the first one included.

    The windows are sorted, so equal ones stand side by side; the union of their places is counted from gaps. Each step
    is a column of its own: the optimizer keeps a column that is used more than once, so nothing is computed twice.
    """
    n = F.size(words)
    parts = [F.slice(words, k, n - 2).alias(part) for k, part in ((1, "a"), (2, "b"), (3, "c"))]
    windows = F.sort_array(F.arrays_zip(*parts, F.sequence(F.lit(0), n - 3).alias("at")))
    docs = docs.withColumn("_windows", F.when(n > 3, windows))
    same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    after = F.zip_with("_windows", F.slice("_windows", 2, F.size("_windows")), lambda x, y: F.coalesce(same(x, y), F.lit(False)))
    docs = docs.withColumn("_after", F.when(F.size("_windows") > 0, after))
    # most texts repeat no window; for them nothing more is computed
    docs = docs.withColumn("_after", F.when(F.array_contains("_after", True), F.col("_after")))
    before = F.concat(F.array(F.lit(False)), F.slice("_after", 1, F.size("_after") - 1))
    twice = F.zip_with("_after", before, lambda p, q: p | q)
    docs = docs.withColumn("_at", F.sort_array(F.array_compact(F.zip_with(twice, "_windows", lambda t, x: F.when(t, x["at"])))))
    gaps = F.zip_with("_at", F.slice("_at", 2, F.size("_at")), lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3))))
    covered = F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)
    return docs.withColumn(name, F.coalesce(covered, F.lit(0)).cast("long")).drop("_windows", "_after", "_at")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def quality_signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the ratios that the rules name.

    A null text has no words and no lines.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    docs = docs.withColumn("_words", _words(whole)).withColumn("_lines", _lines(whole))
    words, lines, n = F.col("_words"), F.col("_lines"), F.col("n_words")
    stops = F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))
    docs = docs.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": (F.size(F.split(whole, SYMBOL)) - 1).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_stop_words": F.size(stops).cast("long"),
            "longest_word": F.coalesce(F.array_max(F.transform(words, F.length)), F.lit(0)).cast("long"),
        }
    )
    docs = with_repeated_words(docs, "_words", "n_repeat_words")
    return docs.withColumns(
        {
            "mean_word_chars": _share(F.col("word_chars"), n),
            "symbols_per_word": _share(F.col("n_symbols"), n),
            "stop_word_share": _share(F.col("n_stop_words"), n),
            "duplicate_line_share": _share(F.col("n_dup_lines"), F.col("n_lines")),
            "longest_word_share": _share(F.col("longest_word"), F.col("word_chars")),
        }
    ).drop("_words", "_lines")


def compiled(rules: tuple[Rule, ...]) -> Column:
    """The table as one condition: true where every rule holds."""
    passes = F.lit(True)
    for rule in rules:
        if rule.least is not None:
            passes = passes & (F.col(rule.signal) >= F.lit(rule.least))
        if rule.most is not None:
            passes = passes & (F.col(rule.signal) <= F.lit(rule.most))
    return passes


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, fewest_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """doc_id, the signals, base_failed (too few words, or more than ``most_repeated`` per cent repeated) and kept.

    One row per input row: a null or empty text has no words and fails the base; repeated rows and null ids stay; other
    columns are ignored, whatever their names; an empty table gives no rows. A value that equals a bound passes.
    """
    docs = quality_signals(docs.select("doc_id", "text")).drop("text")
    failed = (F.col("n_words") < fewest_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return docs.withColumn("base_failed", failed).withColumn("kept", ~failed & compiled(rules))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, fewest_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """The rows of ``docs``, with all columns, that :func:`apply_rules` keeps."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("text"))
    marked = quality_signals(whole)
    failed = (F.col("n_words") < fewest_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    # a column that is not deterministic is computed once: the filter is not pushed below the signals with copies of them
    once = F.monotonically_increasing_id() >= 0
    return marked.select("_row", (~failed & compiled(rules) & once).alias("_kept")).where("_kept").select("_row.*")

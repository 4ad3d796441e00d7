"""Defining the two samples: splits, caps, train/test parts and scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import row_hash
from ..functions.ranks import middle_value
from ..model import X, Y, TwoSample, quoted
from ..runtime import durable

TRANSITION = "T"


def split_by_values(df: DataFrame, column: str, values_x: list, values_y: list, label: str = "label") -> DataFrame:
    """Labels rows by two sets of values and drops all others; the filter reaches the scan."""
    value = quoted(column)
    kept = df.where(value.isin(list(values_x) + list(values_y)))
    return kept.withColumn(label, F.when(value.isin(list(values_x)), F.lit(X)).otherwise(F.lit(Y)))


def split_by_flag(df: DataFrame, flag: str, label: str = "label") -> DataFrame:
    """X where the flag is 1, Y where it is 0, other rows dropped."""
    if flag not in df.columns:
        raise KeyError(f"column {flag!r} is needed to split the samples")
    return split_by_values(df, flag, [1], [0], label)


def split_three_way(
    df: DataFrame, column: str, values_x: list, values_y: list, key: str | None = None, label: str = "label"
) -> DataFrame:
    """X, Y and the remainder ``T``; without the column, first and second half in key order."""
    if column not in df.columns:
        return split_in_halves(df, key, label)
    value = quoted(column)
    named = F.when(value.isin(list(values_x)), X).when(value.isin(list(values_y)), Y).otherwise(TRANSITION)
    return df.withColumn(label, named)


def split_rest(df: DataFrame, key: str | None = None, label: str = "label") -> DataFrame:
    """Report split: X where the match flag is 1, Y everything else, missing flags included.

    Falls back to "both decisions are 1", then to halves in key order.
    """
    if "match" in df.columns:
        chosen = F.col("match") == 1
    elif {"dec", "dec_o"} <= set(df.columns):
        chosen = (F.col("dec") == 1) & (F.col("dec_o") == 1)
    else:
        return split_in_halves(df, key, label)
    return df.withColumn(label, F.when(F.coalesce(chosen, F.lit(False)), X).otherwise(Y))


def split_in_halves(df: DataFrame, key: str | None, label: str = "label") -> DataFrame:
    """The first half of the keys, in the order of their own type, is X, the second half Y; a key that is missing belongs to Y."""
    if key is None:
        raise KeyError("a key column is needed to split the table in halves")
    border = middle_value(df.select(quoted(key).alias("k")), "k")
    first = quoted(key) < F.lit(border).cast(df.schema[key].dataType)
    return df.withColumn(label, F.when(first, X).otherwise(Y))


def hash_borders(hashed: DataFrame, label: str, wanted: Column) -> DataFrame:
    """Per label, hash and key of the last of the ``wanted`` rows in hash order, and how many rows of that key are wanted:
    ``(label, total, edge_hash, edge_key, edge_rows, edge_total)``, the last being all rows of that key.

    ``hashed`` has the label, the hash ``h`` as hex digits and the key ``k``; ``wanted`` may use the column ``total``. Rows are
    counted by the first three digits of their hash, then, behind the border, by the next three. Hashes are uniform, so the
    border cell of the second level holds about one row in 16 million; only that cell is sorted.
    """
    by_label = Window.partitionBy(label)
    hashed = hashed.select(label, F.substring("h", 1, 3).alias("p1"), F.substring("h", 4, 3).alias("p2"), "h", "k")

    def border(cells: DataFrame, level: str, need: str, keep: list[str]) -> DataFrame:
        upto = F.sum("n").over(by_label.orderBy(level))
        cells = cells.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))
        found = cells.where((F.col("before") < F.col(need)) & (F.col("upto") >= F.col(need)))
        return found.select(label, level, *keep, (F.col(need) - F.col("before")).alias("need"))

    first = hashed.groupBy(label, "p1").agg(F.count("*").alias("n"))
    first = first.withColumn("total", F.sum("n").over(by_label))
    first = border(first.withColumn("wanted", F.least(wanted.cast("bigint"), F.col("total"))), "p1", "wanted", ["total"])
    second = hashed.join(F.broadcast(first), [label, "p1"]).groupBy(label, "p1", "total", "p2", "need").agg(F.count("*").alias("n"))
    second = border(second, "p2", "need", ["p1", "total"])
    cell = hashed.join(F.broadcast(second), [label, "p1", "p2"])
    order = by_label.orderBy("h", "k")
    cell = cell.withColumn("place", F.row_number().over(order)).withColumn("first", F.rank().over(order))
    cell = cell.withColumn("edge_total", F.count("*").over(Window.partitionBy(label, "h", "k"))).where(F.col("place") == F.col("need"))
    edge_rows = (F.col("place") - F.col("first") + 1).alias("edge_rows")
    return cell.select(label, "total", F.col("h").alias("edge_hash"), F.col("k").alias("edge_key"), edge_rows, "edge_total")


def _up_to_border(df: DataFrame, key: str, wanted: Column, seed: int, label: str) -> tuple[DataFrame, Column]:
    """The table with its borders, and whether a row comes no later than the border of its label.

    Of several rows with the key of the border as many count as are still wanted, in an order of their whole content.
    """
    hashed = df.select(label, row_hash(quoted(key), seed).alias("h"), quoted(key).alias("k"))
    borders = durable(hash_borders(hashed, label, wanted), "borders")
    joined = df.withColumn("row_hash", row_hash(quoted(key), seed)).join(F.broadcast(borders), label)
    at_border = (F.col("row_hash") == F.col("edge_hash")) & (quoted(key) == F.col("edge_key"))
    before = (F.col("row_hash") < F.col("edge_hash")) | ((F.col("row_hash") == F.col("edge_hash")) & (quoted(key) < F.col("edge_key")))
    if borders.where("edge_total > edge_rows").isEmpty():
        return joined, before | at_border
    content = F.xxhash64(*[quoted(c).cast("string") for c in df.columns])
    place = F.row_number().over(Window.partitionBy(label).orderBy(content))
    joined = joined.where(~at_border).withColumn("edge_place", F.lit(0)).unionByName(joined.where(at_border).withColumn("edge_place", place))
    return joined, before | (at_border & (F.col("edge_place") <= F.col("edge_rows")))


def take_by_hash(df: DataFrame, key: str, wanted: Column, seed: int, label: str = "label") -> DataFrame:
    """The ``wanted`` rows per label with the smallest row hash; ``wanted`` may use the column ``total``.

    Rows are ordered by the hash of ``key``; a key on several rows is cut between them. A label with no more than ``wanted`` rows is kept whole. The rows themselves are only
    filtered by comparison with the border of their label.
    """
    joined, inside = _up_to_border(df, key, wanted, seed, label)
    return joined.where(inside).select(*[quoted(c) for c in df.columns])


def capped(df: DataFrame, key: str, limit: int | None, seed: int = 42, label: str = "label") -> DataFrame:
    """At most ``limit`` rows per label, drawn without replacement; no limit keeps all rows."""
    if limit is None or limit <= 0:
        return df
    return take_by_hash(df, key, F.lit(limit), seed, label)


def capped_sizes(df: DataFrame, limit: int | None, label: str = "label") -> DataFrame:
    """Original and capped row count per label."""
    kept = F.col("n_original") if not limit else F.least(F.col("n_original"), F.lit(limit))
    counts = df.groupBy(label).agg(F.count("*").alias("n_original"))
    return counts.withColumn("n_kept", kept.cast("bigint"))


def train_test_parts(df: DataFrame, key: str, ratio: float = 0.8, seed: int = 42, label: str = "label") -> DataFrame:
    """Adds ``is_train`` and ``is_test``.

    Train holds max(5, floor(ratio * n)) rows per label, never more than there are; test is the rest, or the
    train rows themselves where no row is left.
    """
    size = F.greatest(F.lit(5), F.floor(F.lit(ratio) * F.col("total")))
    joined, inside = _up_to_border(df, key, size, seed, label)
    parts = joined.withColumn("is_train", inside)
    rest = ~F.col("is_train") | (F.col("total") <= size)
    return parts.withColumn("is_test", rest).select(*[quoted(c) for c in df.columns], "is_train", "is_test")


def in_scope(sample: TwoSample, scope: str, limit: int | None, seed: int = 42) -> TwoSample:
    """``subset`` caps the sample, ``whole`` keeps all rows."""
    if scope not in ("subset", "whole"):
        raise ValueError(f"scope must be 'subset' or 'whole', not {scope!r}")
    if scope == "whole" or not limit:
        return sample
    return sample.with_frame(capped(sample.frame, sample.key, limit, seed, sample.label))


def anchor_states(df: DataFrame, anchors: list[str], carry: list[str]) -> DataFrame:
    """One row per observation and binary anchor: ``(anchor, anchor_state, *carry)`` for the states 1 and 0."""
    states = F.explode(F.array(*[F.struct(F.lit(a).alias("anchor"), quoted(a).cast("double").alias("anchor_state")) for a in anchors]))
    rows = df.select(*[quoted(c) for c in carry], states.alias("s")).select(*[quoted(c) for c in carry], "s.*")
    return rows.where(F.col("anchor_state").isin(0.0, 1.0))


def pooled(x: DataFrame, y: DataFrame, label: str = "label") -> DataFrame:
    """Bag union of two separate tables as one labelled table."""
    return x.withColumn(label, F.lit(X)).unionByName(y.withColumn(label, F.lit(Y)))

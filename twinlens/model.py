"""The two-sample table all operators work on."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

X, Y = "X", "Y"


def ticked(name: str) -> str:
    """Name as an SQL identifier that survives dots and spaces."""
    return "`" + name.replace("`", "``") + "`"


def quoted(name: str) -> Column:
    """Column reference that survives dots and spaces in a name."""
    return F.col(ticked(name))


def texts(values) -> Column:
    """Array literal of strings."""
    escaped = [v.replace("\\", "\\\\").replace("'", "\\'") for v in values]
    return F.expr("array(" + ", ".join(f"'{v}'" for v in escaped) + ")")


@dataclass(frozen=True)
class TwoSample:
    """One row per observation: a unique key, a label ``X`` or ``Y`` and one DOUBLE column per feature.

    The id of a variable is its position in ``features``; the builders sort the names, so ids are reproducible.
    """

    frame: DataFrame
    features: tuple[str, ...]
    key: str | None = None
    label: str = "label"

    @staticmethod
    def of(frame: DataFrame, key: str | None = None, label: str = "label", drop: tuple[str, ...] = ()) -> "TwoSample":
        """Takes every column other than key, label and ``drop`` as a feature, in name order."""
        features = tuple(sorted(c for c in frame.columns if c not in {key, label, *drop}))
        return TwoSample(frame, features, key, label)

    def with_frame(self, frame: DataFrame) -> "TwoSample":
        return replace(self, frame=frame)

    def only(self, names: list[str] | tuple[str, ...]) -> "TwoSample":
        """The same rows with a subset of the features, in the order given."""
        return replace(self, features=tuple(names))

    def vector(self) -> Column:
        """All features of a row as ARRAY<DOUBLE>, in id order."""
        return F.expr("array(" + ", ".join(f"CAST({ticked(n)} AS DOUBLE)" for n in self.features) + ")")

    def numbers(self) -> Column:
        """All features as ARRAY<DOUBLE> with 0 for missing values, in id order."""
        cells = (f"coalesce(nanvl(try_cast({ticked(n)} AS DOUBLE), CAST(NULL AS DOUBLE)), 0D)" for n in self.features)
        return F.expr("array(" + ", ".join(cells) + ")")

    def long(self, *carry: str) -> DataFrame:
        """One row per observation and variable ``(label, *carry, id_variable, v)``; missing values are left out."""
        rows = self.frame.select(
            F.col(self.label).alias("label"), *carry, F.posexplode(self.vector()).alias("id_variable", "v")
        )
        return rows.where(F.col("v").isNotNull() & ~F.isnan("v"))

    def name_of(self, id_variable: Column | str) -> Column:
        """Variable name for an id."""
        column = F.col(id_variable) if isinstance(id_variable, str) else id_variable
        return F.get(texts(self.features), column)

    def ids_of(self, names) -> list[int]:
        return [self.features.index(n) for n in names]


def is_x(label: str = "label") -> Column:
    return F.col(label) == F.lit(X)


def is_y(label: str = "label") -> Column:
    return F.col(label) == F.lit(Y)

"""Housing sales, split by the year of sale."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..model import TwoSample, quoted
from ..operators import clean, encode, sample, stats

# Columns where a missing value means that the thing is absent.
ABSENT_CATEGORIES = [
    "PoolQC", "MiscFeature", "Alley", "Fence", "FireplaceQu", "GarageType", "GarageFinish", "GarageQual", "GarageCond",
    "BsmtQual", "BsmtCond", "BsmtExposure", "BsmtFinType1", "BsmtFinType2",
]
ABSENT_AMOUNTS = [
    "GarageArea", "GarageCars", "TotalBsmtSF", "BsmtFinSF1", "BsmtFinSF2", "BsmtUnfSF", "BsmtFullBath", "BsmtHalfBath", "MasVnrArea",
]

# Ordinal scales.
QUALITY = {"Ex": 5, "Gd": 4, "TA": 3, "Fa": 2, "Po": 1, "None": 0}
EXPOSURE = {"Gd": 4, "Av": 3, "Mn": 2, "No": 1, "None": 0}
FINISH = {"GLQ": 6, "ALQ": 5, "BLQ": 4, "Rec": 3, "LwQ": 2, "Unf": 1, "None": 0}
QUALITY_COLUMNS = [
    "ExterQual", "ExterCond", "BsmtQual", "BsmtCond", "HeatingQC", "KitchenQual", "FireplaceQu", "GarageQual", "GarageCond", "PoolQC",
]
SCALES = {
    **{c: QUALITY for c in QUALITY_COLUMNS},
    "BsmtExposure": EXPOSURE,
    "BsmtFinType1": FINISH,
    "BsmtFinType2": FINISH,
}

# Columns that give the split away or only identify a row, and whole-number features.
LEAKAGE = ["YrSold", "MoSold", "SalePrice", "Order", "PID", "SaleType", "SaleCondition", "Id"]
WHOLE_NUMBERS = {
    "YearBuilt", "YearRemodAdd", "GarageYrBlt", "BedroomAbvGr", "KitchenAbvGr", "TotRmsAbvGrd", "Fireplaces", "GarageCars", "FullBath",
    "HalfBath", "BsmtFullBath", "BsmtHalfBath", "OverallQual", "OverallCond", "MoSold",
}

# Column sets of the dataset report, with the number of categories shown.
REPORT_AMOUNTS = [
    "SalePrice", "GrLivArea", "LotArea", "TotalBsmtSF", "GarageArea", "1stFlrSF", "2ndFlrSF", "YearBuilt", "YearRemodAdd",
    "TotRmsAbvGrd", "FullBath", "HalfBath", "BedroomAbvGr", "LotFrontage",
]
REPORT_RATINGS = ["OverallQual", "OverallCond"]
REPORT_CATEGORIES = {"Neighborhood": 12, "BldgType": 6, "SaleType": 6}


@dataclass(frozen=True)
class Housing:
    """Adapter: raw sales to a two-sample table with lineage.

    One-hot encoding runs before the leakage columns are dropped, so the indicator columns of a dropped text column
    stay; ``drop_by_lineage`` removes them as well. Medians, modes and categories are learnt on all rows.
    """

    key: str = "Order"
    years_x: list[int] = field(default_factory=lambda: [2006, 2007])
    years_y: list[int] = field(default_factory=lambda: [2009, 2010])
    limit: int | None = None
    seed: int = 42
    drop_by_lineage: bool = False

    def features(self, raw: DataFrame, apply_limit: bool = True) -> TwoSample:
        return self.prepare(raw, apply_limit)[0]

    def lineage(self, raw: DataFrame) -> list[tuple[str, list[str], str]]:
        return self.prepare(raw, False)[1]

    def prepare(self, raw: DataFrame, apply_limit: bool = True):
        """The two-sample table and its lineage ``[(feature, sources, type)]``."""
        table = raw.withColumn("sample_key", quoted(self.key))
        columns = [c for c in raw.columns]
        table = clean.fill_absent_categories(table, ABSENT_CATEGORIES)
        table = clean.fill_absent_numbers(table, ABSENT_AMOUNTS)
        table = clean.impute_group_median(table, "LotFrontage", "Neighborhood")
        table = clean.impute_generic(table, columns)
        table = encode.encode_ordinal(table, SCALES)
        text = [f.name for f in table.schema if f.dataType.simpleString() == "string" and f.name != "sample_key"]
        table, expanded = encode.encode_onehot(table, text)
        split = sample.split_by_values(clean.coerce_numbers(table, ["YrSold"]), "YrSold", self.years_x, self.years_y)
        dropped = list(LEAKAGE)
        if self.drop_by_lineage:
            dropped += [name for source in LEAKAGE for name in expanded.get(source, [])]
        split = encode.drop_columns(split, dropped)
        names = tuple(sorted(c for c in split.columns if c not in ("sample_key", "label")))
        made = TwoSample(encode.numeric_guard(split, names), names, key="sample_key")
        if apply_limit:
            made = sample.in_scope(made, "subset", self.limit, self.seed)
        return made, self._lineage(columns, made.features, expanded)

    def _lineage(self, raw: list[str], features, expanded):
        origin = {name: source for source, names in expanded.items() for name in names}
        records = []
        for name in features:
            if name == "LotFrontage":
                records.append((name, ["LotFrontage", "Neighborhood"], "float"))
            elif name in origin:
                records.append((name, [origin[name]], "category"))
            elif name in SCALES or name in WHOLE_NUMBERS:
                records.append((name, [name], "int"))
            else:
                records.append((name, [name], "float"))
        used = {source for _, sources, _ in records for source in sources}
        return records + [("removed", [c], "removed") for c in sorted(set(raw) - used)]

    def report(self, raw: DataFrame) -> dict[str, DataFrame]:
        """The tables of the dataset report."""
        split = sample.split_three_way(raw, "YrSold", self.years_x, self.years_y, self.key)
        missing = stats.missingness(split)
        tables = {
            "overview": stats.overview(split),
            "amounts": stats.numeric_comparison(split, REPORT_AMOUNTS),
            "ratings": stats.numeric_comparison(split, REPORT_RATINGS),
            "missingness": stats.top_missing(missing, 15),
            "absence": stats.top_missing(missing.where(F.col("name_column").isin(ABSENT_CATEGORIES + ABSENT_AMOUNTS))),
        }
        present = {c: n for c, n in REPORT_CATEGORIES.items() if c in raw.columns}
        totals = stats.label_totals(split) if present else None
        return tables | {c: stats.category_comparison(split, c, n, totals=totals) for c, n in present.items()}

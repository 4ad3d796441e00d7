"""Dating scorecards, joined into reciprocal pairs and split by mutual match."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.values import first_of
from ..model import TwoSample
from ..operators import clean, encode, pairs, sample, stats
from ..runtime import wide_columns

# Column groups of the survey, to REPORT_CATEGORIES.
DEMOGRAPHICS = ["age", "imprace", "imprelig", "date", "go_out", "goal", "exphappy", "expnum", "career_c"]
INTERESTS = [
    "sports", "tvsports", "exercise", "dining", "museums", "art", "hiking", "gaming", "clubbing", "reading", "tv", "theater", "movies",
    "concerts", "music", "shopping", "yoga",
]
SELF_RATINGS = ["attr3_1", "sinc3_1", "intel3_1", "fun3_1", "amb3_1"]
PREFERENCES = ["attr1_1", "sinc1_1", "intel1_1", "fun1_1", "amb1_1", "shar1_1"]
SURVEY_FIELDS = ["goal", "date", "go_out", "exphappy", "expnum"]
IMPORTANCES = ["imprace", "imprelig"]
MEDIAN_COLUMNS = INTERESTS + SELF_RATINGS + PREFERENCES + ["age", "imprace", "imprelig", "date", "go_out", "exphappy", "expnum"]
MODE_COLUMNS = ["goal", "race", "field_cd", "career_c"]
ID_COLUMNS = ["iid", "pid", "gender"]
FLAGS = ["match", "dec", "dec_o"]
REPORT_HABITS = ["age", "imprace", "imprelig", "date", "go_out"]
REPORT_CATEGORIES = {"goal": 7, "race": 6}


def clean_cards(raw: DataFrame) -> DataFrame:
    """Numbers read, rows without ids dropped, missing answers imputed."""
    cards = clean.coerce_numbers(raw, DEMOGRAPHICS + INTERESTS + SELF_RATINGS + PREFERENCES + FLAGS)
    cards = clean.fill_group_id(clean.drop_missing_ids(cards, ID_COLUMNS), "wave")
    return clean.impute_modes(clean.impute_medians(cards, MEDIAN_COLUMNS, 5.0), MODE_COLUMNS, 1)


@dataclass(frozen=True)
class Dating:
    """Adapter: raw scorecards to a two-sample table of pairs with lineage."""

    limit: int | None = None
    seed: int = 42

    def features(self, raw: DataFrame, apply_limit: bool = True) -> TwoSample:
        return self.prepare(raw, apply_limit)[0]

    def lineage(self, raw: DataFrame) -> list[tuple[str, list[str], str]]:
        return self.prepare(raw, False)[1]

    def prepare(self, raw: DataFrame, apply_limit: bool = True):
        """The two-sample table and its lineage ``[(feature, sources, type)]``."""
        with wide_columns(raw.sparkSession):
            cards = clean_cards(raw)
        joined = pairs.with_pair_key(pairs.reciprocal_pairs(cards))
        table, lineage = pairs.pair_features(joined, INTERESTS, PREFERENCES + SELF_RATINGS, SURVEY_FIELDS, IMPORTANCES)
        names = tuple(sorted(name for name, _, _ in lineage))
        split = encode.drop_columns(sample.split_by_flag(table, "match"), ["match"])
        made = TwoSample(encode.numeric_guard(split, names), names, key="pair_key")
        if apply_limit:
            made = sample.in_scope(made, "subset", self.limit, self.seed)
        used = {source for _, sources, _ in lineage for source in sources} | {"field_cd"}
        removed = [("removed", [c], "removed") for c in sorted(set(raw.columns) - used)]
        return made, lineage + removed

    def report(self, raw: DataFrame, only: list[str] | None = None) -> dict[str, DataFrame]:
        """The tables of the dataset report, or those named in ``only``; its split is per scorecard, with everything unmatched in Y."""
        split = sample.split_rest(raw, first_of(raw.columns, "id", "iid"))
        numbers = {"habits": REPORT_HABITS, "interests": INTERESTS, "self_ratings": SELF_RATINGS, "preferences": PREFERENCES}
        present = {c: n for c, n in REPORT_CATEGORIES.items() if c in raw.columns}
        wanted = [n for n in ("overview", *numbers, "missingness", *present) if only is None or n in only]
        totals = stats.label_totals(split) if set(present) & set(wanted) else None
        tables = {}
        for name in wanted:
            if name in numbers:
                tables[name] = stats.numeric_comparison(split, numbers[name])
            elif name in present:
                tables[name] = stats.category_comparison(split, name, present[name], totals=totals)
            else:
                tables[name] = stats.overview(split) if name == "overview" else stats.top_missing(stats.missingness(split), 15)
        return tables

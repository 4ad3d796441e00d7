"""Reciprocal pairs and their features, on scorecards derived from line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinlens.operators import pairs
from twinlens.plans import dating
from twinlens.runtime import durable, spread

from .base import query, rounded, table

# Column -> expression that reads the same in Spark SQL and in DuckDB. Every answer depends on the person (iid) and
# on the date (line item), some are missing. People are all suppliers in a circle, each meets the hundred around.
ANSWERS = {
    "iid": "l_suppkey",
    "pid": "(l_suppkey - 1 + 100 * {people} + l_partkey % 100 - 50) % {people} + 1",
    "gender": "CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END",
    "wave": "year(l_shipdate)",
    "dec": "CASE WHEN l_quantity > 20 THEN 1.0 ELSE 0.0 END",
    "dec_o": "CASE WHEN l_tax > 0.04 THEN 1.0 ELSE 0.0 END",
    "age": "18 + l_quantity",
    "race": "CASE WHEN l_orderkey % 40 <> 0 THEN l_suppkey % 5 + 1 END",
    "goal": "CASE WHEN l_orderkey % 30 <> 0 THEN l_linenumber % 6 + 1 END",
    "field_cd": "CASE WHEN l_orderkey % 20 <> 0 THEN l_partkey % 18 + 1 END",
    "career_c": "CASE WHEN l_orderkey % 25 <> 0 THEN l_suppkey % 17 + 1 END",
    "zipcode": "CASE WHEN l_orderkey % 9 = 0 THEN NULL WHEN l_orderkey % 9 = 1 THEN '' ELSE concat(CAST(l_partkey * 37 % 99999 AS STRING), CASE WHEN l_orderkey % 9 = 2 THEN '-1234' WHEN l_orderkey % 9 = 3 THEN '.0' ELSE '' END) END",
}
NUMERIC = dating.MEDIAN_COLUMNS[:-7] + ["imprace", "imprelig", "date", "go_out", "exphappy", "expnum"]
for _n, _name in enumerate(NUMERIC):
    _scale = 40 if _name in dating.PREFERENCES else 10
    ANSWERS[_name] = f"CASE WHEN (l_orderkey + {_n}) % 23 <> 0 THEN (l_suppkey * {_n + 3} + l_partkey * {2 * _n + 1} + l_linenumber) % {_scale} + 1 END"

MEDIANS, MODES = dating.MEDIAN_COLUMNS, dating.MODE_COLUMNS


def _cast(name: str, text: str) -> str:
    if name in ("iid", "pid"):
        return f"CAST({text} AS BIGINT)"
    if name in ("gender", "wave"):
        return f"CAST({text} AS INT)"
    return text if name == "zipcode" else f"CAST({text} AS DOUBLE)"


def cards(spark, sf):
    rows, people = spread(table(spark, sf, "lineitem")), str(table(spark, sf, "supplier").count())
    return rows.select(*[F.expr(_cast(name, text).replace("{people}", people)).alias(name) for name, text in ANSWERS.items()])


SQL_CARDS = "cards AS (SELECT " + ", ".join(f"{_cast(n, t)} AS {n}" for n, t in ANSWERS.items()) + " FROM lineitem)"
SQL_CARDS = SQL_CARDS.replace("{people}", "(SELECT count(*) FROM supplier)")
SQL_FILLED = SQL_CARDS + ",\nfills AS (SELECT " + ", ".join(
    [f"coalesce(median({c}), 5.0) AS fill_{c}" for c in MEDIANS]
    + [f"(SELECT {c} FROM cards WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1) AS fill_{c}" for c in MODES]
) + " FROM cards),\nfilled AS (SELECT " + ", ".join(
    f"coalesce({c}, fill_{c}) AS {c}" if c in MEDIANS + MODES else c for c in ANSWERS
) + " FROM cards, fills)"
SQL_PAIRS = """
pairs AS (SELECT substr(sha256(least(m.iid, f.iid) || '_' || greatest(m.iid, f.iid)), 1, 16) AS pair_id_hash,
                 CASE WHEN m.dec = 1 AND f.dec = 1 THEN 1 ELSE 0 END AS match, m.wave, {columns}
          FROM {source} m JOIN {source} f ON m.iid = f.pid AND m.pid = f.iid AND m.wave = f.wave WHERE m.gender = 1 AND f.gender = 0)"""


def _pairs(source: str) -> str:
    names = [c for c in ANSWERS if c != "wave"]
    return SQL_PAIRS.format(source=source, columns=", ".join(f"m.{c} AS {c}_male, f.{c} AS {c}_female" for c in names))


@query("reciprocal_pairs", f"""
WITH {SQL_CARDS}, {_pairs('cards')}
SELECT pair_id_hash, match, wave, iid_male, iid_female, pid_male, pid_female, age_male, age_female FROM pairs""")
def reciprocal_pairs(spark, sf):
    joined = pairs.reciprocal_pairs(cards(spark, sf))
    return joined.select("pair_id_hash", "match", "wave", "iid_male", "iid_female", "pid_male", "pid_female", "age_male", "age_female")


def _region(column: str) -> str:
    bare = f"split_part(split_part(replace(trim({column}), ',', ''), '-', 1), '.', 1)"
    digit = f"CASE WHEN length({bare}) >= 5 THEN substr({bare}, 1, 1) ELSE '0' END"
    names = " ".join(f"WHEN '{d}' THEN '{name}'" for d, name in pairs.ZIP_REGIONS.items())
    return f"CASE WHEN {column} IS NULL OR {bare} = '' THEN 'Unknown' ELSE CASE {digit} {names} ELSE 'Other' END END"


@query("region_match", f"""
WITH {SQL_CARDS}, {_pairs('cards')}
SELECT pair_id_hash, zipcode_male, zipcode_female, {_region('zipcode_male')} AS region_male, {_region('zipcode_female')} AS region_female,
       CAST({_region('zipcode_male')} = {_region('zipcode_female')} AS DOUBLE) AS same_region FROM pairs""")
def region_match(spark, sf):
    joined = pairs.reciprocal_pairs(cards(spark, sf))
    male, female = F.col("zipcode_male"), F.col("zipcode_female")
    return joined.select(
        "pair_id_hash", "zipcode_male", "zipcode_female", pairs.zip_region(male).alias("region_male"),
        pairs.zip_region(female).alias("region_female"), pairs.same_region(male, female).alias("same_region"),
    )


def _domain(column: str) -> str:
    return f"CASE {' '.join(f'WHEN {column} = {field} THEN {domain}' for field, domain in pairs.FIELD_DOMAINS.items())} END"


def _tier(column: str) -> str:
    return f"CASE {' '.join(f'WHEN {column} = {career} THEN {tier}' for career, tier in pairs.CAREER_TIERS.items())} ELSE 5 END"


def _feature_sql() -> dict[str, str]:
    differences = ["age", *dating.INTERESTS, *dating.PREFERENCES, *dating.SELF_RATINGS, *dating.SURVEY_FIELDS, *dating.IMPORTANCES]
    sql = {f"Diff_{c}": f"abs({c}_male - {c}_female)" for c in differences}
    lists = {side: "[" + ", ".join(f"{c}_{side}" for c in dating.INTERESTS) + "]" for side in ("male", "female")}
    sql["Interest_Cosine_Sim"] = f"list_cosine_similarity({lists['male']}, {lists['female']})"
    sql |= {f"career_group_{side}": _tier(f"career_c_{side}") for side in ("male", "female")}
    sql["Same_Race"] = "CASE WHEN race_male = race_female THEN 1 ELSE 0 END"
    sql["Race_Preference_Conflict"] = "CASE WHEN race_male = race_female THEN 0 ELSE (imprace_male + imprace_female) / 2 END"
    sql["Same_Goal"] = "CASE WHEN goal_male = goal_female THEN 1 ELSE 0 END"
    sql["Same_Field"] = "CASE WHEN field_cd_male = field_cd_female THEN 1 ELSE 0 END"
    sql["Field_Similarity"] = (
        "CASE WHEN field_cd_male IN (12, 18) OR field_cd_female IN (12, 18) THEN 0 WHEN field_cd_male = field_cd_female THEN 1 "
        f"WHEN {_domain('field_cd_male')} = {_domain('field_cd_female')} THEN 0.5 ELSE 0 END"
    )
    sql["Same_region"] = f"CASE WHEN {_region('zipcode_male')} = {_region('zipcode_female')} THEN 1 ELSE 0 END"
    for trait, word in (("attr", "Attr"), ("intel", "Intel")):
        sql[f"Delta_Male_{word}_Align"] = f"abs({trait}3_1_male - {trait}1_1_female / 10)"
        sql[f"Delta_Female_{word}_Align"] = f"abs({trait}3_1_female - {trait}1_1_male / 10)"
    return sql


FEATURES = _feature_sql()


@query("pair_features", f"""
WITH {SQL_FILLED}, {_pairs('filled')}
SELECT pair_id_hash, CASE WHEN match = 1 THEN 'X' ELSE 'Y' END AS label,
       {', '.join(f'round(CAST({text} AS DOUBLE), 6) + 0.0 AS "{name}"' for name, text in FEATURES.items())} FROM pairs""")
def pair_features(spark, sf):
    """The whole adapter: cleaning, imputation, join, 49 features and the split."""
    made = dating.Dating(limit=None).features(durable(cards(spark, sf), "cards"))
    return durable(rounded(made.frame.select("pair_id_hash", "label", *made.features), *made.features), "pairs")


@query("pair_feature_catalogue")
def pair_feature_catalogue(spark, sf):
    """Lineage and column profile of the pair features."""
    from twinlens.operators.report import feature_catalogue, lineage_table

    made, lineage = dating.Dating(limit=None).prepare(durable(cards(spark, sf), "cards"))
    return feature_catalogue(made.with_frame(durable(made.frame, "pairs")), lineage_table(spark, lineage))

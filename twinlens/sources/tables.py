"""Raw table scans and the result warehouse."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.values import to_number
from ..model import X, Y, TwoSample, quoted

# Spellings of a missing value in CSV files.
MISSING_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
    "None", "n/a", "nan", "null",
]

# Names and columns of the result tables.
RESULT_TABLES = {
    "analysis_variable_selection": "id_variable int, name_variable string, weight double",
    "analysis_variable_correlation": "id_variable_1 int, id_variable_2 int, correlation_score double",
    "analysis_variable_clustering": "id_variable int, name_variable string, id_cluster int, score_related double",
    "analysis_representative_samples": (
        "id_sample string, label_class string, is_prototype_for string, distance_score double, type_subspace string, features_json string"
    ),
}
FEATURE_TABLE = "dataset_features_preprocessed"
METADATA_TABLE = "dataset_metadata"


def _traits(spark: SparkSession, path: str) -> tuple[bool, bool]:
    """Whether a text file holds bytes that are no UTF-8, and whether a line has an odd number of quotes; one scan."""
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    some = lambda test: F.coalesce(F.max(test), F.lit(False))
    return tuple(spark.read.text(path).agg(some(~F.is_valid_utf8("value")).alias("bytes"), some(quotes % 2 == 1).alias("breaks")).first())


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, encoding: str | None = None) -> DataFrame:
    """CSV with a header. Missing-value words become NULL, then types are taken from the schema or inferred.

    Without an encoding the file is read as UTF-8, or as latin-1 if it is no valid UTF-8. Inference runs on the
    cleaned columns: a column whose values all read as numbers is BIGINT or DOUBLE. Only where a line has an odd number
    of quotes, which a line break inside quotes leaves, is each file read by one task; all others are split.
    """
    malformed, breaks = _traits(spark, path)
    encoding = encoding or ("ISO-8859-1" if malformed else "UTF-8")
    raw = spark.read.csv(path, header=True, encoding=encoding, multiLine=breaks, inferSchema=False, escape='"')
    clean = raw.select(*[F.when(~F.trim(quoted(c)).isin(MISSING_WORDS), quoted(c)).alias(c) for c in raw.columns])
    if schema is not None:
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return clean.select(*[quoted(f.name).try_cast(f.dataType).alias(f.name) for f in wanted])
    whole = lambda c: F.coalesce(F.min(quoted(c).try_cast("bigint").isNotNull() | quoted(c).isNull()), F.lit(False))
    number = lambda c: F.coalesce(F.min(to_number(quoted(c)).isNotNull() | quoted(c).isNull()), F.lit(False))
    checks = [f(c).alias(f"{kind}{i}") for i, c in enumerate(clean.columns) for kind, f in (("w", whole), ("n", number))]
    found = clean.agg(*checks).first()
    typed = []
    for i, c in enumerate(clean.columns):
        kind = "bigint" if found[f"w{i}"] else "double" if found[f"n{i}"] else "string"
        typed.append(quoted(c).try_cast(kind).alias(c))
    return clean.select(*typed)


class Warehouse:
    """Result tables as parquet directories below one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def write_result(self, name: str, rows: DataFrame) -> None:
        """Replaces one of the four result tables."""
        if name not in RESULT_TABLES:
            raise KeyError(f"no result table {name!r}")
        wanted = T.StructType.fromDDL(RESULT_TABLES[name])
        rows.select(*[F.col(f.name).cast(f.dataType) for f in wanted]).write.mode("overwrite").parquet(self.path(name))

    def write_prototypes(self, exemplars: DataFrame) -> None:
        """Replaces the exemplar table; the feature map becomes JSON text here and nowhere else."""
        self.write_result(
            "analysis_representative_samples",
            exemplars.select(
                F.col("sample_key").cast("string").alias("id_sample"), "label_class", "is_prototype_for", "distance_score", "type_subspace",
                F.to_json("features").alias("features_json"),
            ),
        )

    def write_features(self, sample: TwoSample, metadata: dict[str, str] | None = None) -> None:
        """Replaces the feature table, one directory per label, and starts the metadata afresh."""
        rows = sample.frame.select(
            quoted(sample.key).alias("sample_id"), F.col(sample.label).alias("distribution_label"), *[quoted(f) for f in sample.features]
        )
        rows.write.mode("overwrite").partitionBy("distribution_label").parquet(self.path(FEATURE_TABLE))
        counts = {r["distribution_label"]: r["n"] for r in self.table(FEATURE_TABLE).groupBy("distribution_label").agg(F.count("*").alias("n")).collect()}
        values = {
            "dataset_name": "Unknown",
            "n_samples_x": str(counts.get(X, 0)),
            "n_samples_y": str(counts.get(Y, 0)),
            "num_features": str(len(sample.features)),
            **(metadata or {}),
        }
        self._append_metadata(values, mode="overwrite", seq=0)

    def read_features(self) -> TwoSample:
        """The feature table as a two-sample table."""
        rows = self.table(FEATURE_TABLE)
        names = tuple(c for c in rows.columns if c not in ("sample_id", "distribution_label"))
        return TwoSample(rows.withColumnRenamed("distribution_label", "label"), names, key="sample_id")

    def read_side(self, label: str) -> DataFrame:
        """The rows of one label; only its directory is read."""
        return self.table(FEATURE_TABLE).where(F.col("distribution_label") == label)

    def _append_metadata(self, values: dict[str, str], mode: str, seq: int) -> None:
        """One change, in a directory of its own writer: jobs that write into one directory would clean up each other's files."""
        writer = f"w{uuid.uuid4().hex}"
        rows = [(k, v, seq, writer) for k, v in values.items()]
        table = self.spark.createDataFrame(rows, "key string, value string, seq bigint, writer string").coalesce(1)
        if mode == "overwrite":
            table.write.mode(mode).partitionBy("writer").parquet(self.path(METADATA_TABLE))
        else:
            table.drop("writer").write.parquet(f"{self.path(METADATA_TABLE)}/writer={writer}")

    def put_metadata(self, values: dict[str, str]) -> None:
        """Inserts or replaces values by key. Changes are appended with a rising number, so readers never see half a write.

        Writers need no lock: each adds a directory of its own, and where two draw one number the writer's random name decides, for
        every reader alike and for all keys of a change together. A change that begins after another has ended has the higher number.
        """
        try:
            last = self.table_raw(METADATA_TABLE).agg(F.max("seq")).first()[0] or 0
        except AnalysisException:
            last = -1
        self._append_metadata(values, mode="append", seq=last + 1)

    def metadata(self) -> DataFrame:
        """The latest value per key."""
        return latest_by_key(self.table_raw(METADATA_TABLE))

    def table_raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def table(self, name: str) -> DataFrame:
        return self.metadata() if name == METADATA_TABLE else self.table_raw(name)

    def sql(self, text: str) -> DataFrame:
        """Runs a query over the warehouse tables that exist, under their own names."""
        for name in (*RESULT_TABLES, FEATURE_TABLE, METADATA_TABLE):
            try:
                self.table(name).createOrReplaceTempView(name)
            except AnalysisException:
                self.spark.catalog.dropTempView(name)
        return self.spark.sql(text)

    def write_arrays(self, name: str, sample: TwoSample) -> None:
        """Saves both matrices as one table of feature arrays plus a table of names."""
        rows = sample.frame.select(quoted(sample.key).alias("key"), F.col(sample.label).alias("label"), sample.vector().alias("features"))
        rows.write.mode("overwrite").parquet(self.path(name))
        names = self.spark.createDataFrame(list(enumerate(sample.features)), "id_variable int, name_variable string")
        names.coalesce(1).write.mode("overwrite").parquet(self.path(f"{name}_names"))

    def read_arrays(self, name: str) -> TwoSample:
        """Loads what :meth:`write_arrays` saved."""
        names = [r["name_variable"] for r in self.table_raw(f"{name}_names").orderBy("id_variable").collect()]
        columns = [F.col("features")[i].alias(n) for i, n in enumerate(names)]
        return TwoSample(self.table_raw(name).select("key", "label", *columns), tuple(names), key="key")


def latest_by_key(log: DataFrame) -> DataFrame:
    """The value with the highest ``seq`` per key, of equal ones that of the last ``writer`` where the log names them."""
    order = F.struct("seq", "writer") if "writer" in log.columns else F.col("seq")
    return log.groupBy("key").agg(F.max_by("value", order).alias("value"))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Key/value rows of ``old`` with those of ``new`` inserted or replaced."""
    both = old.select("key", "value", F.lit(0).alias("seq")).unionByName(new.select("key", "value", F.lit(1).alias("seq")))
    return latest_by_key(both)


def supplement(features: DataFrame, raw: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Adds raw columns the feature table lacks, joined on the carried key."""
    extra = [c for c in columns if c in raw.columns and c not in features.columns]
    if not extra:
        return features
    return features.join(raw.select(quoted(key), *map(quoted, extra)), key, "left")


def cluster_export(clusters: DataFrame) -> DataFrame:
    """Clusters in file order: by number, best related first, unscored last."""
    return clusters.select("id_variable", "name_variable", "id_cluster", "score_related").orderBy(
        "id_cluster", F.col("score_related").desc_nulls_last(), "id_variable"
    )


def exemplar_export(representatives: DataFrame) -> DataFrame:
    """Exemplars in file order with one column per feature of any subspace; cells outside a row's subspace are NULL."""
    values = F.from_json("features_json", "map<string,double>")
    keys = ["id_sample", "label_class", "is_prototype_for", "distance_score", "type_subspace"]
    rows = representatives.select(*keys, values.alias("features"))
    # the names are the features of at most a few exemplars per label
    names = sorted(r["name"] for r in rows.select(F.explode(F.map_keys("features")).alias("name")).distinct().collect())
    wide = rows.select(*keys, *[F.try_element_at("features", F.lit(n)).alias(n) for n in names])
    return wide.orderBy("type_subspace", "label_class", F.col("distance_score").desc(), "id_sample")


def workbook_sheets(warehouse: Warehouse) -> dict[str, DataFrame]:
    """The four sheets of the result workbook."""
    t = warehouse.table
    return {
        "Anchor Variables": t("analysis_variable_selection").orderBy(F.col("weight").desc(), "id_variable"),
        "Cluster Themes": cluster_export(t("analysis_variable_clustering")),
        "Pairwise Correlations": t("analysis_variable_correlation").orderBy(
            F.col("correlation_score").desc(), "id_variable_1", "id_variable_2"
        ),
        "Representative Exemplars": t("analysis_representative_samples").orderBy(
            "type_subspace", F.col("distance_score").desc(), "id_sample"
        ),
    }


def write_csv(rows: DataFrame, path: str) -> None:
    """Small ordered result as one CSV file with a header."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)

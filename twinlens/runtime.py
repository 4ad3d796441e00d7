"""Durable intermediate results and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="twinlens-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    """Session settings for the queries that run inside."""
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def wide_columns(spark: SparkSession):
    """Queries over many columns run in compiled code: the JVM interprets a generated method of more than 8,000 bytes row by
    row, so Spark is told to fall back on its smaller methods beyond that."""
    return _settings(spark, {METHOD_LIMIT: "8000"})


def durable(df: DataFrame, name: str = "stage") -> DataFrame:
    """Computes ``df`` once and keeps it as a parquet table on shared storage.

    The lineage ends there, so a lost executor costs no recomputation, and later passes read only the columns they need.
    The shuffle files behind the table are of no more use and go at once.
    """
    path = fresh_folder(df.sparkSession, name)
    with _settings(df.sparkSession, {SHUFFLE_CLEANUP: "true"}), wide_columns(df.sparkSession):
        df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Deletes tables that :func:`durable` returned and that nothing reads any more.

    What was made from them must be stored itself by then: a plan that still reads them fails.
    """
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out evenly where a table has fewer splits than the cluster has cores.

    A table of many splits, as any large one is, comes back as it is and is not shuffled.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Marks a materialised table for broadcast when it has at most ``max_rows`` rows.

    A larger table is returned as it is and joins by shuffle, where adaptive execution splits hot keys.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


SIEVE_BITS = 26


def sifted(rows: DataFrame, row_hash: Column, keys: DataFrame, key_hash: Column) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts: those that may have a key among ``keys``, as told by hashes, and the others, which surely have none.

    An exact join needs the first part only; the others stay where they are. The hashes of the keys become 2^26 bits, broadcast
    as at most 2^20 words of 64. More keys than those can tell apart put more rows into the first part, with the same rows in all.
    """
    place = key_hash.bitwiseAND((1 << SIEVE_BITS) - 1).alias("place")
    words = keys.select(place).selectExpr("shiftright(place, 6) AS word", "shiftleft(1L, CAST(place & 63 AS INT)) AS bit")
    words = F.broadcast(words.groupBy("word").agg(F.bit_or("bit").alias("bits")))
    place = row_hash.bitwiseAND((1 << SIEVE_BITS) - 1)
    among = (F.shiftright(place, 6) == words["word"]) & (F.getbit(words["bits"], place.bitwiseAND(63)) == 1)
    return rows.join(words, among, "left_semi"), rows.join(words, among, "left_anti")

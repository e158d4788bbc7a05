"""The session's settings that the dialect's semantics rest on, and access to Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ANSI errors on overflow and division by zero, UTC, and GROUP BY 1 as a constant.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.groupByOrdinal": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with the dialect's settings; others by keyword with _ for a dot."""
    builder = SparkSession.builder.master(master) if master else SparkSession.builder
    for key, value in (SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder; filters and column choices reach its scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def point_get(df: DataFrame, key: str, value: object) -> DataFrame:
    """The rows of a key: an equality that Parquet's statistics prune by."""
    return df.where(df[key] == value)


def system_tables(spark: SparkSession, names: list[str], folder: str) -> DataFrame:
    """(table_name, column_name, position, data_type, nullable) of the folder's tables, from their schemas alone."""
    rows = [(n, f.name, i, f.dataType.simpleString(), f.nullable) for n in names for i, f in enumerate(table(spark, folder, n).schema)]
    return spark.createDataFrame(rows, "table_name string, column_name string, position int, data_type string, nullable boolean")

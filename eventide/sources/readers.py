"""Readers: typed scans, newest snapshot, source cascade, JSON documents."""

from __future__ import annotations

from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.schemas import conform

CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "encoding": "UTF-8", "mode": "PERMISSIVE"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True, multi_line: bool = True) -> DataFrame:
    """CSV with a declared schema; the header only names columns, it is not trusted.

    Columns are taken by header name, so files with more columns or another
    order fit; declared columns the file lacks come out null. A byte order mark
    before the first name is dropped. Large flat tick files should pass
    ``multi_line=False`` so that they split.
    """
    options = {**CSV_OPTIONS, "header": header, "multiLine": multi_line}
    if not header:
        return spark.read.options(**options).schema(schema).csv(path)
    raw = spark.read.options(**options).csv(path)
    clean = [c.lstrip("﻿").strip() for c in raw.columns]
    return conform(raw.toDF(*clean), schema)


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON file holding one array or one object, to rows."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def read_string_map(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """A flat JSON object to (key, value) rows; null values stay null."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string, string>")).alias(key, value))


def read_string_list(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A JSON array of strings to one row per position."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", name))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Stored trajectories, an object of sector -> list, to one row per sector and date."""
    record = "struct<date: string, predicted_trajectory: array<double>, horizons: array<int>>"
    text = spark.read.text(path, wholetext=True)
    by_sector = F.explode(F.from_json("value", f"map<string, array<{record}>>")).alias("sector", "records")
    return text.select(by_sector).select("sector", F.explode("records").alias("r")).select("sector", "r.*")


def prediction_at(predictions: DataFrame, h: int) -> DataFrame:
    """Forecast of one horizon, found by its place in the horizon array."""
    place = F.array_position("horizons", h)
    value = F.when(place > 0, F.try_element_at(F.col("predicted_trajectory"), place.cast("int")))
    return predictions.select("sector", "date", value.alias("pred"))


def read_horizon_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Stored horizon metrics, an object of horizon -> errors, to rows; other entries are skipped."""
    text = spark.read.text(path, wholetext=True)
    entries = F.explode(F.from_json("value", "map<string, string>")).alias("horizon", "body")
    errors = F.from_json("body", "rmse double, mae double")
    return text.select(entries).where(F.col("body").startswith("{")).select("horizon", errors.alias("e")).select("horizon", "e.*")


def _listing(spark: SparkSession, path: str) -> DataFrame | None:
    """Paths of the files under a path or pattern, without their content; None if there are none."""
    try:
        return spark.read.format("binaryFile").load(path).select("path")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or table folder exists."""
    return _listing(spark, path) is not None


def latest_snapshot(spark: SparkSession, folder: str, prefix: str, suffix: str, fallback: str | None = None) -> str:
    """Path of the file or table folder whose name sorts last among those with the prefix.

    Dated names sort by date. Only the listing is read, never the content, and
    one name comes back to the driver.
    """
    folder = folder.rstrip("/")
    listing = _listing(spark, f"{folder}/{prefix}*{suffix}")
    if listing is None:
        if fallback is None:
            raise FileNotFoundError(f"no {prefix}*{suffix} in {folder}")
        return fallback
    name = F.regexp_extract("path", rf"/(\Q{prefix}\E[^/]*\Q{suffix}\E)(/[^/]*)*$", 1)
    newest = listing.agg(F.max(name).alias("name")).first()["name"]
    return f"{folder}/{newest}"


def source_cascade(
    spark: SparkSession,
    folder: str,
    candidates: list[tuple[str, str, Any]],
    schema: T.StructType,
    defaults: dict[str, Any] | None = None,
) -> DataFrame:
    """The first candidate that exists, projected onto one schema, with its lineage tag.

    A candidate is (file name, source tag, reader); the reader turns a path
    into rows. Columns a poorer source lacks take their default. With no
    candidate the result is empty but typed.
    """
    for name, tag, reader in candidates:
        path = f"{folder.rstrip('/')}/{name}"
        if path_exists(spark, path):
            rows = conform(reader(path), schema, defaults)
            return rows.withColumn("source", F.lit(tag))
    return conform(spark.createDataFrame([], schema), schema).withColumn("source", F.lit("none"))

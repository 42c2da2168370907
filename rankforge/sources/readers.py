"""Scans. Schemas are declared by the caller; nothing is inferred unless asked for."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_dir
from .json_parts import json_array_elements

# Format by file suffix (fixed values).
FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "jsonl", ".parquet": "parquet", ".orc": "orc"}


def load_csv(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    reader = spark.read.options(header=True, **options)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


def load_json_array(spark: SparkSession, path: str, schema: str | None = None, in_parts: bool = False, **options) -> DataFrame:
    """A file that holds one JSON array. One such file is one task, but with `in_parts` it is read by many
    (`json_parts`); without a schema the parts are written once to the shared folder and looked through there."""
    if in_parts and schema:
        return json_array_elements(spark, path).select(F.from_json("value", schema, options).alias("row")).select("row.*")
    if in_parts:
        folder = f"{shared_dir(spark).rstrip('/')}/json-{uuid.uuid4().hex}"
        json_array_elements(spark, path).write.text(folder)
        return spark.read.options(**options).json(folder)
    reader = spark.read.options(multiLine=True, **options)
    return (reader.schema(schema) if schema else reader).json(path)


def load_parquet(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.options(**options).parquet(path)


def load_table(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """Read by suffix. Unknown suffix: ValueError. Missing path: FileNotFoundError."""
    suffix = "." + path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()
    if suffix not in FORMATS:
        raise ValueError(f"unsupported file type: {path}")
    try:
        kind = FORMATS[suffix]
        if kind == "csv":
            return load_csv(spark, path, schema, **options)
        if kind == "json":
            return load_json_array(spark, path, schema, **options)
        reader = spark.read.options(**options)
        reader = reader.schema(schema) if schema else reader
        return reader.json(path) if kind == "jsonl" else reader.format(kind).load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from error
        raise


def load_many(spark: SparkSession, directory: str, files: dict[str, str]) -> dict[str, DataFrame]:
    return {name: load_table(spark, f"{directory.rstrip('/')}/{file}") for name, file in files.items()}

"""The table of queries, and the shape results are compared in."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

REGISTRY: dict[str, "Query"] = {}

RATINGS = """ratings AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id,
         CAST(1 + floor((l_quantity - 1) / 10) AS DOUBLE) AS rating, o_orderdate AS ts, l_orderkey, l_linenumber
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
RATINGS_AGG = RATINGS + """,
ra AS (SELECT user_id, item_id, avg(rating) AS rating, max(ts) AS ts FROM ratings GROUP BY 1, 2)"""


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def steady(expression: str, digits: int) -> str:
    """SQL for `functions.numeric.steady_round`."""
    return f"CAST(ROUND(CAST({expression} AS DECIMAL(28,9)), {digits}) AS DOUBLE)"


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Whole numbers as bigint, other numbers rounded doubles, times as text."""
    out = []
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(field.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, floats: tuple[str, ...] = (), ints: tuple[str, ...] = (),
          times: tuple[str, ...] = (), digits: int = 6):
    """Register a function `(spark, sf_dir) -> DataFrame`; the named SQL columns get the same shape."""
    def add(run: Callable[[SparkSession, str], DataFrame]):
        text = sql
        if text is not None:
            swaps = [f"ROUND(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in floats]
            swaps += [f"CAST({c} AS BIGINT) AS {c}" for c in ints]
            swaps += [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in times]
            text = f"SELECT * REPLACE ({', '.join(swaps)}) FROM ({text.strip()}) t" if swaps else text.strip()
        REGISTRY[name] = Query(lambda spark, sf_dir: plain(run(spark, sf_dir), digits), text)
        return run
    return add

"""Continuous registration of new items as they arrive in a folder.

Which keys are registered is kept in the stream's own keyed state, so a batch looks up its keys there and never reads the item table:
its work follows the batch, however many items there are. State, offsets and batch number are committed together, and a
batch that is run again gets the state of before, so it finds the same new rows, gives the same ids and overwrites its own output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.cleaning import drop_missing
from ..operators.ordering import dense_ids

_STORE = "spark.sql.streaming.stateStore.providerClass"
_KEYED_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstOfKey(StatefulProcessor):
    """Lets the first row of a key through, once in the life of the stream; of several in a batch the smallest one, nulls last."""

    def __init__(self, schema: T.StructType):
        self.names = schema.names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("seen", T.BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.seen.exists():
            for _ in rows:  # the batch is read to its end
                pass
            return
        first = min(([row[c] for c in self.names] for row in rows), key=lambda row: [(v is None, v) for v in row])
        self.seen.update((True,))
        yield Row(**dict(zip(self.names, first)))

    def close(self) -> None:
        pass


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def last_id(spark: SparkSession, ledger: str, batch_id: int) -> int:
    """Largest id given before a batch. One row per batch is written; the batch before is looked at first."""
    before = _read(spark, f"{ledger}/batch_id={batch_id - 1}") if batch_id else None
    if before is None:
        every = _read(spark, ledger)
        before = None if every is None else every.filter(F.col("batch_id") < batch_id)
    return 0 if before is None else before.agg(F.max("last")).first()[0] or 0


def register_stream(arrivals: DataFrame, table_path: str, checkpoint: str, keys: list[str],
                    clean: Callable[[DataFrame], DataFrame] | None = None,
                    features: Callable[[DataFrame], DataFrame] | None = None,
                    vectors_path: str | None = None) -> StreamingQuery:
    """Start a job that cleans each batch, numbers keys that were never seen and adds them to the item table.

    The table gets a partition per batch, and next to it (`<table>_ids`) a row per batch with the last id given. `features` maps
    the new items to rows of features with a model fitted before; they go to `vectors_path`, a partition per batch too. `clean` works row by
    row. `checkpoint` belongs to one table: it holds the keys that are in it.
    """
    spark = arrivals.sparkSession
    rows = drop_missing(clean(arrivals) if clean else arrivals, keys)
    fresh = rows.groupBy(*keys).transformWithState(
        statefulProcessor=FirstOfKey(rows.schema), outputStructType=rows.schema, outputMode="Append", timeMode="None")
    ledger = f"{table_path.rstrip('/')}_ids"

    def add(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        path = f"{table_path.rstrip('/')}/batch_id={batch_id}"
        batch.persist()  # the state is read once
        try:
            start = last_id(session, ledger, batch_id) + 1
            ids = dense_ids(batch, keys, "item_id", start)
            batch.join(ids, keys).select(*rows.columns, F.col("item_id").cast("bigint")).write.mode("overwrite").parquet(path)
        finally:
            batch.unpersist()
        stored = session.read.schema(T.StructType([*rows.schema, T.StructField("item_id", T.LongType())])).parquet(path)
        if features is not None and vectors_path is not None:
            features(stored).write.mode("overwrite").parquet(f"{vectors_path.rstrip('/')}/batch_id={batch_id}")
        done = stored.agg(F.coalesce(F.max("item_id"), F.lit(start - 1)).alias("last"))
        done.write.mode("overwrite").parquet(f"{ledger}/batch_id={batch_id}")

    kept = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _KEYED_STORE)  # read when the query starts
    try:
        return (fresh.writeStream.foreachBatch(add).outputMode("append").option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())
    finally:
        spark.conf.set(_STORE, kept) if kept else spark.conf.unset(_STORE)

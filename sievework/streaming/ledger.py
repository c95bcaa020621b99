"""Operation ledgers: batch replay, budgets, early stop, and the same state kept by streaming queries."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sievework.operators.relops import running

STATES = "user_id bigint, events bigint, errors bigint, last_type string, last_ts timestamp"


def last_states(events: DataFrame, key: str, order: list[str], kind: str) -> DataFrame:
    """The state of each key after its last event, by aggregation: count, errors, last kind."""
    o = F.struct(*order)
    return events.groupBy(key).agg(F.count("*").alias("events"), F.count_if(F.col(kind) == "error").alias("errors"), F.max_by(kind, o).alias("last_type"), F.max(order[0]).alias("last_ts"))


def operation_states(events: DataFrame, key: str, order: list[str], kind: str, failure: str, done: str, most_retries: int = 1) -> DataFrame:
    """``key, attempts, failures, state`` after the last event: COMPLETED once an operation is done, else FAILED beyond the retries, PENDING_RETRY after a failure, ATTEMPT_RESERVED otherwise.

    One aggregation, whatever the length of a history: failures count up to the completion only.
    """
    o = F.struct(*order)
    first_done = events.where(F.col(kind) == done).groupBy(key).agg(F.min(o).alias("done_at"))
    e = events.join(first_done, key, "left").where(F.col("done_at").isNull() | (o <= F.col("done_at")))
    s = e.groupBy(key).agg(F.count("*").alias("attempts"), F.count_if(F.col(kind) == failure).alias("failures"), F.max_by(kind, o).alias("last"))
    state = F.when(F.col("last") == done, "COMPLETED").when(F.col("failures") > most_retries, "FAILED").when(F.col("last") == failure, "PENDING_RETRY").otherwise("ATTEMPT_RESERVED")
    return s.select(key, "attempts", "failures", state.alias("state"))


def over_budget(events: DataFrame, key: str, order: list[str], cost: str, ceiling: float) -> DataFrame:
    """The first event of each key at which its running cost exceeds the ceiling."""
    r = running(events.select(key, *order, cost), [key], [F.col(o) for o in order], [F.col(cost).alias("spent")]).where(F.col("spent") > ceiling)
    return r.groupBy(key).agg(F.min(order[0]).alias("at"), F.min_by(order[1], F.struct(*order)).alias("event"))


class LedgerProcessor(StatefulProcessor):
    """Keeps a key's counts and last event; one row for each key a batch touches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ledger", "events bigint, errors bigint, last_type string, last_ts timestamp, last_id bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, errors, kind, ts, last = self.state.get() if self.state.exists() else (0, 0, None, None, -1)
        for b in rows:
            n += len(b)
            errors += int((b.event_type == "error").sum())
            top = b.sort_values(["ts", "event_id"]).iloc[-1]
            if ts is None or (top.ts, top.event_id) > (pd.Timestamp(ts), last):
                kind, ts, last = top.event_type, top.ts.to_pydatetime(), int(top.event_id)
        self.state.update((n, errors, kind, ts, last))
        yield pd.DataFrame({"user_id": [key[0]], "events": [n], "errors": [errors], "last_type": [kind], "last_ts": [ts]})

    def close(self) -> None:
        pass


def live_states(stream: DataFrame) -> DataFrame:
    """The ledger over a stream of events; needs the RocksDB state store."""
    return stream.groupBy("user_id").transformWithStateInPandas(LedgerProcessor(), STATES, "Update", "none")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Within, streaming queries keep their state in RocksDB; the session's own setting comes back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def windowed_counts(stream: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts and sums of events by window and kind; events later than the watermark are dropped once a window is closed."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))


def drained(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Runs a streaming query over all that is there, into Parquet below ``path``."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-log").outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def drained_updates(stream: DataFrame, path: str) -> None:
    """As ``drained`` for update mode: each batch's updates go to the folder of its number, so that a batch that is tried again replaces what it wrote."""
    write = lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch={i}")
    stream.writeStream.foreachBatch(write).option("checkpointLocation", path + "-log").outputMode("update").trigger(availableNow=True).start().awaitTermination()

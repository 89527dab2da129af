"""Job life cycle kept as streaming state, one value per id."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "id string, status string, attempts bigint, events bigint, ignored bigint, last_event timestamp"
STATE = "status string, attempts bigint, events bigint, ignored bigint, last_event timestamp"

# Event kind: states in which it counts, and the state it leads to.
TRANSITIONS = {
    "queued": ({"", "done", "review", "failed", "removed"}, "pending"),
    "claimed": ({"pending"}, "processing"),
    "done": ({"processing"}, "done"),
    "review": ({"processing"}, "review"),
    "failed": ({"processing"}, "failed"),
    "deferred": ({"processing"}, "pending"),
    "removed": ({"pending", "processing", "done", "review", "failed"}, "removed"),
}


def step(status: str, attempts: int, kind: str) -> tuple[str, int, bool]:
    """Next status and attempts, and whether the event was valid in this status."""
    allowed, target = TRANSITIONS.get(kind, (set(), status))
    if status not in allowed:
        return status, attempts, False
    if kind == "queued":
        attempts = 0
    return target, attempts + (kind == "claimed"), True


class JobLifeCycle(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.job = handle.getValueState("job", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.job.exists():
            status, attempts, events, ignored, last = self.job.get()
        else:
            status, attempts, events, ignored, last = "", 0, 0, 0, None
        batch = pd.concat(list(rows)).sort_values(["ts", "kind"])
        for ts, kind in zip(batch["ts"], batch["kind"]):
            status, attempts, valid = step(status, attempts, kind)
            events, ignored, last = events + 1, ignored + (not valid), ts
        self.job.update((status, attempts, events, ignored, last))
        yield pd.DataFrame(
            {
                "id": [key[0]], "status": [status], "attempts": [attempts], "events": [events],
                "ignored": [ignored], "last_event": [last],
            }
        )

    def close(self) -> None:
        pass


def job_states(events: DataFrame) -> DataFrame:
    """Latest state per id out of a stream of ``id, ts, kind`` events, in update mode.

    Within a micro-batch an id's events are applied in time order, so they are held
    together. Bound a micro-batch at the source, with ``maxFilesPerTrigger`` or
    ``maxBytesPerTrigger``.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return (
        events.select("id", "ts", "kind")
        .groupBy("id")
        .transformWithStateInPandas(JobLifeCycle(), outputStructType=OUTPUT, outputMode="Update", timeMode="None")
    )


def run_available(states: DataFrame, table: str, checkpoint: str) -> None:
    """Process what has arrived and keep every emitted state in Parquet under ``table``.

    A batch writes its own folder, so a batch that is run again replaces its rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{table}/batch_id={number}")

    query = (
        states.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def latest_states(spark: SparkSession, table: str) -> DataFrame:
    """The newest state of every id."""
    rows = spark.read.parquet(table)
    fields = [c for c in rows.columns if c not in ("id", "batch", "batch_id")]
    return rows.groupBy("id").agg(F.max_by(F.struct(*fields), "batch").alias("s")).select("id", "s.*")

"""Keyed state machines on streams: a ledger of failures that resumes, and the acquisition of probes.

State lives in the RocksDB store, one small value for each key, and goes with the checkpoint: a query that is started again goes on
where it stopped. ``state_store`` sets the store for a session.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.operators.acquisition import ACCEPTED, PRICES, decide

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LEDGER = "model_id string, instance_id string, status string, attempts int, error string"
ACQUIRED = "model_id string, instance_id string, seq bigint, probe string, outcome string, budget_left bigint, acquired string"


def state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _ms(at: Any) -> int:
    return int(at.timestamp() * 1000)


class Ledger(StatefulProcessor):
    """One key's attempts. A failure adds one and keeps its error; a success clears it and is remembered for ``remember_ms``.

    While it is remembered, further events of the key are of work that is done, and are passed over. A failure without any event for
    ``patience_ms`` is given up: it is reported as expired and cleared. Both times are of events, so a run over the same
    files gives the same changes; one timer a key stands for either, and state whose timer has passed is gone.
    """

    def __init__(self, patience_ms: int, remember_ms: int):
        self.patience_ms, self.remember_ms = patience_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "done boolean, attempts int, error string, due bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        done, attempts, error, due = self.state.get() if self.state.exists() else (False, 0, None, None)
        if done:
            return
        for row in sorted(rows, key=lambda r: (r.at, r.failed, r.error or "")):  # of one batch, which the source bounds
            if row.failed:
                attempts, error, wait = attempts + 1, row.error, self.patience_ms
            else:
                done, wait = True, self.remember_ms
            last = _ms(row.at)
            if done:
                break
        if due is not None:
            self.handle.deleteTimer(due)
        due = max(last + wait, timerValues.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(due)
        self.state.update((done, attempts, error, due))
        if not done:
            yield Row(model_id=key[0], instance_id=key[1], status="open", attempts=attempts, error=error)
        elif attempts:
            yield Row(model_id=key[0], instance_id=key[1], status="resolved", attempts=attempts, error=None)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        done, attempts, error, due = self.state.get() if self.state.exists() else (True, 0, None, None)
        if due != expiredTimerInfo.getExpiryTimeInMs():
            return
        self.state.clear()
        if not done:
            yield Row(model_id=key[0], instance_id=key[1], status="expired", attempts=attempts, error=error)

    def close(self) -> None:
        pass


def failure_ledger(events: DataFrame, patience_ms: int = 7 * 86_400_000, remember_ms: int = 30 * 86_400_000, late: str = "1 hour") -> DataFrame:
    """A stream of (model_id, instance_id, at, failed, error) as a stream of changes of the ledger: open, resolved or expired, with attempts and error.

    Events later than the watermark are dropped, as everywhere in streams.
    """
    own = events.withWatermark("at", late).groupBy("model_id", "instance_id")
    return own.transformWithState(Ledger(patience_ms, remember_ms), LEDGER, "Update", "EventTime")


class Acquisition(StatefulProcessor):
    """One record's acquired probes and the budget that is left."""

    def __init__(self, budget: int, prices: dict[str, int]):
        self.budget, self.prices = budget, prices

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "left bigint, acquired string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        left, text = self.state.get() if self.state.exists() else (self.budget, "[]")
        acquired = dict.fromkeys(json.loads(text), 1)
        for row in sorted(rows, key=lambda r: r.seq):  # of one batch, which the source bounds
            outcome, left = decide(row.probe, acquired, left, self.prices)
            if outcome == ACCEPTED:
                acquired[row.probe] = 1
            yield Row(model_id=key[0], instance_id=key[1], seq=row.seq, probe=row.probe, outcome=outcome, budget_left=left, acquired=",".join(acquired))
        self.state.update((left, json.dumps(list(acquired))))

    def close(self) -> None:
        pass


def acquired_probes(events: DataFrame, budget: int, prices: dict[str, int] = PRICES) -> DataFrame:
    """A stream of (model_id, instance_id, seq, probe), in order from batch to batch, as a stream of outcomes."""
    return events.groupBy("model_id", "instance_id").transformWithState(Acquisition(budget, dict(prices)), ACQUIRED, "Append", "None")


def write_changes(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Takes all that is there and ends. Each batch has a folder of its own, written anew if the batch runs again, so no change is there twice."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()


def latest(changes: DataFrame, keys: tuple[str, ...] = ("model_id", "instance_id")) -> DataFrame:
    """Each key's last change, from the folder of ``write_changes``: the ledger as it stands has the open ones."""
    own = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*own), "batch").alias("c")).select(*keys, "c.*").drop("batch")

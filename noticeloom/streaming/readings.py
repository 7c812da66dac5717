"""States of document readings as a stream: what was read, what waits, and when a wait is over.

Each key (source, external_id) keeps its state in the stream's store. A deferred reading sets a timer on the readings' own time;
when the watermark passes it, the key is due again. documents.reading_states and due_readings do the same over tables.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

HOUR = 3_600_000_000
WAITS = {"quota": 24 * HOUR, "deferred": 3 * HOUR}  # microseconds
READINGS = "source string, external_id string, status string, stale boolean, at timestamp"
#: Times are microseconds inside, so that no worker's time zone matters.
INSIDE = "source string, external_id string, event string, at long, audited long, until long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Readings(StatefulProcessor):
    """For each reading the key's new state (event: read); when a wait ends, that the key is due."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "at long, audited long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        last = max(rows, key=lambda r: (r.us, r.status))
        before = self.state.get()
        if before is not None and before[0] > last.us:  # told late: what is known is newer
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        wait, audited = (None, None) if last.stale else (WAITS.get(last.status), last.us)
        self.state.update((last.us, audited))
        if wait:
            self.handle.registerTimer((last.us + wait) // 1000)
        yield Row(source=key[0], external_id=key[1], event="read", at=last.us, audited=audited, until=last.us + wait if wait else None)
        if last.stale:
            yield Row(source=key[0], external_id=key[1], event="due", at=last.us, audited=None, until=None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        _, audited = self.state.get()
        yield Row(source=key[0], external_id=key[1], event="due", at=expiredTimerInfo.getExpiryTimeInMs() * 1000, audited=audited, until=None)


def reading_events(readings: DataFrame, late: str = "0 seconds") -> DataFrame:
    """A stream of READINGS -> source, external_id, event, at, audited_on, deferred_until. late: by how much readings may come behind the
    newest one; a wait ends when the newest reading is so much past it. The session keeps state in RocksDB (PROVIDER)."""
    rows = readings.withWatermark("at", late).withColumn("us", F.unix_micros("at"))
    out = rows.groupBy("source", "external_id").transformWithState(Readings(), INSIDE, "Append", "EventTime")
    return out.select("source", "external_id", "event", F.timestamp_micros("at").alias("at"), F.timestamp_micros("audited").cast("date").alias("audited_on"), F.timestamp_micros("until").alias("deferred_until"))


def start(spark: SparkSession, folder: str, out: str, checkpoint: str, late: str = "0 seconds", once: bool = True, period: str = "10 minutes") -> StreamingQuery:
    """reading_events of the JSON readings that land in a folder, to Parquet files."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    stream = reading_events(spark.readStream.schema(READINGS).option("maxFilesPerTrigger", 1000).json(folder), late).writeStream
    stream = stream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime=period)).start()

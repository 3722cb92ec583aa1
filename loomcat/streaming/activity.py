"""The activity operators as streams: files in, tables in the shared folder out."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.storage import fresh
from ..operators.activity import LIMITS, admit, visit_days
from .upserts import DayTable


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def visit_stream(visits: DataFrame, keep: int = 1) -> DataFrame:
    """Daily upserts of a stream of visits: each micro-batch is merged into the days it touches, under
    its batch number, so a batch that runs twice counts once."""
    spark, out = visits.sparkSession, fresh(visits.sparkSession, "visit-days")
    days = DayTable(spark, out)

    def upsert(batch: DataFrame, number: int) -> None:
        if days.upsert(visit_days(batch), number):
            days.compact(keep)

    visits.writeStream.foreachBatch(upsert).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return days.read()


class Limiter(StatefulProcessor):
    """Keeps a sender's accepted times. A timer drops them once the watermark has passed the longest
    window after the last one."""

    def __init__(self, limits: tuple[tuple[int, int], ...]):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.past = handle, handle.getListState("past", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        # frame by frame: of one second only the least ids can be accepted, the others are refused at once
        most, kept = min(n for _, n in self.limits), None
        for frame in rows:
            new = frame[["at", "id"]] if kept is None else pd.concat([kept, frame[["at", "id"]]])
            new = new.sort_values(["at", "id"])
            out = new.groupby("at").cumcount() >= most
            if out.any():
                yield self._said(key, new[out], False)
            kept = new[~out]
        if kept is None or not len(kept):
            return
        ok, past = admit(kept["at"].tolist(), self.limits, deque(x[0] for x in self.past.get()))
        self.past.put([(x,) for x in past])
        self.handle.registerTimer(1000 * (past[-1] + max(w for w, _ in self.limits)))
        yield self._said(key, kept, ok)

    @staticmethod
    def _said(key: tuple, rows: pd.DataFrame, ok) -> pd.DataFrame:
        return pd.DataFrame({"sender": key[0], "at": rows["at"], "id": rows["id"]}).assign(ok=ok)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times = [x[0] for x in self.past.get()]
        longest = max(w for w, _ in self.limits)
        if times and 1000 * (max(times) + longest) <= expiredTimerInfo.getExpiryTimeInMs():
            self.past.clear()
        return iter(())

    def close(self) -> None:
        pass


def limiter_stream(attempts: DataFrame, limits: tuple[tuple[int, int], ...] = LIMITS, late: str = "1 hour") -> DataFrame:
    """attempts (sender, at, id) with ok; those more than `late` behind the latest are not decided
    (decided_and_late says how many)."""
    return decided_and_late(attempts, limits, late)[0]


def decided_and_late(attempts: DataFrame, limits: tuple[tuple[int, int], ...] = LIMITS, late: str = "1 hour") -> tuple[DataFrame, int]:
    """As limiter_stream, and how many attempts came behind the watermark. The state store's setting
    is as before when the stream has ended."""
    spark, out = attempts.sparkSession, fresh(attempts.sparkSession, "limiter")
    kind = dict(attempts.dtypes)["sender"]
    schema = f"sender {kind}, at long, id long, ok boolean"
    timed = attempts.select("sender", "at", "id", F.timestamp_seconds("at").alias("ts")).withWatermark("ts", late)
    done = timed.groupBy("sender").transformWithStateInPandas(Limiter(limits), schema, "append", "eventTime")
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    dropped = 0
    try:
        run = done.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
        dropped = sum(x.numRowsDroppedByWatermark for p in run.recentProgress for x in p.stateOperators)
    finally:
        spark.conf.set(STATE_STORE, before)
    return spark.read.schema(schema).parquet(out), dropped


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over the Parquet files of a table, which may be one file: as a pattern, for a stream
    takes a plain path for a folder."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def event_attempts(events: DataFrame, kind: str) -> DataFrame:
    return events.where(F.col("event_type") == kind).select(F.col("user_id").alias("sender"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"))

"""Extension: places and their movement as a stream goes, by a stateful operator with timers.

Counts of each day close once the watermark has passed it; a board (one leaderboard, such as a format) then keeps the open
days' counts and the places of the last closed day as its state, and a timer at a day's end ranks the day, tells each
entry's place and the places that it gained, and forgets the day.  Events later than the watermark allows are left out, as
they are of the batch query over the same watermark.  State is in RocksDB beside the query's progress, so a restart goes on
where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000
PLACES = "board string, day timestamp, entry string, events long, place long, moved long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Board(StatefulProcessor):
    """Of one board: ``open`` has the events of (day, entry) that no timer has closed yet, ``last`` the places of the day that
    was closed last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "day long, entry string", "events long")
        self.last = handle.getMapState("last", "entry string", "place long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        days = set()
        for frame in rows:
            for day, entry, events in zip(frame["day_ms"].tolist(), frame["entry"].tolist(), frame["events"].tolist(), strict=True):
                self.open.updateValue((day, entry), (events,))
                days.add(day)
        for day in days:
            self.handle.registerTimer(day + DAY_MS)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        day = expiredTimerInfo.getExpiryTimeInMs() - DAY_MS
        counts = {k[1]: v[0] for k, v in self.open.iterator() if k[0] == day}
        before = {k[0]: v[0] for k, v in self.last.iterator()}
        if not counts:
            return iter(())
        place = {e: 1 + sum(n > own for n in counts.values()) for e, own in counts.items()}
        for e in before:
            self.last.removeKey((e,))
        for e, n in counts.items():
            self.open.removeKey((day, e))
            self.last.updateValue((e,), (place[e],))
        rows = [(key[0], pd.Timestamp(day, unit="ms"), e, n, place[e], before[e] - place[e] if e in before else None) for e, n in sorted(counts.items())]
        out = pd.DataFrame(rows, columns=["board", "day", "entry", "events", "place", "moved"])
        return iter([out.astype({"moved": "Int64"})])

    def close(self) -> None:
        pass


def batch(events: DataFrame, board: str, entry: str, ts: str = "ts") -> DataFrame:
    """The same of a table: every day is closed, and a day's places move against the last day before that has events."""
    counts = events.groupBy(F.col(board).alias("board"), F.date_trunc("day", ts).alias("day"), F.col(entry).alias("entry")).agg(F.count("*").alias("events"))
    placed = counts.withColumn("place", F.rank().over(Window.partitionBy("board", "day").orderBy(F.desc("events"))).cast("long"))
    days = counts.select("board", "day").distinct().withColumn("before", F.lag("day").over(Window.partitionBy("board").orderBy("day")))
    old = placed.select("board", F.col("day").alias("before"), "entry", F.col("place").alias("old"))
    return placed.join(days, ["board", "day"]).join(old, ["board", "before", "entry"], "left").select("board", "day", "entry", "events", "place", (F.col("old") - F.col("place")).alias("moved"))


def places(stream: DataFrame, board: str, entry: str, ts: str = "ts", late: str = "2 days") -> DataFrame:
    """The stream of closed days' places."""
    counts = stream.select(F.col(board).alias("board"), F.col(entry).alias("entry"), F.col(ts).alias("ts")).withWatermark("ts", late).groupBy("board", "entry", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("events"))
    closed = counts.select("board", "entry", "events", F.unix_millis("w.start").alias("day_ms"), F.window_time("w").alias("at"))
    return closed.groupBy("board").transformWithStateInPandas(Board(), PLACES, "append", "eventTime")


def run(spark: SparkSession, source: DataFrame, folder: str, **names: str) -> DataFrame:
    """Runs the stream over all that the source has, going on from the progress in ``folder``, and gives all places so far."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, PROVIDER)
    try:
        query = places(source, **names).writeStream.outputMode("append").format("parquet").option("path", f"{folder}/places").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(PLACES).parquet(f"{folder}/places")

"""Event-time forms of the activity operators, for Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MINUTES = 30
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Users that follow each other by number, whose last views are one value of state.
SPAN = 64
#: The span of rows without a user, which are as one user's; no user's number gives it.
NOBODY = -(1 << 62)


class LastViews(StatefulProcessor):
    """The last views of a span of users, each kept until the watermark has passed it by the limit. Holds what one batch has of a span."""

    def __init__(self, minutes: int) -> None:
        self.limit = minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "user array<long>, at array<long>, item array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a batch's rows come in several frames, in no order; rows without a time follow and precede nothing
        new = pd.concat([x[["user", "at", "tie", "item"]] for x in rows], ignore_index=True).dropna(subset=["at"]).astype({"at": "int64"})
        before = pd.DataFrame(dict(zip(("user", "at", "item"), self.last.get() if self.last.exists() else ([], [], [])))).astype({"user": "int64", "at": "int64", "item": "object"})
        new = new[~(new["at"] < new["user"].map(before.set_index("user")["at"]))]
        own = pd.concat([before.assign(new=False), new.assign(new=True)], ignore_index=True).sort_values(["user", "at", "new", "tie", "item"], ignore_index=True)
        item, since = own["item"].shift(), own["at"].shift()
        near = (own["user"] == own["user"].shift()) & (own["at"] - since <= self.limit) & own["item"].notna() & item.notna() & (own["item"] != item)
        now = timerValues.getCurrentWatermarkInMs()
        last = own.drop_duplicates("user", keep="last")
        last = last[last["at"] + self.limit >= now * 1000]
        self.last.update((last["user"].tolist(), last["at"].tolist(), [x if isinstance(x, str) else None for x in last["item"]]))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max([now, *((last["at"] + self.limit) // 1000).tolist()]) + 1)
        yield pd.DataFrame({"user": None if key[0] == NOBODY else own["user"], "item": item, "related": own["item"], "at": own["at"]})[near]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame([], columns=["user", "item", "related", "at"])

    def close(self) -> None:
        pass


def consecutive_pairs(views: DataFrame, *, minutes: int = MINUTES) -> DataFrame:
    """user, item, related and ts of each step of a user within minutes. views: user (a whole number), ts (timestamp), item and, where times may be equal, tie (a whole number; otherwise items tell their order).

    State for each span of users is their last views, which a timer clears; events that are older than their user's are ignored. Runs under rocks_db().
    """
    tie = F.col("tie") if "tie" in views.columns else F.lit(0)
    rows = views.withWatermark("ts", f"{minutes} minutes").select(F.col("user").cast("long").alias("_user"), "ts", F.unix_micros("ts").alias("at"), tie.cast("long").alias("tie"), "item")
    span = F.coalesce(F.shiftright("_user", SPAN.bit_length() - 1), F.lit(NOBODY))
    rows = rows.select(span.alias("span"), F.coalesce("_user", F.lit(0).cast("long")).alias("user"), "ts", "at", F.coalesce("tie", F.lit(0)).alias("tie"), "item").groupBy("span")
    found = rows.transformWithStateInPandas(statefulProcessor=LastViews(minutes), outputStructType="user long, item string, related string, at long", outputMode="append", timeMode="EventTime")
    return found.select("user", "item", "related", F.timestamp_micros("at").alias("ts"))


@contextmanager
def rocks_db(spark: SparkSession) -> Iterator[None]:
    """State of queries that are started within is kept in RocksDB, which processors with state of their own need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS_DB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def sessions(views: DataFrame, *, minutes: int = MINUTES) -> DataFrame:
    """Runs of a user's events with gaps of less than minutes."""
    out = views.withWatermark("ts", f"{minutes} minutes").groupBy("user", F.session_window("ts", f"{minutes} minutes").alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return out.select("user", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events by type in tumbling, or with slide in sliding, windows."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"))
    return out.select(F.col("w.start").alias("start"), "event_type", "events")


def first_deliveries(records: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each record once, however often it is delivered within late."""
    return records.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)

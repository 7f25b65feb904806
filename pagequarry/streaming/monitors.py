"""Streams: sessions, spend per day, deduplicated links, rolling trends, and a drift monitor with state.

Each takes a streaming (or batch) DataFrame and returns one; the caller starts the
query and names sink, trigger and checkpoint.
"""

from __future__ import annotations

import calendar
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagequarry.operators.paged import DAILY_QUOTA


def activity_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", time: str = "ts", user: str = "user_id") -> DataFrame:
    """(user, start, end, events) of sessions that end after a gap; events later than the watermark are dropped."""
    w = F.session_window(time, gap)
    return events.withWatermark(time, late).groupBy(F.col(user), w.alias("w")).agg(F.count("*").alias("events")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def spend_per_day(ledger: DataFrame, late: str = "1 hour", time: str = "ts", endpoint: str = "event_type", cost: str = "value") -> DataFrame:
    """(day, endpoint, calls, cost) in tumbling windows of a day."""
    w = F.window(time, "1 day")
    out = ledger.withWatermark(time, late).groupBy(w.alias("w"), F.col(endpoint).alias("endpoint")).agg(F.count("*").alias("calls"), F.round(F.sum(cost), 4).alias("cost"))
    return out.select(F.to_date("w.start").alias("day"), "endpoint", "calls", "cost")


def rolling_mean(points: DataFrame, window: str = "28 days", slide: str = "7 days", late: str = "7 days", time: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """(start, end, key, mean) in sliding windows."""
    w = F.window(time, window, slide)
    out = points.withWatermark(time, late).groupBy(w.alias("w"), key).agg(F.round(F.avg(value), 4).alias("mean"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "mean")


def first_links(links: DataFrame, keys: list[str], late: str = "1 day", time: str = "ts") -> DataFrame:
    """Link rows without repetitions within the watermark."""
    return links.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


CHANGES = "url_hash string, version long, changed string, old_value string, new_value string, ignored long"
STATE = "version long, title string, html_hash string, ignored long"


def drift_monitor(snapshots: DataFrame, time: str | None = None, forget_after_ms: int = 90 * 86_400_000, late: str = "1 day") -> DataFrame:
    """Changes of pages as their snapshots arrive; snapshots: url_hash, version, title, html_hash.

    The state is a page's last snapshot. A snapshot that is older than it is counted
    and ignored; a page's first one makes no row. With a ``time`` column a page without a snapshot for ``forget_after_ms`` of
    that time is forgotten, so that the state holds the pages in use only; its next snapshot counts as a first one.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        out = []
        rows = pd.concat(list(batches))
        for row in rows.sort_values("version").itertuples(index=False):
            if last is not None and row.version <= last[0]:
                last = (*last[:3], last[3] + 1)
                continue
            for name, old, new in (("title", last[1], row.title), ("content", last[2], row.html_hash)) if last is not None else ():
                if old != new:
                    out.append((key[0], int(row.version), name, old, new, last[3]))
            last = (int(row.version), row.title, row.html_hash, last[3] if last is not None else 0)
        state.update(last)
        if time is not None:
            newest = int(rows[time].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + forget_after_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])

    rows = snapshots if time is None else snapshots.withWatermark(time, late)
    timeout = GroupStateTimeout.NoTimeout if time is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("url_hash").applyInPandasWithState(follow, CHANGES, STATE, "append", timeout)


VERDICTS = "site string, day date, position long, url string, verdict string"


class _Quota(StatefulProcessor):
    """A day of a site: requests sent so far, and whether an answer of 429 ended the day."""

    def __init__(self, quota: int):
        self.quota = quota

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("day", "sent long, stopped boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = not self.state.exists()
        sent, stopped = (0, False) if fresh else self.state.get()
        out = []
        for row in pd.concat(list(rows)).sort_values(["position", "url"]).itertuples(index=False):
            verdict = "stopped" if stopped else "over-quota" if sent >= self.quota else "sent"
            if verdict == "sent":
                sent += 1
                stopped = "429" in (row.error or "")
            out.append((key[0], key[1], int(row.position), row.url, verdict))
        self.state.update((sent, stopped))
        if fresh:
            # The day's state goes when the watermark has passed the day's end.
            self.handle.registerTimer((calendar.timegm(key[1].timetuple()) + 86_400) * 1000)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in VERDICTS.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def quota_gate(requests: DataFrame, quota: int = DAILY_QUOTA, late: str = "1 hour", time: str = "ts") -> DataFrame:
    """A verdict on each request of a stream: sent, over-quota, or stopped after an answer of 429 on that day; requests: site, ts, position, url, error.

    State is two numbers a site and day, with a timer that clears it once the watermark has passed the day. Needs the RocksDB state store.
    """
    rows = requests.withWatermark(time, late).withColumn("day", F.to_date(time)).groupBy("site", "day")
    return rows.transformWithStateInPandas(statefulProcessor=_Quota(quota), outputStructType=VERDICTS, outputMode="Append", timeMode="EventTime")

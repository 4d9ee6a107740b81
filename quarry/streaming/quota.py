"""Request quotas in fixed windows, as a batch and as a stream, and progress events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def admitted(requests: DataFrame, seconds: int = 600, per_user: int = 5, overall: int = 60) -> DataFrame:
    """event_id, window_id, user_ok, allowed; requests: event_id, user_id, ts.

    A user's requests beyond the user quota don't use up the overall one; those
    beyond the overall quota have used the user's.  The second step ranks a
    window's requests as far as `overall` only, so each task sends that many
    rows of a window at most; the others are not allowed.
    """
    window = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / seconds).cast("long")
    own = Window.partitionBy("user_id", "window_id").orderBy("ts", "event_id")
    ranked = requests.select("event_id", "user_id", "ts", window.alias("window_id")).withColumn("own_rank", F.row_number().over(own))
    within = ranked.where(F.col("own_rank") <= per_user)
    every = Window.partitionBy("window_id").orderBy("ts", "event_id")
    first = within.withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= overall).select("event_id", "window_id", F.lit(True).alias("allowed"))
    told = ranked.select("event_id", "window_id", (F.col("own_rank") <= per_user).alias("user_ok"))
    return told.join(first, ["event_id", "window_id"], "left").select("event_id", "window_id", "user_ok", F.coalesce("allowed", F.lit(False)).alias("allowed"))


def retry_after(ts, seconds: int = 600):
    """Whole seconds until the window of a request ends, at least 1."""
    at = F.unix_millis(F.col(ts).cast("timestamp"))
    return F.greatest(F.lit(1), F.ceil(((F.floor(at / (1000 * seconds)) + 1) * 1000 * seconds - at) / 1000)).cast("long")


def counts_per_window(requests: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """A stream's requests per user and window, with a watermark for late ones."""
    return requests.withWatermark("ts", late).groupBy(F.window("ts", window), "user_id").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "user_id", "n")


def admit_stream(requests: DataFrame, seconds: int = 600, per_user: int = 5, late: str = "1 hour") -> DataFrame:
    """event_id, user_id, allowed for a stream: one counter for each user, kept as state, forgotten when the watermark has passed its window."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        number, count = state.get if state.exists else (-1, 0)
        for frame in frames:
            frame = frame.sort_values(["ts", "event_id"])
            allowed = []
            for at in frame["ts"].astype("int64") // 10**9 // seconds if frame["ts"].dtype == "datetime64[ns]" else (frame["ts"] - pd.Timestamp(0)).dt.total_seconds() // seconds:
                number, count = (int(at), 0) if at > number else (number, count)
                count += 1
                allowed.append(count <= per_user)
            yield pd.DataFrame({"event_id": frame["event_id"], "user_id": key[0], "allowed": allowed})
        state.update((number, count))
        state.setTimeoutTimestamp(max((number + 1) * seconds * 1000, state.getCurrentWatermarkMs() + 1))

    return requests.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(step, "event_id long, user_id long, allowed boolean", "number long, count long", "append", "EventTimeTimeout")


def progress(events: DataFrame) -> DataFrame:
    """id, agent, state, found: the newest state of each agent, from messages such as `agent:seo started` and `agent:seo done (3)`."""
    agent = F.regexp_extract("msg", r"^agent:([a-z0-9-]+)", 1)
    state = F.when(F.col("msg").rlike(r"done \(0\)"), "clean").when(F.col("msg").rlike(r"done \(\d+\)"), "hit").otherwise("scan")
    found = F.coalesce(F.regexp_extract("msg", r"done \((\d+)\)", 1).try_cast("int"), F.lit(0))
    return events.where(agent != "").groupBy("id", agent.alias("agent")).agg(F.max(F.struct("at", state.alias("state"), found.alias("found"))).alias("x")).select("id", "agent", "x.state", "x.found")


def progress_totals(states: DataFrame, agents: int = 15) -> DataFrame:
    """id, done, found, percent of `progress`: how many of the agents have ended."""
    return states.groupBy("id").agg(F.count_if(F.col("state") != "scan").alias("done"), F.sum("found").cast("long").alias("found")).withColumn("percent", F.floor(100 * F.col("done") / agents + 0.5).cast("long"))


def until_end(events: DataFrame) -> DataFrame:
    """id, place, last, value: each audit's events in order, as lines of JSON, to its first `done` or `error`; events: id, seq, type, data."""
    order = Window.partitionBy("id").orderBy("seq")
    ends = F.col("type").isin("done", "error")
    ended = F.coalesce(F.max(ends).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    kept = events.withColumn("ended", ended).where(~F.col("ended"))
    return kept.select("id", F.row_number().over(order).alias("place"), ends.alias("last"), F.to_json(F.struct("type", "data")).alias("value"))


def of_audit(events: DataFrame, audit: str) -> DataFrame:
    """One audit's events, of a table or a stream."""
    return events.where(F.col("id") == audit)

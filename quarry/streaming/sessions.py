"""Stateful sessions: console lines in, events out, with device state and history kept between lines; waits with a deadline."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: A session keeps at most so many exchanges, of at most so many bytes together; a line has at most LINE_BYTES.
TURNS, BYTES, LINE_BYTES = 16, 96, 256
OUTPUT = "session long, seq long, event string, fan int, heat int, win int, kept int, bytes int"
SETTING = re.compile(r"^(fan=[0-3]|heat=[01]|win=[01])$")
State = tuple[int, int, int, tuple[int, ...]]
EMPTY: State = (0, 0, 0, ())


def remembered(history: tuple[int, ...], size: int) -> tuple[int, ...]:
    """The history (bytes of each exchange) after one more; the oldest go while there are too many or too long ones."""
    history = (*history, size)
    while len(history) > TURNS or sum(history) > BYTES:
        history = history[1:]
    return history


def step(state: State, line: str) -> tuple[State, str]:
    """The state (fan, heat, window, history) after a line, and what the session says.  A setting that would heat with an open window is refused."""
    fan, heat, win, history = state
    line = line.strip(" ").translate({c: c + 32 for c in range(65, 91)})
    size = len(line.encode())
    if not line or size > LINE_BYTES:
        return state, "rejected"
    if line == "/reset":
        return EMPTY, "reset"
    if line == "/kv-reset":
        return (fan, heat, win, ()), "forgotten"
    if line.startswith("/"):
        return state, "unknown"
    history = remembered(history, size)
    if m := SETTING.match(line):
        key, value = m[1].split("=")
        after = {"fan": fan, "heat": heat, "win": win} | {key: int(value)}
        if after["heat"] and after["win"] and key != "fan":
            return (fan, heat, win, history), "heater_window"
        return (after["fan"], after["heat"], after["win"], history), "ok"
    return (fan, heat, win, history), "chat"


def events_of(session, now: State, rows: pd.DataFrame) -> tuple[State, pd.DataFrame]:
    out = []
    for seq, line in rows.sort_values("seq")[["seq", "line"]].itertuples(index=False):
        now, event = step(now, line)
        out.append((session, seq, event, *now[:3], len(now[3]), sum(now[3])))
    return now, pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])


class Sessions(StatefulProcessor):
    """Lines (session, seq, line) to events; within a batch lines are taken in the order of seq."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("device", "fan int, heat int, win int, history string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fan, heat, win, history = self.state.get() if self.state.exists() else (0, 0, 0, "")
        now, out = events_of(key[0], (fan, heat, win, tuple(map(int, history.split()))), pd.concat(list(rows)))
        self.state.update((*now[:3], " ".join(map(str, now[3]))))
        yield out

    def close(self) -> None:
        pass


def stream(lines: DataFrame) -> DataFrame:
    """Events of a stream of lines."""
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return lines.groupBy("session").transformWithStateInPandas(statefulProcessor=Sessions(), outputStructType=OUTPUT, outputMode="Append", timeMode="None")


def batch(lines: DataFrame) -> DataFrame:
    """The same over a finished table: each session's lines in one call, in order."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        return events_of(rows["session"].iloc[0], EMPTY, rows)[1]

    return lines.groupBy("session").applyInPandas(fold, OUTPUT)


class Waiting(StatefulProcessor):
    """For each session the first event that ``found`` marks, if it comes within ``seconds`` of the session's first event; else the deadline, once event time has passed it."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("wait", "deadline long, hit long, event long, done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(rows))
        us = held["us"]
        deadline, hit, event, done = self.state.get() if self.state.exists() else (None, None, None, False)
        if done:
            return
        if deadline is None or us.min() + self.seconds * 1_000_000 < deadline:
            deadline = int(us.min()) + self.seconds * 1_000_000
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(deadline // 1000 + 1)
        good = held[held["found"] & (us <= deadline)].sort_values(["us", "event_id"])
        if len(good) and (hit is None or (int(good["us"].iloc[0]), int(good["event_id"].iloc[0])) < (hit, event)):
            hit, event = int(good["us"].iloc[0]), int(good["event_id"].iloc[0])
        self.state.update((deadline, hit, event, False))
        return
        yield

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        deadline, hit, event, _ = self.state.get()
        late = hit is None or hit > deadline
        self.state.update((deadline, hit, event, True))
        yield pd.DataFrame({"session": [key[0]], "at_us": [deadline if late else hit], "event_id": pd.array([None if late else event], "Int64"), "timed_out": [late]})

    def close(self) -> None:
        pass


def wait_until(events: DataFrame, session: Column, found: Column, seconds: int, delay: str = "0 seconds") -> DataFrame:
    """Of a stream (ts, event_id, ...): session, at_us, event_id and timed_out of each session whose deadline has passed."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.withWatermark("ts", delay).select("ts", session.cast("long").alias("session"), F.unix_micros("ts").alias("us"), "event_id", found.alias("found"))
    return rows.groupBy("session").transformWithStateInPandas(statefulProcessor=Waiting(seconds), outputStructType="session long, at_us long, event_id long, timed_out boolean", outputMode="Append", timeMode="EventTime")


def run_available(stream_df: DataFrame, folder: str, progress: list | None = None) -> DataFrame:
    """All that a stream has now, written to a table in ``folder`` and read from it; ``progress`` takes what each micro-batch reports."""
    query = stream_df.writeStream.format("parquet").option("checkpointLocation", f"{folder}/progress").option("path", f"{folder}/rows").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    if progress is not None:
        progress += query.recentProgress
    return stream_df.sparkSession.read.schema(stream_df.schema).parquet(f"{folder}/rows")


def whole_sessions(closed: DataFrame, folder: str) -> DataFrame:
    """The finished sessions of a stream that ran in ``folder``: what its session windows gave out (user_id, start_us, end_us, n), with parts of one session put together.

    A session is given out as soon as the watermark passes its end, but a row that is still in time may extend it later;
    that row then starts a window of its own.  Such parts overlap.  Where the last of them is still open in the stream's state, the session
    is not finished.
    """
    held = closed.sparkSession.read.format("statestore").load(f"{folder}/progress").select("value.*")
    still = held.select("user_id", F.unix_micros("session_window.start").alias("start_us"), F.unix_micros("session_window.end").alias("end_us"), F.col("count").alias("n"))
    parts = closed.withColumn("open", F.lit(False)).union(still.withColumn("open", F.lit(True)))
    by = Window.partitionBy("user_id").orderBy("start_us")
    starts = parts.withColumn("new", F.when(F.col("start_us") < F.lag("end_us").over(by), 0).otherwise(1))
    placed = starts.withColumn("k", F.sum("new").over(by))
    found = placed.groupBy("user_id", "k").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n").alias("n"), F.max("open").alias("open"))
    return found.where("not open").select(*closed.columns)


def in_order(rows: DataFrame, slices: int, at: Column, folder: str, files: int = 2) -> DataFrame:
    """rows as a stream of ``slices`` micro-batches, in the order of ``at`` (a slice's number from 0).

    Each slice is written after the one before, as ``files`` files, and so many files make a micro-batch.
    """
    spark = rows.sparkSession
    dealt = rows.withColumn("__slice", at)
    for k in range(slices):
        dealt.where(F.col("__slice") == k).drop("__slice").repartition(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


def late_rows(progress: list) -> int:
    """How many rows came too late, over all micro-batches."""
    return sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])

"""Structured Streaming jobs: ingest of document versions, per-user limits, step metrics, feedback."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from lodestone.operators import manage, prepare


def ingest(documents: DataFrame, prepare: Callable[[DataFrame], DataFrame], rows: str, checkpoint: str):
    """Writes prepare(documents) of every micro-batch to rows/batch_id=…, of each document's newest version
    in the batch.  A batch that runs again after a failure overwrites its own folder."""

    def one(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("doc_id").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "doc_id"]), F.col("version")).alias("d")).select("doc_id", "d.*")
        prepare(newest).write.mode("overwrite").parquet(f"{rows}/batch_id={number}")

    return documents.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_rows(rows: DataFrame) -> DataFrame:
    """Of each document the rows of the last batch that held it."""
    last = rows.groupBy("doc_id").agg(F.max("batch_id").alias("batch_id"))
    return rows.join(last, ["doc_id", "batch_id"], "left_semi").drop("batch_id")


def limited(turns: DataFrame, most: int, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """turns(user_id, event_id, ts) as a stream: event_id, user_id, recent (turns of the last seconds, this
    one included) and refused.  State holds a user's turns of the last seconds only and times out.  A task holds
    one user's turns of a micro-batch; maxFilesPerTrigger or maxOffsetsPerTrigger of the source bounds these."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        new = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        span, out = seconds * 1_000_000, []
        for at, ident in zip(new["ts"].astype("datetime64[us]").astype("int64"), new["event_id"], strict=True):
            held = [t for t in held if t > at - span] + [int(at)]
            out.append((key[0], ident, len(held), len(held) > most))
        state.update((held,))
        state.setTimeoutTimestamp(max(held[-1] // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "recent", "refused"])

    return turns.select("user_id", "event_id", "ts").withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(
        run, "user_id long, event_id long, recent long, refused boolean", "held array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


class TurnLimit(StatefulProcessor):
    """A user's turns of the last ``seconds`` as list state; a timer drops those that have left the window, and the state
    with the last of them."""

    def __init__(self, most: int, seconds: int):
        self.most, self.span = most, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long")

    def _keep(self, times: list[int]) -> None:
        """What stands from now on, and a timer for when the newest of it leaves."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if not times:
            self.held.clear()
            return
        self.held.put([(t,) for t in times])
        self.handle.registerTimer((times[-1] + self.span) // 1000 + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = sorted(t for (t,) in self.held.get()) if self.held.exists() else []
        new = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out = []
        for at, ident in zip(new["ts"].astype("datetime64[us]").astype("int64"), new["event_id"], strict=True):
            held = [t for t in held if t > at - self.span] + [int(at)]
            out.append((key[0], ident, len(held), len(held) > self.most))
        self._keep(held)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "recent", "refused"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        self._keep([t for (t,) in self.held.get() if t > now - self.span])
        yield pd.DataFrame({"user_id": pd.Series(dtype="int64"), "event_id": pd.Series(dtype="int64"), "recent": pd.Series(dtype="int64"), "refused": pd.Series(dtype="bool")})

    def close(self) -> None:
        pass


ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def limited_by_timers(turns: DataFrame, most: int, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """The rows of ``limited`` from list state with timers.  The session's state store must be the one that ROCKS names; turns
    later than ``late`` are dropped, and a user whose turns have all left the window holds no state."""
    kept = turns.select("user_id", "event_id", "ts").withWatermark("ts", late)
    return kept.groupBy("user_id").transformWithStateInPandas(TurnLimit(most, seconds), "user_id long, event_id long, recent long, refused boolean", "Append", "EventTime")


def cleaned(documents: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    """documents(…, text) without the lines that match one of the patterns, case apart; stateless, so a stream stays one."""
    any_of = "(?i)" + "|".join(f"(?:{p})" for p in patterns) if patterns else r"(?!)"
    kept = F.filter(F.split("text", r"\n"), lambda x: ~F.coalesce(x.rlike(any_of), F.lit(False)))
    return documents.withColumn("text", F.array_join(kept, "\n"))


def chunked(documents: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """doc_id, ts, ordinal, start, end, tokens, text of documents(doc_id, ts, text): token windows, cut from each row alone, so
    that a stream of documents becomes a stream of pieces without state."""
    c = prepare.token_chunks(documents.select(F.struct("doc_id", "ts").alias("doc_id"), "text"), size, overlap)
    return c.select("doc_id.doc_id", "doc_id.ts", "ordinal", "start", "end", "tokens", "text")


def piece_histogram(pieces: DataFrame, width: str = "1 hour", late: str = "2 hours", step: int = 64) -> DataFrame:
    """start, bucket, n, tokens of pieces(ts, tokens): how many pieces of each size, in steps of ``step`` tokens, each window
    had; of a stream, windows the watermark has closed, late pieces up to ``late`` counted in."""
    bucket = (F.floor((F.col("tokens") - 1) / step) * step).cast("long")
    return pieces.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum("tokens").cast("long").alias("tokens")).select(F.col("w.start").alias("start"), "bucket", "n", "tokens")


def metrics(steps: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """steps(ts, step, ms, status): counts, errors, seconds and the latency histogram of each window and step, and what
    ``manage.measures`` adds for further columns."""
    measures = manage.measures(steps.columns)
    got = steps.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "step").agg(*measures.values())
    return got.select(F.col("w.start").alias("start"), "step", *measures)


def once_each(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Retried events once."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])

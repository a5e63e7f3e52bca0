"""Structured Streaming versions of the event operators.

State is kept per key and expires with the watermark: ``keep`` after a key's last
record its state goes, so that state does not grow with the keys ever seen; records
later than the watermark are dropped.  Within a micro-batch records are folded by
time and a tie column, between micro-batches in the order of arrival.  Timestamps
without a zone are read as UTC (the session's zone).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, schema: str, ts: str = "ts", delay: str = "1 hour", files_per_trigger: int = 8) -> DataFrame:
    """A stream over a folder of Parquet files, with a watermark on ``ts``."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def windowed(events: DataFrame, ts: str, width: str, key: str, value: str, slide: str | None = None) -> DataFrame:
    """Count and sum per key and tumbling or sliding window; the same for batch and stream."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, key: str) -> DataFrame:
    """Sessions per key that end after ``gap`` without a record."""
    return events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def deduplicated(events: DataFrame, keys: list[str]) -> DataFrame:
    """Records without repeats of ``keys`` within the watermark."""
    return events.dropDuplicatesWithinWatermark(keys)


Step = Callable[[tuple | None, pd.DataFrame, tuple], tuple[tuple | None, list[tuple]]]


def follow(events: DataFrame, key: str, ts: str, tie: str, state: str, out: str, keep: str, step: Step, gone: Callable[[tuple, tuple], list[tuple]] | None = None) -> DataFrame:
    """A state per key: ``step(state, records, key)`` gives the new state and rows of the schema ``out``.

    ``records`` are a micro-batch's records of the key in order.  A state that is None
    is dropped.  Without records for ``keep`` beyond the watermark the state is dropped
    too, and ``gone(state, key)`` gives the last rows.
    """
    kept = int(pd.Timedelta(keep).total_seconds() * 1000)
    names = [f.split()[0].strip("`") for f in out.split(",")]

    def fold(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            rows = gone(held.get, k) if gone else []
            held.remove()
        else:
            records = pd.concat(list(batches)).sort_values([ts, tie], kind="stable")
            now, rows = step(held.get if held.exists else None, records, k)
            if now is None:
                if held.exists:
                    held.remove()
            else:
                held.update(now)
                last = int(records[ts].max().value // 1_000_000)
                held.setTimeoutTimestamp(max(last, held.getCurrentWatermarkMs()) + kept + 1)
        yield pd.DataFrame(rows, columns=names)

    return events.groupBy(key).applyInPandasWithState(fold, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def _type(events: DataFrame, column: str) -> str:
    return events.schema[column].dataType.simpleString()


def moving_average(events: DataFrame, key: str, ts: str, tie: str, value: str, alpha: float, keep: str = "7 days") -> DataFrame:
    """After every micro-batch the moving average of each key that it touched: ``key, average, samples``.

    Only the average and the count are kept.
    """

    def step(now: tuple | None, records: pd.DataFrame, k: tuple) -> tuple[tuple | None, list[tuple]]:
        average, samples = now or (None, 0)
        for x in records[value].dropna():
            average = float(x) if average is None else alpha * float(x) + (1 - alpha) * average
            samples += 1
        return (None, []) if average is None else ((average, samples), [(k[0], average, samples)])

    return follow(events, key, ts, tie, "average double, samples bigint", f"`{key}` {_type(events, key)}, average double, samples bigint", keep, step)


def health_triggers(events: DataFrame, key: str, ts: str, tie: str, score: str, low: float, high: float, keep: str = "7 days") -> DataFrame:
    """State changes with hysteresis, as a stream: ``key, ts, state``."""

    def step(now: tuple | None, records: pd.DataFrame, k: tuple) -> tuple[tuple | None, list[tuple]]:
        is_ = now[0] if now else "healthy"
        changes = []
        for when, s in zip(records[ts], records[score], strict=True):
            new = "degraded" if s < low else "healthy" if s >= high else is_
            if new != is_:
                changes.append((k[0], when, new))
                is_ = new
        return (is_,), changes

    return follow(events, key, ts, tie, "state string", f"`{key}` {_type(events, key)}, `{ts}` timestamp, state string", keep, step)


def smoothed_rtt(events: DataFrame, key: str, ts: str, tie: str, rtt_us: str, keep: str = "1 day") -> DataFrame:
    """Smoothed round-trip time and variance per key after every micro-batch, truncated like the batch version: ``key, srtt, rttvar``."""

    def step(now: tuple | None, records: pd.DataFrame, k: tuple) -> tuple[tuple | None, list[tuple]]:
        for x in records[rtt_us].dropna().astype("int64"):
            x = int(x)
            now = (x, x // 2) if now is None else ((7 * now[0] + x) // 8, (3 * now[1] + abs(now[0] - x)) // 4)
        return now, [] if now is None else [(k[0], *now)]

    return follow(events, key, ts, tie, "srtt bigint, rttvar bigint", f"`{key}` {_type(events, key)}, srtt bigint, rttvar bigint", keep, step)


def drift_alerts(events: DataFrame, key: str, ts: str, tie: str, size: str, millis: str, expected: float, threshold: float, least: int, alpha: float = 0.3, keep: str = "1 day") -> DataFrame:
    """When a key's average speed (bits a second) leaves or regains ``expected`` by a share: ``key, ts, drifting, average``.

    Judged from the ``least``-th sample on; samples of no duration are ignored.
    """

    def step(now: tuple | None, records: pd.DataFrame, k: tuple) -> tuple[tuple | None, list[tuple]]:
        average, n, off = now or (0.0, 0, False)
        out = []
        for when, b, ms in zip(records[ts], records[size], records[millis], strict=True):
            if not ms > 0:
                continue
            x = float(int(b) * 8000 // int(ms))
            average = x if n == 0 else alpha * x + (1 - alpha) * average
            n += 1
            if n >= least and (abs(average - expected) > threshold * expected) != off:
                off = not off
                out.append((k[0], when, off, average))
        return (average, n, off), out

    return follow(events, key, ts, tie, "average double, n bigint, off boolean", f"`{key}` {_type(events, key)}, `{ts}` timestamp, drifting boolean, average double", keep, step)


def stale_keys(events: DataFrame, key: str, ts: str, tie: str, keep: str) -> DataFrame:
    """Keys without a record for ``keep``: ``key, last_seen, records``, once the watermark has passed."""

    def step(now: tuple | None, records: pd.DataFrame, k: tuple) -> tuple[tuple | None, list[tuple]]:
        last, n = now or (0, 0)
        return (max(last, int(records[ts].max().value // 1000)), n + len(records)), []

    def gone(now: tuple, k: tuple) -> list[tuple]:
        return [(k[0], pd.Timestamp(now[0], unit="us"), now[1])]

    return follow(events, key, ts, tie, "last bigint, n bigint", f"`{key}` {_type(events, key)}, last_seen timestamp, records bigint", keep, step, gone)


def unanswered(events: DataFrame, request: str, ts: str, tie: str, is_answer: str, timeout: str) -> DataFrame:
    """Requests and their fate: ``request, fate`` (answered, or timed out without an answer within ``timeout``)."""

    def step(now: tuple | None, records: pd.DataFrame, k: tuple) -> tuple[tuple | None, list[tuple]]:
        if now == (True,):
            return now, []
        if records[is_answer].any():
            return (True,), [(k[0], "answered")]
        return (False,), []

    def gone(now: tuple, k: tuple) -> list[tuple]:
        return [] if now[0] else [(k[0], "timed out")]

    return follow(events, request, ts, tie, "answered boolean", f"`{request}` {_type(events, request)}, fate string", timeout, step, gone)


def numbered_blocks(objects: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Fixed-size blocks with their sequence numbers, of a batch or a stream of objects."""
    from lakeglass.operators.dedup import fixed_blocks

    return fixed_blocks(objects, key, text, size)


def pipeline(stream: DataFrame, process: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Read, process and write, bounded by what a trigger takes; what is there now, then stop."""
    run_available(process(stream), sink, checkpoint, mode)


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there now, each micro-batch handed to ``sink``, then stop."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()

import pytest
from pyspark.sql import functions as F

from lakeglass.operators import folds
from lakeglass.streaming import streams

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@pytest.fixture
def stream(spark, small, tmp_path):
    folder = tmp_path / "in"
    spark.read.parquet(f"{small}/events.parquet").orderBy("ts").coalesce(1).write.parquet(str(folder))
    return streams.event_stream(spark, str(folder), SCHEMA)


def gather(df, tmp_path, mode):
    out = []
    streams.run_available(df, lambda batch, _: out.extend(batch.collect()), str(tmp_path / "checkpoint"), mode)
    return out


def test_windows_equal_batch(spark, small, stream, tmp_path):
    batch = streams.windowed(spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", "event_type", "value")
    rows = gather(streams.windowed(stream, "ts", "1 day", "event_type", "value"), tmp_path, "complete")
    assert {(r["start"], r["event_type"]): r["n"] for r in rows} == {(r["start"], r["event_type"]): r["n"] for r in batch.collect()}


def test_moving_average_equals_fold(spark, small, stream, tmp_path):
    e = spark.read.parquet(f"{small}/events.parquet")
    batch = {r["user_id"]: r["value"] for r in folds.ema(e, ["user_id"], ["ts", "event_id"], "value", 0.2).collect()}
    rows = gather(streams.moving_average(stream, "user_id", "ts", "event_id", "value", 0.2), tmp_path, "append")
    assert {r["user_id"]: pytest.approx(r["average"]) for r in rows} == batch


def test_triggers_equal_batch(spark, small, stream, tmp_path):
    e = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = folds.hysteresis(e, ["user_id"], ["ts", "event_id"], "value", 30, 60)
    rows = gather(streams.health_triggers(stream, "user_id", "ts", "event_id", "value", 30, 60), tmp_path, "append")
    assert {(r["user_id"], r["ts"], r["state"]) for r in rows} == {(r["user_id"], r["ts"], r["state"]) for r in batch.collect()}


def test_deduplicated(stream, tmp_path):
    rows = gather(streams.deduplicated(stream, ["event_id"]).select("event_id"), tmp_path, "append")
    assert len(rows) == len({r["event_id"] for r in rows}) > 0


def test_smoothed_rtt_equals_fold(spark, small, stream, tmp_path):
    e = spark.read.parquet(f"{small}/events.parquet").withColumn("us", (F.col("value") * 1000).cast("bigint"))
    batch = {r["user_id"]: (r["srtt"], r["rttvar"]) for r in folds.smoothed_rtt(e, ["user_id"], ["ts", "event_id"], "us").collect()}
    rows = gather(streams.smoothed_rtt(stream.withColumn("us", (F.col("value") * 1000).cast("bigint")), "user_id", "ts", "event_id", "us"), tmp_path, "append")
    assert {r["user_id"]: (r["srtt"], r["rttvar"]) for r in rows} == batch


def test_drift_alerts_like_a_plain_loop(spark, small, stream, tmp_path):
    e = spark.read.parquet(f"{small}/events.parquet").orderBy("ts", "event_id").collect()
    want, state = [], {}
    for r in e:
        if (ms := int(r["value"])) <= 0:
            continue
        average, n, off = state.get(r["user_id"], (0.0, 0, False))
        x = float(r["event_id"] * 8000 // ms)
        average, n = (x if n == 0 else 0.3 * x + 0.7 * average), n + 1
        if n >= 3 and (abs(average - 50_000) > 25_000) != off:
            off = not off
            want.append((r["user_id"], off, pytest.approx(average)))
        state[r["user_id"]] = (average, n, off)
    out = streams.drift_alerts(stream.withColumn("ms", F.col("value").cast("int")), "user_id", "ts", "event_id", "event_id", "ms", 50_000.0, 0.5, 3)
    got = [(r["user_id"], r["drifting"], r["average"]) for r in gather(out, tmp_path, "append")]
    assert sorted(got) == sorted(want, key=lambda w: w[:2] + (w[2].expected,)) and want


def arrivals(spark, tmp_path, parts):
    """A stream over files that arrive one after the other, with a watermark of no delay."""
    import os

    folder = tmp_path / "arrivals"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, answer boolean").coalesce(1).write.mode("append").parquet(str(folder))
        for name in os.listdir(folder):
            if name.startswith("part") and name.endswith(".parquet") and not name.startswith("part-n"):
                os.rename(folder / name, folder / f"part-n{i}.parquet")
                os.utime(folder / f"part-n{i}.parquet", (i * 10 + 1_000_000, i * 10 + 1_000_000))
    return streams.event_stream(spark, str(folder), "event_id bigint, ts timestamp_ntz, user_id bigint, answer boolean", delay="0 seconds", files_per_trigger=1)


def test_stale_keys_and_expiry(spark, tmp_path):
    from datetime import datetime as at

    parts = [[(1, at(2024, 1, 1), 7, False), (2, at(2024, 1, 1, 1), 8, False)], [(3, at(2024, 1, 1, 2), 8, False)], [(4, at(2024, 1, 1, 3), 9, False)], [(5, at(2024, 1, 9), 9, False)], [(6, at(2024, 1, 9, 1), 9, False)]]
    rows = gather(streams.stale_keys(arrivals(spark, tmp_path, parts), "user_id", "ts", "event_id", "12 hours"), tmp_path, "append")
    assert {(r["user_id"], r["records"]) for r in rows if r["user_id"] != 9} == {(7, 1), (8, 2)}
    assert {r["last_seen"].replace(tzinfo=None) for r in rows if r["user_id"] == 8} == {at(2024, 1, 1, 2)}


def test_unanswered_requests_time_out(spark, tmp_path):
    from datetime import datetime as at

    parts = [[(1, at(2024, 1, 1), 7, False), (2, at(2024, 1, 1), 8, False)], [(3, at(2024, 1, 1, 0, 1), 8, True)], [(4, at(2024, 1, 2), 9, False)], [(5, at(2024, 1, 2, 1), 9, True)]]
    rows = gather(streams.unanswered(arrivals(spark, tmp_path, parts), "user_id", "ts", "event_id", "answer", "10 minutes"), tmp_path, "append")
    assert {(r["user_id"], r["fate"]) for r in rows if r["user_id"] != 9} == {(7, "timed out"), (8, "answered")}


def test_pipeline_cuts_blocks(spark, stream, tmp_path):
    out = []
    streams.pipeline(stream, lambda e: streams.numbered_blocks(e, "event_id", "props", 4), lambda batch, _: out.extend(batch.collect()), str(tmp_path / "c"))
    first = [r for r in out if r["event_id"] == out[0]["event_id"]]
    assert sorted(r["block"] for r in first) == list(range(len(first))) and max(len(r["content"]) for r in out) == 4

"""Streams that fail, start anew from their log and meet late rows."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from barweave.streaming import live as L, stream as ST

T0 = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


def at(h):
    return T0 + h * HOUR


def folder(spark):
    return f"{spark.conf.get('spark.checkpoint.dir')}/live-{uuid.uuid4().hex}"


def signals(spark, rows):
    return spark.createDataFrame([(a, at(h), d, c, s) for a, h, d, c, s in rows], "asset string, ts timestamp, direction long, close double, slice int")


def bars(spark, rows):
    return spark.createDataFrame([(a, at(h), c, r, s) for a, h, c, r, s in rows], "asset string, ts timestamp, close double, ret double, slice int")


def hours(rows, *cols):
    return sorted((r["asset"], (r["ts"] - T0) // HOUR, *(r[c] for c in cols)) for r in rows)


def test_scores_wait_across_restarts_and_give_late_rows_up(spark):
    s = signals(spark, [("a", 1, 1, 10.0, 0), ("a", 2, -1, 11.0, 0), ("a", 4, 1, 10.0, 0), ("a", 3, 1, 9.0, 2), ("b", 20, 1, 5.0, 1), ("b", 40, 1, 5.0, 2), (None, 2, 1, 1.0, 0)])
    b = bars(spark, [("a", 2, 11.0, None, 0), ("a", 3, 12.0, None, 1), ("b", 20, 5.0, None, 1), ("a", 5, 9.0, None, 2), ("b", 40, 5.0, None, 2), (None, 3, 1.0, None, 0)])
    got = L.replay({"signals": s, "bars": b}, 3, lambda signals, bars: L.live_scores(signals, bars), folder(spark)).collect()
    # the bar of hour 3 comes a slice later and is in time; that of hour 5, and the signal of hour 3, come after 18:30
    assert hours([r for r in got if r["asset"]], "outcome") == [("a", 1, "hit"), ("a", 2, "miss"), ("a", 4, None), ("b", 20, None)]
    assert [(r["asset"], r["outcome"]) for r in got if r["asset"] is None] == [(None, None)]


def test_cycles_need_all_their_bars(spark):
    s = signals(spark, [("a", 0, 1, 10.0, 0), ("a", 1, -1, 10.0, 0), ("a", 2, 1, 10.0, 0)])
    b = bars(spark, [("a", 1, 11.0, 0.1, 0), ("a", 2, 9.9, -0.1, 1), ("a", 3, 9.9, 0.0, 1), ("x", 9, 1.0, 0.0, 1), ("a", 4, 9.9, 0.0, 2), ("x", 30, 1.0, 0.0, 2)])
    s = s.unionByName(signals(spark, [("x", 9, 1, 1.0, 1), ("x", 30, 1, 1.0, 2)]))
    got = L.replay({"signals": s, "bars": b}, 3, lambda signals, bars: L.live_cycles(signals, bars, 2, 10.0), folder(spark)).collect()
    fee = 10 / 1e4
    assert hours(got, "outcome") == [("a", 0, "loss"), ("a", 1, "profit"), ("a", 2, None)]
    pnl = {(r["ts"] - T0) // HOUR: r["pnl"] for r in got}
    assert pnl[0] == pytest.approx((1.1 - fee) * 0.9 * (1 - fee) - 1) and pnl[1] == pytest.approx((1.1 - fee) * (1 - fee) - 1) and pnl[2] is None


def test_log_has_a_key_once_whatever_comes_again(spark):
    rows = [("a", 1, 1, 1.0, s) for s in (0, 0, 1, 3)] + [("a", 2, 1, 1.0, 1), ("a", 30, 1, 1.0, 1), ("a", 3, 1, 1.0, 2), ("a", 29, 1, 1.0, 2), ("a", 29, 1, 1.0, 3)]
    job = lambda signals: ST.log_signals(signals, delay="2 hours")
    got = L.replay({"signals": signals(spark, rows)}, 4, job, folder(spark)).collect()
    assert hours(got) == [("a", 1), ("a", 2), ("a", 29), ("a", 30)]  # hour 3 comes after 28:00


def test_sessions_are_told_once_and_not_reopened(spark):
    ticks = [("a", 0.0, 0), ("a", 0.4, 0), ("a", 5.0, 0), ("a", 0.7, 1), ("a", 5.3, 1), ("a", 9.0, 1), ("b", 20.0, 2)]
    feed = spark.createDataFrame([(a, at(h), s) for a, h, s in ticks], "asset string, ts timestamp, slice int")
    got = L.replay({"ticks": feed}, 3, lambda ticks: ST.feed_sessions(ticks, "1 hour", delay="30 minutes"), folder(spark)).collect()
    assert sorted((r["asset"], (r["session_start"] - T0) / HOUR, r["n"]) for r in got) == [("a", 0.0, 2), ("a", 5.0, 2), ("a", 9.0, 1)]


def test_a_batch_that_fails_is_written_once(spark):
    """The sink breaks off after it has written; the restart takes the same batch from the log and writes it over."""
    root = folder(spark)
    rows = spark.createDataFrame([("a", at(h)) for h in range(5)], "asset string, ts timestamp")
    rows.write.parquet(f"{root}/in")
    stream = ST.log_signals(spark.readStream.schema(rows.schema).parquet(f"{root}/in"), delay="1 day")
    broken = []

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")
        if not broken:
            broken.append(number)
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        ST.each_batch(stream, write, f"{root}/log").awaitTermination()
    ST.each_batch(stream, write, f"{root}/log").awaitTermination()
    rows.withColumn("ts", F.col("ts") + F.expr("interval 30 minutes")).unionByName(rows).write.mode("append").parquet(f"{root}/in")
    ST.each_batch(stream, write, f"{root}/log").awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    assert out.count() == 10 and out.select("asset", "ts").distinct().count() == 10


def test_feed_without_rows(spark):
    none = signals(spark, [])
    assert L.replay({"signals": none, "bars": bars(spark, [("a", 1, 1.0, 0.0, 0)])}, 2, lambda signals, bars: L.live_scores(signals, bars), folder(spark)).count() == 0

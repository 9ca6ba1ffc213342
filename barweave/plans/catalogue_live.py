"""Registered queries: live jobs over feeds that arrive in slices, with late rows, and SQL with the same rule of lateness."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barweave.functions import features as X
from barweave.plans import bindings as B
from barweave.plans.catalogue import pool_streak
from barweave.plans.registry import cte, query
from barweave.sources.stored import shared_folder
from barweave.streaming import live as L, stream as ST

SLICES = 4
DAY = 86400


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"


def _sliced(spark: SparkSession, sf: str, rows: DataFrame, late: Column) -> DataFrame:
    """Rows with the slice that they arrive in: ``late`` seconds after their time."""
    ends = B.table(spark, sf, "events").agg(F.floor(F.unix_seconds(F.min(F.col("ts").cast("timestamp")))).alias("a"), F.unix_seconds(F.max(F.col("ts").cast("timestamp"))).alias("b")).first()
    width = (ends["b"] - ends["a"]) // SLICES + 1 if ends["a"] is not None else 1
    return rows.withColumn("slice", L.arrival_slice(F.timestamp_seconds(F.unix_seconds("ts") + late), ends["a"] or 0, width, SLICES))


cte("feed_ends", f"SELECT CAST(floor(epoch(min(ts))) AS BIGINT) AS a, (CAST(floor(epoch(max(ts))) AS BIGINT) - CAST(floor(epoch(min(ts))) AS BIGINT)) // {SLICES} + 1 AS width FROM events")


def slice_sql(at: str) -> str:
    return f"greatest(0, least({SLICES - 1}, CAST(floor(({at} - (SELECT a FROM feed_ends)) / (SELECT width FROM feed_ends)) AS BIGINT)))"


def mark_sql(feeds: list[tuple[str, str]], delay_s: int) -> str:
    """(slice, mark): the watermark after each slice, the least over the feeds (table, time in seconds)."""
    per = " UNION ALL ".join(f"SELECT '{name}' AS feed, slice, max({at}) AS top FROM {name} GROUP BY slice" for name, at in feeds)
    grid = f"SELECT feed, slice FROM (SELECT unnest([{', '.join(repr(n) for n, _ in feeds)}]) AS feed), (SELECT unnest(range({SLICES})) AS slice)"
    return f"SELECT slice, min(top) - {delay_s} AS mark FROM (SELECT feed, slice, max(top) OVER (PARTITION BY feed ORDER BY slice ROWS UNBOUNDED PRECEDING) AS top FROM ({grid}) AS g LEFT JOIN ({per}) AS p USING (feed, slice)) AS x GROUP BY slice"


def in_time(feed: str, marks: str, at: str) -> str:
    """The rows of a feed that aren't late."""
    return f"SELECT f.* FROM {feed} AS f LEFT JOIN {marks} AS m ON m.slice = f.slice - 1 WHERE f.slice = 0 OR {at} > m.mark"


# ---- W1, W6: ticks, of which each seventh is 20 minutes and each fortieth three days late

_TICK_LATE = f"CASE WHEN seq % 40 = 0 THEN {3 * DAY} WHEN seq % 7 = 0 THEN 1200 ELSE 0 END"
cte("tick_feed", f"SELECT asset, ts, epoch_us(ts) / 1e6 AS s, price, qty, seq, {slice_sql(f'CAST(floor(epoch(ts)) AS BIGINT) + {_TICK_LATE}')} AS slice FROM ticks")
cte("tick_marks", mark_sql([("tick_feed", "s")], 3600))


def tick_feed(spark: SparkSession, sf: str) -> DataFrame:
    late = F.when(F.col("seq") % 40 == 0, 3 * DAY).when(F.col("seq") % 7 == 0, 1200).otherwise(0)
    return _sliced(spark, sf, B.ticks(spark, sf).select("asset", "ts", "price", "qty", "seq"), late)


cte("tick_in_time", in_time("tick_feed", "tick_marks", "floor(f.s / 3600) * 3600 + 3600"))


@query("w1_live_bars", "asset ts:i open:d high:d low:d close:d volume:d", f"SELECT asset, CAST(floor(s / 3600) * 3600 AS BIGINT) AS ts, min_by(price, (s, seq)) AS open, max(price) AS high, min(price) AS low, max_by(price, (s, seq)) AS close, sum(qty) AS volume FROM tick_in_time GROUP BY asset, floor(s / 3600) HAVING floor(s / 3600) * 3600 + 3600 <= (SELECT mark FROM tick_marks WHERE slice = {SLICES - 1})")
def w1_live(spark, sf):
    """Bars of a stream that is an hour behind: those that the watermark has closed."""
    return L.replay({"ticks": tick_feed(spark, sf)}, SLICES, lambda ticks: ST.stream_bars(ticks, "1h", delay="1 hour"), _folder(spark))


def _sessions_sql(gap: int) -> str:
    """Slice by slice: what is open and what comes in time are merged, and what the watermark has passed is closed."""
    parts = []
    for k in range(SLICES):
        mark = f"(SELECT mark FROM tick_marks WHERE slice = {k})"
        late = "" if k == 0 else f" AND s + {gap} > (SELECT mark FROM tick_marks WHERE slice = {k - 1})"
        old = "" if k == 0 else f" UNION ALL SELECT asset, a, b, n FROM merged_{k - 1} WHERE b > (SELECT mark FROM tick_marks WHERE slice = {k - 1})"
        rows = f"SELECT asset, s AS a, s + {gap} AS b, 1 AS n FROM tick_feed WHERE slice = {k}{late}{old}"
        runs = f"SELECT *, sum(new) OVER (PARTITION BY asset ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN a < max(b) OVER (PARTITION BY asset ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM ({rows}) AS r) AS q"
        cte(f"merged_{k}", f"SELECT asset, min(a) AS a, max(b) AS b, sum(n) AS n FROM ({runs}) AS z GROUP BY asset, run")
        parts.append(f"SELECT asset, CAST(floor(a) AS BIGINT) AS session_start, CAST(floor(b) AS BIGINT) AS session_end, n FROM merged_{k} WHERE b <= {mark}")
    return " UNION ALL ".join(parts)


@query("w6_live_sessions", "asset session_start:i session_end:i n:i", _sessions_sql(1800))
def w6_live(spark, sf):
    """Sessions of a stream, each told once, when the watermark has passed its end."""
    return L.replay({"ticks": tick_feed(spark, sf)}, SLICES, lambda ticks: ST.feed_sessions(ticks, "30 minutes", delay="1 hour"), _folder(spark))


# ---- W2, W3, W4: signals of hourly bars; each comes twice, some copies days later

_SIGNAL_LATE = f"CASE WHEN (t // 3600) % 11 = 0 THEN {4 * DAY} WHEN (t // 3600) % 5 = 0 THEN 3000 ELSE 0 END"
_BAR_LATE = f"CASE WHEN (t // 3600) % 13 = 0 THEN {3 * DAY} WHEN (t // 3600) % 6 = 0 THEN 2400 ELSE 0 END"
cte("signal_once", f"SELECT asset, t, CAST(-sign(streak) AS BIGINT) AS direction, close, 0 AS again, {slice_sql(f't + {_SIGNAL_LATE}')} AS slice FROM pool WHERE abs(streak) >= 2")
cte("signal_feed", f"SELECT * FROM signal_once UNION ALL SELECT asset, t, CAST(-sign(streak) AS BIGINT), close, 1, {slice_sql(f't + {2 * DAY}')} FROM pool WHERE abs(streak) >= 2")
cte("bar_feed", f"SELECT asset, t, close, return_1h AS ret, {slice_sql(f't + {_BAR_LATE}')} AS slice FROM pool")


def _hour() -> Column:
    return F.floor(F.unix_seconds("ts") / 3600)


def signal_feed(spark: SparkSession, sf: str, again: bool) -> DataFrame:
    """Contrarian signals with their price; with ``again`` each a second time, two days after it."""
    rows = pool_streak(spark, sf).where(F.abs("streak") >= 2).select("asset", "ts", (-F.signum("streak")).cast("long").alias("direction"), "close")
    late = F.when(_hour() % 11 == 0, 4 * DAY).when(_hour() % 5 == 0, 3000).otherwise(0)
    once = _sliced(spark, sf, rows, late)
    return once.unionByName(_sliced(spark, sf, rows, F.lit(2 * DAY))) if again else once


def bar_feed(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.pct_return(B.bars(spark, sf), 1, name="ret").select("asset", "ts", "close", "ret")
    return _sliced(spark, sf, rows, F.when(_hour() % 13 == 0, 3 * DAY).when(_hour() % 6 == 0, 2400).otherwise(0))


cte("signal_marks", mark_sql([("signal_feed", "t")], 5400))
cte("signal_in_time", in_time("signal_feed", "signal_marks", "f.t"))


@query("w2_live_log", "asset ts:i direction:i close:d", "SELECT DISTINCT asset, t AS ts, direction, close FROM signal_in_time")
def w2_live(spark, sf):
    """The log of a stream that repeats itself: one row for each asset and bar."""
    return L.replay({"signals": signal_feed(spark, sf, True)}, SLICES, lambda signals: ST.log_signals(signals, delay="90 minutes"), _folder(spark))


cte("pair_marks", mark_sql([("signal_once", "t"), ("bar_feed", "t")], 5400))
cte("pair_signals", in_time("signal_once", "pair_marks", "f.t"))
cte("pair_bars", in_time("bar_feed", "pair_marks", "f.t"))
_LAST = f"(SELECT mark FROM pair_marks WHERE slice = {SLICES - 1})"


@query("w3_live_scores", "asset ts:i direction:i forward_return_pct:d outcome", f"SELECT asset, t AS ts, direction, f AS forward_return_pct, CASE WHEN sign(f) = direction THEN 'hit' WHEN f IS NOT NULL THEN 'miss' END AS outcome FROM (SELECT s.asset, s.t, s.direction, 100 * (b.close / s.close - 1) AS f, b.t AS bt FROM pair_signals AS s LEFT JOIN pair_bars AS b ON b.asset = s.asset AND b.t = s.t + 3600) AS x WHERE bt IS NOT NULL OR t + 3600 < {_LAST}")
def w3_live(spark, sf):
    """Signals and bars as two streams; a signal is scored when its next bar comes, or given up when that can't come in time."""
    return L.replay({"signals": signal_feed(spark, sf, False), "bars": bar_feed(spark, sf)}, SLICES, lambda signals, bars: L.live_scores(signals, bars), _folder(spark))


@query("w4_live_cycles", "asset ts:i direction:i exit_price:d pnl:d outcome", f"SELECT *, t AS ts, CASE WHEN pnl > 0 THEN 'profit' WHEN pnl IS NOT NULL THEN 'loss' END AS outcome FROM (SELECT s.asset, s.t, s.direction, max(b.close) FILTER (b.t = s.t + 10800) AS exit_price, CASE WHEN count(ret) = 3 THEN (max(1 + s.direction * ret) FILTER (b.t = s.t + 3600) - 0.0005) * max(1 + s.direction * ret) FILTER (b.t = s.t + 7200) * max(1 + s.direction * ret) FILTER (b.t = s.t + 10800) * (1 - 0.0005) - 1 END AS pnl FROM pair_signals AS s JOIN pair_bars AS b ON b.asset = s.asset AND b.t > s.t AND b.t <= s.t + 10800 GROUP BY s.asset, s.t, s.direction) AS x WHERE t + 10800 < {_LAST}")
def w4_live(spark, sf):
    """Hold cycles of three bars, told when the watermark has passed their last."""
    return L.replay({"signals": signal_feed(spark, sf, False), "bars": bar_feed(spark, sf)}, SLICES, lambda signals, bars: L.live_cycles(signals, bars, 3), _folder(spark))

"""The registered queries: each applies operators to the test tables' bindings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from barweave.functions import discretize as P, features as X
from barweave.functions.windows import chunked
from barweave.operators import resample as R
from barweave.plans import bindings as B
from barweave.plans.registry import cte, query
from barweave.sources import io as S
from barweave.sources.stored import shared_folder, stored

A = ["asset"]


def bars_sql(src: str, n: int) -> str:
    return f"SELECT asset, CAST(floor(epoch(ts) / {n}) * {n} AS BIGINT) AS t, first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, seq) AS close, CAST(sum(qty) AS DOUBLE) AS volume FROM {src} GROUP BY ALL"


cte("ticks", "SELECT event_type AS asset, ts, 1000 + value AS price, 1 AS qty, event_id AS seq, user_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
for _rule, _n in (("1m", 60), ("5m", 300), ("15m", 900), ("30m", 1800), ("1h", 3600), ("4h", 14400)):
    cte(f"bars_{_rule}", bars_sql("ticks", _n))
_LI = "row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax)"
cte("prices_flag", f"SELECT l_returnflag AS asset, l_shipdate AS ts, 1000 + l_extendedprice / 1000 AS price, l_quantity AS qty, {_LI} AS seq FROM lineitem")
cte("prices_supp", f"SELECT CAST(l_suppkey AS VARCHAR) AS asset, l_shipdate AS ts, 1000 + l_extendedprice / 1000 AS price, l_quantity AS qty, {_LI} AS seq FROM lineitem")
cte("bars_daily", bars_sql("prices_flag", 86400))
cte("panel_daily", bars_sql("prices_supp", 86400))
cte("funding", "SELECT asset, CAST(floor(epoch(ts) / 28800) * 28800 AS BIGINT) AS t, (avg(k) - 50) / 10000 AS funding_rate FROM ticks GROUP BY ALL")
cte("news", "SELECT 'all' AS symbol, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, avg(k) - 50 AS news_tone, CAST(count(*) AS DOUBLE) AS news_volume FROM ticks GROUP BY ALL")


def roll(agg: str, col: str, n: int, end: int = 0, part: str = "asset") -> str:
    frame = f"ROWS BETWEEN {n - 1 - end} PRECEDING AND {-end} PRECEDING" if end else f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
    w = f"OVER (PARTITION BY {part} ORDER BY t {frame})"
    return f"CASE WHEN count({col}) {w} = {n} THEN {agg} {w} END"


def pool_sql(src: str, part: str = "asset", extra: str = "") -> list[str]:
    """Features in steps, as SQL subqueries."""
    w = f"OVER (PARTITION BY {part} ORDER BY t)"
    one = f"SELECT *, close / lag(close) {w} - 1 AS return_1h, close / lag(close, 6) {w} - 1 AS return_6h, lead(close) {w} / close - 1 AS fwd, row_number() {w} AS rn, (high - low) / close AS range_pct, (close - low) / nullif(high - low, 0) AS close_pos FROM {src}"
    two = f"""SELECT *, {roll('stddev_samp(return_1h)', 'return_1h', 24, part=part)} AS volatility, (volume - {roll('avg(volume)', 'volume', 24, part=part)}) / nullif({roll('stddev_samp(volume)', 'volume', 24, part=part)}, 0) AS volume_zscore,
        {roll('regr_slope(close, rn)', 'close', 12, part=part)} / nullif({roll('avg(close)', 'close', 12, part=part)}, 0) AS trend_slope, {roll('regr_slope(volume, rn)', 'volume', 12, part=part)} / nullif({roll('avg(volume)', 'volume', 12, part=part)}, 0) AS volume_trend,
        return_1h - lag(return_1h) {w} AS return_accel, coalesce(sign(return_1h), 0) AS sg FROM one"""
    three = f"SELECT *, CASE WHEN abs(return_1h) > volatility THEN sign(return_1h) ELSE 0 END AS big, CASE WHEN sg = lag(sg) {w} THEN 0 ELSE 1 END AS ch FROM two"
    four = f"SELECT *, sum(ch) OVER (PARTITION BY {part} ORDER BY t ROWS UNBOUNDED PRECEDING) AS isl, CASE WHEN big = lag(big) {w} THEN 0 ELSE 1 END AS bch FROM three"
    five = f"SELECT *, CAST(sg * row_number() OVER (PARTITION BY {part}, isl ORDER BY t) AS BIGINT) AS streak_signed, sum(bch) OVER (PARTITION BY {part} ORDER BY t ROWS UNBOUNDED PRECEDING) AS bisl FROM four"
    six = f"SELECT *, CAST(big * row_number() OVER (PARTITION BY {part}, bisl ORDER BY t) AS BIGINT) AS streak_big, coalesce(lag(streak_signed) {w}, 0) AS streak FROM five"
    return [one, two, three, four, five, six]


def nested(steps: list[str]) -> str:
    names = ["one", "two", "three", "four", "five", "six"]
    body = steps[0]
    for name, step in zip(names, steps[1:], strict=False):
        body = step.replace(f"FROM {name}", f"FROM ({body}) AS {name}")
    return body


cte("pool", nested(pool_sql("bars_1h")))
cte("pool_daily", nested(pool_sql("bars_daily")))
cte("vr_rows", f"SELECT *, lag(ratio) OVER (PARTITION BY asset ORDER BY t) AS vol_ratio FROM (SELECT *, ({roll('stddev_samp(return_1h)', 'return_1h', 24)}) / nullif({roll('stddev_samp(return_1h)', 'return_1h', 168)}, 0) AS ratio FROM pool) AS x")


def pool(spark: SparkSession, sf_dir: str, patterns: bool = False) -> DataFrame:
    return X.forward_return(X.atom_pool(B.bars(spark, sf_dir), patterns=patterns))


def daily_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.streak_before(X.forward_return(X.atom_pool(B.bars_daily(spark, sf_dir), patterns=False)))


def pool_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.streak_before(pool(spark, sf_dir))


# ---- sources

@query("s1_tidy_bars", "asset res ts:i open:d high:d low:d close:d volume:d", "SELECT asset, '5m' AS res, t AS ts, open, high, low, close, volume FROM bars_5m")
def s1(spark, sf):
    """Text columns, odd headers, and every row twice with an older version first."""
    bars = B.bars(spark, sf, "5m")
    text = bars.select("asset", "res", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias(" Time "), *[F.col(c).cast("string").alias(c.upper()) for c in S.PRICES])
    old = text.withColumn("CLOSE", F.lit("1")).withColumn("_seq", F.lit(0))
    bad = text.withColumn(" Time ", F.lit("never")).withColumn("_seq", F.lit(2))
    return S.tidy_ohlcv(old.unionByName(text.withColumn("_seq", F.lit(1))).unionByName(bad))


@query("s2_parse_klines", "asset ts:i open:d high:d low:d close:d volume:d", "SELECT asset, t AS ts, open, high, low, close, volume FROM bars_1h")
def s2(spark, sf):
    b = B.bars(spark, sf)
    row = F.array((F.unix_seconds("ts") * 1000).cast("string"), *[F.col(c).cast("string") for c in S.PRICES], F.lit("0"))
    raw = b.groupBy("asset", F.to_date("ts").alias("d")).agg(F.to_json(F.collect_list(row)).alias("payload"))
    return S.parse_klines(raw, "payload", A)


@query("s3_parse_timeline", "symbol date:i news_tone:d", "SELECT symbol, day AS date, news_tone FROM news")
def s3(spark, sf):
    n = B.news_like(spark, sf)
    item = F.struct(F.date_format("date", "yyyyMMdd'T'000000'Z'").alias("date"), F.col("news_tone").alias("value"))
    raw = n.groupBy("symbol", F.month("date").alias("m")).agg(F.to_json(F.struct(F.array(F.struct(F.collect_list(item).alias("data"))).alias("timeline"))).alias("payload"))
    return S.parse_timeline(raw, "payload", ["symbol"], "news_tone")


@query("s4_funding_by_hour", "asset ts:i funding_rate:d", "SELECT asset, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS ts, last(k ORDER BY ts, k) AS funding_rate FROM ticks WHERE k IS NOT NULL GROUP BY asset, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT)")
def s4(spark, sf):
    raw = B.ticks(spark, sf).select("asset", "ts", F.get_json_object("props", "$.k").cast("double").alias("funding_rate"), F.lit(None).cast("double").alias("mark_price"))
    return S.tidy_funding(raw)


@query("s5_tidy_news", "symbol date:i news_tone:d news_volume:d", "SELECT symbol, day AS date, news_tone, news_volume FROM news")
def s5(spark, sf):
    n = B.news_like(spark, sf)
    return S.tidy_news(n.select("symbol", F.col("date").cast("string").alias("Date"), F.col("news_tone").alias("tone"), F.col("news_volume").alias("Volume")))


@query("s6_incremental_append", "asset res ts:i close:d", "SELECT asset, '1h' AS res, t AS ts, CASE WHEN (t // 3600) % 3 = 0 THEN close + 1 ELSE close END AS close FROM bars_1h")
def s6(spark, sf):
    b = B.bars(spark, sf)
    hour = F.floor(F.unix_seconds("ts") / 3600)
    return S.incremental_append(b.where(hour % 3 != 1), b.where(hour % 3 < 2).withColumn("close", F.when(hour % 3 == 0, F.col("close") + 1).otherwise(F.col("close"))), ["asset", "res", "ts"])


@query("s7_s8_rule_memory", "asset event direction:i consistency:d folds_present:i", "SELECT asset, 'h=' || CAST((t // 3600) % 24 AS VARCHAR) AS event, CASE WHEN avg(close) > 1050 THEN 1 ELSE 0 END AS direction, round(avg(volume), 3) AS consistency, count(*) AS folds_present FROM bars_1h GROUP BY ALL")
def s8(spark, sf):
    """Rules as the JSON map of a memory file, read back."""
    hour = F.hour("ts").cast("string")
    rules = B.bars(spark, sf).groupBy("asset", F.concat(F.lit("h="), hour).alias("event")).agg((F.avg("close") > 1050).cast("int").alias("direction"), F.round(F.avg("volume"), 3).alias("consistency"), F.count("*").cast("int").alias("folds_present"))
    entry = F.struct("event", F.struct("direction", "consistency", "folds_present").alias("rule"))
    raw = rules.groupBy("asset").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("payload"))
    return S.parse_rules(raw)


@query("s7_ledger", "asset bar_ts direction source outcome forward_return_pct:d", "SELECT asset, strftime(to_timestamp(t) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS bar_ts, CASE WHEN streak < 0 THEN 'UP' ELSE 'DOWN' END AS direction, CASE WHEN (t // 3600) % 2 = 0 THEN 'even' ELSE 'odd' END AS source, CASE WHEN sign(fwd) = -sign(streak) THEN 'hit' WHEN fwd IS NOT NULL THEN 'miss' END AS outcome, 100 * fwd AS forward_return_pct FROM pool WHERE abs(streak) >= 2")
def s7(spark, sf):
    """Scored signals written to a ledger in two appends, one for each source, and read back."""
    rows = pool_streak(spark, sf).where(F.abs("streak") >= 2)
    hit = F.signum("fwd") == -F.signum("streak")
    rows = rows.select("asset", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("bar_ts"), F.when(F.col("streak") < 0, "UP").otherwise("DOWN").alias("direction"), F.when(F.hour("ts") % 2 == 0, "even").otherwise("odd").alias("source"), F.when(hit, "hit").when(F.col("fwd").isNotNull(), "miss").alias("outcome"), (100 * F.col("fwd")).alias("forward_return_pct"))
    path = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    rows = stored(rows, "signals")
    for source in ("even", "odd"):
        S.write_ledger(rows.where(F.col("source") == source), path)
    return S.read_ledger(spark, path)


# ---- resampling and alignment

@query("r1_resample", "asset res ts:i open:d high:d low:d close:d volume:d", "SELECT asset, '4h' AS res, t AS ts, open, high, low, close, volume FROM bars_4h")
def r1(spark, sf):
    return R.resample_ohlcv(B.bars(spark, sf, "5m"), "4h")


@query("r2_rollup_ladder", "asset res ts:i open:d high:d low:d close:d volume:d", "SELECT asset, '15m' AS res, t AS ts, open, high, low, close, volume FROM bars_15m UNION ALL SELECT asset, '1h', t, open, high, low, close, volume FROM bars_1h UNION ALL SELECT asset, '4h', t, open, high, low, close, volume FROM bars_4h")
def r2(spark, sf):
    return R.rollup_ladder(B.bars(spark, sf, "5m"), ["15m", "1h", "4h"])


_GRID = "SELECT asset, unnest(range(min(t // 14400 * 14400), max(t // 14400 * 14400) + 14400, 14400)) AS t FROM bars_1h GROUP BY asset"


@query("r3_resample_last", "asset ts:i close:d", f"SELECT asset, t AS ts, last_value(c IGNORE NULLS) OVER (PARTITION BY asset ORDER BY t ROWS UNBOUNDED PRECEDING) AS close FROM (SELECT g.asset, g.t, b.close AS c FROM ({_GRID}) AS g LEFT JOIN bars_4h AS b USING (asset, t)) AS x")
def r3(spark, sf):
    return R.resample_last(B.bars(spark, sf), "close", "4h", A, fill=True)


@query("r4_resample_sum", "asset ts:i return_1h:d", f"SELECT g.asset, g.t AS ts, coalesce(s, 0.0) AS return_1h FROM ({_GRID}) AS g LEFT JOIN (SELECT asset, t // 14400 * 14400 AS t, sum(return_1h) AS s FROM pool GROUP BY ALL) AS b USING (asset, t)")
def r4(spark, sf):
    return R.resample_sum(X.pct_return(B.bars(spark, sf), 1, name="return_1h"), "return_1h", "4h", A)


@query("r5_asof_join", "asset ts:i close:d funding_rate:d", "SELECT b.asset, b.t AS ts, b.close, CASE WHEN b.t - f.t <= 14400 THEN f.funding_rate END AS funding_rate FROM bars_1h AS b ASOF LEFT JOIN funding AS f ON b.asset = f.asset AND b.t >= f.t")
def r5(spark, sf):
    return R.asof_join(B.bars(spark, sf).select("asset", "ts", "close"), B.funding_like(spark, sf), tolerance="4h")


@query("r5_asof_slices", "asset ts:i close:d funding_rate:d", "SELECT b.asset, b.t AS ts, b.close, CASE WHEN b.t - f.t <= 14400 THEN f.funding_rate END AS funding_rate FROM bars_1h AS b ASOF LEFT JOIN funding AS f ON b.asset = f.asset AND b.t >= f.t")
def r5s(spark, sf):
    """The same with each asset in slices of 40 rows, each a task's."""
    return R.asof_join(B.bars(spark, sf).select("asset", "ts", "close"), B.funding_like(spark, sf), tolerance="4h", rows=40)


@query("r6_available_at", "asset ts:i day_close:d", "SELECT b.asset, b.t AS ts, d.close AS day_close FROM bars_1h AS b ASOF LEFT JOIN (SELECT asset, t // 86400 * 86400 + 86400 AS av, last(close ORDER BY t) AS close FROM bars_1h GROUP BY ALL) AS d ON b.asset = d.asset AND b.t >= d.av")
def r6(spark, sf):
    b = B.bars(spark, sf)
    days = R.available_at(R.resample_ohlcv(b, "1d"), "ts", "1d").select("asset", "available_at", F.col("close").alias("day_close"))
    return R.asof_join(b.select("asset", "ts"), days, right_on="available_at")


cte("news_feat", f"SELECT symbol, t + 1 AS day, news_tone, news_tone - lag(news_tone) OVER (PARTITION BY symbol ORDER BY t) AS news_tone_chg, (news_volume - {roll('avg(news_volume)', 'news_volume', 5, part='symbol')}) / nullif({roll('stddev_samp(news_volume)', 'news_volume', 5, part='symbol')}, 0) AS news_vol_z FROM (SELECT *, day AS t FROM news) AS n")


@query("r7_f19_news_features", "asset ts:i news_tone:d news_tone_chg:d news_vol_z:d", "SELECT asset, t AS ts, last_value(n.news_tone IGNORE NULLS) OVER w AS news_tone, last_value(n.news_tone_chg IGNORE NULLS) OVER w AS news_tone_chg, last_value(n.news_vol_z IGNORE NULLS) OVER w AS news_vol_z FROM bars_4h AS b LEFT JOIN news_feat AS n ON b.t // 86400 = n.day WINDOW w AS (PARTITION BY asset ORDER BY t ROWS UNBOUNDED PRECEDING)")
def r7(spark, sf):
    return R.ffill_daily(B.bars(spark, sf, "4h"), X.news_features(B.news_like(spark, sf), 5).drop("symbol"))


@query("r8_align_assets", "ts:i a_close:d b_close:d a_return_1h:d b_return_1h:d", "SELECT a.t AS ts, a.close AS a_close, b.close AS b_close, a.return_1h AS a_return_1h, b.return_1h AS b_return_1h FROM pool AS a JOIN pool AS b USING (t) WHERE a.asset = 'click' AND b.asset = 'view'")
def r8(spark, sf):
    return R.align_assets(X.pct_return(B.bars(spark, sf), 1, name="return_1h"), "click", "view", ["close", "return_1h"])


@query("r9_panel_closes", "ts:i click:d view:d", "SELECT t AS ts, max(close) FILTER (asset = 'click') AS click, max(close) FILTER (asset = 'view') AS view FROM bars_1h GROUP BY t")
def r9(spark, sf):
    return R.panel_closes(B.bars(spark, sf), ["click", "view"])


cte("weekly", "SELECT g.asset, g.t AS week, d.close FROM (SELECT asset, unnest(range(CAST(ceil((min(t) // 86400 - 4) / 7.0) * 7 + 4 AS BIGINT) * 86400, max(t) + 1, 604800)) AS t FROM panel_daily GROUP BY asset) AS g ASOF JOIN panel_daily AS d ON g.asset = d.asset AND g.t >= d.t")


@query("r10_calendar_sample", "asset week:i close:d", "SELECT asset, week // 86400 AS week, close FROM weekly")
def r10(spark, sf):
    return R.calendar_sample(B.panel(spark, sf))


cte("vol_hours", f"SELECT asset, t, row_number() OVER (PARTITION BY asset ORDER BY vol DESC, t) AS r FROM (SELECT asset, t, {roll('stddev_samp(return_1h)', 'return_1h', 24)} AS vol FROM pool) AS x WHERE vol IS NOT NULL")
# one window more in each round: the first hour in order of volatility that is over 12 hours from all chosen ones
cte("vol_picks", "WITH RECURSIVE pick AS (SELECT DISTINCT asset, CAST([] AS BIGINT[]) AS chosen FROM vol_hours UNION ALL SELECT asset, list_append(any_value(chosen), arg_min(t, r)) FROM (SELECT p.asset, p.chosen, h.t, h.r FROM pick AS p JOIN vol_hours AS h ON h.asset = p.asset WHERE len(p.chosen) < 5 AND len(list_filter(p.chosen, lambda c: abs(c - h.t) <= 43200)) = 0) AS x GROUP BY asset) SELECT asset, unnest(list_sort(chosen)) AS center, unnest(range(len(chosen))) AS segment FROM (SELECT asset, arg_max(chosen, len(chosen)) AS chosen FROM pick GROUP BY asset) AS y")


@query("r11_top_vol_windows", "asset ts:i segment:i close:d", "SELECT b.asset, b.t AS ts, v.segment, b.close FROM bars_5m AS b JOIN vol_picks AS v ON b.asset = v.asset AND abs(b.t - v.center) <= 21600")
def r11(spark, sf):
    hourly = X.rolling_vol(X.pct_return(B.bars(spark, sf), 1, name="return_1h"), 24).select("asset", "ts", F.col("volatility").alias("vol"))
    return R.top_vol_windows(hourly, B.bars(spark, sf, "5m"), k=5, hours=6)


@query("r12_outer_merge", "symbol date:i news_tone:d news_volume:d", "SELECT 'all' AS symbol, day AS date, CASE WHEN day % 3 > 0 THEN news_tone END AS news_tone, CASE WHEN day % 3 < 2 THEN news_volume END AS news_volume FROM news")
def r12(spark, sf):
    n = B.news_like(spark, sf)
    day = F.datediff("date", F.lit("1970-01-01"))
    return R.outer_merge_daily(n.where(day % 3 > 0).drop("news_volume"), n.where(day % 3 < 2).drop("news_tone"))


@query("r13_date_gaps", "asset gap_start:i gap_end:i n_days:i", "SELECT asset, d + 1 AS gap_start, n - 1 AS gap_end, n - d - 1 AS n_days FROM (SELECT asset, t // 86400 AS d, lead(t // 86400) OVER (PARTITION BY asset ORDER BY t) AS n FROM panel_daily) AS x WHERE n - d > 1")
def r13(spark, sf):
    return R.date_gaps(B.panel(spark, sf).withColumn("date", F.to_date("ts")), "date", A)


@query("r14_freshness", "asset last_ts:i lag_hours:d ok:b", "SELECT asset, l AS last_ts, (m - l) / 3600.0 AS lag_hours, coalesce((m - l) / 3600.0 <= 2, false) AS ok FROM (SELECT asset FROM bars_1h GROUP BY asset UNION ALL SELECT 'absent') AS e LEFT JOIN (SELECT asset, max(t) AS l FROM bars_1h GROUP BY asset) AS x USING (asset), (SELECT max(t) AS m FROM bars_1h) AS y")
def r14(spark, sf):
    b = B.bars(spark, sf)
    expected = b.select("asset").distinct().unionByName(spark.createDataFrame([("absent",)], "asset string"))
    now = b.agg(F.max("ts").alias("now")).first()["now"]
    return R.freshness(b, expected, F.lit(now), 2)


@query("r15_fingerprint", "asset n:i first_ts:i last_ts:i sha256", """SELECT asset, sum(n) AS n, min(a) AS first_ts, max(b) AS last_ts, sha256(string_agg(h, '' ORDER BY d)) AS sha256 FROM (SELECT asset, t // 86400 AS d, count(*) AS n, min(t) AS a, max(t) AS b,
    sha256(string_agg(sha256(concat_ws(',', t, CAST(round(open, 6) AS DECIMAL(38, 6)), CAST(round(high, 6) AS DECIMAL(38, 6)), CAST(round(low, 6) AS DECIMAL(38, 6)), CAST(round(close, 6) AS DECIMAL(38, 6)), CAST(round(volume, 6) AS DECIMAL(38, 6)))), '' ORDER BY t)) AS h FROM bars_1h GROUP BY asset, t // 86400) AS x GROUP BY asset""")
def r15(spark, sf):
    return R.slice_fingerprint(B.bars(spark, sf), by=A)


# ---- features

_F = "asset ts:i "


@query("f1_f6_core_features", _F + "return_1h:d return_6h:d volatility:d volume_zscore:d trend_slope:d range_pct:d close_pos:d return_accel:d volume_trend:d", "SELECT *, t AS ts FROM pool")
def f1(spark, sf):
    return pool(spark, sf)


@query("f7_f10_streaks", _F + "streak_signed:i streak_big:i streak:i", "SELECT *, t AS ts FROM pool")
def f7(spark, sf):
    return pool_streak(spark, sf)


@query("f7_f10_streak_slices", _F + "streak_signed:i streak_big:i streak:i", "SELECT *, t AS ts FROM pool")
def f7s(spark, sf):
    """Runs over slices of 30 rows."""
    rows = pool(spark, sf).drop("streak_signed", "streak_big")
    return X.streak_before(X.streak_big(X.streak_signed(rows, rows=30), rows=30), rows=30)


@query("f9_session_streak", _F + "streak:i", "SELECT asset, t AS ts, CAST(s * row_number() OVER (PARTITION BY asset, d, isl ORDER BY t) AS BIGINT) AS streak FROM (SELECT *, sum(ch) OVER (PARTITION BY asset, d ORDER BY t ROWS UNBOUNDED PRECEDING) AS isl FROM (SELECT *, CASE WHEN s = lag(s) OVER (PARTITION BY asset, d ORDER BY t) THEN 0 ELSE 1 END AS ch FROM (SELECT asset, t, t // 86400 AS d, coalesce(sign(lag(return_1h) OVER (PARTITION BY asset ORDER BY t)), 0) AS s FROM pool) AS a) AS b) AS c")
def f9(spark, sf):
    return X.streak_session(pool(spark, sf))


_PREV = "lag({}) OVER (PARTITION BY asset ORDER BY t)"
cte("ohlc", f"SELECT *, {_PREV.format('open')} AS po, {_PREV.format('close')} AS pc, {_PREV.format('high')} AS ph, {_PREV.format('low')} AS pl, {roll('max(high)', 'high', 24, -1)} AS rh, {roll('min(low)', 'low', 24, -1)} AS rl, close / nullif(lag(close, 5) OVER (PARTITION BY asset ORDER BY t), 0) - 1 AS mv, {roll('stddev_samp(return_1h)', 'return_1h', 24)} AS vl, {roll('stddev_samp(return_1h)', 'return_1h', 5)} AS vs FROM pool")


@query("f11_candles", _F + "doji:d bullish_engulfing:d bearish_engulfing:d", "SELECT asset, t AS ts, CAST(coalesce(abs(close - open) / nullif(high - low, 0) < 0.1, false) AS INT) AS doji, CAST(coalesce(pc < po AND close > open AND open <= pc AND close >= po, false) AS INT) AS bullish_engulfing, CAST(coalesce(pc > po AND close < open AND open >= pc AND close <= po, false) AS INT) AS bearish_engulfing FROM ohlc")
def f11(spark, sf):
    return X.candle_flags(B.bars(spark, sf))


@query("f12_f13_breakouts_flags", _F + "breakout_up:d breakout_down:d bull_flag:d bear_flag:d", "SELECT asset, t AS ts, CAST(close > rh AS INT) AS breakout_up, CAST(close < rl AS INT) AS breakout_down, CASE WHEN vl IS NOT NULL AND vs IS NOT NULL THEN CAST(coalesce(mv >= 0.015 AND vs <= vl * 0.55, false) AS INT) END AS bull_flag, CASE WHEN vl IS NOT NULL AND vs IS NOT NULL THEN CAST(coalesce(mv <= -0.015 AND vs <= vl * 0.55, false) AS INT) END AS bear_flag FROM ohlc")
def f12(spark, sf):
    return X.flags(X.breakouts(pool(spark, sf)))


@query("f14_double_extremes", _F + "double_top:d double_bottom:d", f"""SELECT asset, t AS ts, CASE WHEN bd IS NOT NULL THEN CAST(coalesce(nt = 1 AND ({roll('sum(nt)', 'nt', 24)}) >= 2 AND close < rh * 0.999, false) AS INT) END AS double_top, CASE WHEN bd IS NOT NULL THEN CAST(coalesce(nb = 1 AND ({roll('sum(nb)', 'nb', 24)}) >= 2 AND close > rl * 1.001, false) AS INT) END AS double_bottom
    FROM (SELECT *, CAST(coalesce(high >= rh - 0.08 * bd, false) AS INT) AS nt, CAST(coalesce(low <= rl + 0.08 * bd, false) AS INT) AS nb FROM (SELECT *, nullif(rh - rl, 0) AS bd FROM ohlc) AS a) AS b""")
def f14(spark, sf):
    return X.double_extremes(B.bars(spark, sf))


@query("f15_trend_flags", _F + "trend_hh_hl:d trend_lh_ll:d", f"SELECT asset, t AS ts, CAST(({roll('avg(hh)', 'hh', 12)}) >= 0.55 AND ({roll('avg(hl)', 'hl', 12)}) >= 0.55 AS INT) AS trend_hh_hl, CAST(({roll('avg(lh)', 'lh', 12)}) >= 0.55 AND ({roll('avg(ll)', 'll', 12)}) >= 0.55 AS INT) AS trend_lh_ll FROM (SELECT *, CAST(coalesce(high > ph, false) AS INT) AS hh, CAST(coalesce(low > pl, false) AS INT) AS hl, CAST(coalesce(high < ph, false) AS INT) AS lh, CAST(coalesce(low < pl, false) AS INT) AS ll FROM ohlc) AS x")
def f15(spark, sf):
    return X.trend_flags(B.bars(spark, sf))


@query("f16_f18_ratio_targets", _F + "vol_ratio:d fwd:d up:i material:i", "SELECT asset, t AS ts, vol_ratio, fwd, CAST(fwd > 0 AS INT) AS up, CASE WHEN fwd > 0.01 THEN 1 WHEN fwd < -0.01 THEN 0 END AS material FROM vr_rows")
def f16(spark, sf):
    return X.material_direction(X.material_direction(X.vol_ratio(pool(spark, sf))), 0.01, name="material")


@query("f20_atoms", _F + "close_pos:d range_pct:d streak_signed:i", "SELECT *, t AS ts FROM pool WHERE close_pos IS NOT NULL AND range_pct IS NOT NULL AND streak_signed IS NOT NULL")
def f20(spark, sf):
    return X.atoms(pool(spark, sf), X.ATOM_SETS["path_lean3"])


cte("seg_bars", "SELECT *, t // 86400 AS segment FROM bars_5m")
cte("seg_pool", nested(pool_sql("seg_bars", "asset, segment")))


@query("f21_segment_features", _F + "return_6h:d volatility:d streak_signed:i fwd:d", "SELECT *, t AS ts FROM seg_pool")
def f21(spark, sf):
    b = B.bars(spark, sf, "5m").withColumn("segment", F.datediff(F.to_date("ts"), F.lit("1970-01-01")))
    by = ["asset", "res", "segment"]
    return X.forward_return(X.atom_pool(b, by, patterns=False), 1, by)


_SYM = "CASE WHEN return_1h > 0 THEN 'U' WHEN return_1h <= 0 THEN 'D' END"
cte("grams", "SELECT asset, t, up, k, gram FROM (SELECT asset, t, CAST(return_1h > 0 AS INT) AS up, 2 AS k, lag(sy, 2) OVER w || lag(sy) OVER w AS gram FROM (SELECT *, " + _SYM + " AS sy FROM pool) AS a WINDOW w AS (PARTITION BY asset ORDER BY t) UNION ALL SELECT asset, t, CAST(return_1h > 0 AS INT), 3, lag(sy, 3) OVER w || lag(sy, 2) OVER w || lag(sy) OVER w FROM (SELECT *, " + _SYM + " AS sy FROM pool) AS a WINDOW w AS (PARTITION BY asset ORDER BY t)) AS g")


@query("f22_kgram", _F + "gram up:i", "SELECT asset, t AS ts, gram, up FROM grams WHERE k = 3")
def f22(spark, sf):
    return X.kgram(pool(spark, sf), 3)


@query("f23_sequence_window", _F + "n:i first:d last:d y:i", f"SELECT asset, t AS ts, 6 AS n, CAST(lag(close_pos, 5) OVER w AS FLOAT) AS first, CAST(close_pos AS FLOAT) AS last, CAST(fwd > 0 AS INT) AS y FROM (SELECT * FROM pool WHERE close_pos IS NOT NULL AND return_1h IS NOT NULL) AS x WINDOW w AS (PARTITION BY asset ORDER BY t) QUALIFY row_number() OVER w >= 6")
def f23(spark, sf):
    out = X.sequence_window(X.material_direction(pool(spark, sf)), ["close_pos", "return_1h"], 6)
    return out.withColumns({"n": F.size("x"), "first": F.col("x")[0][0], "last": F.col("x")[5][0]})


@query("f24_recent_vol", _F + "recent_vol:d", f"SELECT asset, t AS ts, {roll('avg(abs(return_1h))', 'return_1h', 5, -1)} AS recent_vol FROM pool_daily")
def f24(spark, sf):
    return X.recent_vol(daily_pool(spark, sf))


@query("chunked_features", _F + "return_6h:d volatility:d", "SELECT *, t AS ts FROM pool")
def chunks(spark, sf):
    """The same features with long series cut into overlapping chunks."""
    b = B.bars(spark, sf)
    return chunked(b, lambda d, by: X.rolling_vol(X.pct_return(X.pct_return(d, 1, by, name="return_1h"), 6, by, name="return_6h"), 24, by), rows=100, overlap=30, by=["asset", "res"])


# ---- states

_THREE = ("return_1h", "volume_zscore", "trend_slope")
cte("known", "SELECT *, row_number() OVER (PARTITION BY asset ORDER BY t) AS pos, count(*) OVER (PARTITION BY asset) AS n_all FROM pool WHERE return_1h IS NOT NULL AND volume_zscore IS NOT NULL AND trend_slope IS NOT NULL")
cte("parted", "SELECT *, CASE WHEN pos <= floor(n_all * (1 - 0.3) + 1e-9) THEN 'dev' ELSE 'hold' END AS part FROM known")


def cuts_sql(src: str, where: str, keys: str, names=_THREE) -> str:
    return f"SELECT {keys}, " + ", ".join(f"quantile_cont({n}, 1.0 / 3) AS {n}_lo, quantile_cont({n}, 2.0 / 3) AS {n}_hi" for n in names) + f" FROM {src} WHERE {where} GROUP BY {keys}"


def states_sql(src: str, cuts: str, keys: str, names=_THREE) -> str:
    return "SELECT x.* EXCLUDE (" + ", ".join(names) + "), " + ", ".join(f"CASE WHEN round(x.{n}, 10) <= round(c.{n}_lo, 10) THEN 'LOW' WHEN round(x.{n}, 10) >= round(c.{n}_hi, 10) THEN 'HIGH' ELSE 'MID' END AS {n}" for n in names) + f" FROM {src} AS x JOIN {cuts} AS c USING ({keys})"


cte("cuts", cuts_sql("parted", "part = 'dev'", "asset"))
cte("states", states_sql("parted", "cuts", "asset"))


def known(spark, sf) -> DataFrame:
    return pool(spark, sf).dropna(subset=list(_THREE))


def states(spark, sf) -> DataFrame:
    split = P.chrono_split(known(spark, sf), 0.3)
    return P.discretize(split, P.fit_thresholds(split.where("part = 'dev'"), _THREE), _THREE)


@query("p1_thresholds", "asset atom lo:d hi:d", " UNION ALL ".join(f"SELECT asset, '{n}' AS atom, {n}_lo AS lo, {n}_hi AS hi FROM cuts" for n in _THREE) + " UNION ALL SELECT asset, 'streak_signed', -2, 2 FROM cuts")
def p1(spark, sf):
    return P.fit_thresholds(P.chrono_split(known(spark, sf), 0.3).where("part = 'dev'"), [*_THREE, "streak_signed"])


@query("p1_thresholds_large", "asset atom lo:d hi:d", " UNION ALL ".join(f"SELECT asset, '{n}' AS atom, {n}_lo AS lo, {n}_hi AS hi FROM cuts" for n in _THREE) + " UNION ALL SELECT asset, 'streak_signed', -2, 2 FROM cuts")
def p1l(spark, sf):
    """By sketched intervals and exact counts inside them."""
    return P.fit_thresholds(P.chrono_split(known(spark, sf), 0.3).where("part = 'dev'"), [*_THREE, "streak_signed"], large=True)


@query("p2_p14_discretize", _F + "part return_1h volume_zscore trend_slope", "SELECT *, t AS ts FROM states")
def p2(spark, sf):
    return states(spark, sf)


def events_sql(src: str, keys: str, names=_THREE, sizes=(2, 3)) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, {' || '.join(repr(('|' if i else '') + c + '=') + ' || ' + c for i, c in enumerate(combo))} AS event FROM {src}" for combo in P.combos(names, sizes))


cte("events_long", events_sql("states", "asset, t, part, fwd"))


@query("p3_events", _F + "event", "SELECT *, t AS ts FROM events_long WHERE event NOT LIKE '%return_1h=MID%'")
def p3(spark, sf):
    s = states(spark, sf)
    blocked = P.build_events(s, _THREE).where(F.col("event").contains("return_1h=MID")).select("event").distinct()
    return P.build_events(s, _THREE, blocked=blocked)


@query("p4_frequent", "asset event n:i", "SELECT asset, event, count(*) AS n FROM events_long GROUP BY ALL HAVING count(*) >= 25")
def p4(spark, sf):
    return P.frequent_events(P.build_events(states(spark, sf), _THREE), 25)


cte("shocks", """SELECT *, CASE WHEN up AND sp THEN 'COMBINED_UP' WHEN dn AND sp THEN 'COMBINED_DOWN' WHEN up THEN 'PRICE_UP' WHEN dn THEN 'PRICE_DOWN' WHEN sp THEN 'VOLUME_SPIKE' ELSE '' END AS change_type, CAST(up OR dn OR sp AS INT) AS any_shock
    FROM (SELECT *, coalesce(return_1h > 1.5 * volatility, false) AS up, coalesce(return_1h < -1.5 * volatility, false) AS dn, coalesce(abs(volume_zscore) > 2, false) AS sp FROM pool) AS x""")


@query("p5_p7_changes", _F + "change_type price_shock:b volume_shock:b regime", "SELECT asset, t AS ts, change_type, up OR dn AS price_shock, sp AS volume_shock, CASE WHEN any_shock = 1 THEN 'SHOCK_ACTIVE' WHEN max(any_shock) OVER (PARTITION BY asset ORDER BY t ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) = 1 THEN 'POST_SHOCK' ELSE 'NORMAL' END AS regime FROM shocks")
def p5(spark, sf):
    return P.shock_regime(P.significant_changes(pool(spark, sf), 1.5))


@query("p6_change_summary", "asset change_type n:i mean_fwd:d", "SELECT asset, change_type, count(*) AS n, avg(fwd) AS mean_fwd FROM shocks WHERE change_type <> '' GROUP BY ALL")
def p6(spark, sf):
    return P.summarize_changes(P.significant_changes(pool(spark, sf), 1.5))[0]


cte("vr_cut", "SELECT asset, quantile_cont(vol_ratio, 1.0 / 3) AS lo, quantile_cont(vol_ratio, 2.0 / 3) AS hi FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY t) AS pos, count(*) OVER (PARTITION BY asset) AS n_all FROM vr_rows) AS x WHERE pos <= floor(n_all * 0.7 + 1e-9) GROUP BY asset")
cte("vr_state", "SELECT x.*, CASE WHEN vol_ratio <= lo THEN 'LOW_VR' WHEN vol_ratio >= hi THEN 'HIGH_VR' ELSE 'NORMAL' END AS vr FROM vr_rows AS x LEFT JOIN vr_cut USING (asset)")


@query("p8_p11_regime_state", _F + "vr streak_bucket state", "SELECT asset, t AS ts, vr, b AS streak_bucket, b || '|' || vr AS state FROM (SELECT *, CASE WHEN streak <= -3 THEN 'strong_down' WHEN streak >= 3 THEN 'strong_up' ELSE 'mild' END AS b FROM vr_state) AS x")
def p8(spark, sf):
    return P.state_key(P.vr_regime(X.vol_ratio(pool_streak(spark, sf))))


cte("fund_part", "SELECT *, CASE WHEN row_number() OVER (PARTITION BY asset ORDER BY t) <= floor(count(*) OVER (PARTITION BY asset) * 0.7 + 1e-9) THEN 'dev' ELSE 'hold' END AS part FROM funding")


@query("p9_decile_state", _F + "bucket", "SELECT f.asset, f.t AS ts, CASE WHEN funding_rate <= lo THEN 'EXTREME_NEG' WHEN funding_rate >= hi THEN 'EXTREME_POS' ELSE 'NEUTRAL' END AS bucket FROM funding AS f JOIN (SELECT asset, quantile_cont(funding_rate, 0.1) AS lo, quantile_cont(funding_rate, 0.9) AS hi FROM fund_part WHERE part = 'dev' GROUP BY asset) AS c USING (asset)")
def p9(spark, sf):
    return P.decile_state(B.funding_like(spark, sf), "funding_rate", by=A)


@query("p12_contrarian", _F + "sig:i", "SELECT asset, t AS ts, CASE WHEN abs(streak) >= 2 THEN -sign(streak) ELSE 0 END AS sig FROM pool")
def p12(spark, sf):
    return P.contrarian_signal(pool_streak(spark, sf))


@query("p13_quantile_bins", _F + "bin:i", "SELECT asset, t AS ts, len(list_filter(list_distinct(e), lambda x: x <= close_pos)) AS bin FROM pool JOIN (SELECT asset, [" + ", ".join(f"quantile_cont(close_pos, {i} / 5.0)" for i in range(1, 5)) + "] AS e FROM pool GROUP BY asset) AS q USING (asset) WHERE close_pos IS NOT NULL")
def p13(spark, sf):
    return P.quantile_bins(pool(spark, sf), "close_pos", 5).where("bin is not null")


@query("p13_quantile_bins_large", _F + "bin:i", "SELECT asset, t AS ts, len(list_filter(list_distinct(e), lambda x: x <= close_pos)) AS bin FROM pool JOIN (SELECT asset, [" + ", ".join(f"quantile_cont(close_pos, {i} / 5.0)" for i in range(1, 5)) + "] AS e FROM pool GROUP BY asset) AS q USING (asset) WHERE close_pos IS NOT NULL")
def p13l(spark, sf):
    return P.quantile_bins(pool(spark, sf), "close_pos", 5, large=True).where("bin is not null")


@query("p14_splits", _F + "two three", "SELECT asset, t AS ts, CASE WHEN r <= floor(n * 0.7 + 1e-9) THEN 'dev' ELSE 'hold' END AS two, CASE WHEN r <= floor(n * 0.55 + 1e-9) THEN 'train' WHEN r <= floor(n * 0.8 + 1e-9) THEN 'validate' ELSE 'test' END AS three FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY t) AS r, count(*) OVER (PARTITION BY asset) AS n FROM bars_1h) AS x")
def p14(spark, sf):
    return P.three_way(P.chrono_split(B.bars(spark, sf), name="two"), name="three")


@query("p14_split_slices", _F + "two three", "SELECT asset, t AS ts, CASE WHEN r <= floor(n * 0.7 + 1e-9) THEN 'dev' ELSE 'hold' END AS two, CASE WHEN r <= floor(n * 0.55 + 1e-9) THEN 'train' WHEN r <= floor(n * 0.8 + 1e-9) THEN 'validate' ELSE 'test' END AS three FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY t) AS r, count(*) OVER (PARTITION BY asset) AS n FROM bars_1h) AS x")
def p14s(spark, sf):
    return P.three_way(P.chrono_split(B.bars(spark, sf), name="two", rows=50), name="three", rows=50)


def folds_sql(src: str, n_folds: int = 5, initial: float = 0.4, keys: str = "asset") -> str:
    return f"""SELECT * FROM (SELECT *, CASE WHEN r < st + fold * sp THEN 'train' WHEN r < CASE WHEN fold = {n_folds - 1} THEN n ELSE st + (fold + 1) * sp END THEN 'test' END AS role FROM (SELECT *, greatest(1, floor((n - st) / {n_folds})) AS sp, unnest(range({n_folds})) AS fold FROM
        (SELECT *, floor(n * {initial} + 1e-9) AS st FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY t) - 1 AS r, count(*) OVER (PARTITION BY {keys}) AS n FROM {src}) AS a) AS b) AS c) AS d WHERE role IS NOT NULL"""


cte("folded", folds_sql("known"))


@query("p15_folds", "asset fold:i role n:i first_ts:i last_ts:i", "SELECT asset, fold, role, count(*) AS n, min(t) AS first_ts, max(t) AS last_ts FROM folded GROUP BY ALL")
def p15(spark, sf):
    return P.assign_folds(known(spark, sf)).groupBy("asset", "fold", "role").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("p16_asset_symbol", "name symbol interval", "SELECT asset || '_1h' AS name, asset AS symbol, '1h' AS interval FROM bars_1h GROUP BY asset UNION ALL SELECT asset, asset, NULL FROM bars_1h GROUP BY asset")
def p16(spark, sf):
    names = B.bars(spark, sf).select(F.explode(F.array(F.concat("asset", F.lit("_"), "res"), F.col("asset"))).alias("name")).distinct()
    symbol, interval = P.asset_symbol("name")
    return names.select("name", symbol.alias("symbol"), interval.alias("interval"))

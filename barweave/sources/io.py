"""Sources and sinks: bars, klines, funding, news, ledgers, rule memory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

BAR = "asset string, res string, ts timestamp, open double, high double, low double, close double, volume double"
LEDGER = (
    "track_id string, asset string, bar_ts string, logged_at string, direction string, source string, label string, confidence_pct double, conviction_tier string, regime string, vr_regime string, "
    "primary_status string, reason string, outcome string, actual_direction string, forward_return_pct double, traded boolean, entry_bar_ts string, entry_price double, planned_exit_bar_ts string, fee_bps double, "
    "hold_cycle_pnl double, hold_cycle_outcome string, recorded_utc string, period_ts string, funding_rate double, gate_on boolean, regime_trailing_30d_annualized double, regime_hot boolean"
)
RULE = "struct<direction:int,consistency:double,avg_oos_hit:double,avg_confidence:double,folds_present:int,stability:double>"
TIME_NAMES = ("timestamp", "time", "date", "datetime")
PRICES = ("open", "high", "low", "close", "volume")


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], keep: str = "last") -> DataFrame:
    """One row per key: the last or first by ``order``, whose last entries should make it total."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranked = [c.desc_nulls_last() if keep == "last" else c.asc_nulls_last() for c in cols]
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*ranked))).where("_rank = 1").drop("_rank")


def tidy_ohlcv(raw: DataFrame, asset: Column | None = None, res: Column | None = None) -> DataFrame:
    """Rows with text or typed columns to bars: names folded, times parsed, of equal times the last row kept.

    ``_seq`` (a row's place in the input) decides what is last; without it all values together do. A missing column or
    time column raises ValueError; rows with an unreadable time or a missing value go.
    """
    folded = raw.toDF(*[c.strip().lower() for c in raw.columns])
    time = next((c for c in TIME_NAMES if c in folded.columns), None)
    missing = [c for c in PRICES if c not in folded.columns]
    if time is None or missing:
        raise ValueError(f"bars lack {missing or 'a time column'}")
    stamp = F.coalesce(F.try_to_timestamp(F.col(time).cast("string")), F.try_to_timestamp(F.col(time).cast("string"), F.lit("yyyy-MM-dd HH:mm:ssXXX")))
    seq = F.col("_seq") if "_seq" in folded.columns else F.struct(*PRICES)
    named = {"asset": asset if asset is not None else F.col("asset"), "res": res if res is not None else F.col("res")}
    rows = folded.select(*[c.alias(n) for n, c in named.items()], stamp.alias("ts"), *[F.nanvl(F.col(c).try_cast("double"), F.lit(None)).alias(c) for c in PRICES], seq.alias("_seq"))
    return keep_one(rows.where("ts is not null"), ["asset", "res", "ts"], ["_seq"]).drop("_seq").dropna(subset=list(PRICES))


def read_ohlcv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """CSV files named ``{asset}_{interval}.csv``, with headers, to bars."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(paths)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv(?:\.gz)?$", 1)
    raw = raw.withColumns({"asset": F.regexp_replace(name, r"_\d+[smhdw]$", ""), "res": F.regexp_extract(name, r"_(\d+[smhdw])$", 1), "_seq": F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())})
    return tidy_ohlcv(raw, F.col("asset"), F.col("res"))


def parse_klines(df: DataFrame, json_col: str = "payload", keys: Sequence[str] = ()) -> DataFrame:
    """JSON arrays of kline arrays to bars; of equal times the last in the payload stays."""
    rows = df.select(*keys, F.posexplode(F.from_json(json_col, "array<array<string>>")).alias("at", "k"))
    bars = rows.select(*keys, F.timestamp_millis(F.get("k", F.lit(0)).try_cast("long")).alias("ts"), *[F.get("k", F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(PRICES, 1)], "at")
    return keep_one(bars.where("ts is not null"), [*keys, "ts"], ["at", F.struct(*PRICES)]).drop("at")


def parse_timeline(df: DataFrame, json_col: str = "payload", keys: Sequence[str] = (), name: str = "value") -> DataFrame:
    """``{"timeline": [{"data": [{"date", "value"}]}]}`` to (date, value); only the first series counts."""
    data = F.from_json(json_col, "struct<timeline:array<struct<data:array<struct<date:string,value:double>>>>>")
    rows = df.select(*keys, F.explode(F.get(data["timeline"], F.lit(0))["data"]).alias("d"))
    digits = F.substring(F.regexp_replace("d.date", "[^0-9]", ""), 1, 8)
    return rows.select(*keys, F.to_date(F.try_to_timestamp(digits, F.lit("yyyyMMdd"))).alias("date"), F.col("d.value").alias(name)).where("date is not null")


def tidy_funding(raw: DataFrame, keep: str = "last", by: Sequence[str] = ("asset",)) -> DataFrame:
    """Funding rows by hour: rows without a rate go, of an hour the last or first stays."""
    rows = raw.select(*by, F.col("ts").cast("timestamp").alias("at"), F.nanvl(F.col("funding_rate").cast("double"), F.lit(None)).alias("funding_rate"), F.col("mark_price").cast("double").alias("mark_price")).where("funding_rate is not null and at is not null")
    pick = F.max_by if keep == "last" else F.min_by
    return rows.groupBy(*by, F.date_trunc("hour", "at").alias("ts")).agg(pick(F.struct("funding_rate", "mark_price"), F.struct("at", "funding_rate")).alias("v")).select(*by, "ts", "v.*")


def read_funding(spark: SparkSession, path: str, keep: str = "last") -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:_funding)?\.csv$", 1)
    stamp = F.coalesce(F.try_to_timestamp(F.col("timestamp")), F.timestamp_millis(F.col("timestamp").try_cast("long")))
    return tidy_funding(raw.select(name.alias("asset"), stamp.alias("ts"), F.col("funding_rate").try_cast("double").alias("funding_rate"), F.col("mark_price").try_cast("double").alias("mark_price")), keep)


def tidy_news(raw: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Daily news by date; ``tone`` and ``volume`` are other names of the columns; of equal dates the last row stays."""
    names = {"tone": "news_tone", "volume": "news_volume", "timestamp": "date"}
    cols = {c.strip().lower(): c for c in raw.columns}
    pick = lambda c: F.col(cols[c] if c in cols else cols[next(k for k, v in names.items() if v == c)])
    seq = F.col("_seq") if "_seq" in raw.columns else F.lit(0)
    rows = raw.select(*by, F.to_date(pick("date")).alias("date"), pick("news_tone").cast("double").alias("news_tone"), pick("news_volume").cast("double").alias("news_volume"), seq.alias("_seq"))
    return keep_one(rows.where("date is not null"), [*by, "date"], ["_seq", "news_volume", "news_tone"]).drop("_seq")


def read_news(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:_news)?\.csv$", 1)
    return tidy_news(raw.withColumns({"symbol": name, "_seq": F.monotonically_increasing_id()}))


def incremental_append(existing: DataFrame, new: DataFrame, keys: Sequence[str], keep: str = "last") -> DataFrame:
    """The union; of rows with one key that of ``new`` stays ("last") or that of ``existing`` ("first")."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in existing.columns if c not in keys]
    return keep_one(both, keys, ["_new", F.struct(*rest)], keep).drop("_new")


def write_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Overwrite only the partitions that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_ledger(spark: SparkSession, path: str, schema: str = LEDGER) -> DataFrame:
    """A JSON-lines ledger; keys that a row lacks are null, lines that are no JSON go."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_ledger(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).option("ignoreNullFields", True).json(path)


def parse_rules(df: DataFrame, json_col: str = "payload", keys: Sequence[str] = ("asset",)) -> DataFrame:
    """A JSON map of event to rule, one row per event."""
    return df.select(*keys, F.explode(F.from_json(json_col, f"map<string,{RULE}>")).alias("event", "rule")).select(*keys, "event", "rule.*")


def save_rules(rules: DataFrame, path: str) -> None:
    write_partitioned(rules, path, ["asset"])


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

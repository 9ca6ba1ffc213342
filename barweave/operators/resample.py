"""Resampling and alignment of series."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from barweave.functions import slices
from barweave.functions.windows import BY, over, so_far

UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def seconds(rule: str) -> int:
    """"15m" to 900."""
    return int(rule[:-1]) * UNITS[rule[-1]]


def bucket(ts: Column | str, rule: str) -> Column:
    """The start of the interval of ``rule`` that holds a time."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    n = seconds(rule)
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / n) * n)


def ticks_to_bars(ticks: DataFrame, rule: str, by: Sequence[str] = ("asset",)) -> DataFrame:
    """(price, qty, seq) ticks to bars; first and last by time, then seq. Grouped with partial aggregates only."""
    at = F.struct("ts", "seq")
    return ticks.groupBy(*by, bucket("ts", rule).alias("start")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("qty").cast("double").alias("volume")
    ).select(*by, F.lit(rule).alias("res"), F.col("start").alias("ts"), "open", "high", "low", "close", "volume")


def resample_ohlcv(bars: DataFrame, rule: str, by: Sequence[str] = ("asset",)) -> DataFrame:
    """Bars to coarser bars; buckets without bars don't appear."""
    return bars.groupBy(*by, bucket("ts", rule).alias("start")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    ).select(*by, F.lit(rule).alias("res"), F.col("start").alias("ts"), "open", "high", "low", "close", "volume")


def rollup_ladder(bars: DataFrame, rules: Sequence[str], by: Sequence[str] = ("asset",)) -> DataFrame:
    """Bars to several resolutions in one shuffle; each bar is spread over the rules before partial aggregation."""
    rule = F.explode(F.array(*[F.struct(F.lit(r).alias("res"), F.lit(seconds(r)).alias("n")) for r in rules]))
    spread = bars.drop("res").withColumn("_r", rule).withColumn("_start", F.timestamp_seconds(F.floor(F.unix_seconds("ts") / F.col("_r.n")) * F.col("_r.n")))
    return spread.groupBy(*by, F.col("_r.res").alias("res"), "_start").agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    ).withColumnRenamed("_start", "ts")


def dense_grid(df: DataFrame, rule: str, by: Sequence[str] = BY) -> DataFrame:
    """Every bucket from each series' first to its last."""
    n = seconds(rule)
    ends = df.groupBy(*by).agg(F.min(bucket("ts", rule)).alias("a"), F.max(bucket("ts", rule)).alias("b"))
    return ends.select(*by, F.explode(F.sequence("a", "b", F.expr(f"interval {n} seconds"))).alias("ts"))


def resample_last(df: DataFrame, col: str, rule: str, by: Sequence[str] = BY, fill: bool = False) -> DataFrame:
    """The last value in each bucket, stamped at its start; with ``fill`` on the dense grid, carried forward."""
    out = df.groupBy(*by, bucket("ts", rule).alias("start")).agg(F.max_by(col, "ts").alias(col)).withColumnRenamed("start", "ts")
    if not fill:
        return out
    grid = dense_grid(df, rule, by).join(out, [*by, "ts"], "left")
    return grid.withColumn(col, F.last(col, True).over(so_far(by)))


def resample_sum(df: DataFrame, col: str, rule: str, by: Sequence[str] = BY) -> DataFrame:
    """The sum in each bucket of the dense grid; an empty bucket is 0."""
    out = df.groupBy(*by, bucket("ts", rule).alias("start")).agg(F.sum(col).alias(col)).withColumnRenamed("start", "ts")
    return dense_grid(df, rule, by).join(out, [*by, "ts"], "left").withColumn(col, F.coalesce(col, F.lit(0.0)))


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str] = ("asset",), on: str = "ts", tolerance: str | None = None, right_on: str | None = None, rows: int | None = None) -> DataFrame:
    """Each left row with the right row of the same key that is latest at or before it.

    One union, one shuffle and one sort: no pairs are made. Right columns must have names of their own; ``tolerance``
    is a rule such as "1h". Of right rows with equal times the largest counts. ``rows`` cuts a key's rows into slices of
    about so many, for keys too long for one task.
    """
    at = right_on or on
    if rows is not None:
        return slices.asof_join(left, right.withColumnRenamed(at, on), by, on, None if tolerance is None else seconds(tolerance), rows)
    extra = [c for c in right.columns if c not in by and c != at]
    r = right.select(*by, F.col(at).alias(on), F.struct(F.col(at).alias("_at"), *extra).alias("_r"), F.lit(0).alias("_tag"))
    rest = [c for c in left.columns if c not in by and c != on]
    l = left.select(*by, on, F.struct(*rest).alias("_l") if rest else F.lit(None).alias("_l"), F.lit(1).alias("_tag"))  # noqa: E741
    w = Window.partitionBy(*by).orderBy(on, "_tag", "_r").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_found", F.last("_r", True).over(w)).where("_tag = 1")
    found = F.col("_found")
    if tolerance is not None:
        found = F.when(F.unix_seconds(on) - F.unix_seconds("_found._at") <= seconds(tolerance), found)
        both = both.withColumn("_found", found)
    return both.select(*by, on, *[F.col(f"_l.{c}").alias(c) for c in rest], *[F.col(f"_found.{c}").alias(c) for c in extra])


def available_at(df: DataFrame, col: str, interval: str, name: str = "available_at") -> DataFrame:
    """When a period's value may be used: ``interval`` after its stamp."""
    return df.withColumn(name, F.col(col).cast("timestamp") + F.expr(f"interval {seconds(interval)} seconds"))


def ffill_daily(bars: DataFrame, features: DataFrame, by: Sequence[str] = BY, date_col: str = "available_date", keys: Sequence[str] = ()) -> DataFrame:
    """Daily features joined on the bar's date, then each carried forward along the bars."""
    cols = [c for c in features.columns if c not in (date_col, *keys)]
    joined = bars.withColumn("_day", F.to_date("ts")).join(features.withColumnRenamed(date_col, "_day"), ["_day", *keys], "left")
    return joined.withColumns({c: F.last(c, True).over(so_far(by)) for c in cols}).drop("_day")


def align_assets(df: DataFrame, a: str, b: str, cols: Sequence[str], keys: Sequence[str] = ("ts",)) -> DataFrame:
    """Two assets' rows at common times: a_* and b_*."""
    pick = lambda name, p: df.where(F.col("asset") == name).select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in cols])
    return pick(a, "a").join(pick(b, "b"), list(keys))


def panel_closes(bars: DataFrame, assets: Sequence[str]) -> DataFrame:
    """A row per time, a column per asset, for output."""
    return bars.groupBy("ts").pivot("asset", list(assets)).agg(F.first("close"))


def calendar_sample(bars: DataFrame, weekday: int = 1, by: Sequence[str] = ("asset",)) -> DataFrame:
    """Each asset's last close at or before every Monday 00:00 (``weekday`` 1 to 7) of its life."""
    day = F.to_date("ts")
    ends = bars.groupBy(*by).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    first = F.date_add("a", F.pmod(F.lit(weekday) - (F.weekday("a") + 1), F.lit(7)).cast("int"))
    weeks = ends.withColumn("first", first).where("first <= b").select(*by, F.explode(F.sequence("first", "b", F.expr("interval 7 days"))).alias("week"))
    grid = weeks.withColumn("ts", F.col("week").cast("timestamp"))
    return asof_join(grid, bars.select(*by, "ts", "close"), by).select(*by, "week", "close").where("close is not null")


def top_vol_windows(hourly: DataFrame, fine: DataFrame, k: int = 40, hours: int = 12, candidates: int = 4000, by: Sequence[str] = ("asset",)) -> DataFrame:
    """The fine bars in the ``k`` most volatile, non-overlapping windows of 2 * ``hours`` hours, with segment and center.

    ``hourly`` has (ts, vol). Picking is greedy per asset over its ``candidates`` most volatile hours, which must be
    at least k * (4 * hours + 1) for the result to be that over all hours.
    """
    if candidates < k * (4 * hours + 1):
        raise ValueError("too few candidates to be sure of k windows")
    best = hourly.where("vol is not null").withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("vol"), "ts"))).where(F.col("_rank") <= candidates)

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        chosen: list[pd.Timestamp] = []
        for ts in rows.sort_values("_rank")["ts"]:
            if all(abs(ts - c) > pd.Timedelta(hours=2 * hours) for c in chosen):
                chosen.append(ts)
                if len(chosen) == k:
                    break
        out = pd.DataFrame({c: [rows[c].iloc[0]] * len(chosen) for c in by})
        return out.assign(center=sorted(chosen), segment=range(len(chosen)))

    kinds = {c: t for c, t in hourly.dtypes}
    centers = best.select(*by, "ts", "_rank").groupBy(*by).applyInPandas(pick, ", ".join(f"{c} {kinds[c]}" for c in by) + ", center timestamp, segment int")
    # every hour of a window is a key: an equi-join instead of a range join
    reach = centers.withColumn("_hour", F.explode(F.sequence(F.date_trunc("hour", F.col("center") - F.expr(f"interval {hours} hours")), F.col("center") + F.expr(f"interval {hours} hours"), F.expr("interval 1 hour"))))
    inside = fine.withColumn("_hour", F.date_trunc("hour", "ts")).join(reach, [*by, "_hour"]).drop("_hour")
    return inside.where(F.abs(F.unix_seconds("ts") - F.unix_seconds("center")) <= hours * 3600).dropDuplicates([*by, "ts"])


def outer_merge_daily(tone: DataFrame, volume: DataFrame, keys: Sequence[str] = ("symbol", "date")) -> DataFrame:
    return tone.join(volume, list(keys), "full").select(*keys, "news_tone", "news_volume")


def date_gaps(df: DataFrame, date_col: str = "date", by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Runs of missing days inside each series: gap_start, gap_end, n_days."""
    days = df.select(*by, F.col(date_col).alias("d")).distinct()
    nxt = F.lead("d").over(Window.partitionBy(*by).orderBy("d"))
    gaps = days.withColumn("n", nxt).where(F.datediff("n", "d") > 1)
    return gaps.select(*by, F.date_add("d", 1).alias("gap_start"), F.date_sub("n", 1).alias("gap_end"), (F.datediff("n", "d") - 1).alias("n_days"))


def freshness(bars: DataFrame, expected: DataFrame, now: Column, max_lag_hours: float = 3, by: Sequence[str] = ("asset",)) -> DataFrame:
    """Per expected asset its last time, the lag in hours and whether it is recent; a missing asset isn't."""
    last = bars.groupBy(*by).agg(F.max("ts").alias("last_ts"))
    lag = (F.unix_seconds(now) - F.unix_seconds("last_ts")) / 3600
    return expected.join(last, list(by), "left").withColumn("lag_hours", lag).withColumn("ok", F.coalesce(F.col("lag_hours") <= max_lag_hours, F.lit(False)))


def slice_fingerprint(bars: DataFrame, start: str | None = None, end: str | None = None, by: Sequence[str] = BY) -> DataFrame:
    """Count, span and SHA-256 of a slice: rows are digested into days, days into the whole, each in order of time."""
    rows = bars
    if start:
        rows = rows.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        rows = rows.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    row = F.sha2(F.concat_ws(",", F.unix_seconds("ts"), *[F.round(c, 6).cast("decimal(38,6)").cast("string") for c in ("open", "high", "low", "close", "volume")]), 256)
    digest = lambda order: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "h"))), lambda x: x["h"]), ""), 256)
    days = rows.select(*by, "ts", F.to_date("ts").alias("day"), row.alias("h")).groupBy(*by, "day").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"), digest("ts").alias("h"))
    return days.groupBy(*by).agg(F.sum("n").alias("n"), F.min("a").alias("first_ts"), F.max("b").alias("last_ts"), digest("day").alias("sha256"))

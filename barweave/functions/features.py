"""Causal features of bars: functions that add columns. All share one partitioning, so Spark sorts a series once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barweave.functions.slices import run_lengths
from barweave.functions.windows import BY, div, over, rolling, so_far, trailing

# Named sets of features.
CORE5 = ("return_1h", "return_6h", "volatility", "volume_zscore", "trend_slope")
ATOM_SETS = {
    "core5": CORE5,
    "plus7": (*CORE5, "range_pct", "close_pos"),
    "full9": (*CORE5, "range_pct", "close_pos", "return_accel", "volume_trend"),
    "core5_path": (*CORE5, "streak_signed"),
    "path_min": ("return_1h", "volatility", "volume_zscore", "streak_signed"),
    "path_lean3": ("close_pos", "range_pct", "streak_signed"),
    "path_big": ("close_pos", "range_pct", "streak_big"),
    "path_both": ("close_pos", "range_pct", "streak_signed", "streak_big"),
    "path_candles": ("close_pos", "range_pct", "streak_signed", "doji", "bullish_engulfing", "bearish_engulfing"),
}


def pct_return(df: DataFrame, n: int = 1, by: Sequence[str] = BY, col: str = "close", name: str | None = None) -> DataFrame:
    return df.withColumn(name or f"return_{n}", div(F.col(col), F.lag(col, n).over(over(by))) - 1)


def rolling_vol(df: DataFrame, n: int = 24, by: Sequence[str] = BY, ret: str = "return_1h", name: str = "volatility") -> DataFrame:
    return df.withColumn(name, rolling(F.stddev_samp, ret, n, by))


def zscore(df: DataFrame, col: str, n: int = 24, by: Sequence[str] = BY, name: str | None = None) -> DataFrame:
    return df.withColumn(name or f"{col}_zscore", div(F.col(col) - rolling(F.avg, col, n, by), rolling(F.stddev_samp, col, n, by)))


def rolling_slope(df: DataFrame, col: str, n: int = 12, by: Sequence[str] = BY, name: str = "trend_slope") -> DataFrame:
    """Least-squares slope of the last n values against their place, over their mean."""
    w = trailing(n, by)
    numbered = df.withColumn("_place", F.row_number().over(over(by)))
    full = F.count(col).over(w) == n
    return numbered.withColumn(name, F.when(full, div(F.regr_slope(F.col(col), F.col("_place")).over(w), F.avg(col).over(w)))).drop("_place")


def range_features(df: DataFrame) -> DataFrame:
    return df.withColumns({"range_pct": div(F.col("high") - F.col("low"), F.col("close")), "close_pos": div(F.col("close") - F.col("low"), F.col("high") - F.col("low"))})


def diff(df: DataFrame, col: str, by: Sequence[str] = BY, name: str | None = None) -> DataFrame:
    return df.withColumn(name or f"{col}_chg", F.col(col) - F.lag(col).over(over(by)))


def _run(df: DataFrame, sign: Column, name: str, by: Sequence[str], rows: int | None = None) -> DataFrame:
    """Signed length of the run of equal signs that ends here; 0 where the sign is 0 or null.

    ``rows`` cuts each series into slices of about so many rows, for series too long for one task.
    """
    if rows is not None:
        return run_lengths(df, sign, name, rows, by)
    w = over(by)
    marked = df.withColumn("_sign", F.coalesce(sign.cast("int"), F.lit(0)))
    change = F.when(F.col("_sign") == F.lag("_sign").over(w), 0).otherwise(1)
    islands = marked.withColumn("_change", change).withColumn("_island", F.sum("_change").over(so_far(by)))
    length = F.row_number().over(Window.partitionBy(*by, "_island").orderBy("ts"))
    return islands.withColumn(name, F.col("_sign") * length).drop("_sign", "_change", "_island")


def streak_signed(df: DataFrame, ret: str = "return_1h", by: Sequence[str] = BY, name: str = "streak_signed", rows: int | None = None) -> DataFrame:
    """Run length with the current bar; flat or missing returns are 0 and end a run."""
    return _run(df, F.signum(ret), name, by, rows)


def streak_before(df: DataFrame, ret: str = "return_1h", by: Sequence[str] = BY, name: str = "streak", rows: int | None = None) -> DataFrame:
    """Run length up to the bar before; ``rows`` as in ``_run``."""
    if rows is not None:
        return run_lengths(df, F.signum(ret), name, rows, by, shifted=True)
    inner = _run(df, F.signum(ret), "_inclusive", by)
    return inner.withColumn(name, F.coalesce(F.lag("_inclusive").over(over(by)), F.lit(0))).drop("_inclusive")


def streak_session(df: DataFrame, ret: str = "return_1h", by: Sequence[str] = BY, name: str = "streak") -> DataFrame:
    """Run length up to the bar before, counted anew each day; a day's first bar still reads the day before's last return."""
    prior = df.withColumn("_prior", F.signum(F.lag(ret).over(over(by)))).withColumn("_day", F.to_date("ts"))
    return _run(prior, F.col("_prior"), name, [*by, "_day"]).drop("_prior", "_day")


def streak_big(df: DataFrame, k: float = 1.0, ret: str = "return_1h", vol: str = "volatility", by: Sequence[str] = BY, name: str = "streak_big", rows: int | None = None) -> DataFrame:
    """Run length of returns over k times the volatility; any smaller one ends the run."""
    return _run(df, F.when(F.abs(ret) > k * F.col(vol), F.signum(ret)).otherwise(0), name, by, rows)


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def candle_flags(df: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    w = over(by)
    o, c, po, pc = F.col("open"), F.col("close"), F.lag("open").over(w), F.lag("close").over(w)
    return df.withColumns({
        "doji": _flag(div(F.abs(c - o), F.col("high") - F.col("low")) < 0.10),
        "bullish_engulfing": _flag((pc < po) & (c > o) & (o <= pc) & (c >= po)),
        "bearish_engulfing": _flag((pc > po) & (c < o) & (o >= pc) & (c <= po)),
    })


def breakouts(df: DataFrame, n: int = 24, by: Sequence[str] = BY) -> DataFrame:
    """Close beyond the n bars' range before it; null until there are n."""
    return df.withColumns({"breakout_up": (F.col("close") > rolling(F.max, "high", n, by, end=-1)).cast("double"), "breakout_down": (F.col("close") < rolling(F.min, "low", n, by, end=-1)).cast("double")})


def flags(df: DataFrame, n: int = 24, impulse: int = 5, pct: float = 0.015, ratio: float = 0.55, by: Sequence[str] = BY, ret: str = "return_1h") -> DataFrame:
    """A strong move followed by low volatility; null until both volatilities are known."""
    move = div(F.col("close"), F.lag("close", impulse).over(over(by))) - 1
    out = df.withColumns({"_long": rolling(F.stddev_samp, ret, n, by), "_short": rolling(F.stddev_samp, ret, 5, by), "_move": move})
    known = F.col("_long").isNotNull() & F.col("_short").isNotNull()
    tight = F.col("_short") <= F.col("_long") * ratio
    return out.withColumns({"bull_flag": F.when(known, _flag((F.col("_move") >= pct) & tight)), "bear_flag": F.when(known, _flag((F.col("_move") <= -pct) & tight))}).drop("_long", "_short", "_move")


def double_extremes(df: DataFrame, n: int = 24, band: float = 0.08, by: Sequence[str] = BY) -> DataFrame:
    """Two touches or more of the range's edge in n bars and a close back inside."""
    high, low = rolling(F.max, "high", n, by, end=-1), rolling(F.min, "low", n, by, end=-1)
    out = df.withColumns({"_top": high, "_bottom": low}).withColumn("_band", F.nullif(F.col("_top") - F.col("_bottom"), F.lit(0.0)))
    out = out.withColumns({"_near_top": _flag(F.col("high") >= F.col("_top") - band * F.col("_band")), "_near_bottom": _flag(F.col("low") <= F.col("_bottom") + band * F.col("_band"))})
    w = trailing(n, by)
    enough = lambda c: (F.count(c).over(w) == n) & (F.sum(c).over(w) >= 2) & (F.col(c) == 1)
    return out.withColumns({
        "double_top": F.when(F.col("_band").isNotNull(), _flag(enough("_near_top") & (F.col("close") < F.col("_top") * 0.999))),
        "double_bottom": F.when(F.col("_band").isNotNull(), _flag(enough("_near_bottom") & (F.col("close") > F.col("_bottom") * 1.001))),
    }).drop("_top", "_bottom", "_band", "_near_top", "_near_bottom")


def trend_flags(df: DataFrame, n: int = 12, share: float = 0.55, by: Sequence[str] = BY) -> DataFrame:
    """Mostly higher highs and lows, or lower ones, over n bars."""
    w = over(by)
    up = {"_hh": F.col("high") > F.lag("high").over(w), "_hl": F.col("low") > F.lag("low").over(w), "_lh": F.col("high") < F.lag("high").over(w), "_ll": F.col("low") < F.lag("low").over(w)}
    out = df.withColumns({k: _flag(v) for k, v in up.items()})
    mean = {k: rolling(F.avg, k, n, by) for k in up}
    return out.withColumns({"trend_hh_hl": ((mean["_hh"] >= share) & (mean["_hl"] >= share)).cast("double"), "trend_lh_ll": ((mean["_lh"] >= share) & (mean["_ll"] >= share)).cast("double")}).drop(*up)


def vol_ratio(df: DataFrame, short: int = 24, long: int = 168, shift: int = 1, ret: str = "return_1h", by: Sequence[str] = BY, name: str = "vol_ratio") -> DataFrame:
    out = df.withColumn("_ratio", div(rolling(F.stddev_samp, ret, short, by), rolling(F.stddev_samp, ret, long, by)))
    return out.withColumn(name, F.lag("_ratio", shift).over(over(by))).drop("_ratio")


def forward_return(df: DataFrame, h: int = 1, by: Sequence[str] = BY, name: str = "fwd") -> DataFrame:
    return df.withColumn(name, div(F.lead("close", h).over(over(by)), F.col("close")) - 1)


def material_direction(df: DataFrame, thr: float = 0.0, fwd: str = "fwd", name: str = "up") -> DataFrame:
    """1 or 0 for a return over or under the threshold, null inside the zone; without a threshold 0 counts as down."""
    x = F.col(fwd)
    value = F.when(x > 0, 1).when(x.isNotNull(), 0) if thr <= 0 else F.when(x > thr, 1).when(x < -thr, 0)
    return df.withColumn(name, value)


def news_features(news: DataFrame, n: int = 30, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Tone, its change and the volume's z-score, usable from the next day on."""
    out = news.withColumn("ts", F.col("date"))
    out = zscore(diff(out, "news_tone", by, "news_tone_chg"), "news_volume", n, by, "news_vol_z")
    return out.select(*by, F.date_add("date", 1).alias("available_date"), "news_tone", "news_tone_chg", "news_vol_z")


def atom_pool(bars: DataFrame, by: Sequence[str] = BY, patterns: bool = True) -> DataFrame:
    """Every feature beside the bars; add "segment" to ``by`` to keep features inside a segment."""
    out = pct_return(bars, 1, by, name="return_1h")
    out = pct_return(out, 6, by, name="return_6h")
    out = rolling_vol(out, 24, by)
    out = zscore(out, "volume", 24, by, "volume_zscore")
    out = rolling_slope(out, "close", 12, by, "trend_slope")
    out = range_features(out)
    out = diff(out, "return_1h", by, "return_accel")
    out = rolling_slope(out, "volume", 12, by, "volume_trend")
    out = streak_big(streak_signed(out, by=by), by=by)
    if patterns:
        out = trend_flags(double_extremes(flags(breakouts(candle_flags(out, by), by=by), by=by), by=by), by=by)
    return out


def atoms(pool: DataFrame, names: Sequence[str], keep: Sequence[str] = ("asset", "res", "ts")) -> DataFrame:
    """The named features where all are known."""
    return pool.select(*keep, *names).dropna(subset=list(names))


def kgram(df: DataFrame, k: int, alphabet: str = "sign", thr: float = 0.003, ret: str = "return_1h", by: Sequence[str] = BY) -> DataFrame:
    """The k symbols before each bar, and whether the bar rose; null until k symbols exist."""
    x = F.col(ret)
    symbol = F.when(x > 0, "U").when(x <= 0, "D") if alphabet == "sign" else F.when(x > thr, "+").when(x < -thr, "-").when(x.isNotNull(), "0")
    marked = df.withColumn("_symbol", symbol)
    w = over(by)
    gram = F.concat(*[F.lag("_symbol", i).over(w) for i in range(k, 0, -1)])
    return marked.withColumns({"gram": gram, "up": F.when(x.isNotNull(), (x > 0).cast("int"))}).drop("_symbol")


def sequence_window(df: DataFrame, cols: Sequence[str], k: int = 12, target: str = "up", latest_only: bool = False, by: Sequence[str] = BY) -> DataFrame:
    """The last k feature vectors as one array per bar, with the bar's label; only full windows without gaps."""
    row = F.array(*[F.col(c).cast("float") for c in cols])
    rows = df.dropna(subset=list(cols))
    out = rows.withColumn("x", F.collect_list(row).over(trailing(k, by))).where(F.size("x") == k)
    if latest_only:
        out = out.withColumn("_last", F.row_number().over(over(by, F.desc("ts")))).where("_last = 1").drop("_last")
    return out.select(*by, "ts", "x", F.col(target).alias("y"))


def recent_vol(df: DataFrame, n: int = 5, ret: str = "return_1h", by: Sequence[str] = BY) -> DataFrame:
    """Mean size of the n returns before."""
    return df.withColumn("recent_vol", rolling(F.avg, F.abs(ret), n, by, end=-1))

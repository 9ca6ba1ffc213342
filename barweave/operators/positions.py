"""Positions, costs and returns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from barweave.functions.slices import ROWS, through_chunks
from barweave.functions.windows import BY, over, so_far
from barweave.operators.chains import Holding, Trading, trade_end
from barweave.operators.resample import asof_join
from barweave.sources.stored import stored

BARS_PER_YEAR = {"5m": 105_120, "15m": 35_040, "30m": 17_520, "1h": 8_760, "4h": 2_190, "8h": 1_095, "1d": 365, "1w": 52}
MIN_HOLDS = (1, 2, 3, 4, 6, 8, 12, 24, 48)


def target_positions(preds: DataFrame, variant: str = "long_short", conf: float = 0.55) -> DataFrame:
    """Adds target: long_only, long_short, confidence (only at or over ``conf``), conviction (column dir), policy (primary_dir)."""
    side = F.when(F.col("pred") == 1, 1.0).when(F.col("pred") == 0, -1.0).otherwise(0.0) if "pred" in preds.columns else F.lit(0.0)
    if variant == "long_only":
        target = F.greatest(side, F.lit(0.0))
    elif variant == "long_short":
        target = side
    elif variant == "confidence":
        target = F.when(F.col("calibrated_prob") >= conf, side).otherwise(0.0)
    else:
        target = F.coalesce(F.col({"conviction": "dir", "policy": "primary_dir"}[variant]), F.lit(0)).cast("double")
    return preds.withColumn("target", target)


def periodic_rebalance(df: DataFrame, step: int, by: Sequence[str] = BY, target: str = "target") -> DataFrame:
    """The first target of each block of ``step`` bars is held through it."""
    rows = df.withColumn("_block", F.floor((F.row_number().over(over(by)) - 1) / step))
    return rows.withColumn("pos", F.first(target).over(Window.partitionBy(*by, "_block").orderBy("ts"))).drop("_block")


def net_returns(df: DataFrame, fee_bps: float | Column = 4.0, slip_bps: float = 1.0, by: Sequence[str] = BY, ret: str = "fwd") -> DataFrame:
    """Adds turnover, cost and net_ret of the position ``pos`` held over ``ret``; the first change is from 0."""
    fee = fee_bps if isinstance(fee_bps, Column) else F.lit(float(fee_bps))
    out = df.withColumn("turnover", F.abs(F.col("pos") - F.lag("pos", 1, 0.0).over(over(by))))
    out = out.withColumn("cost", F.col("turnover") * (fee + slip_bps) / 1e4)
    return out.withColumn("net_ret", F.col("pos") * F.col(ret) - F.col("cost"))


def equity(df: DataFrame, by: Sequence[str] = BY, ret: str = "net_ret") -> DataFrame:
    """Adds equity, its peak so far (without the initial 1) and the drawdown."""
    w = so_far(by)
    out = df.withColumn("equity", F.product(1 + F.col(ret)).over(w))
    out = out.withColumn("peak", F.max("equity").over(w))
    return out.withColumn("drawdown", F.col("equity") / F.nullif("peak", F.lit(0.0)) - 1)


def return_stats(df: DataFrame, bars_per_year: float, by: Sequence[str] = BY, ret: str = "net_ret", extra: dict[str, Column] | None = None) -> DataFrame:
    """Total and yearly return, Sharpe (population deviation), worst drawdown, changes and cost of an equity table.

    A yearly return of an equity that isn't positive is null.
    """
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.max_by("equity", "ts").alias("_e"), F.avg(ret).alias("_m"), F.stddev_pop(ret).alias("_s"), F.min("drawdown").alias("max_dd"), F.sum((F.col("turnover") > 0).cast("int")).alias("n_changes"), F.sum("cost").alias("cost_drag"), *[c.alias(k) for k, c in (extra or {}).items()])
    sharpe = F.when(F.col("_s") > 1e-15, F.col("_m") / F.col("_s") * float(np.sqrt(bars_per_year))).otherwise(0.0)
    annual = F.when(F.col("_e") > 0, F.pow("_e", bars_per_year / F.col("n")) - 1)
    return out.withColumns({"total": F.col("_e") - 1, "annual": annual, "sharpe": sharpe}).drop("_e", "_m", "_s")


def min_hold(df: DataFrame, n: int | str, by: Sequence[str] = BY, target: str = "target", rows: int = ROWS) -> DataFrame:
    """Adds pos: the target, but a position stays ``n`` bars at least (a number, or a column constant per group).

    Missing targets are 0. A series is worked in chunks of ``rows`` bars by as many tasks. Rows with equal ts stay as
    many and are taken in order of their targets. ``df`` is written once, as it is read several times.
    """
    size = F.lit(n) if isinstance(n, int) else F.col(n)
    return through_chunks(stored(df, "targets"), Holding(), {"target": F.col(target), "n": size}, {"pos": "double"}, rows, by)


def thesis_trades(signal: np.ndarray, ret: np.ndarray, tp: float, sl: float, max_hold: int, least: int, cooldown: int, on_flip: bool) -> list[tuple[int, int, float, str | None]]:
    """Trades (first bar, last bar, direction, why it ends; None at the end of the series) of one short series.

    A trade starts where the signal stands (or changes, with ``on_flip``) and no other is open or cooling down, and ends
    as ``trade_end`` says.
    """
    starts = np.flatnonzero((signal != 0) & ((signal != np.concatenate([[0.0], signal[:-1]])) | (not on_flip)))
    trades, free = [], 0
    while (k := int(np.searchsorted(starts, free))) < len(starts):
        i = int(starts[k])
        last, why = trade_end(signal, ret, i, tp, sl, max_hold, least)
        trades.append((i, last, signal[i], why))
        free = last + 1 + cooldown
    return trades


def thesis_hold(df: DataFrame, tp: float = 0.0030, sl: float = 0.0045, max_hold: int = 48, least: int = 6, cooldown: int = 0, on_flip: bool = False, by: Sequence[str] = BY, signal: str = "sig", ret: str = "fwd", rows: int = ROWS) -> DataFrame:
    """Adds pos and exit_reason (at a trade's last bar): positions that follow a signal until a take-profit, stop, timeout or opposite signal.

    Missing signals and returns are 0. A series is worked in chunks, and equal times are ordered, as in ``min_hold``.
    """
    trading = Trading(tp, sl, max_hold, least, cooldown, on_flip)
    return through_chunks(stored(df, "signals"), trading, {"signal": F.col(signal), "ret": F.col(ret)}, {"pos": "double", "exit_reason": "string"}, rows, by)


def exit_counts(df: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return df.where("exit_reason is not null").groupBy(*by, "exit_reason").agg(F.count("*").alias("n"))


def grid_returns(df: DataFrame, holds: Sequence[int] = MIN_HOLDS, fees_bps: Sequence[float] = (1.0, 5.0), moves: Sequence[float] = (0.0,), lens: Sequence[int] = (0,), bars_per_year: float = 8760, by: Sequence[str] = BY, top: int | None = None) -> DataFrame:
    """Return statistics of every minimum hold, fee and gate on the last move's size and the run's length, ranked.

    One grouped pass finds the positions of all holds and gates; fees don't change positions, so they come after.
    A row is viable with a positive return and enough changes. ``top`` keeps each group's best.
    """
    grid = F.explode(F.array(*[F.struct(F.lit(h).alias("hold"), F.lit(float(m)).alias("move"), F.lit(s).alias("len")) for h in holds for m in moves for s in lens]))
    rows = df.withColumn("_g", grid).select("*", "_g.*").drop("_g")
    gated = (F.coalesce(F.abs("return_1h"), F.lit(0.0)) >= F.col("move")) & (F.abs("streak") >= F.col("len"))
    rows = rows.withColumn("target", F.when(gated, F.col("target")).otherwise(0.0))
    keys = [*by, "hold", "move", "len"]
    held = min_hold(rows.select(*keys, "ts", "target", "fwd"), "hold", keys)
    fee = F.explode(F.array(*[F.lit(float(f)) for f in fees_bps]))
    priced = net_returns(held.withColumn("fee_bps", fee), F.col("fee_bps"), 0.0, [*keys, "fee_bps"])
    out = return_stats(equity(priced, [*keys, "fee_bps"]), bars_per_year, [*keys, "fee_bps"], extra={"active": F.sum((F.col("pos") != 0).cast("int"))})
    out = out.withColumn("viable", (F.col("total") > 0) & (F.col("n_changes") >= 30) & (F.col("active") >= 200))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.round("total", 9).desc_nulls_last(), "hold", "fee_bps", "move", "len")))
    return out if top is None else out.where(F.col("rank") <= top)


def expanding_oracle(df: DataFrame, horizon: int = 12, k_fee: float = 2.0, min_n: int = 80, fee_rt: float = 0.001, by: Sequence[str] = BY) -> DataFrame:
    """Adds mu and n_past, of the completed ``horizon``-bar returns in the same state, and a signal where mu is worth the fee."""
    rows = df.withColumn("_rn", F.row_number().over(over(by))).withColumn("fwd_h", F.lead("close", horizon).over(over(by)) / F.col("close") - 1)
    past = Window.partitionBy(*by, "state").orderBy("_rn").rangeBetween(Window.unboundedPreceding, -horizon)
    rows = rows.withColumns({"mu": F.avg("fwd_h").over(past), "n_past": F.count("fwd_h").over(past)})
    enough = F.col("n_past") >= min_n
    return rows.withColumn("signal", F.when(enough & (F.col("mu") >= k_fee * fee_rt), 1).when(enough & (F.col("mu") <= -k_fee * fee_rt), -1).otherwise(0)).drop("_rn")


def rank_portfolio(panel: DataFrame, q: float = 0.2, reversal: bool = True, fee_side: float = 0.0005, least: int = 10) -> DataFrame:
    """Per week the gross return, turnover, cost and net return of the long-short portfolio of the extreme fifths.

    ``panel``: (asset, week, close), written once, as are its ranks. Assets are ranked by their last week's return and held for the next. Weeks with
    under ``least`` assets have no positions, and the next week buys anew.
    """
    w = Window.partitionBy("asset").orderBy("week")
    near = lambda c, k: F.when(F.abs(F.datediff(F.lag("week", k).over(w) if k > 0 else F.lead("week", -k).over(w), "week")) == 7, c)
    panel = stored(panel.select("asset", "week", "close"), "panel")
    rows = panel.withColumns({"rank_ret": near(F.col("close") / F.lag("close").over(w) - 1, 1), "next_ret": near(F.lead("close").over(w) / F.col("close") - 1, -1)})
    weeks = panel.select("week").distinct()
    ranked = rows.where("rank_ret is not null and next_ret is not null")
    per = Window.partitionBy("week")
    ranked = ranked.withColumns({"_n": F.count("*").over(per), "_lo": F.row_number().over(per.orderBy("rank_ret", "asset")), "_hi": F.row_number().over(per.orderBy(F.desc("rank_ret"), F.desc("asset")))}).where(F.col("_n") >= least)
    k = F.greatest(F.lit(1), F.floor(F.col("_n") * q + 1e-9))
    side = 1.0 if reversal else -1.0
    weight = F.when(F.col("_lo") <= k, side).when(F.col("_hi") <= k, -side).otherwise(0.0) / (2 * k)
    ranked = stored(ranked.select("asset", "week", weight.alias("w"), "next_ret"), "ranked")
    held = ranked.where("w <> 0")
    traded = ranked.select("week").distinct().withColumn("_traded", F.lit(1))
    # a week's change concerns what is held in it or was held the week before
    here = held.select("asset", "week", "w", F.lit(0.0).alias("old"), (F.col("w") * F.col("next_ret")).alias("g"))
    gone = held.select("asset", F.date_add("week", 7).alias("week"), F.lit(0.0).alias("w"), F.col("w").alias("old"), F.lit(0.0).alias("g"))
    moved = here.unionByName(gone).groupBy("asset", "week").agg(F.sum("w").alias("w"), F.sum("old").alias("old"), F.sum("g").alias("g"))
    out = moved.groupBy("week").agg(F.sum("g").alias("gross"), F.sum(F.abs(F.col("w") - F.col("old"))).alias("turnover"))
    out = weeks.join(out, "week", "left").join(traded, "week", "left")
    on = F.col("_traded").isNotNull()
    out = out.select("week", F.when(on, F.col("gross")).otherwise(0.0).alias("gross"), F.when(on, F.col("turnover")).otherwise(0.0).alias("turnover"))
    return out.withColumn("cost", F.col("turnover") * fee_side).withColumn("net", F.col("gross") - F.col("cost"))


def hold_cycle_pnl(signals: DataFrame, bars: DataFrame, n: int = 6, fee_bps: float = 5.0, by: Sequence[str] = ("asset",)) -> DataFrame:
    """Each signal (by, ts, direction 1/-1) held for n bars: entry and exit price and time, net result, profit or loss.

    A fee is paid on the first bar and on leaving. Cycles whose exit bar isn't there yet have null results.
    """
    w = over(by)
    rows = bars.withColumns({"exit_ts": F.lead("ts", n).over(w), "exit_price": F.lead("close", n).over(w), "_r": F.lead("close").over(w) / F.col("close") - 1})
    fee = fee_bps / 1e4
    ahead = w.rowsBetween(1, n - 1)
    for side, name in ((1, "_up"), (-1, "_down")):
        later = F.coalesce(F.product(1 + side * F.col("_r")).over(ahead), F.lit(1.0)) if n > 1 else F.lit(1.0)
        rows = rows.withColumn(name, (1 + side * F.col("_r") - fee) * later * (1 - fee) - 1)
    rows = rows.select(*by, "ts", F.col("close").alias("entry_price"), "exit_ts", "exit_price", "_up", "_down")
    out = signals.join(rows, [*by, "ts"], "left")
    pnl = F.when(F.col("exit_ts").isNotNull(), F.when(F.col("direction") > 0, F.col("_up")).otherwise(F.col("_down")))
    return out.withColumn("pnl", pnl).withColumn("outcome", F.when(F.col("pnl") > 0, "profit").when(F.col("pnl").isNotNull(), "loss")).drop("_up", "_down")


def passes_contract(total: Column, buy_hold: Column, n_changes: Column, sharpe: Column) -> Column:
    """The success contract's four clauses, as a struct with their conjunction."""
    clauses = {"positive": total > 0, "beats_hold": total > buy_hold, "enough_changes": n_changes >= 30, "sharpe": sharpe > 0}
    every = F.lit(True)
    for c in clauses.values():
        every = every & F.coalesce(c, F.lit(False))
    return F.struct(*[F.coalesce(c, F.lit(False)).alias(k) for k, c in clauses.items()], every.alias("passed"))


def sealed_eval(df: DataFrame, start: Column, end: Column | None = None, hold: int = 12, fee_bps: float = 5.0, min_bars: int = 500, bars_per_year: float = 8760, by: Sequence[str] = BY) -> DataFrame:
    """Return statistics in (start, end] of targets (ts, target, fwd) from rules that saw nothing later than ``start``.

    A series with under ``min_bars`` bars there is "pending".
    """
    rows = df.where((F.col("ts") > start) & ((F.col("ts") <= end) if end is not None else F.lit(True)) & F.col("fwd").isNotNull())
    held = equity(net_returns(min_hold(rows.select(*by, "ts", "target", "fwd"), hold, by), fee_bps, 0.0, by), by)
    stats = return_stats(held, bars_per_year, by, extra={"buy_hold": F.product(1 + F.col("fwd")) - 1})
    checked = stats.withColumn("contract", passes_contract(F.col("total"), F.col("buy_hold"), F.col("n_changes"), F.col("sharpe")))
    return checked.withColumn("status", F.when(F.col("n") < min_bars, "pending").otherwise("evaluated")).withColumn("passed", F.col("contract.passed") & (F.col("status") == "evaluated"))


def align_panel(grid: DataFrame, parts: dict[str, DataFrame], by: Sequence[str] = ("asset",)) -> DataFrame:
    """The grid with each part's latest signal as a column."""
    out = grid
    for name, part in parts.items():
        out = asof_join(out, part.select(*by, "ts", F.col("sig").alias(name)), by)
    return out

"""Funding and news studies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barweave.functions.discretize import chrono_split, decile_state, news_states
from barweave.functions.windows import over, rolling
from barweave.operators.positions import equity, return_stats
from barweave.operators.resample import asof_join

PERIODS_PER_YEAR = 1095  # of eight hours


def funding_frame(funding: DataFrame, bars: DataFrame, by: Sequence[str] = ("asset",)) -> DataFrame:
    """Each funding stamp with the close known then and the return to the next stamp."""
    at = asof_join(funding, bars.select(*by, "ts", "close"), by)
    nxt = F.lead("close").over(over(by))
    return at.withColumn("ret", nxt / F.nullif("close", F.lit(0.0)) - 1)


def funding_contrarian(frame: DataFrame, frac: float = 0.3, by: Sequence[str] = ("asset",)) -> DataFrame:
    """Correlation of rate and next return; coverage and hit rate on hold stamps of betting against the dev deciles."""
    rows = decile_state(frame.where("ret is not null"), "funding_rate", frac, by=by)
    side = F.when(F.col("bucket") == "EXTREME_POS", -1).when(F.col("bucket") == "EXTREME_NEG", 1)
    hold = (F.col("part") == "hold")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.corr("funding_rate", "ret").alias("corr"), F.avg(F.when(hold, side.isNotNull().cast("int"))).alias("coverage"), F.avg(F.when(hold & side.isNotNull(), (F.signum("ret") == side).cast("int"))).alias("hit"))


def funding_streak(bars: DataFrame, funding: DataFrame, min_len: int = 3, frac: float = 0.3, by: Sequence[str] = ("asset",), ret: str = "return_1h") -> DataFrame:
    """Hit rate of betting against long runs by the funding rate's bucket, and its distance from NEUTRAL's."""
    rows = asof_join(bars.select(*by, "ts", "streak", F.col(ret).alias("ret")), funding.select(*by, "ts", "funding_rate"), by)
    rows = decile_state(rows.where("funding_rate is not null"), "funding_rate", frac, by=by).where((F.abs("streak") >= min_len) & F.col("ret").isNotNull() & (F.col("ret") != 0))
    out = rows.groupBy(*by, "bucket").agg(F.count("*").alias("n"), F.avg((F.signum("ret") != F.signum("streak")).cast("int")).alias("hit"))
    neutral = F.max(F.when(F.col("bucket") == "NEUTRAL", F.col("hit"))).over(Window.partitionBy(*by))
    return out.withColumn("boost", F.col("hit") - neutral)


def funding_carry(funding: DataFrame, window: int = 21, frac: float = 0.3, fees: dict[str, float] | None = None, basis: float = 0.0005, by: Sequence[str] = ("asset",)) -> DataFrame:
    """Carry on hold periods, passive and gated by the lagged trailing mean, per fee: return statistics and switches.

    ``fees`` are round trips. The variant "stressed" is gated with ``basis`` more.
    """
    fees = fees or {"taker": 0.0020, "maker": 0.0008}
    # a window inside a window needs a column of its own
    rows = funding.withColumn("_mean", rolling(F.avg, "funding_rate", window, by)).withColumn("in", F.coalesce((F.lag("_mean").over(over(by)) > 0).cast("double"), F.lit(0.0)))
    hold = chrono_split(rows, frac, by).where("part = 'hold'")
    w = over(by)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    hold = hold.withColumns({"_rn": F.row_number().over(w), "_n": n, "_switch": F.abs(F.col("in") - F.lag("in", 1, 0.0).over(w))})
    ends = (F.col("_rn") == 1).cast("int") + (F.col("_rn") == F.col("_n")).cast("int")
    variants = []
    for fee, cost in fees.items():
        variants += [F.struct(F.lit(fee).alias("fee"), F.lit("passive").alias("variant"), (F.col("funding_rate") - ends * (cost / 2)).alias("net_ret"), F.lit(1.0).alias("pos")), F.struct(F.lit(fee).alias("fee"), F.lit("gated").alias("variant"), (F.col("in") * F.col("funding_rate") - F.col("_switch") * (cost / 2)).alias("net_ret"), F.col("in").alias("pos"))]
    variants.append(F.struct(F.lit("taker").alias("fee"), F.lit("stressed").alias("variant"), (F.col("in") * F.col("funding_rate") - F.col("_switch") * ((fees.get("taker", 0.0) + basis) / 2)).alias("net_ret"), F.col("in").alias("pos")))
    long = hold.select(*by, "ts", "_switch", F.explode(F.array(*variants)).alias("v")).select(*by, "ts", "v.*", F.when(F.col("v.variant") != "passive", F.col("_switch")).otherwise(0.0).alias("turnover"), F.lit(0.0).alias("cost"))
    return return_stats(equity(long, [*by, "fee", "variant"]), PERIODS_PER_YEAR, [*by, "fee", "variant"], extra={"coverage": F.avg("pos")})


def worst_rolling(funding: DataFrame, window: int = 270, by: Sequence[str] = ("asset",)) -> DataFrame:
    """The worst sum over ``window`` periods, as a yearly rate."""
    return funding.withColumn("_s", rolling(F.sum, "funding_rate", window, by)).groupBy(*by).agg((F.min("_s") * (PERIODS_PER_YEAR / window)).alias("worst_annualized"))


def return_on_capital(annual: Column, risk_free: float = 0.04, capital: dict[str, float] | None = None) -> Column:
    """An array of (model, on_capital, excess) for multiples of the notional."""
    models = capital or {"full": 1.0, "conservative": 1.5, "double": 2.0}
    return F.array(*[F.struct(F.lit(k).alias("model"), (annual / m).alias("on_capital"), (annual / m - risk_free).alias("excess")) for k, m in models.items()])


def funding_regime(funding: DataFrame, gate: int = 21, regime: int = 90, hot: float = 0.10, by: Sequence[str] = ("asset",)) -> DataFrame:
    """Each period with its gate, the yearly rate of the ``regime`` periods before, whether that is hot, and OFF to HOT edges."""
    rows = funding.withColumns({"_g": rolling(F.avg, "funding_rate", gate, by), "_r": rolling(F.avg, "funding_rate", regime, by)})
    w = over(by)
    rows = rows.withColumns({"gate_on": F.lag("_g").over(w) > 0, "regime_annualized": F.lag("_r").over(w) * PERIODS_PER_YEAR}).withColumn("hot", F.col("regime_annualized") >= hot)
    return rows.withColumn("turned_hot", F.coalesce(F.col("hot") & ~F.coalesce(F.lag("hot").over(w), F.lit(False)), F.lit(False))).drop("_g", "_r")


def funding_ledger(regime: DataFrame, ledger: DataFrame, by: Sequence[str] = ("asset",)) -> DataFrame:
    """Only the periods that the ledger (by, ts) lacks and that are later than its last; all of an asset that it lacks."""
    last = ledger.groupBy(*by).agg(F.max("ts").alias("_last"))
    return regime.join(last, list(by), "left").where("_last is null or ts > _last").drop("_last")


def funding_report(ledger: DataFrame, by: Sequence[str] = ("asset",)) -> DataFrame:
    """Per asset: periods, share with the gate on, funding collected on them, the last regime."""
    return ledger.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col("gate_on").cast("int")).alias("gate_share"), F.sum(F.when(F.col("gate_on"), F.col("funding_rate"))).alias("collected"), F.max_by("hot", "ts").alias("hot"), F.sum(F.col("turned_hot").cast("int")).alias("edges"))


def news_patterns(daily: DataFrame, frac: float = 0.3, min_dev: int = 1, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Per state the direction learned on dev days and its hit rate and edge over the base rate on hold days."""
    rows = news_states(daily.where("fwd is not null"), frac, by).withColumn("_up", (F.col("fwd") > 0).cast("int"))
    base = chrono_split(daily.where("fwd is not null"), frac, by).where("part = 'hold'").groupBy(*by).agg(F.avg((F.col("fwd") > 0).cast("int")).alias("_b"))
    out = rows.groupBy(*by, "state").agg(F.sum(F.col("is_dev").cast("int")).alias("dev_n"), F.avg(F.when(F.col("is_dev"), F.col("_up"))).alias("dev_up"), F.sum((~F.col("is_dev")).cast("int")).alias("hold_n"), F.avg(F.when(~F.col("is_dev"), F.col("_up"))).alias("_h")).where(F.col("dev_n") >= min_dev).join(base, list(by))
    side = F.col("dev_up") >= 0.5
    out = out.withColumn("hold_hit", F.when(side, F.col("_h")).otherwise(1 - F.col("_h")))
    return out.withColumn("edge", F.col("hold_hit") - F.when(side, F.col("_b")).otherwise(1 - F.col("_b"))).drop("_h", "_b")


def news_attention(daily: DataFrame, z: float = 1.5, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Do attention spikes precede larger moves: gap, correlation, gap inside volatility fifths, partial correlation.

    ``daily``: news_vol_z, recent_vol, fwd.
    """
    rows = daily.where("fwd is not null and news_vol_z is not null and recent_vol is not null").withColumns({"_m": F.abs("fwd"), "_s": F.col("news_vol_z") >= z})
    rows = rows.withColumn("_q", F.ntile(5).over(Window.partitionBy(*by).orderBy("recent_vol", "ts")))
    spike, calm = F.avg(F.when(F.col("_s"), F.col("_m"))), F.avg(F.when(~F.col("_s"), F.col("_m")))
    total = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("_s").cast("int")).alias("n_spike"), (spike - calm).alias("gap"), F.corr("news_vol_z", "_m").alias("corr"), F.corr("news_vol_z", "recent_vol").alias("_xv"), F.corr("_m", "recent_vol").alias("_yv"))
    strata = rows.groupBy(*by, "_q").agg((spike - calm).alias("g"), F.sum(F.col("_s").cast("int")).alias("k")).where("g is not null").groupBy(*by).agg((F.sum(F.col("g") * F.col("k")) / F.sum("k")).alias("controlled_gap"))
    partial = (F.col("corr") - F.col("_xv") * F.col("_yv")) / F.nullif(F.sqrt((1 - F.pow("_xv", 2)) * (1 - F.pow("_yv", 2))), F.lit(0.0))
    return total.join(strata, list(by), "left").withColumn("partial_corr", partial).drop("_xv", "_yv")


def alignment_check(daily: DataFrame, lags: Sequence[int] = range(-2, 3), by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Correlation and sign agreement of tone with the return ``lag`` days on."""
    w = over(by)
    shifted = {f"r{k + 10}": F.lead("ret", k).over(w) if k >= 0 else F.lag("ret", -k).over(w) for k in lags}
    rows = daily.withColumns(shifted)
    wide = rows.groupBy(*by).agg(*[x for k in lags for c in [f"r{k + 10}"] for x in (F.corr("news_tone", c).alias(f"c{k + 10}"), F.count(F.when(F.col("news_tone").isNotNull(), F.col(c))).alias(f"n{k + 10}"), F.avg(F.when(F.col(c) != 0, (F.signum("news_tone") == F.signum(c)).cast("int"))).alias(f"s{k + 10}"))])
    return wide.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"c{k + 10}").alias("corr"), F.col(f"n{k + 10}").alias("n"), F.col(f"s{k + 10}").alias("sign_agreement")) for k in lags])).alias("r")).select(*by, "r.*")

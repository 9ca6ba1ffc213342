"""Run, n-gram and multi-timeframe analytics."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from barweave.functions.discretize import chrono_split
from barweave.functions.features import kgram, streak_session
from barweave.functions.slices import ROWS, overlapped
from barweave.functions.windows import BY, div
from barweave.operators.resample import asof_join

# Tiers in order of preference: name, least streak, least agreeing timeframes (0: not asked for), stored hit rate.
TIERS = [("elite", 2, 4, 0.626), ("strong", 3, 3, 0.596), ("high", 2, 3, 0.582), ("multi3", 0, 3, 0.583), ("streak4", 4, 0, 0.571), ("streak3", 3, 0, 0.553), ("streak2", 2, 0, 0.546)]
HIGH_VR_MIN_STREAK = 3


def trend_structure(df: DataFrame, max_streak: int = 5, by: Sequence[str] = BY, ret: str = "return_1h") -> DataFrame:
    """Per sign and length of the run before a bar (the last length is open): how often the bar rose or went on."""
    rows = df.where((F.col("streak") != 0) & F.col(ret).isNotNull())
    up = (F.col(ret) > 0).cast("int")
    goes_on = (F.signum(ret) == F.signum("streak")).cast("int")
    out = rows.groupBy(*by, F.signum("streak").cast("int").alias("sign"), F.least(F.abs("streak"), F.lit(max_streak)).alias("len")).agg(F.count("*").alias("n"), F.avg(up).alias("next_up_rate"), F.avg(goes_on).alias("continuation"))
    return out.withColumn("behaviour", F.when(F.col("continuation") > 0.5, "continues").when(F.col("continuation") < 0.5, "reverts").otherwise("even"))


def _cells(df: DataFrame, by: Sequence[str], ret: str, min_len: int, max_len: int, min_n: int) -> DataFrame:
    rows = df.where(F.abs("streak").between(min_len, max_len) & F.col(ret).isNotNull() & (F.col(ret) != 0))
    goes_on = (F.signum(ret) == F.signum("streak")).cast("int")
    return rows.groupBy(*by, F.col("streak")).agg(F.count("*").alias("n"), F.sum(goes_on).alias("c")).where(F.col("n") >= min_n)


def reversion_index(df: DataFrame, min_len: int = 2, max_len: int = 7, min_n: int = 50, by: Sequence[str] = BY, ret: str = "return_1h") -> DataFrame:
    """0.5 less the share of runs that go on, over signed lengths with enough cases."""
    out = _cells(df, by, ret, min_len, max_len, min_n).groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("c") / F.sum("n")).alias("continuation"))
    return out.withColumn("reversion_index", 0.5 - F.col("continuation"))


def reversion_ladder(df: DataFrame, min_n: int = 50, by: Sequence[str] = BY, ret: str = "return_1h") -> DataFrame:
    """The reversion index of every resolution and the slope of continuation against run length."""
    cells = _cells(df, by, ret, 2, 7, min_n).groupBy(*by, F.abs("streak").alias("len")).agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    out = cells.groupBy(*by).agg(F.sum("n").alias("n"), (0.5 - F.sum("c") / F.sum("n")).alias("reversion_index"), F.regr_slope(F.col("c") / F.col("n"), F.col("len")).alias("slope"))
    return out


def crossover(ladder: DataFrame, by: Sequence[str] = ("asset",)) -> DataFrame:
    """Neighbouring resolutions between which the reversion index changes sign; ``seconds`` orders them."""
    nxt = Window.partitionBy(*by).orderBy("seconds")
    out = ladder.withColumns({"next_res": F.lead("res").over(nxt), "next_index": F.lead("reversion_index").over(nxt)})
    return out.where(F.signum("reversion_index") != F.signum("next_index")).select(*by, "res", "next_res", "reversion_index", "next_index")


def ngram_holdout(df: DataFrame, ks: Sequence[int] = range(2, 9), min_dev: int = 30, min_hold: int = 15, frac: float = 0.3, by: Sequence[str] = BY, alphabet: str = "sign", thr: float = 0.003) -> DataFrame:
    """Per k and gram the direction learned on dev bars, and its hit rate and edge over the base rate on later ones."""
    rows = df
    cols = []
    for k in ks:
        rows = kgram(rows, k, alphabet, thr, by=by).withColumnRenamed("gram", f"_g{k}")
        cols.append(F.struct(F.lit(k).alias("k"), F.col(f"_g{k}").alias("gram")))
        if k != list(ks)[-1]:
            rows = rows.drop("up")
    rows = chrono_split(rows.where("up is not null"), frac, by)
    dev = F.col("part") == "dev"
    per = rows.select(*by, "part", "up", F.explode(F.array(*cols)).alias("g")).select(*by, "part", "up", "g.*").where("gram is not null")
    out = per.groupBy(*by, "k", "gram").agg(F.sum(F.when(dev, 1).otherwise(0)).alias("dev_n"), F.avg(F.when(dev, F.col("up"))).alias("dev_rate"), F.sum(F.when(~dev, 1).otherwise(0)).alias("hold_n"), F.avg(F.when(~dev, F.col("up"))).alias("_h"))
    base = rows.where(~dev).groupBy(*by).agg(F.avg("up").alias("_b"))
    out = out.where((F.col("dev_n") >= min_dev) & (F.col("hold_n") >= min_hold)).join(base, list(by))
    out = out.withColumn("direction", (F.col("dev_rate") >= 0.5).cast("int"))
    side = F.col("direction") == 1
    out = out.withColumn("hold_hit", F.when(side, F.col("_h")).otherwise(1 - F.col("_h")))
    return out.withColumn("edge", F.col("hold_hit") - F.when(side, F.col("_b")).otherwise(1 - F.col("_b"))).drop("_h", "_b")


def ngram_summary(grams: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Per k the hit rate and edge over all its grams."""
    return grams.groupBy(*by, "k").agg(F.count("*").alias("n_grams"), F.sum("hold_n").alias("hold_n"), (F.sum(F.col("hold_hit") * F.col("hold_n")) / F.sum("hold_n")).alias("hit"), (F.sum(F.col("edge") * F.col("hold_n")) / F.sum("hold_n")).alias("edge"))


def streak_gate(df: DataFrame, lens: Sequence[int] = range(1, 9), by: Sequence[str] = BY, ret: str = "return_1h") -> DataFrame:
    """Coverage and hit rate of betting against runs of at least each length."""
    rows = df.where(F.col(ret).isNotNull())
    against = (F.signum(ret) == -F.signum("streak")).cast("int")
    total = rows.groupBy(*by).agg(F.count("*").alias("_n"), *[F.sum(F.when(F.abs("streak") >= k, 1).otherwise(0)).alias(f"n{k}") for k in lens], *[F.sum(F.when(F.abs("streak") >= k, against)).alias(f"h{k}") for k in lens])
    r = F.explode(F.array(*[F.struct(F.lit(k).alias("min_len"), F.col(f"n{k}").alias("n"), F.col(f"h{k}").alias("h")) for k in lens]))
    return total.select(*by, "_n", r.alias("r")).select(*by, "r.min_len", "r.n", (F.col("r.n") / F.col("_n")).alias("coverage"), div(F.col("r.h").cast("double"), F.col("r.n").cast("double")).alias("hit"))


def agreement(cols: Sequence[str]) -> tuple[Column, Column]:
    """(direction, number of agreeing timeframes) of signal columns; a tie is up."""
    up = sum((F.when(F.col(c) > 0, 1).otherwise(0) for c in cols), F.lit(0))
    down = sum((F.when(F.col(c) < 0, 1).otherwise(0) for c in cols), F.lit(0))
    return F.when((up >= down) & (up > 0), 1).when(down > 0, -1).otherwise(0), F.when((up >= down) & (up > 0), up).when(down > 0, down).otherwise(0)


def multi_tf_gate(panel: DataFrame, cols: Sequence[str], ks: Sequence[int] = (1, 2, 3, 4), lens: Sequence[int] = (0,), by: Sequence[str] = ("asset",)) -> DataFrame:
    """Coverage and hit rate of the timeframes' common direction, for K agreeing ones and a run of at least L."""
    way, agree = agreement(cols)
    rows = panel.where("fwd is not null").withColumns({"_way": way, "_agree": agree})
    grid = F.explode(F.array(*[F.struct(F.lit(l).alias("l"), F.lit(k).alias("k")) for l in lens for k in ks]))  # noqa: E741
    hit = (F.signum("fwd") == F.col("_way")).cast("int")
    use = (F.col("_agree") >= F.col("k")) & (F.abs("streak") >= F.col("l")) & (F.col("_way") != 0)
    out = rows.withColumn("_g", grid).select("*", "_g.*").groupBy(*by, "l", "k").agg(F.sum(use.cast("int")).alias("n"), F.avg(use.cast("int")).alias("coverage"), F.avg(F.when(use, hit)).alias("hit"))
    return out


def conviction_tier(panel: DataFrame, cols: Sequence[str], vr_rule: bool = True) -> DataFrame:
    """Adds streak_dir, multi_dir, tf_agree, aligned, tier and dir: the first tier that a bar meets."""
    way, agree = agreement(cols)
    out = panel.withColumns({"streak_dir": -F.signum("streak").cast("int"), "multi_dir": way, "tf_agree": agree, "slen": F.abs("streak")})
    out = out.withColumn("aligned", (F.col("streak_dir") != 0) & (F.col("multi_dir") != 0) & (F.col("streak_dir") == F.col("multi_dir")))
    high = (F.coalesce(F.col("vr"), F.lit("")) == "HIGH_VR") if vr_rule else F.lit(False)
    tier = F.lit(None).cast("string")
    for name, s, k, _ in reversed(TIERS):
        least = F.when(high, F.lit(max(s, HIGH_VR_MIN_STREAK))).otherwise(F.lit(s)) if s else F.lit(0)
        run = (F.col("slen") >= least) & (F.col("streak_dir") != 0)
        many = (F.col("tf_agree") >= k) & (F.col("multi_dir") != 0)
        tier = F.when(run if k == 0 else many if s == 0 else run & many & F.col("aligned"), name).otherwise(tier)
    out = out.withColumn("tier", tier)
    return out.withColumn("dir", F.when(F.col("tier") == "multi3", F.col("multi_dir")).when(F.col("tier").isNotNull(), F.col("streak_dir")).otherwise(0))


def tier_calibration(panel: DataFrame, by: Sequence[str] = ("asset",), sparse_only: bool = False) -> DataFrame:
    """Hit rate per tier, apart for bars where the run and the timeframes conflict."""
    rows = panel.where("tier is not null and fwd is not null and fwd <> 0")
    if sparse_only:
        rows = rows.where(F.col("tier").isin("elite", "strong", "high"))
    hit = (F.signum("fwd") == F.col("dir")).cast("int")
    conflict = (F.col("multi_dir") != 0) & (F.col("streak_dir") != 0) & (F.col("multi_dir") != F.col("streak_dir"))
    return rows.groupBy(*by, "tier").agg(F.count("*").alias("n"), F.avg(hit).alias("hit"), F.sum(conflict.cast("int")).alias("conflict_n"), F.avg(F.when(conflict, hit)).alias("conflict_hit"))


def primary_policy(panel: DataFrame, core: Sequence[str] = ("s15m", "s30m", "s1h"), mode: str = "frequent") -> DataFrame:
    """The direction to act on. "frequent": the unanimous core timeframes beat the tier; "sparse": tiers of high quality only."""
    a, b, c = (F.signum(F.coalesce(x, F.lit(0))).cast("int") for x in core)
    unanimous = F.when((a != 0) & (a == b) & (b == c), a)
    conv = F.when(F.col("dir") != 0, F.col("dir"))
    if mode == "sparse":
        quality = F.col("tier").isin("elite", "strong", "high")
        way = F.when(quality, conv)
        source = F.when(way.isNotNull(), "sparse").otherwise("abstain")
        reason = F.when(way.isNotNull(), F.col("tier")).when(conv.isNotNull(), "tier_below_high").otherwise("no_signal")
    else:
        way = F.when(conv.isNotNull(), F.coalesce(unanimous, conv))
        source = F.when(conv.isNull(), "abstain").when(unanimous.isNotNull() & (unanimous != conv), "frequent").otherwise("conviction")
        reason = F.when(conv.isNull(), "no_signal").when(unanimous.isNotNull() & (unanimous != conv), "conflict").when(unanimous.isNotNull(), "aligned").otherwise("tier_only")
    return panel.withColumns({"primary_dir": F.coalesce(way, F.lit(0)), "source": source, "reason": reason})


def vr_gate(panel: DataFrame, min_len: int = 2, by: Sequence[str] = ("asset",)) -> DataFrame:
    """Hit rate of betting against runs by volatility regime, over all and over all but HIGH_VR."""
    rows = panel.where((F.abs("streak") >= min_len) & F.col("fwd").isNotNull() & (F.col("fwd") != 0))
    hit = (F.signum("fwd") == -F.signum("streak")).cast("int")
    groups = F.explode(F.array_compact(F.array(F.col("vr"), F.lit("ALL"), F.when(F.col("vr") != "HIGH_VR", "NOT_HIGH"))))
    return rows.withColumn("_hit", hit).select(*by, groups.alias("vr"), "_hit").groupBy(*by, "vr").agg(F.count("*").alias("n"), F.avg("_hit").alias("hit"))


def vr_conviction(panel: DataFrame, by: Sequence[str] = ("asset",)) -> DataFrame:
    """Hit rate per tier and volatility regime."""
    rows = panel.where("tier is not null and fwd is not null and fwd <> 0")
    hit = (F.signum("fwd") == F.col("dir")).cast("int")
    return rows.groupBy(*by, "tier", "vr").agg(F.count("*").alias("n"), F.avg(hit).alias("hit"))


def multi_res_ensemble(grid: DataFrame, preds: dict[str, DataFrame], by: Sequence[str] = ("asset",), tolerance: str | None = None) -> DataFrame:
    """Each resolution's latest prediction on the grid (by, ts, up): hit rates of each, of unanimous and majority votes."""
    out = grid
    for name, p in preds.items():
        out = asof_join(out, p.select(*by, "ts", F.col("pred").alias(f"p_{name}")), by, tolerance=tolerance)
    cols = [F.col(f"p_{n}") for n in preds]
    votes = F.array_compact(F.array(*cols))
    total = F.aggregate(votes, F.lit(0), lambda a, v: a + v)
    full = F.size(votes) == len(cols)
    modes = {**{n: F.col(f"p_{n}") for n in preds}, "unanimous": F.when(full & (total == len(cols)), 1).when(full & (total == 0), 0), "majority": F.when(full & (2 * total != len(cols)), (2 * total > len(cols)).cast("int"))}
    stacked = out.where("up is not null").select(*by, "up", F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), c.alias("p")) for m, c in modes.items()])).alias("r")).select(*by, "up", "r.*")
    return stacked.groupBy(*by, "mode").agg(F.count("p").alias("n"), F.avg((F.col("p") == F.col("up")).cast("int")).alias("hit"), F.avg(F.col("p").isNotNull().cast("int")).alias("agreement_rate"))


def micro_macro(micro: DataFrame, macro: DataFrame, by: Sequence[str] = ("asset",), ret: str = "return_1h") -> DataFrame:
    """Reversal by the sign of the micro run and of the last closed macro bar (available_at, macro_sign), with totals."""
    rows = asof_join(micro.select(*by, "ts", "streak", F.col(ret).alias("ret")).where("streak <> 0 and ret is not null and ret <> 0"), macro.select(*by, F.col("available_at"), "macro_sign"), by, right_on="available_at").where("macro_sign is not null")
    rows = rows.withColumns({"micro": F.signum("streak").cast("int"), "macro": F.col("macro_sign").cast("int"), "_up": (F.col("ret") > 0).cast("int"), "_rev": (F.signum("ret") != F.signum("streak")).cast("int")})
    sets = [[*map(F.col, by), F.col("micro"), F.col("macro")], [*map(F.col, by), F.col("micro")], [*map(F.col, by), F.col("macro")], [*map(F.col, by)]]
    return rows.groupingSets(sets, *by, "micro", "macro").agg(F.count("*").alias("n"), F.avg("_up").alias("next_up"), F.avg("_rev").alias("reversal"))


def vol_conditioned(df: DataFrame, frac: float = 0.3, by: Sequence[str] = BY, ret: str = "return_1h", min_len: int = 2) -> DataFrame:
    """Reversal of runs on hold bars with volatility over or under the dev median."""
    split = chrono_split(df.where("volatility is not null"), frac, by)
    median = split.where("part = 'dev'").groupBy(*by).agg(F.percentile("volatility", 0.5).alias("_m"))
    rows = split.where("part = 'hold'").join(median, list(by)).where((F.abs("streak") >= min_len) & F.col(ret).isNotNull() & (F.col(ret) != 0))
    return rows.withColumn("vol_bucket", F.when(F.col("volatility") <= F.col("_m"), "LOW").otherwise("HIGH")).groupBy(*by, "vol_bucket").agg(F.count("*").alias("n"), F.avg((F.signum(ret) != F.signum("streak")).cast("int")).alias("reversal"))


def signal_correlation(panel: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Pairwise correlation of the columns: a, b, corr, n; one pass over the panel."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    aggs = [x for i, (a, b) in enumerate(pairs) for x in (F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}"), F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias(f"n{i}"))]
    wide = panel.groupBy(*keys).agg(*aggs)
    return wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr"), F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(pairs)])).alias("r")).select(*keys, "r.*")


def joint_agreement(pair: DataFrame) -> DataFrame:
    """Two assets' signals: how often they agree, and a's hit rate when they agree or not."""
    rows = pair.where("a_sig <> 0 and b_sig <> 0 and a_fwd is not null and a_fwd <> 0")
    return rows.groupBy(F.when(F.col("a_sig") == F.col("b_sig"), "agree").otherwise("disagree").alias("kind")).agg(F.count("*").alias("n"), F.avg((F.signum("a_fwd") == F.col("a_sig")).cast("int")).alias("hit"))


def _corr(a: Column | str, b: Column | str, w: WindowSpec | None = None) -> Column:
    """Pearson's correlation, null where one side doesn't vary."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    over_w = (lambda c: c.over(w)) if w is not None else (lambda c: c)
    both = a.isNotNull() & b.isNotNull()
    spread = over_w(F.stddev_pop(F.when(both, a))) * over_w(F.stddev_pop(F.when(both, b)))
    return div(over_w(F.covar_pop(a, b)), spread)


def cross_asset_corr(pair: DataFrame, lags: Sequence[int] = range(-3, 4), window: int = 720, rows: int = ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per lag the correlation of a with b shifted; rolling statistics; same direction and leader hits) of a_ret, b_ret.

    The pair is one series; it is cut into chunks of ``rows`` rows that overlap by what the lags and windows reach, so no
    window is over the whole of it.
    """
    known = pair.where("a_ret is not null and b_ret is not null").select("ts", "a_ret", "b_ret")
    w = Window.partitionBy("_key", "_chunk").orderBy("ts")
    near = overlapped(known, max(0, *lags), max(1, *[-k for k in lags]), rows)
    b = {k: F.lag("b_ret", k).over(w) if k >= 0 else F.lead("b_ret", -k).over(w) for k in lags}
    lagged = near.select("_home", "a_ret", *[c.alias(f"l{k + 100}") for k, c in b.items()]).where("_home")
    wide = lagged.agg(*[x for k in lags for x in (_corr("a_ret", f"l{k + 100}").alias(f"c{k + 100}"), F.count(f"l{k + 100}").alias(f"n{k + 100}"))])
    per_lag = wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"c{k + 100}").alias("corr"), F.col(f"n{k + 100}").alias("n")) for k in lags])).alias("r")).select("r.*")
    wide_window = w.rowsBetween(-(window - 1), 0)
    full = F.count(F.lit(1)).over(wide_window) == window
    rolled = overlapped(known, window - 1, 0, rows).select("_home", F.when(full, _corr("a_ret", "b_ret", wide_window)).alias("c")).where("_home and c is not null").agg(F.count("*").alias("n"), F.avg("c").alias("mean"), F.min("c").alias("min"), F.max("c").alias("max"))
    ahead = near.withColumn("_b1", F.lead("b_ret").over(w)).where("_home")
    same = ahead.agg(F.count("*").alias("n"), F.avg((F.signum("a_ret") == F.signum("b_ret")).cast("int")).alias("same_dir"), F.avg(F.when(F.col("_b1").isNotNull() & (F.col("a_ret") != 0), (F.signum("a_ret") == F.signum("_b1")).cast("int"))).alias("lead_hit"))
    return per_lag, rolled, same


def yearly_stability(df: DataFrame, period: Column | None = None, min_len: int = 2, by: Sequence[str] = BY, ret: str = "return_1h") -> DataFrame:
    """Hit rate of betting against runs per calendar year, or another period."""
    rows = df.where((F.abs("streak") >= min_len) & F.col(ret).isNotNull() & (F.col(ret) != 0))
    return rows.groupBy(*by, (period if period is not None else F.year("ts")).alias("period")).agg(F.count("*").alias("n"), F.avg((F.signum(ret) != F.signum("streak")).cast("int")).alias("hit"))


def decay(yearly: DataFrame, recent: int = 1, drop: float = 0.02, by: Sequence[str] = BY) -> DataFrame:
    """Hit rates weighted by n of the ``recent`` last periods and of the earlier ones, and whether they fell."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("period")))
    late = F.col("_r") <= recent
    out = yearly.withColumn("_r", rank).groupBy(*by).agg((F.sum(F.when(late, F.col("hit") * F.col("n"))) / F.sum(F.when(late, F.col("n")))).alias("recent"), (F.sum(F.when(~late, F.col("hit") * F.col("n"))) / F.sum(F.when(~late, F.col("n")))).alias("earlier"))
    return out.withColumn("delta", F.col("recent") - F.col("earlier")).withColumn("decayed", F.coalesce(F.col("delta") < -drop, F.lit(False)))


def decay_by_regime(df: DataFrame, cut: Column, regime: str = "vr", min_len: int = 2, by: Sequence[str] = BY, ret: str = "return_1h") -> DataFrame:
    """Hit rate before and after a time, per regime and over all."""
    rows = df.where((F.abs("streak") >= min_len) & F.col(ret).isNotNull() & (F.col(ret) != 0))
    rows = rows.withColumns({"era": F.when(F.col("ts") >= cut, "recent").otherwise("earlier"), "regime": F.col(regime), "_hit": (F.signum(ret) != F.signum("streak")).cast("int")})
    out = rows.groupingSets([[*map(F.col, by), F.col("era"), F.col("regime")], [*map(F.col, by), F.col("era")]], *by, "era", "regime").agg(F.count("*").alias("n"), F.avg("_hit").alias("hit"))
    return out.withColumn("regime", F.coalesce("regime", F.lit("ALL")))


def quarterly(df: DataFrame, period: Column | None = None, by: Sequence[str] = BY, ret: str = "return_1h") -> DataFrame:
    """The reversion index per quarter (or another period), with its trend: slope and correlation against the period's rank."""
    p = period if period is not None else F.year("ts") * 4 + F.quarter("ts") - 1
    per = reversion_index(df.withColumn("period", p), min_n=1, by=[*by, "period"], ret=ret)
    ranked = per.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy("period")))
    w = Window.partitionBy(*by)
    return ranked.withColumns({"slope": F.regr_slope("reversion_index", "_at").over(w), "corr": F.corr("reversion_index", F.col("_at").cast("double")).over(w)}).drop("_at")


#: Conditions on two assets' tier columns, as SQL over {a} and {b}, the prefixes of the predicted and the other asset.
CONDITIONS: dict[str, dict[str, str]] = {
    "base": {
        "own": "{a}tier = 'elite' AND {a}dir <> 0",
        "pair": "{a}tier = 'elite' AND {b}tier = 'elite' AND {a}dir = {b}dir AND {a}dir <> 0",
        "frames": "{a}tf_agree = 4 AND {b}tf_agree = 4 AND {a}aligned AND {b}aligned AND {a}dir = {b}dir AND {a}dir <> 0",
        "led": "{a}tf_agree = 4 AND {a}aligned AND {a}dir = {b}dir AND {a}dir <> 0",
    },
    "side": {"": "", "a": "{a}slen >= {run}", "b": "{b}slen >= {run}", "ab": "{a}slen >= {run} AND {b}slen >= {run}"},
    "regime": {"": "", "low": "{a}vr = 'LOW_VR' AND {b}vr = 'LOW_VR'", "high": "{a}vr = 'HIGH_VR' AND {b}vr = 'HIGH_VR'"},
    "extra": {"": "", "freq": "{a}freq AND {b}freq", "fund": "coalesce({a}fund_extreme, false)"},
}


def catalog_rules(bases: Sequence[str] = ("own", "pair", "frames", "led"), sides: Sequence[str] = ("", "a", "b", "ab"), runs: Sequence[int] = (4,), regimes: Sequence[str] = ("", "low", "high"), moves: Sequence[float] = (0.0, 0.005, 0.01), extras: Sequence[str] = ("",)) -> dict[str, str]:
    """A catalogue of rules, one for each choice of a base, runs of some length on some side, a regime, a least move and more.

    Names tell the choices, moves in basis points (``pair_ab4_low_m50``); values are conditions in SQL over {a} and {b}.
    """
    out = {}
    for base, side, regime, move, extra in product(bases, sides, regimes, moves, extras):
        for run in runs if side else (0,):
            parts = [CONDITIONS["base"][base], CONDITIONS["side"][side].replace("{run}", str(run)), CONDITIONS["regime"][regime], f"{{a}}absret >= {move}" if move else "", CONDITIONS["extra"][extra]]
            name = "_".join(x for x in (base, f"{side}{run}" if side else "", regime, f"m{round(move * 10_000)}" if move else "", extra) if x)
            out[name] = " AND ".join(x for x in parts if x)
    return out


def _holds(condition: str) -> Column:
    return F.coalesce(F.expr(condition.format(a="a_", b="b_")), F.lit(False))


def rule_catalog(pair: DataFrame, rules: dict[str, str] | None = None, min_n: int = 20) -> DataFrame:
    """Every rule side by side on (a_*, b_*, a_fwd): n, coverage_pct, hit_rate, rank among those with enough cases.

    A row counts for each rule that holds, in one pass over the pair's rows.
    """
    rules = rules or catalog_rules()
    rows = pair.where("a_fwd is not null")
    hit = (F.signum("a_fwd") == F.col("a_dir")).cast("int").alias("hit")
    held = F.array_compact(F.array(*[F.when(_holds(c), F.lit(k)) for k, c in rules.items()], F.lit("")))  # "" stands for every row
    counts = rows.select(hit, F.explode(held).alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("n"), F.avg("hit").alias("hit_rate"))
    every = pair.sparkSession.createDataFrame([(k,) for k in rules], "rule_id string")  # as many rows as there are rules
    total = counts.where("rule_id = ''").select(F.col("n").alias("_n"))
    out = F.broadcast(every).join(counts, "rule_id", "left").join(F.broadcast(total), F.lit(True), "left")
    out = out.select("rule_id", F.coalesce("n", F.lit(0)).alias("n"), (100.0 * F.coalesce("n", F.lit(0)) / F.col("_n")).alias("coverage_pct"), "hit_rate")
    rank = F.row_number().over(Window.orderBy((F.col("n") >= min_n).desc(), F.col("hit_rate").desc_nulls_last(), F.col("n").desc(), "rule_id"))
    return out.withColumn("rank", rank)


def promote(catalog: DataFrame, active_hit: float, min_n: int = 20, margin: float = 0.0) -> DataFrame:
    """The best rule with enough cases, and whether it beats the active one."""
    return catalog.where((F.col("rank") == 1) & (F.col("n") >= min_n)).withColumn("promote", F.col("hit_rate") > active_hit + margin)


def rule_replay(pair: DataFrame, rule_id: str, rules: dict[str, str] | None = None) -> DataFrame:
    """A rule's signals with their outcome."""
    picked = _holds((rules or catalog_rules())[rule_id])
    out = pair.where(picked & F.col("a_fwd").isNotNull())
    return out.select("ts", F.when(F.col("a_dir") > 0, "UP").otherwise("DOWN").alias("direction"), F.when(F.signum("a_fwd") == F.col("a_dir"), "hit").otherwise("miss").alias("outcome"), (100 * F.col("a_fwd")).alias("forward_return_pct"))


def session_benchmark(bars: DataFrame, ranges: dict[str, tuple[str, str]], min_n: int = 1, by: Sequence[str] = BY, ret: str = "return_1h") -> DataFrame:
    """The reversion index with runs that start anew each day, per named range of dates."""
    rows = streak_session(bars, ret, by)
    label = F.explode(F.array_compact(F.array(*[F.when(F.to_date("ts").between(a, b), F.lit(k)) for k, (a, b) in ranges.items()])))
    return reversion_index(rows.withColumn("label", label), min_n=min_n, by=[*by, "label"], ret=ret)


def generalization(df: DataFrame, by: Sequence[str] = BY, ret: str = "return_1h") -> DataFrame:
    """Per series the numbers of its mechanism: reversion, the close position's edge, the median range."""
    rev = reversion_index(df, min_n=1, by=by, ret=ret).select(*by, "reversion_index")
    edge = df.where("fwd is not null and close_pos is not null and fwd <> 0").groupBy(*by).agg((F.avg(F.when(F.col("close_pos") <= 1 / 3, (F.col("fwd") > 0).cast("int"))) - F.avg(F.when(F.col("close_pos") >= 2 / 3, (F.col("fwd") > 0).cast("int")))).alias("close_pos_edge"), F.percentile("range_pct", 0.5).alias("range_med"))
    return edge.join(rev, list(by), "left")

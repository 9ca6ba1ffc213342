"""Registered queries: runs, timeframes, funding, news, positions, streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from barweave.functions import discretize as P, features as X
from barweave.operators import positions as H, resample as R, streaks as Q, studies as N
from barweave.plans import bindings as B, workloads as W
from barweave.plans.catalogue import bars_sql, daily_pool, pool_streak, roll
from barweave.plans.registry import cte, query
from barweave.sources.stored import shared_folder
from barweave.streaming import stream as ST

A = ["asset"]
_T = "SELECT *, t AS ts FROM "

# ---- runs and n-grams

_ON = "CAST(sign(return_1h) = sign(streak) AS INT)"
_OFF = "CAST(sign(return_1h) <> sign(streak) AS INT)"


@query("q1_trend_structure", "asset sign:i len:i n:i next_up_rate:d continuation:d behaviour", f"SELECT *, CASE WHEN continuation > 0.5 THEN 'continues' WHEN continuation < 0.5 THEN 'reverts' ELSE 'even' END AS behaviour FROM (SELECT asset, sign(streak) AS sign, least(abs(streak), 5) AS len, count(*) AS n, avg(CAST(return_1h > 0 AS INT)) AS next_up_rate, avg({_ON}) AS continuation FROM pool WHERE streak <> 0 AND return_1h IS NOT NULL GROUP BY ALL) AS x")
def q1(spark, sf):
    return Q.trend_structure(pool_streak(spark, sf))


cte("cells", f"SELECT asset, streak, count(*) AS n, sum({_ON}) AS c FROM pool_daily WHERE abs(streak) BETWEEN 2 AND 7 AND return_1h <> 0 GROUP BY ALL HAVING count(*) >= 10")


@query("q2_reversion_index", "asset n:i continuation:d reversion_index:d", "SELECT asset, sum(n) AS n, sum(c) / sum(n) AS continuation, 0.5 - sum(c) / sum(n) AS reversion_index FROM cells GROUP BY asset")
def q2(spark, sf):
    return Q.reversion_index(daily_pool(spark, sf), min_n=10)


def _stk(src: str, res: str) -> str:
    sg = f"(SELECT *, coalesce(sign(r), 0) AS sg FROM (SELECT asset, t, close, close / lag(close) OVER (PARTITION BY asset ORDER BY t) - 1 AS r FROM {src}) AS a)"
    isl = f"(SELECT *, sum(ch) OVER (PARTITION BY asset ORDER BY t ROWS UNBOUNDED PRECEDING) AS isl FROM (SELECT *, CASE WHEN sg = lag(sg) OVER (PARTITION BY asset ORDER BY t) THEN 0 ELSE 1 END AS ch FROM {sg} AS b) AS c)"
    return f"SELECT *, coalesce(lag(si) OVER (PARTITION BY asset ORDER BY t), 0) AS streak, '{res}' AS res FROM (SELECT *, sg * row_number() OVER (PARTITION BY asset, isl ORDER BY t) AS si FROM {isl} AS d) AS e"


for _r in ("15m", "30m", "1h", "4h"):
    cte(f"run_{_r}", _stk(f"bars_{_r}", _r))
cte("ladder_cells", "SELECT asset, res, streak, count(*) AS n, sum(CAST(sign(r) = sign(streak) AS INT)) AS c FROM (SELECT * FROM run_15m UNION ALL SELECT * FROM run_1h UNION ALL SELECT * FROM run_4h) AS x WHERE abs(streak) BETWEEN 2 AND 7 AND r <> 0 GROUP BY ALL HAVING count(*) >= 10")


@query("q3_reversion_ladder", "asset res n:i reversion_index:d slope:d", "SELECT asset, res, sum(n) AS n, 0.5 - sum(c) / sum(n) AS reversion_index, regr_slope(c / n, len) AS slope FROM (SELECT asset, res, abs(streak) AS len, sum(n) AS n, sum(c) AS c FROM ladder_cells GROUP BY ALL) AS x GROUP BY asset, res")
def q3(spark, sf):
    ladder = R.rollup_ladder(B.bars(spark, sf, "5m"), ["15m", "1h", "4h"])
    return Q.reversion_ladder(X.streak_before(X.pct_return(ladder, 1, name="return_1h")), 10)


cte("gram_part", "SELECT g.*, CASE WHEN r <= floor(n_all * 0.7 + 1e-9) THEN 'dev' ELSE 'hold' END AS part FROM grams AS g JOIN (SELECT asset, t, row_number() OVER (PARTITION BY asset ORDER BY t) AS r, count(*) OVER (PARTITION BY asset) AS n_all FROM pool WHERE return_1h IS NOT NULL) AS p USING (asset, t)")
cte("gram_out", """SELECT *, CASE WHEN d = 1 THEN h ELSE 1 - h END AS hold_hit, CASE WHEN d = 1 THEN h - b ELSE b - h END AS edge FROM (SELECT asset, k, gram, count(*) FILTER (part = 'dev') AS dev_n, avg(up) FILTER (part = 'dev') AS dev_rate, count(*) FILTER (part = 'hold') AS hold_n, avg(up) FILTER (part = 'hold') AS h, CAST(avg(up) FILTER (part = 'dev') >= 0.5 AS INT) AS d
    FROM gram_part WHERE gram IS NOT NULL GROUP BY ALL) AS x JOIN (SELECT asset, avg(up) AS b FROM gram_part WHERE part = 'hold' AND k = 2 GROUP BY asset) AS y USING (asset) WHERE dev_n >= 30 AND hold_n >= 15""")


@query("q4_ngram_holdout", "asset k:i gram dev_n:i dev_rate:d direction:i hold_n:i hold_hit:d edge:d", "SELECT *, d AS direction FROM gram_out")
def q4(spark, sf):
    return Q.ngram_holdout(pool_streak(spark, sf), [2, 3])


@query("q4_ngram_summary", "asset k:i n_grams:i hold_n:i hit:d edge:d", "SELECT asset, k, count(*) AS n_grams, sum(hold_n) AS hold_n, sum(hold_hit * hold_n) / sum(hold_n) AS hit, sum(edge * hold_n) / sum(hold_n) AS edge FROM gram_out GROUP BY ALL")
def q4s(spark, sf):
    return Q.ngram_summary(Q.ngram_holdout(pool_streak(spark, sf), [2, 3]))


@query("q5_streak_gate", "asset min_len:i n:i coverage:d hit:d", "SELECT asset, l AS min_len, count(*) FILTER (abs(streak) >= l) AS n, count(*) FILTER (abs(streak) >= l) / count(*) AS coverage, avg(CAST(sign(return_1h) = -sign(streak) AS INT)) FILTER (abs(streak) >= l) AS hit FROM pool, range(1, 9) AS r(l) WHERE return_1h IS NOT NULL GROUP BY asset, l")
def q5(spark, sf):
    return Q.streak_gate(pool_streak(spark, sf))


# ---- timeframes

_COLS = ("s15m", "s30m", "s1h", "s4h")
for _r in ("15m", "30m", "1h", "4h"):
    cte(f"sig_{_r}", f"SELECT asset, CAST(t // 3600 * 3600 AS BIGINT) AS t, last(CASE WHEN abs(streak) >= 2 THEN -sign(streak) ELSE 0 END ORDER BY run_{_r}.t) AS s FROM run_{_r} GROUP BY ALL")
cte("run_vr", f"SELECT *, lag(ratio) OVER (PARTITION BY asset ORDER BY t) AS vol_ratio FROM (SELECT *, ({roll('stddev_samp(r)', 'r', 6)}) / nullif({roll('stddev_samp(r)', 'r', 24)}, 0) AS ratio, lead(close) OVER (PARTITION BY asset ORDER BY t) / close - 1 AS fwd, coalesce(lead(streak) OVER (PARTITION BY asset ORDER BY t), streak) AS st FROM run_1h) AS x")
cte("run_cut", "SELECT asset, quantile_cont(vol_ratio, 1.0 / 3) AS lo, quantile_cont(vol_ratio, 2.0 / 3) AS hi FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY t) AS pos, count(*) OVER (PARTITION BY asset) AS n_all FROM run_vr) AS x WHERE pos <= floor(n_all * 0.7 + 1e-9) GROUP BY asset")
cte("signals", "SELECT b.asset, b.t, b.r AS return_1h, b.st AS streak, b.fwd, CASE WHEN vol_ratio <= lo THEN 'LOW_VR' WHEN vol_ratio >= hi THEN 'HIGH_VR' ELSE 'NORMAL' END AS vr, " + ", ".join(f"s{r}.s AS s{r}" for r in ("15m", "30m", "1h", "4h")) + " FROM run_vr AS b LEFT JOIN run_cut AS c USING (asset) " + " ".join(f"ASOF LEFT JOIN sig_{r} AS s{r} ON b.asset = s{r}.asset AND b.t >= s{r}.t" for r in ("15m", "30m", "1h", "4h")))
_UP, _DN = (" + ".join(f"CAST(coalesce({c} {o} 0, false) AS INT)" for c in _COLS) for o in (">", "<"))
cte("agreed", f"SELECT *, CASE WHEN u >= d AND u > 0 THEN 1 WHEN d > 0 THEN -1 ELSE 0 END AS multi_dir, CASE WHEN u >= d AND u > 0 THEN u WHEN d > 0 THEN d ELSE 0 END AS tf_agree, -sign(streak) AS streak_dir, abs(streak) AS slen FROM (SELECT *, {_UP} AS u, {_DN} AS d FROM signals) AS x")


def _tier_case() -> str:
    out = "CASE"
    for name, s, k, _ in Q.TIERS:
        run = f"slen >= CASE WHEN vr = 'HIGH_VR' THEN {max(s, 3)} ELSE {s} END AND streak_dir <> 0"
        many = f"tf_agree >= {k} AND multi_dir <> 0"
        out += f" WHEN {run if k == 0 else many if s == 0 else f'{run} AND {many} AND aligned'} THEN '{name}'"
    return out + " END"


cte("tiers", f"SELECT *, CASE WHEN tier = 'multi3' THEN multi_dir WHEN tier IS NOT NULL THEN streak_dir ELSE 0 END AS dir FROM (SELECT *, {_tier_case()} AS tier FROM (SELECT *, streak_dir <> 0 AND multi_dir <> 0 AND streak_dir = multi_dir AS aligned FROM agreed) AS x) AS y")


def ladder(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {r: B.bars(spark, sf, r) for r in ("15m", "30m", "1h", "4h")}


def tiers(spark, sf) -> DataFrame:
    return W.conviction_panel(ladder(spark, sf))


@query("q6_multi_tf_gate", "asset l:i k:i n:i coverage:d hit:d", "SELECT asset, l, k, count(*) FILTER (ok) AS n, avg(CAST(ok AS INT)) AS coverage, avg(CAST(sign(fwd) = multi_dir AS INT)) FILTER (ok) AS hit FROM (SELECT *, tf_agree >= k AND slen >= l AND multi_dir <> 0 AS ok FROM agreed, range(1, 5) AS a(k), (SELECT unnest([0, 2]) AS l) AS b WHERE fwd IS NOT NULL) AS x GROUP BY asset, l, k")
def q6(spark, sf):
    return Q.multi_tf_gate(W.signal_panel(ladder(spark, sf)), _COLS, lens=(0, 2))


@query("q7_conviction_tier", "asset ts:i streak_dir:i multi_dir:i tf_agree:i aligned:b tier dir:i", _T + "tiers")
def q7(spark, sf):
    return tiers(spark, sf)


_OK = "tier IS NOT NULL AND fwd <> 0"


@query("q8_tier_calibration", "asset tier n:i hit:d conflict_n:i conflict_hit:d", f"SELECT asset, tier, count(*) AS n, avg(h) AS hit, sum(CAST(cf AS INT)) AS conflict_n, avg(h) FILTER (cf) AS conflict_hit FROM (SELECT *, CAST(sign(fwd) = dir AS INT) AS h, multi_dir <> 0 AND streak_dir <> 0 AND multi_dir <> streak_dir AS cf FROM tiers WHERE {_OK}) AS x GROUP BY ALL")
def q8(spark, sf):
    return Q.tier_calibration(tiers(spark, sf))


cte("policy", "SELECT *, CASE WHEN dir <> 0 AND un IS NOT NULL AND un <> dir THEN un ELSE dir END AS primary_dir, CASE WHEN dir = 0 THEN 'abstain' WHEN un IS NOT NULL AND un <> dir THEN 'frequent' ELSE 'conviction' END AS source, CASE WHEN dir = 0 THEN 'no_signal' WHEN un IS NOT NULL AND un <> dir THEN 'conflict' WHEN un IS NOT NULL THEN 'aligned' ELSE 'tier_only' END AS reason FROM (SELECT *, CASE WHEN coalesce(s15m, 0) <> 0 AND s15m = s30m AND s30m = s1h THEN sign(s15m) END AS un FROM tiers) AS x")


@query("q9_primary_policy", "asset ts:i primary_dir:i source reason", _T + "policy")
def q9(spark, sf):
    return Q.primary_policy(tiers(spark, sf))


@query("q10_vr_gate", "asset vr n:i hit:d", "SELECT asset, g AS vr, count(*) AS n, avg(h) AS hit FROM (SELECT asset, unnest(CASE WHEN vr = 'HIGH_VR' THEN [vr, 'ALL'] ELSE [vr, 'ALL', 'NOT_HIGH'] END) AS g, CAST(sign(fwd) = -sign(streak) AS INT) AS h FROM agreed WHERE slen >= 2 AND fwd <> 0) AS x GROUP BY asset, g")
def q10(spark, sf):
    return Q.vr_gate(W.signal_panel(ladder(spark, sf)))


@query("q10_vr_conviction", "asset tier vr n:i hit:d", f"SELECT asset, tier, vr, count(*) AS n, avg(CAST(sign(fwd) = dir AS INT)) AS hit FROM tiers WHERE {_OK} GROUP BY ALL")
def q10c(spark, sf):
    return Q.vr_conviction(tiers(spark, sf))


def _mode(name: str, p: str) -> str:
    return f"SELECT asset, '{name}' AS mode, count({p}) AS n, avg(CAST({p} = up AS INT)) AS hit, avg(CAST(({p}) IS NOT NULL AS INT)) AS agreement_rate FROM ens GROUP BY asset"


cte("ens", "SELECT asset, CAST(fwd > 0 AS INT) AS up, " + ", ".join(f"CASE WHEN s{r} <> 0 THEN CAST(s{r} > 0 AS INT) END AS p{r}" for r in ("15m", "30m", "1h")) + " FROM signals WHERE fwd IS NOT NULL")
_SUM = "p15m + p30m + p1h"


@query("q11_ensemble", "asset mode n:i hit:d agreement_rate:d", " UNION ALL ".join([_mode(r, f"p{r}") for r in ("15m", "30m", "1h")] + [_mode("unanimous", f"CASE WHEN {_SUM} = 3 THEN 1 WHEN {_SUM} = 0 THEN 0 END"), _mode("majority", f"CAST(2 * ({_SUM}) > 3 AS INT)")]))
def q11(spark, sf):
    panel = W.signal_panel(ladder(spark, sf))
    grid = panel.where("fwd is not null").select("asset", "ts", (F.col("fwd") > 0).cast("int").alias("up"))
    preds = {r: panel.select("asset", "ts", F.when(F.col(f"s{r}") != 0, (F.col(f"s{r}") > 0).cast("int")).alias("pred")) for r in ("15m", "30m", "1h")}
    return Q.multi_res_ensemble(grid, preds)


cte("macro", "SELECT asset, d0 + 86400 AS av, sign(c / lag(c) OVER (PARTITION BY asset ORDER BY d0) - 1) AS m FROM (SELECT asset, t // 86400 * 86400 AS d0, last(close ORDER BY t) AS c FROM bars_1h GROUP BY ALL) AS x")


@query("q12_micro_macro", "asset micro:i macro:i n:i next_up:d reversal:d", "SELECT asset, sign(streak) AS micro, m AS macro, count(*) AS n, avg(CAST(r > 0 AS INT)) AS next_up, avg(CAST(sign(r) <> sign(streak) AS INT)) AS reversal FROM (SELECT b.asset, b.streak, b.r, d.m FROM run_1h AS b ASOF JOIN macro AS d ON b.asset = d.asset AND b.t >= d.av WHERE b.streak <> 0 AND b.r <> 0) AS x WHERE m IS NOT NULL GROUP BY GROUPING SETS ((asset, sign(streak), m), (asset, sign(streak)), (asset, m), (asset))")
def q12(spark, sf):
    days = X.pct_return(R.resample_ohlcv(B.bars(spark, sf), "1d"), 1, name="r")
    macro = R.available_at(days, "ts", "1d").select("asset", "available_at", F.signum("r").alias("macro_sign"))
    return Q.micro_macro(pool_streak(spark, sf), macro)


cte("vol_part", "SELECT *, CASE WHEN row_number() OVER (PARTITION BY asset ORDER BY t) <= floor(count(*) OVER (PARTITION BY asset) * 0.7 + 1e-9) THEN 'dev' ELSE 'hold' END AS part FROM pool WHERE volatility IS NOT NULL")


@query("q13_vol_conditioned", "asset vol_bucket n:i reversal:d", f"SELECT asset, CASE WHEN volatility <= m THEN 'LOW' ELSE 'HIGH' END AS vol_bucket, count(*) AS n, avg({_OFF}) AS reversal FROM vol_part JOIN (SELECT asset, quantile_cont(volatility, 0.5) AS m FROM vol_part WHERE part = 'dev' GROUP BY asset) AS c USING (asset) WHERE part = 'hold' AND abs(streak) >= 2 AND return_1h <> 0 GROUP BY ALL")
def q13(spark, sf):
    return Q.vol_conditioned(pool_streak(spark, sf))


@query("q14_signal_correlation", "asset a b corr:d n:i", " UNION ALL ".join(f"SELECT asset, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM signals GROUP BY asset" for i, a in enumerate(_COLS) for b in _COLS[i + 1 :]))
def q14(spark, sf):
    return Q.signal_correlation(W.signal_panel(ladder(spark, sf)), _COLS, A)


cte("pair_ret", "SELECT a.t, a.return_1h AS a_ret, b.return_1h AS b_ret FROM pool AS a JOIN pool AS b USING (t) WHERE a.asset = 'click' AND b.asset = 'view' AND a.return_1h IS NOT NULL AND b.return_1h IS NOT NULL")


def pair(spark, sf) -> DataFrame:
    r = X.pct_return(B.bars(spark, sf), 1, name="ret")
    return R.align_assets(r, "click", "view", ["ret"])


@query("q15_lead_lag", "lag:i corr:d n:i", " UNION ALL ".join(f"SELECT {k} AS lag, corr(a_ret, l) AS corr, count(l) AS n FROM (SELECT a_ret, {'lag' if k >= 0 else 'lead'}(b_ret, {abs(k)}) OVER (ORDER BY t) AS l FROM pair_ret) AS x" for k in range(-3, 4)))
def q15(spark, sf):
    return Q.cross_asset_corr(pair(spark, sf))[0]


@query("q15_rolling_corr", "n:i mean:d min:d max:d", "SELECT count(*) AS n, avg(c) AS mean, min(c) AS min, max(c) AS max FROM (SELECT CASE WHEN count(*) OVER w = 100 THEN corr(a_ret, b_ret) OVER w END AS c FROM pair_ret WINDOW w AS (ORDER BY t ROWS 99 PRECEDING)) AS x WHERE c IS NOT NULL")
def q15r(spark, sf):
    return Q.cross_asset_corr(pair(spark, sf), window=100)[1]


@query("q15_same_direction", "n:i same_dir:d lead_hit:d", "SELECT count(*) AS n, avg(CAST(sign(a_ret) = sign(b_ret) AS INT)) AS same_dir, avg(CAST(sign(a_ret) = sign(b1) AS INT)) FILTER (b1 IS NOT NULL AND a_ret <> 0) AS lead_hit FROM (SELECT *, lead(b_ret) OVER (ORDER BY t) AS b1 FROM pair_ret) AS x")
def q15s(spark, sf):
    return Q.cross_asset_corr(pair(spark, sf))[2]


cte("yearly", f"SELECT asset, year(make_timestamp(t * 1000000)) AS period, count(*) AS n, avg({_OFF}) AS hit FROM pool_daily WHERE abs(streak) >= 2 AND return_1h <> 0 GROUP BY ALL")


@query("q16_yearly", "asset period:i n:i hit:d", "SELECT * FROM yearly")
def q16(spark, sf):
    return Q.yearly_stability(daily_pool(spark, sf))


@query("q16_decay", "asset recent:d earlier:d delta:d decayed:b", "SELECT *, recent - earlier AS delta, coalesce(recent - earlier < -0.02, false) AS decayed FROM (SELECT asset, sum(hit * n) FILTER (r <= 2) / sum(n) FILTER (r <= 2) AS recent, sum(hit * n) FILTER (r > 2) / sum(n) FILTER (r > 2) AS earlier FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY period DESC) AS r FROM yearly) AS x GROUP BY asset) AS y")
def q16d(spark, sf):
    return Q.decay(Q.yearly_stability(daily_pool(spark, sf)), 2)


@query("q17_decay_by_regime", "asset era regime n:i hit:d", "SELECT asset, era, coalesce(vr, 'ALL') AS regime, count(*) AS n, avg(h) AS hit FROM (SELECT asset, CASE WHEN t >= 1705276800 THEN 'recent' ELSE 'earlier' END AS era, vr, " + _OFF + " AS h FROM vr_state WHERE abs(streak) >= 2 AND return_1h <> 0) AS x GROUP BY GROUPING SETS ((asset, era, vr), (asset, era))")
def q17(spark, sf):
    rows = P.vr_regime(X.vol_ratio(pool_streak(spark, sf)))
    return Q.decay_by_regime(rows, F.timestamp_seconds(F.lit(1705276800)))


cte("quarters", f"SELECT asset, period, n, 0.5 - c / n AS reversion_index, row_number() OVER (PARTITION BY asset ORDER BY period) AS pno FROM (SELECT asset, year(make_timestamp(t * 1000000)) * 4 + quarter(make_timestamp(t * 1000000)) - 1 AS period, count(*) AS n, sum({_ON}) AS c FROM pool_daily WHERE abs(streak) BETWEEN 2 AND 7 AND return_1h <> 0 GROUP BY ALL) AS x")


@query("q17_quarterly", "asset period:i n:i reversion_index:d slope:d corr:d", "SELECT *, regr_slope(reversion_index, pno) OVER (PARTITION BY asset) AS slope, corr(reversion_index, pno) OVER (PARTITION BY asset) AS corr FROM quarters")
def q17q(spark, sf):
    return Q.quarterly(daily_pool(spark, sf))


def _each_rule(rules: dict[str, str] | None = None, source: str = "moved") -> str:
    parts = []
    for name, condition in (rules or Q.catalog_rules()).items():
        holds = f"coalesce({condition.format(a='a.', b='b.')}, false)"
        parts.append(f"SELECT '{name}' AS rule_id, count(*) FILTER ({holds}) AS n, 100.0 * count(*) FILTER ({holds}) / count(*) AS coverage_pct, avg(CAST(sign(a.fwd) = a.dir AS INT)) FILTER ({holds}) AS hit_rate FROM {source} AS a JOIN {source} AS b USING (t) WHERE a.asset = 'click' AND b.asset = 'view' AND a.fwd IS NOT NULL")
    return " UNION ALL ".join(parts)


cte("moved", "SELECT *, abs(return_1h) AS absret FROM tiers")


@query("q18_rule_catalog", "rule_id n:i coverage_pct:d hit_rate:d", _each_rule())
def q18(spark, sf):
    return Q.rule_catalog(W.tier_pair(tiers(spark, sf), "click", "view", _COLS))


_EXTRA = Q.catalog_rules(bases=("own", "pair", "led"), sides=("", "a"), regimes=("",), moves=(0.0,), extras=("freq", "fund"))
cte("fund_bucket", "SELECT f.asset, f.t, funding_rate <= lo OR funding_rate >= hi AS extreme FROM funding AS f JOIN (SELECT asset, quantile_cont(funding_rate, 0.1) AS lo, quantile_cont(funding_rate, 0.9) AS hi FROM fund_part WHERE part = 'dev' GROUP BY asset) AS c USING (asset)")
cte("moved_extra", "SELECT m.*, coalesce(s15m, 0) = coalesce(s30m, 0) AND coalesce(s30m, 0) = coalesce(s1h, 0) AND coalesce(s1h, 0) <> 0 AS freq, coalesce(f.extreme, false) AS fund_extreme FROM moved AS m ASOF LEFT JOIN fund_bucket AS f ON m.asset = f.asset AND m.t >= f.t")


@query("q18_rule_extras", "rule_id n:i coverage_pct:d hit_rate:d", _each_rule(_EXTRA, "moved_extra"))
def q18x(spark, sf):
    """Rules that also ask for agreeing timeframes of both assets, or for extreme funding of the first."""
    fund = P.decile_state(B.funding_like(spark, sf), "funding_rate", by=A).select("asset", "ts", (F.col("bucket") != "NEUTRAL").alias("fund_extreme"))
    return Q.rule_catalog(W.tier_pair(R.asof_join(tiers(spark, sf), fund), "click", "view", _COLS), _EXTRA)


@query("q18_all_rules_ranked", "rule_id n:i rank:i promote:b")
def q18a(spark, sf):
    ranked = Q.rule_catalog(W.tier_pair(tiers(spark, sf), "click", "view", _COLS))
    return ranked.join(Q.promote(ranked, 0.5).select("rule_id", "promote"), "rule_id", "left")


@query("q19_rule_replay", "ts:i direction outcome forward_return_pct:d", "SELECT t AS ts, CASE WHEN a.dir > 0 THEN 'UP' ELSE 'DOWN' END AS direction, CASE WHEN sign(a.fwd) = a.dir THEN 'hit' ELSE 'miss' END AS outcome, 100 * a.fwd AS forward_return_pct FROM tiers AS a JOIN tiers AS b USING (t) WHERE a.asset = 'click' AND b.asset = 'view' AND a.fwd IS NOT NULL AND a.tier = 'elite' AND a.dir <> 0 AND abs(a.return_1h) >= 0.005")
def q19(spark, sf):
    return Q.rule_replay(W.tier_pair(tiers(spark, sf), "click", "view", _COLS), "own_m50")


cte("sess", "SELECT *, CAST(s * row_number() OVER (PARTITION BY asset, d, isl ORDER BY t) AS BIGINT) AS sst FROM (SELECT *, sum(ch) OVER (PARTITION BY asset, d ORDER BY t ROWS UNBOUNDED PRECEDING) AS isl FROM (SELECT *, CASE WHEN s = lag(s) OVER (PARTITION BY asset, d ORDER BY t) THEN 0 ELSE 1 END AS ch FROM (SELECT asset, t, return_1h, t // 86400 AS d, coalesce(sign(lag(return_1h) OVER (PARTITION BY asset ORDER BY t)), 0) AS s FROM pool) AS a) AS b) AS c")


@query("q20_session_benchmark", "asset label n:i continuation:d reversion_index:d", "SELECT asset, 'january' AS label, count(*) AS n, avg(CAST(sign(return_1h) = sign(sst) AS INT)) AS continuation, 0.5 - avg(CAST(sign(return_1h) = sign(sst) AS INT)) AS reversion_index FROM sess WHERE abs(sst) BETWEEN 2 AND 7 AND return_1h <> 0 AND d BETWEEN 19723 AND 19753 GROUP BY asset")
def q20(spark, sf):
    return Q.session_benchmark(pool_streak(spark, sf).drop("streak"), {"january": ("2024-01-01", "2024-01-31")})


@query("q21_generalization", "asset close_pos_edge:d range_med:d reversion_index:d", f"SELECT e.asset, e.close_pos_edge, e.range_med, r.reversion_index FROM (SELECT asset, avg(CAST(fwd > 0 AS INT)) FILTER (close_pos <= 1.0 / 3) - avg(CAST(fwd > 0 AS INT)) FILTER (close_pos >= 2.0 / 3) AS close_pos_edge, quantile_cont(range_pct, 0.5) AS range_med FROM pool WHERE fwd <> 0 AND close_pos IS NOT NULL GROUP BY asset) AS e LEFT JOIN (SELECT asset, 0.5 - avg({_ON}) AS reversion_index FROM pool WHERE abs(streak) BETWEEN 2 AND 7 AND return_1h <> 0 GROUP BY asset) AS r USING (asset)")
def q21(spark, sf):
    return Q.generalization(pool_streak(spark, sf))


# ---- funding and news

cte("fund_frame", "SELECT *, CASE WHEN row_number() OVER (PARTITION BY asset ORDER BY t) <= floor(count(*) OVER (PARTITION BY asset) * 0.7 + 1e-9) THEN 'dev' ELSE 'hold' END AS part FROM (SELECT asset, t, funding_rate, lead(close) OVER (PARTITION BY asset ORDER BY t) / close - 1 AS ret FROM (SELECT f.asset, f.t, f.funding_rate, b.close FROM funding AS f ASOF LEFT JOIN bars_1h AS b ON f.asset = b.asset AND f.t >= b.t) AS x) AS y WHERE ret IS NOT NULL")


@query("n1_funding_contrarian", "asset n:i corr:d coverage:d hit:d", "SELECT asset, count(*) AS n, corr(funding_rate, ret) AS corr, avg(CAST(side IS NOT NULL AS INT)) FILTER (part = 'hold') AS coverage, avg(CAST(sign(ret) = side AS INT)) FILTER (part = 'hold' AND side IS NOT NULL) AS hit FROM (SELECT *, CASE WHEN funding_rate <= lo THEN 1 WHEN funding_rate >= hi THEN -1 END AS side FROM fund_frame JOIN (SELECT asset, quantile_cont(funding_rate, 0.1) AS lo, quantile_cont(funding_rate, 0.9) AS hi FROM fund_frame WHERE part = 'dev' GROUP BY asset) AS c USING (asset)) AS x GROUP BY asset")
def n1(spark, sf):
    return N.funding_contrarian(N.funding_frame(B.funding_like(spark, sf), B.bars(spark, sf)))


cte("fund_run", "SELECT *, CASE WHEN row_number() OVER (PARTITION BY asset ORDER BY t) <= floor(count(*) OVER (PARTITION BY asset) * 0.7 + 1e-9) THEN 'dev' ELSE 'hold' END AS part FROM (SELECT b.asset, b.t, b.streak, b.r, f.funding_rate FROM run_1h AS b ASOF JOIN funding AS f ON b.asset = f.asset AND b.t >= f.t) AS x")
cte("fund_hit", "SELECT asset, bucket, count(*) AS n, avg(CAST(sign(r) <> sign(streak) AS INT)) AS hit FROM (SELECT *, CASE WHEN funding_rate <= lo THEN 'EXTREME_NEG' WHEN funding_rate >= hi THEN 'EXTREME_POS' ELSE 'NEUTRAL' END AS bucket FROM fund_run JOIN (SELECT asset, quantile_cont(funding_rate, 0.1) AS lo, quantile_cont(funding_rate, 0.9) AS hi FROM fund_run WHERE part = 'dev' GROUP BY asset) AS c USING (asset)) AS x WHERE abs(streak) >= 2 AND r <> 0 GROUP BY ALL")


@query("n2_funding_streak", "asset bucket n:i hit:d boost:d", "SELECT *, hit - max(hit) FILTER (bucket = 'NEUTRAL') OVER (PARTITION BY asset) AS boost FROM fund_hit")
def n2(spark, sf):
    return N.funding_streak(pool_streak(spark, sf), B.funding_like(spark, sf), 2)


cte("carry", f"SELECT *, row_number() OVER (PARTITION BY asset ORDER BY t) AS rn, count(*) OVER (PARTITION BY asset) AS nn, abs(pos - coalesce(lag(pos) OVER (PARTITION BY asset ORDER BY t), 0)) AS sw FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY t) AS q, count(*) OVER (PARTITION BY asset) AS m FROM (SELECT *, CASE WHEN lag(g) OVER (PARTITION BY asset ORDER BY t) > 0 THEN 1.0 ELSE 0.0 END AS pos FROM (SELECT *, {roll('avg(funding_rate)', 'funding_rate', 6)} AS g FROM funding) AS a) AS b) AS c WHERE q > floor(m * 0.7 + 1e-9)")
cte("carry_long", "SELECT asset, t, 'taker' AS fee, 'passive' AS variant, funding_rate - (CAST(rn = 1 AS INT) + CAST(rn = nn AS INT)) * 0.001 AS net, 1.0 AS pos, 0.0 AS sw FROM carry UNION ALL SELECT asset, t, 'maker', 'passive', funding_rate - (CAST(rn = 1 AS INT) + CAST(rn = nn AS INT)) * 0.0004, 1.0, 0.0 FROM carry UNION ALL SELECT asset, t, 'taker', 'gated', pos * funding_rate - sw * 0.001, pos, sw FROM carry UNION ALL SELECT asset, t, 'maker', 'gated', pos * funding_rate - sw * 0.0004, pos, sw FROM carry UNION ALL SELECT asset, t, 'taker', 'stressed', pos * funding_rate - sw * 0.00125, pos, sw FROM carry")


def stats_sql(src: str, keys: str, bpy: float, extra: str = "", net: str = "net", moved: str = "sw > 0") -> str:
    """Return statistics from (keys, t, net, ...); the running product as the exponential of a sum of logarithms."""
    return f"""SELECT {keys}, count(*) AS n, last(eq ORDER BY t) - 1 AS total, CASE WHEN last(eq ORDER BY t) > 0 THEN pow(last(eq ORDER BY t), {bpy} / count(*)) - 1 END AS annual, CASE WHEN stddev_pop({net}) > 1e-15 THEN avg({net}) / stddev_pop({net}) * sqrt({bpy}) ELSE 0 END AS sharpe, min(eq / pk - 1) AS max_dd, sum(CAST({moved} AS INT)) AS n_changes {extra}
        FROM (SELECT *, max(eq) OVER (PARTITION BY {keys} ORDER BY t ROWS UNBOUNDED PRECEDING) AS pk FROM (SELECT *, exp(sum(ln(1 + {net})) OVER (PARTITION BY {keys} ORDER BY t ROWS UNBOUNDED PRECEDING)) AS eq FROM {src}) AS a) AS b GROUP BY {keys}"""


_STATS = "n:i total:d annual:d sharpe:d max_dd:d n_changes:i"


@query("n3_funding_carry", "asset fee variant " + _STATS + " coverage:d", stats_sql("carry_long", "asset, fee, variant", 1095, ", avg(pos) AS coverage"))
def n3(spark, sf):
    return N.funding_carry(B.funding_like(spark, sf), 6)


@query("n3_worst_rolling", "asset worst_annualized:d", f"SELECT asset, min(s) * (1095 / 20.0) AS worst_annualized FROM (SELECT asset, {roll('sum(funding_rate)', 'funding_rate', 20)} AS s FROM funding) AS x GROUP BY asset")
def n3w(spark, sf):
    return N.worst_rolling(B.funding_like(spark, sf), 20)


cte("fund_regime", f"SELECT *, coalesce(hot AND NOT coalesce(lag(hot) OVER (PARTITION BY asset ORDER BY t), false), false) AS turned_hot FROM (SELECT *, lag(g) OVER (PARTITION BY asset ORDER BY t) > 0 AS gate_on, lag(q) OVER (PARTITION BY asset ORDER BY t) * 1095 AS regime_annualized, lag(q) OVER (PARTITION BY asset ORDER BY t) * 1095 >= 0.1 AS hot FROM (SELECT *, {roll('avg(funding_rate)', 'funding_rate', 6)} AS g, {roll('avg(funding_rate)', 'funding_rate', 12)} AS q FROM funding) AS x) AS y")


@query("n4_funding_regime", "asset ts:i funding_rate:d gate_on:b regime_annualized:d hot:b turned_hot:b", _T + "fund_regime WHERE asset <> 'click' OR t > 1705276800")
def n4(spark, sf):
    r = N.funding_regime(B.funding_like(spark, sf), 6, 12)
    return N.funding_ledger(r, r.where("asset = 'click'").where(F.col("ts") <= F.timestamp_seconds(F.lit(1705276800))))


@query("n4_funding_report", "asset n:i gate_share:d collected:d hot:b edges:i", "SELECT asset, count(*) AS n, avg(CAST(gate_on AS INT)) AS gate_share, sum(funding_rate) FILTER (gate_on) AS collected, last(hot ORDER BY t) AS hot, sum(CAST(turned_hot AS INT)) AS edges FROM fund_regime GROUP BY asset")
def n4r(spark, sf):
    return N.funding_report(N.funding_regime(B.funding_like(spark, sf), 6, 12))


cte("day_ret", "SELECT asset, t // 86400 AS day, c / lag(c) OVER (PARTITION BY asset ORDER BY t) - 1 AS ret, lead(c) OVER (PARTITION BY asset ORDER BY t) / c - 1 AS fwd FROM (SELECT asset, t // 86400 * 86400 AS t, last(close ORDER BY bars_1h.t) AS c FROM bars_1h GROUP BY ALL) AS x")
cte("news_day", f"SELECT asset AS symbol, day AS t, ret, fwd, news_tone, news_tone_chg, news_vol_z, {roll('avg(abs(ret))', 'ret', 3, -1).replace('ORDER BY t', 'ORDER BY day')} AS recent_vol FROM day_ret JOIN (SELECT day, news_tone, news_tone - lag(news_tone) OVER (ORDER BY day) AS news_tone_chg, (news_volume - {roll('avg(news_volume)', 'news_volume', 5, part='symbol').replace('ORDER BY t', 'ORDER BY day')}) / nullif({roll('stddev_samp(news_volume)', 'news_volume', 5, part='symbol').replace('ORDER BY t', 'ORDER BY day')}, 0) AS news_vol_z FROM news) AS n USING (day)")


def news_day(spark, sf) -> DataFrame:
    days = R.resample_ohlcv(B.bars(spark, sf), "1d")
    days = X.recent_vol(X.forward_return(X.pct_return(days, 1, name="ret")), 3, "ret").withColumn("date", F.to_date("ts"))
    feats = X.news_features(B.news_like(spark, sf), 5).withColumn("date", F.date_sub("available_date", 1)).drop("symbol", "available_date")
    return days.join(feats, "date").select(F.col("asset").alias("symbol"), "ts", "date", "ret", "fwd", "recent_vol", "news_tone", "news_tone_chg", "news_vol_z")


cte("news_part", "SELECT *, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY t) <= floor(count(*) OVER (PARTITION BY symbol) * 0.7 + 1e-9) THEN 1 ELSE 0 END AS dev FROM news_day WHERE fwd IS NOT NULL")
cte("news_state", "SELECT x.*, unnest(list_filter([CASE WHEN news_tone <= tl THEN 'panic_extreme_neg_tone' END, CASE WHEN news_tone >= th THEN 'euphoria_extreme_pos_tone' END, CASE WHEN news_tone_chg <= cl THEN 'tone_shock_down' END, CASE WHEN news_tone_chg >= ch THEN 'tone_shock_up' END, CASE WHEN news_vol_z >= 1.5 THEN 'attention_spike' END], lambda s: s IS NOT NULL)) AS state FROM news_part AS x JOIN (SELECT symbol, quantile_cont(news_tone, 0.1) AS tl, quantile_cont(news_tone, 0.9) AS th, quantile_cont(news_tone_chg, 0.1) AS cl, quantile_cont(news_tone_chg, 0.9) AS ch FROM news_part WHERE dev = 1 GROUP BY symbol) AS c USING (symbol)")


@query("p10_n5_news_patterns", "symbol state dev_n:i dev_up:d hold_n:i hold_hit:d edge:d", "SELECT *, CASE WHEN dev_up >= 0.5 THEN h ELSE 1 - h END AS hold_hit, CASE WHEN dev_up >= 0.5 THEN h - b ELSE b - h END AS edge FROM (SELECT symbol, state, sum(dev) AS dev_n, avg(CAST(fwd > 0 AS INT)) FILTER (dev = 1) AS dev_up, sum(1 - dev) AS hold_n, avg(CAST(fwd > 0 AS INT)) FILTER (dev = 0) AS h FROM news_state GROUP BY ALL) AS x JOIN (SELECT symbol, avg(CAST(fwd > 0 AS INT)) AS b FROM news_part WHERE dev = 0 GROUP BY symbol) AS y USING (symbol) WHERE dev_n >= 1")
def n5(spark, sf):
    return N.news_patterns(news_day(spark, sf))


cte("att", "SELECT *, abs(fwd) AS m, news_vol_z >= 1.0 AS s, ntile(5) OVER (PARTITION BY symbol ORDER BY recent_vol, t) AS q FROM news_day WHERE fwd IS NOT NULL AND news_vol_z IS NOT NULL AND recent_vol IS NOT NULL")


@query("n6_news_attention", "symbol n:i n_spike:i gap:d controlled_gap:d corr:d partial_corr:d", "SELECT *, (corr - xv * yv) / nullif(sqrt((1 - xv * xv) * (1 - yv * yv)), 0) AS partial_corr FROM (SELECT symbol, count(*) AS n, sum(CAST(s AS INT)) AS n_spike, avg(m) FILTER (s) - avg(m) FILTER (NOT s) AS gap, corr(news_vol_z, m) AS corr, corr(news_vol_z, recent_vol) AS xv, corr(m, recent_vol) AS yv FROM att GROUP BY symbol) AS x LEFT JOIN (SELECT symbol, sum(g * k) / sum(k) AS controlled_gap FROM (SELECT symbol, q, avg(m) FILTER (s) - avg(m) FILTER (NOT s) AS g, sum(CAST(s AS INT)) AS k FROM att GROUP BY symbol, q) AS z WHERE g IS NOT NULL GROUP BY symbol) AS y USING (symbol)")
def n6(spark, sf):
    return N.news_attention(news_day(spark, sf), 1.0)


@query("n7_alignment", "symbol lag:i corr:d n:i sign_agreement:d", " UNION ALL ".join(f"SELECT symbol, {k} AS lag, corr(news_tone, l) AS corr, count(l) AS n, avg(CAST(sign(news_tone) = sign(l) AS INT)) FILTER (l <> 0) AS sign_agreement FROM (SELECT symbol, news_tone, {'lead' if k >= 0 else 'lag'}(ret, {abs(k)}) OVER (PARTITION BY symbol ORDER BY t) AS l FROM news_day) AS x GROUP BY symbol" for k in range(-2, 3)))
def n7(spark, sf):
    return N.alignment_check(news_day(spark, sf))


# ---- positions

cte("pos_rows", "SELECT asset, t, fwd, CAST(CASE WHEN abs(streak) >= 2 THEN -sign(streak) ELSE 0 END AS DOUBLE) AS target FROM pool WHERE fwd IS NOT NULL")
cte("pos_step", "SELECT *, first_value(target) OVER (PARTITION BY asset, b ORDER BY t) AS pos FROM (SELECT *, floor((row_number() OVER (PARTITION BY asset ORDER BY t) - 1) / 4) AS b FROM pos_rows) AS x")
cte("pos_net", "SELECT *, pos * fwd - cost AS net FROM (SELECT *, abs(pos - coalesce(lag(pos) OVER (PARTITION BY asset ORDER BY t), 0)) AS sw, abs(pos - coalesce(lag(pos) OVER (PARTITION BY asset ORDER BY t), 0)) * 5 / 1e4 AS cost FROM pos_step) AS x")


def targets(spark, sf) -> DataFrame:
    return P.contrarian_signal(pool_streak(spark, sf)).where("fwd is not null").withColumn("target", F.col("sig").cast("double"))


def stepped(spark, sf) -> DataFrame:
    return H.net_returns(H.periodic_rebalance(targets(spark, sf), 4))


@query("a1_targets", "asset ts:i long_only:d long_short:d confidence:d", "SELECT asset, t AS ts, pred AS long_only, CASE WHEN pred = 1 THEN 1 ELSE -1 END AS long_short, CASE WHEN c >= 0.5 THEN CASE WHEN pred = 1 THEN 1 ELSE -1 END ELSE 0 END AS confidence FROM (SELECT asset, t, CAST(return_1h > 0 AS INT) AS pred, close_pos AS c FROM pool WHERE return_1h IS NOT NULL) AS x")
def a1(spark, sf):
    out = pool_streak(spark, sf).where("return_1h is not null").select("asset", "ts", (F.col("return_1h") > 0).cast("int").alias("pred"), F.col("close_pos").alias("calibrated_prob"))
    for v in ("long_only", "long_short", "confidence"):
        out = H.target_positions(out, v, 0.5).withColumnRenamed("target", v)
    return out


@query("a2_a4_equity", "asset ts:i pos:d turnover:d net_ret:d equity:d drawdown:d", "SELECT asset, t AS ts, pos, sw AS turnover, net AS net_ret, eq AS equity, eq / max(eq) OVER (PARTITION BY asset ORDER BY t ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM (SELECT *, exp(sum(ln(1 + net)) OVER (PARTITION BY asset ORDER BY t ROWS UNBOUNDED PRECEDING)) AS eq FROM pos_net) AS x")
def a2(spark, sf):
    return H.equity(stepped(spark, sf))


@query("a5_return_stats", "asset " + _STATS + " cost_drag:d", stats_sql("pos_net", "asset", 8760, ", sum(cost) AS cost_drag"))
def a5(spark, sf):
    return H.return_stats(H.equity(stepped(spark, sf)), 8760)


def hold_sql(src: str, n: int) -> str:
    """The minimum-hold walk over (asset, t, target, ...), one row after the other."""
    return f"""WITH RECURSIVE numbered AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY t) AS rn FROM {src}), walk AS (SELECT *, target AS pos, CASE WHEN target <> 0 THEN 1 ELSE 0 END AS held FROM numbered WHERE rn = 1
    UNION ALL SELECT n.*, CASE WHEN n.target = w.pos OR w.held >= {n} OR w.pos = 0 THEN n.target ELSE w.pos END, CASE WHEN n.target = w.pos THEN w.held + CASE WHEN w.pos <> 0 THEN 1 ELSE 0 END WHEN w.held >= {n} OR w.pos = 0 THEN CASE WHEN n.target <> 0 THEN 1 ELSE 0 END ELSE w.held + 1 END FROM walk AS w JOIN numbered AS n ON n.asset = w.asset AND n.rn = w.rn + 1) SELECT * FROM walk"""


cte("held_six", hold_sql("pos_rows", 6))


@query("a6_min_hold", "asset ts:i pos:d", _T + "held_six")
def a6(spark, sf):
    return H.min_hold(targets(spark, sf), 6)


@query("a6_min_hold_chunks", "asset ts:i pos:d", _T + "held_six")
def a6c(spark, sf):
    """The same with each asset in chunks of 50 bars, each a task's."""
    return H.min_hold(targets(spark, sf), 6, rows=50)


_THESIS = """WITH RECURSIVE numbered AS (SELECT asset, t, fwd, target AS sig, row_number() OVER (PARTITION BY asset ORDER BY t) AS rn FROM pos_rows), walk AS (SELECT DISTINCT asset, CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS rn, 0.0::DOUBLE AS pos, NULL::VARCHAR AS why, 0.0::DOUBLE AS cur, 0 AS held, 0.0::DOUBLE AS gain, 0 AS rest FROM numbered
    UNION ALL SELECT asset, t, rn, pos, why, CASE WHEN why IS NULL THEN pos ELSE 0 END, held, gain, CASE WHEN why IS NULL THEN rest ELSE 2 END FROM (SELECT *, CASE WHEN stay AND held >= 2 AND gain >= 0.003 THEN 'tp' WHEN stay AND held >= 2 AND gain <= -0.0045 THEN 'sl' WHEN stay AND held >= 12 THEN 'timeout' WHEN stay AND held >= 2 AND sig <> 0 AND sig <> pos THEN 'invalidate' END AS why
    FROM (SELECT n.*, w.cur <> 0 AS stay, CASE WHEN w.cur <> 0 THEN w.cur WHEN w.rest > 0 THEN 0 ELSE n.sig END AS pos, CASE WHEN w.cur <> 0 THEN w.held + 1 WHEN w.rest > 0 THEN 0 ELSE CAST(n.sig <> 0 AS INT) END AS held, CASE WHEN w.cur <> 0 THEN w.gain + w.cur * n.fwd WHEN w.rest > 0 THEN 0 ELSE n.sig * n.fwd END AS gain, CASE WHEN w.cur = 0 AND w.rest > 0 THEN w.rest - 1 ELSE 0 END AS rest FROM walk AS w JOIN numbered AS n ON n.asset = w.asset AND n.rn = w.rn + 1) AS x) AS y) SELECT * FROM walk WHERE rn > 0"""
cte("thesis", _THESIS)


@query("a7_thesis_hold", "asset ts:i pos:d exit_reason", "SELECT *, t AS ts, why AS exit_reason FROM thesis")
def a7(spark, sf):
    return H.thesis_hold(targets(spark, sf), max_hold=12, least=2, cooldown=2)


@query("a7_thesis_hold_chunks", "asset ts:i pos:d exit_reason", "SELECT *, t AS ts, why AS exit_reason FROM thesis")
def a7c(spark, sf):
    return H.thesis_hold(targets(spark, sf), max_hold=12, least=2, cooldown=2, rows=50)


# each asset's rows under each gate are a series of their own, named by all three
cte("grid_rows", "SELECT asset AS name, asset || '#' || m || '#' || l AS asset, m, l, t, fwd, CASE WHEN abs(coalesce(return_1h, 0)) >= m AND abs(streak) >= l AND abs(streak) >= 2 THEN -CAST(sign(streak) AS DOUBLE) ELSE 0.0 END AS target FROM pool, (SELECT unnest([0.0, 0.005])::DOUBLE AS m), (SELECT unnest([0, 3]) AS l) WHERE fwd IS NOT NULL")
for _hold in (1, 6):
    cte(f"grid_held_{_hold}", hold_sql("grid_rows", _hold))
cte("grid_moved", "SELECT *, abs(pos - coalesce(lag(pos) OVER (PARTITION BY asset, hold ORDER BY t), 0)) AS sw FROM (SELECT *, 1 AS hold FROM grid_held_1 UNION ALL SELECT *, 6 AS hold FROM grid_held_6) AS x")
cte("grid_net", "SELECT name, hold, fee_bps, m, l, t, pos, sw, pos * fwd - sw * fee_bps / 1e4 AS net FROM grid_moved, (SELECT unnest([1.0, 5.0])::DOUBLE AS fee_bps)")
cte("grid_stats", stats_sql("grid_net", "name, hold, fee_bps, m, l", 8760, ", sum(CAST(pos <> 0 AS INT)) AS active"))


@query("a8_grid", "asset hold:i fee_bps:d move:d len:i total:d n_changes:i active:i viable:b rank:i", "SELECT name AS asset, hold, fee_bps, m AS move, l AS len, total, n_changes, active, total > 0 AND n_changes >= 30 AND active >= 200 AS viable, row_number() OVER (PARTITION BY name ORDER BY round(total, 9) DESC NULLS LAST, hold, fee_bps, m, l) AS rank FROM grid_stats")
def a8(spark, sf):
    return H.grid_returns(targets(spark, sf), (1, 6), (1.0, 5.0), (0.0, 0.005), (0, 3))


cte("oracle_rows", "SELECT asset, t, pos, r12, (SELECT 0) AS z, CASE WHEN streak <= -3 THEN 'strong_down' WHEN streak >= 3 THEN 'strong_up' ELSE 'mild' END || '|' || vr AS state FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY t) AS pos, lead(close, 6) OVER (PARTITION BY asset ORDER BY t) / close - 1 AS r12 FROM vr_state) AS x")


@query("a9_expanding_oracle", "asset ts:i state mu:d n_past:i signal:i", "SELECT *, t AS ts, CASE WHEN n_past >= 20 AND mu >= 0.0004 THEN 1 WHEN n_past >= 20 AND mu <= -0.0004 THEN -1 ELSE 0 END AS signal FROM (SELECT asset, t, state, avg(r12) OVER w AS mu, count(r12) OVER w AS n_past FROM oracle_rows WINDOW w AS (PARTITION BY asset, state ORDER BY pos RANGE BETWEEN UNBOUNDED PRECEDING AND 6 PRECEDING)) AS x")
def a9(spark, sf):
    rows = P.state_key(P.vr_regime(X.vol_ratio(pool_streak(spark, sf))))
    return H.expanding_oracle(rows, 6, 2.0, 20, 0.0002)


cte("rank_rows", "SELECT * FROM (SELECT asset, week, close / lag(close) OVER w - 1 AS rank_ret, lead(close) OVER w / close - 1 AS next_ret FROM weekly WINDOW w AS (PARTITION BY asset ORDER BY week)) AS x WHERE rank_ret IS NOT NULL AND next_ret IS NOT NULL")
cte("rank_w", "SELECT asset, week, next_ret, CASE WHEN lo <= k THEN 1.0 WHEN hi <= k THEN -1.0 ELSE 0 END / (2 * k) AS w FROM (SELECT *, greatest(1, floor(count(*) OVER (PARTITION BY week) * 0.2 + 1e-9)) AS k, count(*) OVER (PARTITION BY week) AS n, row_number() OVER (PARTITION BY week ORDER BY rank_ret, asset) AS lo, row_number() OVER (PARTITION BY week ORDER BY rank_ret DESC, asset DESC) AS hi FROM rank_rows) AS x WHERE n >= 10")


@query("a10_rank_portfolio", "week:i gross:d turnover:d cost:d net:d", "SELECT v.week // 86400 AS week, coalesce(g, 0) AS gross, coalesce(o, 0) AS turnover, coalesce(o, 0) * 0.0005 AS cost, coalesce(g, 0) - coalesce(o, 0) * 0.0005 AS net FROM (SELECT DISTINCT week FROM weekly) AS v LEFT JOIN (SELECT week, sum(w * next_ret) AS g FROM rank_w GROUP BY week) AS a USING (week) LEFT JOIN (SELECT week, sum(abs(w - p)) AS o FROM (SELECT coalesce(c.week, q.week + 604800) AS week, coalesce(c.w, 0) AS w, coalesce(q.w, 0) AS p FROM rank_w AS c FULL JOIN rank_w AS q ON c.asset = q.asset AND c.week = q.week + 604800) AS x WHERE week IN (SELECT week FROM rank_w) GROUP BY week) AS b USING (week)")
def a10(spark, sf):
    return H.rank_portfolio(R.calendar_sample(B.panel(spark, sf)))


def cycle_sql(n: int, fee: float) -> str:
    gain = " * ".join(f"(1 + s * (lead(close, {i + 1}) OVER w / lead(close, {i}) OVER w - 1){f' - {fee}' if i == 0 else ''})" for i in range(n))
    return f"SELECT asset, t, s, close AS entry_price, lead(t, {n}) OVER w AS exit_ts, {gain} * (1 - {fee}) - 1 AS pnl FROM (SELECT *, CASE WHEN abs(streak) >= 2 THEN -sign(streak) ELSE 0 END AS s FROM pool) AS x WINDOW w AS (PARTITION BY asset ORDER BY t)"


cte("cycles", cycle_sql(3, 0.0005))


@query("a11_hold_cycles", "asset ts:i entry_price:d exit_ts:i pnl:d outcome", "SELECT *, t AS ts, CASE WHEN pnl > 0 THEN 'profit' WHEN pnl IS NOT NULL THEN 'loss' END AS outcome FROM cycles WHERE s <> 0")
def a11(spark, sf):
    signals = targets_all(spark, sf)
    return H.hold_cycle_pnl(signals, B.bars(spark, sf), 3)


def targets_all(spark, sf) -> DataFrame:
    """Every bar with a contrarian signal: (asset, ts, direction)."""
    return P.contrarian_signal(pool_streak(spark, sf)).where("sig <> 0").select("asset", "ts", F.col("sig").alias("direction"))


cte("sealed_rows", "SELECT * FROM pos_rows WHERE t > 1705276800")
cte("sealed_held", hold_sql("sealed_rows", 12))
cte("sealed_net", "SELECT *, pos * fwd - sw * 5 / 1e4 AS net FROM (SELECT *, abs(pos - coalesce(lag(pos) OVER (PARTITION BY asset ORDER BY t), 0)) AS sw FROM sealed_held) AS x")


@query("a12_sealed_eval", "asset status n:i total:d n_changes:i buy_hold:d passed:b", f"SELECT *, CASE WHEN n < 100 THEN 'pending' ELSE 'evaluated' END AS status, n >= 100 AND total > 0 AND total > buy_hold AND n_changes >= 30 AND sharpe > 0 AS passed FROM ({stats_sql('sealed_net', 'asset', 8760, ', exp(sum(ln(1 + fwd))) - 1 AS buy_hold')}) AS s")
def a12(spark, sf):
    return H.sealed_eval(targets(spark, sf), F.timestamp_seconds(F.lit(1705276800)), min_bars=100)


@query("t12_a12_contract", "asset positive:b beats_hold:b enough_changes:b sharpe_ok:b passed:b", f"SELECT asset, total > 0 AS positive, total > bh AS beats_hold, n_changes >= 30 AS enough_changes, sharpe > 0 AS sharpe_ok, total > 0 AND total > bh AND n_changes >= 30 AND sharpe > 0 AS passed FROM ({stats_sql('pos_net', 'asset', 8760)}) AS s JOIN (SELECT asset, exp(sum(ln(1 + fwd))) - 1 AS bh FROM pos_rows GROUP BY asset) AS h USING (asset)")
def t12a(spark, sf):
    s = H.return_stats(H.equity(stepped(spark, sf)), 8760, extra={"bh": F.product(1 + F.col("fwd")) - 1})
    return s.withColumn("c", H.passes_contract(F.col("total"), F.col("bh"), F.col("n_changes"), F.col("sharpe"))).select("asset", "c.positive", "c.beats_hold", "c.enough_changes", F.col("c.sharpe").alias("sharpe_ok"), "c.passed")


# ---- streaming, run over what is there

def _stream(spark: SparkSession, sf: str, job, mode: str = "append") -> DataFrame:
    """``job`` over the event table read as a stream, into a table in the shared folder."""
    from pathlib import PurePosixPath

    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    file = PurePosixPath(path)
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*").parquet(path if _is_folder(spark, path) else f"{sf}/{file.stem}*.parquet")
    ticks = raw.select(F.col("event_type").alias("asset"), F.col("ts").cast("timestamp").alias("ts"), (1000 + F.col("value")).alias("price"), F.lit(1).alias("qty"), F.col("event_id").alias("seq"), "user_id")
    name = f"s{uuid.uuid4().hex}"
    folder = shared_folder(spark)
    return ST.run_available(job(ticks), f"{folder}/{name}-out", f"{folder}/{name}-log", mode)


def _is_folder(spark: SparkSession, path: str) -> bool:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hpath).isDirectory()


@query("w1_stream_bars", "asset res ts:i open:d high:d low:d close:d volume:d", "SELECT asset, '1h' AS res, t AS ts, open, high, low, close, volume FROM bars_1h")
def w1(spark, sf):
    return _stream(spark, sf, lambda t: ST.stream_bars(t, "1h", delay="40 days"), "complete")


cte("sliding", "SELECT asset, w AS t, count(*) AS n FROM (SELECT asset, unnest([CAST(floor(epoch(ts) / 1800) * 1800 AS BIGINT), CAST(floor(epoch(ts) / 1800) * 1800 AS BIGINT) - 1800]) AS w FROM ticks) AS x GROUP BY ALL")


@query("w1_sliding_bars", "asset ts:i volume:d", "SELECT asset, t AS ts, n AS volume FROM sliding")
def w1s(spark, sf):
    return ST.stream_bars(B.ticks(spark, sf), "1h", "30m")


@query("w2_signal_log", "asset ts:i direction:i", "SELECT asset, t AS ts, CASE WHEN abs(streak) >= 2 THEN -sign(streak) END AS direction FROM pool WHERE abs(streak) >= 2 AND (t // 3600) % 2 = 1")
def w2(spark, sf):
    s = targets_all(spark, sf)
    return ST.log_signals(s.unionByName(s), s.where(F.hour("ts") % 2 == 0))


@query("w3_score_next_bar", "asset ts:i direction:i forward_return_pct:d outcome", "SELECT asset, t AS ts, -sign(streak) AS direction, 100 * fwd AS forward_return_pct, CASE WHEN sign(100 * fwd) = -sign(streak) THEN 'hit' WHEN fwd IS NOT NULL THEN 'miss' END AS outcome FROM pool WHERE abs(streak) >= 2")
def w3(spark, sf):
    b = B.bars(spark, sf).withColumn("next_close", F.lead("close").over(Window.partitionBy("asset").orderBy("ts")))
    return ST.score_next_bar(targets_all(spark, sf), b)


@query("w4_score_cycles", "asset ts:i pnl:d", "SELECT asset, t AS ts, pnl FROM cycles WHERE s <> 0 AND pnl IS NOT NULL")
def w4(spark, sf):
    return ST.score_hold_cycles(targets_all(spark, sf), B.bars(spark, sf), 3)


cte("tick_targets", "SELECT asset, epoch_us(ts) AS t, CASE WHEN first(price) > 1050 THEN 1.0 ELSE -1.0 END AS target FROM ticks GROUP BY asset, ts")
cte("tick_held", hold_sql("tick_targets", 3))


@query("w5_live_min_hold", "asset ts:i pos:d traded:b", "SELECT *, t // 1000000 AS ts, pos <> coalesce(lag(pos) OVER (PARTITION BY asset ORDER BY t), 0) AS traded FROM tick_held")
def w5(spark, sf):
    """Every tick above its asset's start is a target to be long; the positions as a stream keeps them."""
    return _stream(spark, sf, lambda t: ST.live_min_hold(t.select("asset", "ts", F.when(F.col("price") > 1050, 1.0).otherwise(-1.0).alias("target")), 3))


@query("w6_feed_sessions", "asset session_start:i session_end:i n:i", "SELECT asset, CAST(floor(epoch(min(ts))) AS BIGINT) AS session_start, CAST(floor(epoch(max(ts))) AS BIGINT) + 3600 AS session_end, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY asset ORDER BY ts)) < 3600 THEN 0 ELSE 1 END AS b FROM ticks) AS x) AS y GROUP BY asset, s")
def w6(spark, sf):
    return ST.feed_sessions(B.ticks(spark, sf))


cte("ledger", "SELECT asset, CASE WHEN (t // 3600) % 2 = 0 THEN 'even' ELSE 'odd' END AS source, t, CASE WHEN fwd IS NULL OR t % 10800 = 0 THEN NULL WHEN sign(100 * fwd) = -sign(streak) THEN 1 ELSE 0 END AS h FROM pool WHERE abs(streak) >= 2")


@query("w7_ledger_report", "slice logged:i scored:i pending:i hit:d recent_hit:d validated:b", "SELECT slice, count(*) AS logged, count(h) AS scored, count(*) - count(h) AS pending, avg(h) AS hit, avg(h) FILTER (r <= 30) AS recent_hit, coalesce(count(h) >= 100 AND avg(h) >= 0.55, false) AS validated FROM (SELECT *, row_number() OVER (PARTITION BY slice, h IS NOT NULL ORDER BY t DESC, asset, source) AS r FROM (SELECT *, unnest(['all', 'asset=' || asset, 'source=' || source]) AS slice FROM ledger) AS x) AS y GROUP BY slice")
def w7(spark, sf):
    b = B.bars(spark, sf).withColumn("next_close", F.lead("close").over(Window.partitionBy("asset").orderBy("ts")))
    scored = ST.score_next_bar(targets_all(spark, sf), b).withColumn("source", F.when(F.hour("ts") % 2 == 0, "even").otherwise("odd"))
    return ST.ledger_report(scored.withColumn("outcome", F.when(F.unix_seconds("ts") % 10800 != 0, F.col("outcome"))))


@query("entry_flagship", "asset n:i n_pred:i coverage:d model_hit:d", "SELECT asset, n, n_pred, coverage, model_hit FROM (SELECT asset, count(*) AS n, count(pred) AS n_pred, avg(CAST(pred IS NOT NULL AS DOUBLE)) AS coverage, avg(CASE WHEN pred IS NOT NULL THEN CAST(pred = CAST(fwd > 0 AS INT) AS DOUBLE) END) AS model_hit FROM truth_hold LEFT JOIN (SELECT asset, t, pred FROM votes) AS v USING (asset, t) WHERE fwd IS NOT NULL GROUP BY asset) AS x")
def flagship(spark, sf):
    """Which conjunctions of states predict the next bar, and how well on bars that they haven't seen?"""
    from barweave.plans.catalogue_rules import m7

    return m7(spark, sf)

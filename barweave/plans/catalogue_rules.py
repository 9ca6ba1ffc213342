"""Registered queries: rules, validation, memory, calibration, workloads."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from barweave.functions import discretize as P, features as X
from barweave.operators import mining as M, tests_of_chance as T
from barweave.plans import bindings as B, workloads as W
from barweave.plans.catalogue import _THREE, cuts_sql, events_sql, folds_sql, known, pool, pool_streak, states, states_sql
from barweave.plans.registry import cte, query

A = ["asset"]
CFG = W.Config(atoms=_THREE, min_support=20, min_folds=3)
_T = "SELECT *, t AS ts FROM "


def rules_sql(src: str, keys: str, support: int = 20, conf: float = 0.55, half: float = 720.0) -> str:
    """Rules from events (keys, t, event, fwd) as mine_rules finds them."""
    return f"""SELECT *, greatest(p_up, 1 - p_up) AS confidence, CAST(p_up >= 0.5 AS INT) AS direction FROM (SELECT {keys}, event, count(*) AS support, sum(w) AS weighted_support, sum(w * u) / nullif(sum(w), 0) AS p_up, avg(fwd) AS mean_fwd, max(t) AS last_seen
        FROM (SELECT *, pow(0.5, greatest(0, (ref - t) / 3600.0) / {half}) AS w, CAST(fwd > 0 AS INT) AS u FROM {src} JOIN (SELECT {keys}, max(t) AS ref FROM {src} WHERE fwd IS NOT NULL GROUP BY {keys}) AS r USING ({keys}) WHERE fwd IS NOT NULL) AS x GROUP BY {keys}, event HAVING count(*) >= {support}) AS y WHERE greatest(p_up, 1 - p_up) >= {conf}"""


def votes_sql(events: str, rules: str, keys: str) -> str:
    return f"SELECT {keys}, t, sum(CASE WHEN direction = 1 THEN confidence ELSE -confidence END) AS score, count(*) AS n_rules, CAST(round(sum(CASE WHEN direction = 1 THEN confidence ELSE -confidence END), 12) > 0 AS INT) AS pred FROM {events} JOIN {rules} USING ({keys}, event) GROUP BY {keys}, t"


def eval_sql(preds: str, truth: str, keys: str) -> str:
    return f"""SELECT {keys}, count(*) AS n, count(pred) AS n_pred, avg(CAST(pred IS NOT NULL AS DOUBLE)) AS coverage, avg(CASE WHEN pred IS NOT NULL THEN CAST(pred = CAST(fwd > 0 AS INT) AS DOUBLE) END) AS model_hit, avg(CASE WHEN pred IS NOT NULL AND return_6h IS NOT NULL THEN CAST((return_6h > 0) = (fwd > 0) AS DOUBLE) END) AS momentum_hit,
        avg(CASE WHEN pred = 1 THEN fwd WHEN pred = 0 THEN -fwd END) AS mean_signed_edge FROM {truth} LEFT JOIN (SELECT {keys}, t, pred FROM {preds}) AS p USING ({keys}, t) WHERE fwd IS NOT NULL GROUP BY {keys}"""


cte("ev_dev", "SELECT * FROM events_long WHERE part = 'dev'")
cte("ev_hold", "SELECT * FROM events_long WHERE part = 'hold'")
cte("rules", rules_sql("ev_dev", "asset"))
cte("votes", votes_sql("ev_hold", "rules", "asset"))
cte("truth", "SELECT asset, t, part, fwd, return_6h FROM parted")


def dev_rules(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """States, rules of the dev part, events of the rest."""
    s = states(spark, sf)
    return s, M.mine_rules(s.where("part = 'dev'"), _THREE, min_support=20), P.build_events(s.where("part = 'hold'"), _THREE)


def truth(s: DataFrame) -> DataFrame:
    return s.select("asset", "res", "ts", "part", "fwd", "return_6h")


@query("m1_mine_rules", "asset event support:i weighted_support:d p_up:d confidence:d direction:i mean_fwd:d last_seen:i", "SELECT * FROM rules")
def m1(spark, sf):
    return dev_rules(spark, sf)[1]


@query("m2_votes", "asset ts:i pred:i score:d n_rules:i", _T + "votes")
def m2(spark, sf):
    _, rules, events = dev_rules(spark, sf)
    return M.predict_votes(events, rules)


def side_sql(events: str, rules: str, keys: str = "asset", weight: str = "confidence") -> str:
    up, down = f"sum(CASE WHEN direction = 1 THEN {weight} ELSE 0 END)", f"sum(CASE WHEN direction = 0 THEN {weight} ELSE 0 END)"
    return f"SELECT *, CASE WHEN pred = 1 THEN mu ELSE md END AS raw_prob FROM (SELECT {keys}, t, count(*) AS n_rules, avg({weight}) FILTER (direction = 1) AS mu, avg({weight}) FILTER (direction = 0) AS md, CAST(round({up}, 12) >= round({down}, 12) AS INT) AS pred FROM {events} JOIN {rules} USING ({keys}, event) GROUP BY {keys}, t) AS s"


cte("dev_sides", side_sql("ev_dev", "rules"))
_BIN = "CAST(least(9, greatest(0, floor((raw_prob - 0.5) / 0.05 + 1e-9))) AS BIGINT)"
cte("dev_samples", f"SELECT d.asset, d.t, d.raw_prob, {_BIN} AS bin, CAST(d.pred = CAST(x.fwd > 0 AS INT) AS INT) AS hit FROM dev_sides AS d JOIN truth AS x USING (asset, t) WHERE x.fwd IS NOT NULL")
cte("bins", "SELECT asset, bin, 0.5 + bin * 0.05 AS lo, 0.55 + bin * 0.05 AS hi, sum(hit) AS hits, count(*) AS total FROM dev_samples GROUP BY asset, bin")


def dev_samples(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    s, rules, events = dev_rules(spark, sf)
    preds = M.predict_calibrated(P.build_events(s.where("part = 'dev'"), _THREE), rules)
    rows = preds.join(truth(s), ["asset", "res", "ts"]).where("fwd is not null").withColumn("hit", (F.col("pred") == (F.col("fwd") > 0).cast("int")).cast("int"))
    return s, rules, events, rows


@query("m3_calibrated", "asset ts:i pred:i raw_prob:d calibrated_prob:d n_rules:i", f"SELECT s.asset, s.t AS ts, s.pred, s.raw_prob, s.n_rules, coalesce((b.hits + 1) / (b.total + 2.0), s.raw_prob) AS calibrated_prob FROM ({side_sql('ev_hold', 'rules')}) AS s LEFT JOIN bins AS b ON s.asset = b.asset AND b.bin = {_BIN}")
def m3(spark, sf):
    _, rules, events, rows = dev_samples(spark, sf)
    return M.predict_calibrated(events, rules, None, M.calibration_table(rows))


_NA = "len(string_split(event, '|'))"
_SIDE = "CASE WHEN direction = 1 THEN 1 ELSE -1 END"
_WEIGHTS = {"equal": "1.0", "size": _NA, "size2": f"{_NA} * {_NA}", "rarity": "1.0 / sqrt(support)", "edge": "(confidence - 0.5)", "size_edge": f"{_NA} * (confidence - 0.5)"}


@query("m4_weighted_votes", "scheme asset ts:i pred:i score:d", " UNION ALL ".join(f"SELECT '{k}' AS scheme, asset, t AS ts, sum({w} * {_SIDE}) AS score, CAST(round(sum({w} * {_SIDE}), 12) > 0 AS INT) AS pred FROM ev_hold JOIN rules USING (asset, event) GROUP BY asset, t" for k, w in _WEIGHTS.items()))
def m4(spark, sf):
    _, rules, events = dev_rules(spark, sf)
    return M.weighted_votes(events, rules)


@query("m5_argmax_specific", "asset ts:i pred:i score:d", f"SELECT asset, t AS ts, direction AS pred, confidence * {_SIDE} AS score FROM (SELECT *, row_number() OVER (PARTITION BY asset, t ORDER BY {_NA} DESC, round(confidence, 12) DESC, event DESC) AS r FROM ev_hold JOIN rules USING (asset, event)) AS x WHERE r = 1")
def m5(spark, sf):
    _, rules, events = dev_rules(spark, sf)
    return M.argmax_specific(events, rules.withColumn("confidence", F.round("confidence", 12)))


@query("m6_mechanism_gate", "asset ts:i pred:i gated:b", f"SELECT asset, t AS ts, CAST(round(coalesce(sum(confidence * {_SIDE}) FILTER (event LIKE '%trend_slope%'), sum(confidence * {_SIDE})), 12) > 0 AS INT) AS pred, count(*) FILTER (event LIKE '%trend_slope%') > 0 AS gated FROM ev_hold JOIN rules USING (asset, event) GROUP BY asset, t")
def m6(spark, sf):
    _, rules, events = dev_rules(spark, sf)
    return M.mechanism_gate(events, rules, "trend_slope")


cte("truth_hold", "SELECT * FROM truth WHERE part = 'hold'")


@query("m7_evaluate", "asset n:i n_pred:i coverage:d model_hit:d momentum_hit:d mean_signed_edge:d", eval_sql("votes", "truth_hold", "asset"))
def m7(spark, sf):
    s, rules, events = dev_rules(spark, sf)
    return M.evaluate(M.predict_votes(events, rules), truth(s).where("part = 'hold'"))


@query("m8_score_predictions", "asset n:i hits:i hit_rate:d", "SELECT asset, count(*) AS n, sum(CAST(pred = CAST(fwd > 0 AS INT) AS INT)) AS hits, avg(CAST(pred = CAST(fwd > 0 AS INT) AS INT)) AS hit_rate FROM votes JOIN truth USING (asset, t) WHERE abs(fwd) > 0.01 GROUP BY asset")
def m8(spark, sf):
    s, rules, events = dev_rules(spark, sf)
    return M.score_predictions(M.predict_votes(events, rules), truth(s), 0.01)


@query("m9_oos_hits", "asset event n:i oos_hit:d", "SELECT asset, event, count(*) AS n, avg(CAST(direction = CAST(fwd > 0 AS INT) AS INT)) AS oos_hit FROM ev_hold JOIN (SELECT asset, event, direction FROM rules) AS r USING (asset, event) WHERE fwd IS NOT NULL GROUP BY ALL HAVING count(*) >= 5")
def m9(spark, sf):
    s, rules, events = dev_rules(spark, sf)
    return M.oos_rule_hits(events, rules, truth(s))


# ---- walk-forward; the fold is part of every key

def walk_ctes(prefix: str, src: str, folds: int = 5, initial: float = 0.4, min_folds: int = 3, base: str = "asset") -> None:
    k = f"{base}, fold"
    cte(f"{prefix}_f", folds_sql(src, folds, initial, base))
    cte(f"{prefix}_c", cuts_sql(f"{prefix}_f", "role = 'train'", k))
    cte(f"{prefix}_s", states_sql(f"{prefix}_f", f"{prefix}_c", k))
    cte(f"{prefix}_e", events_sql(f"{prefix}_s", f"{k}, t, role, fwd, return_6h"))
    cte(f"{prefix}_tr", f"SELECT * FROM {prefix}_e WHERE role = 'train'")
    cte(f"{prefix}_te", f"SELECT * FROM {prefix}_e WHERE role = 'test'")
    cte(f"{prefix}_r", rules_sql(f"{prefix}_tr", k))
    cte(f"{prefix}_v", votes_sql(f"{prefix}_te", f"{prefix}_r", k))
    cte(f"{prefix}_h", f"SELECT {k}, event, avg(CAST(direction = CAST(fwd > 0 AS INT) AS INT)) AS oos_hit FROM {prefix}_te JOIN (SELECT {k}, event, direction FROM {prefix}_r) AS r USING ({k}, event) WHERE fwd IS NOT NULL GROUP BY ALL HAVING count(*) >= 5")
    cte(f"{prefix}_st", f"SELECT *, coverage_frac * consistency AS stability FROM (SELECT {base}, event, count(*) AS folds_present, count(*) / {folds}.0 AS coverage_frac, CAST(round_even(avg(direction), 0) AS INT) AS direction, greatest(avg(direction), 1 - avg(direction)) AS consistency, avg(oos_hit) AS avg_oos_hit, avg(confidence) AS avg_confidence FROM {prefix}_r LEFT JOIN {prefix}_h USING ({k}, event) GROUP BY {base}, event) AS x")
    cte(f"{prefix}_ok", f"SELECT * FROM {prefix}_st WHERE folds_present >= {min_folds} AND consistency >= 0.75 AND avg_oos_hit > 0.5")


walk_ctes("wf", "known")
walk_ctes("wd", "(SELECT * FROM parted WHERE part = 'dev') AS d")


def rows3(spark, sf) -> DataFrame:
    return known(spark, sf).select("asset", "res", "ts", *_THREE, "return_6h", "fwd")


@query("m10_stability", "asset event folds_present:i coverage_frac:d direction:i consistency:d avg_oos_hit:d avg_confidence:d stability:d", "SELECT * FROM wf_st")
def m10(spark, sf):
    return W.walk_forward(rows3(spark, sf), CFG)["stability"]


@query("m11_walk_forward", "asset fold:i n:i n_pred:i coverage:d model_hit:d momentum_hit:d mean_signed_edge:d", eval_sql("wf_v", "(SELECT DISTINCT asset, fold, t, fwd, return_6h FROM wf_te) AS tt", "asset, fold"))
def m11(spark, sf):
    return W.walk_forward(rows3(spark, sf), CFG)["fold_metrics"]


_SPOTS = "(SELECT DISTINCT asset, fold, t, fwd FROM wf_te WHERE fwd IS NOT NULL) AS x"
cte("wm_fail", "SELECT asset, fold, event, confidence, direction, coalesce(sum(CASE WHEN oos_hit <= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY asset, event ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS failures FROM wf_r LEFT JOIN wf_h USING (asset, fold, event)")
cte("wm_r", "SELECT * FROM wm_fail WHERE failures < 1")
cte("wm_side", side_sql("wf_te", "wm_r", "asset, fold"))
cte("wm_seen", f"SELECT asset, fold, t, raw_prob, {_BIN} AS bin, CAST(pred = CAST(fwd > 0 AS INT) AS INT) AS hit FROM wm_side JOIN {_SPOTS} USING (asset, fold, t)")
cte("wm_bins", "SELECT s.asset, f.fold, s.bin, sum(hit) AS hits, count(*) AS total FROM wm_seen AS s JOIN (SELECT unnest(range(5)) AS fold) AS f ON f.fold > s.fold GROUP BY ALL")


@query("m11_walk_memory", "asset fold:i blocked:i n:i hit:d raw:d calibrated:d", "SELECT * FROM (SELECT asset, fold, count(*) AS n, avg(hit) AS hit, avg(raw_prob) AS raw, avg(CASE WHEN total > 0 THEN (hits + 1) / (total + 2) ELSE raw_prob END) AS calibrated FROM wm_seen LEFT JOIN wm_bins USING (asset, fold, bin) GROUP BY asset, fold) AS p JOIN (SELECT asset, fold, count(*) FILTER (failures >= 1) AS blocked FROM wm_fail GROUP BY asset, fold) AS b USING (asset, fold)")
def m11m(spark, sf):
    """Folds that teach the later ones: an event that failed once is blocked, and probabilities are calibrated on earlier folds."""
    rows = rows3(spark, sf)
    parts = W.walk_forward(rows, CFG, max_failures=1)
    hit = (F.col("pred") == (F.col("fwd") > 0).cast("int")).cast("int")
    seen = parts["calibrated"].join(rows.where("fwd is not null").select("asset", "res", "ts", "fwd"), ["asset", "res", "ts"])
    out = seen.groupBy("asset", "fold").agg(F.count("*").alias("n"), F.avg(hit).alias("hit"), F.avg("raw_prob").alias("raw"), F.avg("calibrated_prob").alias("calibrated"))
    return out.join(parts["failures"].groupBy("asset", "fold").agg(F.sum((F.col("failures") >= 1).cast("int")).alias("blocked")), ["asset", "fold"])


@query("m12_stable_rules", "asset event direction:i avg_confidence:d", "SELECT * FROM wf_ok")
def m12(spark, sf):
    return M.select_stable(W.walk_forward(rows3(spark, sf), CFG)["stability"])


@query("m13_memory", "kind asset event value:i flag:b", """SELECT 'positive' AS kind, asset, event, direction AS value, true AS flag FROM wf_ok UNION ALL SELECT 'negative', asset, event, f, f >= 2 FROM (SELECT s.asset, s.event, 1 + CASE WHEN s.folds_present > 1 THEN 1 ELSE 0 END AS f FROM wf_st AS s LEFT JOIN wf_ok AS o USING (asset, event) WHERE o.event IS NULL
    UNION ALL SELECT s.asset, s.event, 1 FROM wf_st AS s JOIN wf_ok AS o USING (asset, event) WHERE s.folds_present > 1) AS n""")
def m13(spark, sf):
    """The old memory: every event seen in more than one fold has failed once."""
    stab = W.walk_forward(rows3(spark, sf), CFG)["stability"]
    empty = M.select_stable(stab).where("false").drop("coverage_frac")
    old = stab.where("folds_present > 1").select("asset", "event", F.lit(1).alias("failures"))
    pos, neg = M.update_memory(empty, old, stab)
    return pos.select(F.lit("positive").alias("kind"), "asset", "event", F.col("direction").alias("value"), F.lit(True).alias("flag")).unionByName(neg.select(F.lit("negative").alias("kind"), "asset", "event", F.col("failures").alias("value"), F.col("blacklisted").alias("flag")))


cte("regimes", "SELECT asset, t, CASE WHEN any_shock = 1 THEN 'SHOCK_ACTIVE' WHEN max(any_shock) OVER (PARTITION BY asset ORDER BY t ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) = 1 THEN 'POST_SHOCK' ELSE 'NORMAL' END AS regime FROM shocks")
cte("hit_regime", "SELECT v.asset, v.t, g.regime, CAST(v.pred = CAST(x.fwd > 0 AS INT) AS INT) AS hit FROM votes AS v JOIN truth AS x USING (asset, t) JOIN regimes AS g USING (asset, t) WHERE x.fwd IS NOT NULL")


def regimes(spark, sf) -> DataFrame:
    return P.shock_regime(P.significant_changes(pool(spark, sf), 1.5)).select("asset", "res", "ts", "regime")


@query("m14_by_regime", "asset regime n:i hit_rate:d lift:d", "SELECT asset, coalesce(regime, 'ALL') AS regime, count(*) AS n, avg(hit) AS hit_rate, avg(hit) - 0.5 AS lift FROM hit_regime GROUP BY GROUPING SETS ((asset, regime), (asset))")
def m14(spark, sf):
    s, rules, events = dev_rules(spark, sf)
    return M.evaluate_by_regime(M.predict_votes(events, rules), truth(s), regimes(spark, sf))


@query("m15_regime_scale", "asset regime n:i scale:d", "SELECT asset, regime, count(*) AS n, CASE WHEN a > 0.5 THEN greatest(0, least(2, (avg(hit) - 0.5) / (a - 0.5))) ELSE 1 END AS scale FROM hit_regime JOIN (SELECT asset, avg(hit) AS a FROM hit_regime GROUP BY asset) AS x USING (asset) GROUP BY asset, regime, a")
def m15(spark, sf):
    s, rules, events = dev_rules(spark, sf)
    rows = M.predict_votes(events, rules).join(truth(s).where("fwd is not null"), ["asset", "res", "ts"]).join(regimes(spark, sf), ["asset", "res", "ts"])
    return M.regime_scale(rows.withColumn("hit", (F.col("pred") == (F.col("fwd") > 0).cast("int")).cast("int")))


@query("m16_calibration", "asset bin:i lo:d hi:d hits:i total:i", "SELECT * FROM bins")
def m16(spark, sf):
    return M.calibration_table(dev_samples(spark, sf)[3])


@query("m17_prequential", "asset n:i ece:d brier:d", "SELECT asset, sum(n) AS n, sum(abs(c - h)) / sum(n) AS ece, sum(b) / sum(n) AS brier FROM (SELECT asset, bin, count(*) AS n, sum(cal) AS c, sum(hit) AS h, sum((cal - hit) * (cal - hit)) AS b FROM (SELECT *, (sum(hit) OVER w + 1) / (count(*) OVER w + 2.0) AS cal FROM dev_samples WINDOW w AS (PARTITION BY asset, bin ORDER BY t ROWS UNBOUNDED PRECEDING)) AS x GROUP BY asset, bin) AS y GROUP BY asset")
def m17(spark, sf):
    return M.prequential_metrics(dev_samples(spark, sf)[3])


@query("m18_brier_ece", "asset n:i brier:d ece:d", "SELECT asset, sum(n) AS n, sum(b) / sum(n) AS brier, sum(abs(p - h)) / sum(n) AS ece FROM (SELECT asset, least(9, floor(raw_prob * 10 + 1e-9)) AS k, count(*) AS n, sum(raw_prob) AS p, sum(hit) AS h, sum((raw_prob - hit) * (raw_prob - hit)) AS b FROM dev_samples GROUP BY ALL) AS x GROUP BY asset")
def m18(spark, sf):
    return M.brier_ece(dev_samples(spark, sf)[3])


cte("frozen", "SELECT asset, event, direction, avg_confidence AS confidence FROM wd_ok")
cte("hold_votes", votes_sql("ev_hold", "frozen", "asset"))
cte("hold_scored", "SELECT asset, t, pred, CAST(fwd > 0 AS INT) AS up FROM truth_hold LEFT JOIN hold_votes USING (asset, t) WHERE fwd IS NOT NULL")


@query("m19_holdout", "asset n_hold:i n_rules:i n:i hits:i coverage:d hit:d lift:d", "SELECT asset, n_hold, coalesce(n_rules, 0) AS n_rules, n, CASE WHEN n > 0 THEN hits END AS hits, n / n_hold AS coverage, CASE WHEN n > 0 THEN hits / n END AS hit, CASE WHEN n > 0 THEN hits / n - 0.5 END AS lift FROM (SELECT asset, count(*) AS n_hold, count(pred) AS n, sum(CAST(pred = up AS INT)) AS hits FROM hold_scored GROUP BY asset) AS x LEFT JOIN (SELECT asset, count(*) AS n_rules FROM frozen GROUP BY asset) AS y USING (asset)")
def m19(spark, sf):
    return W.holdout_test(rows3(spark, sf), CFG, p_values=False)


@query("m20_infer_latest", "asset ts:i status direction raw_prob:d n_rules:i used", f"SELECT x.asset, x.t AS ts, CASE WHEN s.pred IS NULL THEN 'no_rules' ELSE 'ok' END AS status, CASE WHEN s.pred = 1 THEN 'UP' WHEN s.pred = 0 THEN 'DOWN' END AS direction, s.raw_prob, coalesce(s.n_rules, 0) AS n_rules, u.used FROM (SELECT asset, max(t) AS t FROM known GROUP BY asset) AS x LEFT JOIN ({side_sql('ev_hold', 'rules')}) AS s USING (asset, t) LEFT JOIN (SELECT asset, t, string_agg(event, ',' ORDER BY event) AS used FROM ev_hold JOIN (SELECT asset, event FROM rules) AS r USING (asset, event) GROUP BY asset, t) AS u USING (asset, t)")
def m20(spark, sf):
    split = P.chrono_split(known(spark, sf), 0.3)
    dev = split.where("part = 'dev'")
    rules = dev_rules(spark, sf)[1]
    out = W.infer_latest(split.drop("part"), rules, CFG, dev)
    return out.withColumn("used", F.array_join(F.transform("rules_used", lambda r: r.event), ","))


cte("grown", "SELECT k.*, g.win FROM (SELECT * EXCLUDE (pos, n_all), row_number() OVER (PARTITION BY asset ORDER BY t) AS r0, count(*) OVER (PARTITION BY asset) AS n0 FROM known) AS k, range(1, 5) AS g(win) WHERE r0 <= floor(n0 * win / 4.0 + 1e-9)")
walk_ctes("rp", "grown", base="asset, win")
cte("rp_m", eval_sql("rp_v", "(SELECT DISTINCT asset, win, fold, t, fwd, return_6h FROM rp_te) AS tt", "asset, win, fold"))
cte("rp_o", "SELECT asset, win, b AS bars, n, h AS hit_rate, e AS n_rules, h - 0.5 AS lift FROM (SELECT asset, win, count(*) AS b FROM grown GROUP BY ALL) AS x LEFT JOIN (SELECT asset, win, sum(n_pred) AS n, sum(model_hit * n_pred) / sum(n_pred) AS h FROM rp_m GROUP BY ALL) AS y USING (asset, win) LEFT JOIN (SELECT asset, win, count(*) AS e FROM rp_st GROUP BY ALL) AS z USING (asset, win)")


@query("m21_replay", "asset window:i bars:i n:i hit_rate:d n_rules:i lift:d lift_trend:d", 'SELECT *, win AS "window", first_value(lift) OVER (PARTITION BY asset ORDER BY win DESC) - first_value(lift) OVER (PARTITION BY asset ORDER BY win) AS lift_trend FROM rp_o')
def m21(spark, sf):
    return W.replay(rows3(spark, sf), CFG, 4)


def learning_sql(checkpoints: int, seed: float) -> None:
    cte("pl", f"SELECT * FROM (SELECT *, CASE WHEN r < cut THEN 'train' WHEN r < CASE WHEN fold = {checkpoints - 1} THEN n ELSE cut + sp END THEN 'test' END AS role FROM (SELECT *, st + fold * sp AS cut FROM (SELECT *, greatest(1, floor((n - st) / {checkpoints})) AS sp, unnest(range({checkpoints})) AS fold FROM (SELECT *, floor(n * {seed} + 1e-9) AS st FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY t) - 1 AS r, count(*) OVER (PARTITION BY asset) AS n FROM known) AS a) AS b) AS c) AS d) AS e WHERE role IS NOT NULL")
    k = "asset, fold"
    cte("pl_c", cuts_sql("pl", "role = 'train'", k))
    cte("pl_s", states_sql("pl", "pl_c", k))
    cte("pl_e", events_sql("pl_s", "asset, fold, t, role, fwd"))
    cte("pl_tr", "SELECT * FROM pl_e WHERE role = 'train'")
    cte("pl_te", "SELECT * FROM pl_e WHERE role = 'test' AND fwd IS NOT NULL")
    cte("pl_r", rules_sql("pl_tr", k))
    cte("pl_v", votes_sql("pl_te", "pl_r", k))
    cte("pl_x", "SELECT asset, fold AS checkpoint, max(cut) AS revealed, count(*) AS n, count(pred) AS n_pred, sum(CASE WHEN pred IS NOT NULL THEN CAST(pred = CAST(fwd > 0 AS INT) AS INT) END) AS hits FROM (SELECT * FROM pl_s WHERE role = 'test' AND fwd IS NOT NULL) AS s LEFT JOIN (SELECT asset, fold, t, pred FROM pl_v) AS v USING (asset, fold, t) GROUP BY asset, fold")


learning_sql(6, 0.3)


@query("m22_progressive", "asset checkpoint:i revealed:i n:i n_pred:i coverage:d chunk_hit:d cum_hit:d", "SELECT *, n_pred / n AS coverage, CASE WHEN n_pred > 0 THEN hits / n_pred END AS chunk_hit, sum(hits) OVER w / nullif(sum(n_pred) OVER w, 0) AS cum_hit FROM pl_x WINDOW w AS (PARTITION BY asset ORDER BY checkpoint ROWS UNBOUNDED PRECEDING)")
def m22(spark, sf):
    return W.progressive_learning(rows3(spark, sf), CFG, 6)


@query("m23_sweep", "asset config rank:i validate_n:i validate_hit:d validate_skill:d test_n:i test_hit:d test_skill:d test_p:d")
def m23(spark, sf):
    base = pool(spark, sf)
    lean = replace(CFG, atoms=("close_pos", "range_pct", "streak_signed"))
    frames = {"three_1": (rows3(spark, sf), CFG), "lean_1": (W.frame(None, lean, base), lean), "lean_4": (W.frame(None, replace(lean, horizon=4), base), replace(lean, horizon=4)), "three_move": (rows3(spark, sf), replace(CFG, threshold=0.005))}
    return W.sweep(frames)


@query("m24_feature_sets", "set asset n_hold:i n_rules:i n:i hits:i hit:d")
def m24(spark, sf):
    """Price, news and both on daily rows that have both."""
    from barweave.operators.resample import ffill_daily

    base = ffill_daily(pool(spark, sf), X.news_features(B.news_like(spark, sf), 5).drop("symbol"))
    rows = base.select("asset", "res", "ts", *_THREE, "news_tone", "news_tone_chg", "return_6h", "fwd")
    return W.compare_feature_sets(rows, {"price": _THREE, "news": ("news_tone", "news_tone_chg"), "both": ("return_1h", "news_tone", "news_tone_chg")}, CFG)


cte("pool_hold", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY t) AS r, count(*) OVER (PARTITION BY asset) AS n_rows FROM pool) AS x WHERE r > floor(n_rows * 0.7 + 1e-9)")
for _set, _only in (("three", ""), ("lean", " WHERE event NOT LIKE '%volume_zscore%'")):
    cte(f"why_{_set}", f"SELECT asset, avg(CAST(pred = CAST(fwd > 0 AS INT) AS INT)) AS hit FROM truth_hold JOIN ({votes_sql('ev_hold', f'(SELECT * FROM frozen{_only}) AS z', 'asset')}) AS v USING (asset, t) WHERE fwd IS NOT NULL GROUP BY asset")
    cte(f"why_rules_{_set}", f"SELECT asset, count(*) AS n FROM frozen{_only} GROUP BY asset")
_STAYS = "CAST(sign(return_1h) = sign(streak) AS INT)"


@query("q21_generalization_why", "asset close_pos_edge:d range_med:d reversion_index:d first_hit:d second_hit:d first_rules:i second_rules:i delta:d wins:b", f"SELECT e.*, r.reversion_index, a.hit AS first_hit, b.hit AS second_hit, coalesce(c.n, 0) AS first_rules, coalesce(d.n, 0) AS second_rules, b.hit - a.hit AS delta, coalesce(b.hit > a.hit, false) AS wins FROM (SELECT asset, avg(CAST(fwd > 0 AS INT)) FILTER (close_pos <= 1.0 / 3) - avg(CAST(fwd > 0 AS INT)) FILTER (close_pos >= 2.0 / 3) AS close_pos_edge, quantile_cont(range_pct, 0.5) AS range_med FROM pool_hold WHERE fwd <> 0 AND close_pos IS NOT NULL GROUP BY asset) AS e LEFT JOIN (SELECT asset, 0.5 - avg({_STAYS}) AS reversion_index FROM pool_hold WHERE abs(streak) BETWEEN 2 AND 7 AND return_1h <> 0 GROUP BY asset) AS r USING (asset) LEFT JOIN why_three AS a USING (asset) LEFT JOIN why_lean AS b USING (asset) LEFT JOIN why_rules_three AS c USING (asset) LEFT JOIN why_rules_lean AS d USING (asset)")
def q21w(spark, sf):
    return W.generalization_why(pool_streak(spark, sf), rows3(spark, sf), {"three": _THREE, "lean": ("return_1h", "trend_slope")}, CFG)


# ---- tests of chance

_COUNTS = "SELECT asset, count(*) AS n, sum(up) AS n_up, sum(pred) AS n_pred_up, sum(CAST(pred = up AS INT)) AS hits FROM (SELECT v.asset, v.pred, CAST(x.fwd > 0 AS INT) AS up FROM votes AS v JOIN truth AS x USING (asset, t) WHERE x.fwd IS NOT NULL) AS z GROUP BY asset"


def counts(spark, sf) -> DataFrame:
    s, rules, events = dev_rules(spark, sf)
    return T.permutation_counts(M.predict_votes(events, rules).join(truth(s).where("fwd is not null").withColumn("up", (F.col("fwd") > 0).cast("int")), ["asset", "res", "ts"]))


@query("t1_exact_null", "asset n:i n_up:i n_pred_up:i hits:i hit:d null_mean:d null_std:d", f"SELECT *, hits / n AS hit, (n - n_up - n_pred_up + 2.0 * n_up * n_pred_up / n) / n AS null_mean, sqrt(4.0 * n_pred_up * (n_up / n) * (1 - n_up / n) * (n - n_pred_up) / (n - 1)) / n AS null_std FROM ({_COUNTS}) AS c")
def t1(spark, sf):
    return T.exact_null(counts(spark, sf))


@query("t1_permutation_p", "asset hit:d null_mean:d null_std:d p_value:d")
def t1p(spark, sf):
    return T.permutation_p(counts(spark, sf))


@query("t2_t3_cell_nulls", "asset len:i rate:d p_sampling:d p_coin:d")
def t2(spark, sf):
    from barweave.operators.streaks import trend_structure
    from pyspark.sql import Window

    cells = trend_structure(X.streak_before(pool(spark, sf))).withColumn("len", F.col("sign") * F.col("len")).select("asset", "len", "n", F.round(F.col("next_up_rate") * F.col("n")).cast("long").alias("hits"))
    w = Window.partitionBy("asset")
    cells = cells.withColumns({"total": F.sum("n").over(w), "total_hits": F.sum("hits").over(w)})
    a = T.sampling_null(cells, 500, by=["asset", "len"]).withColumnRenamed("p_value", "p_sampling")
    return a.join(T.coin_null(cells, 500, by=["asset", "len"]).select("asset", "len", F.col("p_value").alias("p_coin")), ["asset", "len"])


@query("t4_permute_means", "asset observed:d", "SELECT asset, avg(abs(fwd)) FILTER (volume_zscore > 1) - avg(abs(fwd)) FILTER (volume_zscore <= 1) AS observed FROM pool WHERE fwd IS NOT NULL AND volume_zscore IS NOT NULL GROUP BY asset")
def t4(spark, sf):
    rows = pool(spark, sf).where("fwd is not null and volume_zscore is not null").withColumns({"spike": (F.col("volume_zscore") > 1).cast("int"), "size": F.abs("fwd")})
    return T.permute_means(rows, "spike", "size", n=200, by=A)


@query("t5_feasibility", "asset real_lift:d consistency:d null_lift:d p_value:d")
def t5(spark, sf):
    return W.feasibility(rows3(spark, sf), replace(CFG, n_folds=2), 3)


cte("pvals", "SELECT asset, event, (1 + n % 37) / 1000.0 AS p_value FROM (SELECT asset, event, count(*) AS n FROM events_long GROUP BY ALL) AS x")


@query("t6_adjust_p", "asset event p_bonferroni:d p_holm:d", "SELECT asset, event, least(1, p_value * m) AS p_bonferroni, max(st) OVER (PARTITION BY asset ORDER BY p_value) AS p_holm FROM (SELECT *, count(*) OVER (PARTITION BY asset) AS m, least(1, p_value * (count(*) OVER (PARTITION BY asset) - rank() OVER (PARTITION BY asset ORDER BY p_value) + 1)) AS st FROM pvals) AS x")
def t6(spark, sf):
    e = P.build_events(states(spark, sf), _THREE).groupBy("asset", "event").agg(F.count("*").alias("n"))
    out = T.adjust_p(e.withColumn("p_value", (1 + F.col("n") % 37) / 1000.0), family=A)
    from pyspark.sql import Window

    # equal p-values: the first one's step is the largest, and holds for all of them
    return out.withColumn("p_holm", F.max("p_holm").over(Window.partitionBy("asset", "p_value")))


@query("t7_deflated_sharpe", "asset n:i skew:d kurt_excess:d sr_hat:d sr0:d dsr:d", f"""SELECT *, (sr_hat - sr0) / sqrt(greatest(1e-12, 1 - skew * sr_hat + kurt_excess / 4 * sr_hat * sr_hat) / (n - 1)) AS dsr FROM (SELECT asset, n, m3c / pow(s, 3) AS skew, m4c / pow(s, 4) - 3 AS kurt_excess, m / s AS sr_hat, {T.expected_max_sharpe(20, 1.0)!r} * sqrt(1.0 / n) AS sr0 FROM
    (SELECT asset, count(*) AS n, any_value(m) AS m, any_value(s) AS s, avg(pow(fwd - m, 3)) AS m3c, avg(pow(fwd - m, 4)) AS m4c FROM pool JOIN (SELECT asset, avg(fwd) AS m, stddev_samp(fwd) AS s FROM pool GROUP BY asset) AS a USING (asset) WHERE fwd IS NOT NULL GROUP BY asset) AS b) AS c""")
def t7(spark, sf):
    return T.deflated_sharpe(pool(spark, sf), 20, ret="fwd")


@query("t8_fold_instability", "asset fold:i n:i mean:d positive_rate:d under:b non_positive:b", "SELECT asset, fold, count(*) AS n, avg(fwd) AS mean, avg(CAST(fwd > 0 AS INT)) AS positive_rate, avg(CAST(fwd > 0 AS INT)) < any_value(a) - 0.02 AS under, avg(fwd) <= 0 AS non_positive FROM (SELECT *, ntile(8) OVER (PARTITION BY asset ORDER BY t) AS fold, avg(CAST(fwd > 0 AS INT)) OVER (PARTITION BY asset) AS a FROM pool WHERE fwd IS NOT NULL) AS x GROUP BY asset, fold")
def t8(spark, sf):
    return T.fold_instability(pool(spark, sf), ret="fwd")


cte("ranked_atoms", "SELECT asset, " + ", ".join(f"rank() OVER (PARTITION BY asset ORDER BY round({n}, 10)) + (count(*) OVER (PARTITION BY asset, round({n}, 10)) - 1) / 2.0 AS r_{n}" for n in _THREE) + " FROM known")
_CM = [(a, b) for a in _THREE for b in _THREE]


@query("t9_correlations", "method asset a b corr:d", " UNION ALL ".join(f"SELECT 'pearson' AS method, asset, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM known GROUP BY asset UNION ALL SELECT 'spearman', asset, '{a}', '{b}', corr(r_{a}, r_{b}) FROM ranked_atoms GROUP BY asset" for a, b in _CM))
def t9(spark, sf):
    k = known(spark, sf)
    out = [T.correlation_matrix(k, _THREE, m, A).withColumn("method", F.lit(m)) for m in ("pearson", "spearman")]
    return out[0].unionByName(out[1])


# the eigenvalues of a 3 x 3 correlation matrix in closed form: 1 + 2 sqrt(p / 3) cos((acos(abc / (p / 3)^1.5) - 2 pi k) / 3), p = a^2 + b^2 + c^2
cte("corr_three", f"SELECT asset, corr({_THREE[0]}, {_THREE[1]}) AS a, corr({_THREE[0]}, {_THREE[2]}) AS b, corr({_THREE[1]}, {_THREE[2]}) AS c FROM known WHERE {' AND '.join(f'{x} IS NOT NULL' for x in _THREE)} GROUP BY asset")
cte("eigen_three", "SELECT asset, k, (1 + 2 * sqrt(p / 3) * cos((acos(greatest(-1, least(1, a * b * c / pow(p / 3, 1.5)))) - 2 * pi() * k) / 3)) / 3 AS ratio FROM (SELECT *, a * a + b * b + c * c AS p, unnest([0, 1, 2]) AS k FROM corr_three) AS x")
cte("eigen_sums", "SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ratio DESC) AS pc, sum(ratio) OVER (PARTITION BY asset ORDER BY ratio DESC ROWS UNBOUNDED PRECEDING) AS cumulative FROM eigen_three")


@query("t10_explained_variance", "asset pc:i ratio:d cumulative:d needed:i", "SELECT *, min(CASE WHEN cumulative >= 0.95 - 1e-12 THEN pc END) OVER (PARTITION BY asset) AS needed FROM eigen_sums")
def t10(spark, sf):
    return T.explained_variance(known(spark, sf), _THREE)


_EDGES = ", ".join(f"quantile_cont(close_pos, {i} / 5.0)" for i in range(1, 5))


@query("t11_mutual_information", "asset col mi:d", f"SELECT asset, 'close_pos' AS col, sum(c / n * ln(c * n / (cx * cy))) AS mi FROM (SELECT *, sum(c) OVER (PARTITION BY asset) AS n, sum(c) OVER (PARTITION BY asset, bin) AS cx, sum(c) OVER (PARTITION BY asset, y) AS cy FROM (SELECT asset, len(list_filter(list_distinct(e), lambda x: x <= close_pos)) AS bin, CAST(fwd > 0 AS INT) AS y, count(*)::DOUBLE AS c FROM (SELECT * FROM pool WHERE close_pos IS NOT NULL AND fwd IS NOT NULL) AS p JOIN (SELECT asset, [{_EDGES}] AS e FROM pool WHERE close_pos IS NOT NULL AND fwd IS NOT NULL GROUP BY asset) AS q USING (asset) GROUP BY ALL) AS a) AS b GROUP BY asset")
def t11(spark, sf):
    return T.mutual_information(X.material_direction(pool(spark, sf)), ["close_pos"], "up", 5)


_THREE_COLS = ("return_1h", "trend_slope", "close_pos")
cte("known_up", "SELECT *, CAST(fwd > 0 AS INT) AS up FROM known WHERE fwd IS NOT NULL AND return_1h IS NOT NULL AND trend_slope IS NOT NULL AND close_pos IS NOT NULL")
cte("greedy_edges", "SELECT asset, " + ", ".join(f"list_distinct([{', '.join(f'quantile_cont({c}, {i} / 4.0)' for i in range(1, 4))}]) AS e{k}" for k, c in enumerate(_THREE_COLS)) + " FROM known_up GROUP BY asset")
cte("greedy_bins", "SELECT asset, up AS y, " + ", ".join(f"len(list_filter(e{k}, lambda x: x <= {c})) AS b{k}" for k, c in enumerate(_THREE_COLS)) + " FROM known_up JOIN greedy_edges USING (asset)")
for _step in range(1, 4):
    _had = "SELECT DISTINCT asset, CAST([] AS BIGINT[]) AS have, 0.0 AS mi FROM greedy_bins" if _step == 1 else f"SELECT asset, have, mi FROM greedy_{_step - 1}"
    _cells = f"SELECT asset, have, before, cand, y, list_transform(list_append(have, cand), lambda i: [b0, b1, b2][i + 1]) AS x, count(*)::DOUBLE AS c FROM (SELECT g.*, h.have, h.mi AS before, unnest(list_filter([0, 1, 2], lambda i: NOT list_contains(h.have, i))) AS cand FROM greedy_bins AS g JOIN ({_had}) AS h USING (asset)) AS t GROUP BY ALL"
    _scores = f"SELECT asset, have, before, cand, sum(c / n * ln(c * n / (cx * cy))) AS mi FROM (SELECT *, sum(c) OVER (PARTITION BY asset, cand) AS n, sum(c) OVER (PARTITION BY asset, cand, x) AS cx, sum(c) OVER (PARTITION BY asset, cand, y) AS cy FROM ({_cells}) AS u) AS v GROUP BY ALL"
    cte(f"greedy_{_step}", f"SELECT asset, list_append(have, cand) AS have, mi, mi - before AS gain, {_step} AS step, list_extract(['return_1h', 'trend_slope', 'close_pos'], cand + 1) AS col FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY round(mi, 10) DESC, cand) AS r FROM ({_scores}) AS w) AS z WHERE r = 1")


@query("t11_greedy_subset", "asset step:i col gain:d", " UNION ALL ".join(f"SELECT asset, step, col, gain FROM greedy_{s}" for s in range(1, 4)))
def t11g(spark, sf):
    return T.greedy_subset(X.material_direction(known(spark, sf)), _THREE_COLS, "up", 4, 3)


@query("t12_hit_se_gap", "asset se:d gap_pp:d", "SELECT asset, sqrt(h * (1 - h) / n) AS se, 100 * (h - d) AS gap_pp FROM (SELECT asset, n, hits / n AS h FROM (" + _COUNTS + ") AS c) AS x JOIN (SELECT asset, avg(hit) AS d FROM dev_samples GROUP BY asset) AS y USING (asset)")
def t12(spark, sf):
    hold = counts(spark, sf).select("asset", "n", (F.col("hits") / F.col("n")).alias("h"))
    dev = dev_samples(spark, sf)[3].groupBy("asset").agg(F.avg("hit").alias("d"))
    return hold.join(dev, "asset").select("asset", T.hit_se(F.col("h"), F.col("n")).alias("se"), T.overfit_gap(F.col("h"), F.col("d")).alias("gap_pp"))


@query("l1_boosted", "asset n:i hit:d lift:d")
def l1b(spark, sf):
    """Boosted trees of all assets at once."""
    return W.boosted_holdout(rows3(spark, sf), CFG, 6, 2, 16)


@query("l1_gbt", "asset n:i hit:d lift:d")
def l1(spark, sf):
    return W.gbt_holdout(rows3(spark, sf), CFG, "click", 5)

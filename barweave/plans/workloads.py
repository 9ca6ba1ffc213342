"""Whole studies: walk-forward, holdout, replay, progressive learning, sweeps, feasibility, the conviction panel."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window, functions as F

from barweave.functions.discretize import assign_folds, build_events, chrono_split, contrarian_signal, discretize, fit_thresholds, three_way, vr_regime
from barweave.functions.features import ATOM_SETS, atom_pool, forward_return, pct_return, streak_before, vol_ratio
from barweave.functions.windows import BY, over
from barweave.operators import mining
from barweave.operators.boosting import boosted
from barweave.operators.positions import align_panel
from barweave.operators.resample import resample_last
from barweave.operators.streaks import conviction_tier, generalization
from barweave.operators.tests_of_chance import permutation_counts, permutation_p
from barweave.sources.stored import stored


@dataclass(frozen=True)
class Config:
    """A study's numbers; the defaults are the usual ones for hourly bars."""

    atoms: tuple[str, ...] = ATOM_SETS["core5"]
    sizes: tuple[int, ...] = (2, 3)
    horizon: int = 1
    min_support: int = 25
    min_conf: float = 0.55
    half_life_h: float = 720.0
    n_folds: int = 5
    initial: float = 0.4
    min_folds: int = 3
    min_consistency: float = 0.75
    min_oos: int = 5
    holdout: float = 0.3
    threshold: float = 0.0
    by: tuple[str, ...] = field(default=BY)


def frame(bars: DataFrame, cfg: Config, pool: DataFrame | None = None) -> DataFrame:
    """Features, the forward return and the momentum baseline of every bar with known features."""
    pool = atom_pool(bars, cfg.by, patterns=bool({"doji", "bullish_engulfing", "bearish_engulfing"} & set(cfg.atoms))) if pool is None else pool
    extra = [c for c in ("return_6h",) if c not in cfg.atoms]
    return forward_return(pool, cfg.horizon, cfg.by).select(*cfg.by, "ts", *cfg.atoms, *extra, "fwd").dropna(subset=list(cfg.atoms))


def _states(rows: DataFrame, train: DataFrame, cfg: Config, by: Sequence[str]) -> DataFrame:
    return discretize(rows, fit_thresholds(train, cfg.atoms, by), cfg.atoms, by)


def _mine(states: DataFrame, cfg: Config, by: Sequence[str]) -> DataFrame:
    return mining.mine_rules(states, cfg.atoms, cfg.sizes, cfg.half_life_h, cfg.min_support, cfg.min_conf, by)


def walk_forward(rows: DataFrame, cfg: Config, blocked: DataFrame | None = None, positive: DataFrame | None = None, bins: DataFrame | None = None, regimes: DataFrame | None = None, max_failures: int | None = None) -> dict[str, DataFrame]:
    """All folds at once, the fold as a key: rules, out-of-sample predictions and hits, fold_metrics, stability, calibrated, by_regime.

    Memory goes in as tables: ``blocked`` events (series, event) make no rules, a ``positive`` rule (series, event,
    avg_oos_hit) weighs by its remembered hit rate, ``bins`` (series, bin, hits, total) calibrate. With ``max_failures``
    the folds teach the later ones: a rule whose side was right in half of a fold's bars or fewer has failed there, and
    after so many failures its event is blocked; and a fold's probabilities are calibrated on the hits of the folds
    before it (and ``bins``). Both depend on earlier folds by sums over them only, so they are windows over the fold.
    ``regimes`` (series, ts, regime) adds hit rates by regime. Folds, states and rules are written once.
    """
    by = [*cfg.by, "fold"]
    folds = stored(assign_folds(rows, cfg.n_folds, cfg.initial, cfg.by), "folds")
    states = stored(_states(folds, folds.where("role = 'train'"), cfg, by), "states")
    rules = _mine(states.where("role = 'train'"), cfg, by)
    if blocked is not None:
        rules = rules.join(blocked.select(*cfg.by, "event").distinct(), [*cfg.by, "event"], "left_anti")
    rules = stored(rules, "rules")
    test = states.where("role = 'test'")
    events = build_events(test, cfg.atoms, cfg.sizes, [*by, "ts"])
    truth = test.select(*by, "ts", "fwd", "return_6h")
    hits = stored(mining.oos_rule_hits(events, rules, truth, cfg.min_oos, by), "hits")
    out = {"hits": hits, "stability": mining.stability_table(rules, hits, cfg.n_folds, cfg.by)}
    if max_failures is not None:
        before = Window.partitionBy(*cfg.by, "event").orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
        failed = rules.join(hits.select(*by, "event", "oos_hit"), [*by, "event"], "left").withColumn("failures", F.coalesce(F.sum((F.col("oos_hit") <= 0.5).cast("int")).over(before), F.lit(0)))
        out["failures"] = failed.select(*by, "event", "failures")
        rules = stored(failed.where(F.col("failures") < max_failures).drop("oos_hit", "failures"), "rules")
    preds = mining.predict_votes(events, rules, by)
    memory = None if positive is None else rules.select(*by, "event").join(positive.select(*cfg.by, "event", "avg_oos_hit"), [*cfg.by, "event"])
    raw = mining.predict_calibrated(events, rules, memory, None, by)
    if max_failures is not None:
        seen = raw.join(truth.where("fwd is not null"), [*by, "ts"]).withColumn("hit", (F.col("pred") == (F.col("fwd") > 0).cast("int")).cast("int"))
        each = mining.calibration_table(seen, by).select(*by, "bin", "hits", "total")
        later = each.where(F.col("fold") < cfg.n_folds - 1).withColumn("fold", F.explode(F.sequence(F.col("fold") + 1, F.lit(cfg.n_folds - 1))))
        if bins is not None:
            later = later.unionByName(bins.select(*cfg.by, "bin", "hits", "total").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(cfg.n_folds - 1)))))
        bins = later.groupBy(*by, "bin").agg(F.sum("hits").alias("hits"), F.sum("total").alias("total"))
    calibrated = raw if bins is None else mining.calibrate(raw.drop("calibrated_prob"), bins, by)
    out |= {"rules": rules, "predictions": preds, "fold_metrics": mining.evaluate(preds, truth, by), "calibrated": calibrated}
    if regimes is not None:
        out["by_regime"] = mining.evaluate_by_regime(calibrated.drop("fold"), truth.drop("fold"), regimes, cfg.by)
    return out


def _holdout(rows: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The dev part's stable rules, the held-out states' events, and the held-out moves; each written once."""
    split = stored(chrono_split(rows, cfg.holdout, cfg.by), "split")
    dev = split.where("part = 'dev'").drop("part")
    stable = mining.select_stable(walk_forward(dev, cfg)["stability"], cfg.min_folds, cfg.min_consistency)
    frozen = stored(stable.select(*cfg.by, "event", "direction", F.col("avg_confidence").alias("confidence")), "frozen")
    states = stored(_states(split.where("part = 'hold'"), dev, cfg, cfg.by), "held")
    truth = states.where("fwd is not null" if cfg.threshold <= 0 else f"abs(fwd) > {cfg.threshold}").select(*cfg.by, "ts", (F.col("fwd") > 0).cast("int").alias("up"))
    return frozen, build_events(states, cfg.atoms, cfg.sizes, [*cfg.by, "ts"]), truth


def _held_out(frozen: DataFrame, events: DataFrame, truth: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """n_hold, n_rules, n, hits, coverage, hit and lift of frozen rules, and the counts behind them."""
    by = list(by)
    counts = stored(permutation_counts(truth.join(mining.predict_votes(events, frozen, by), [*by, "ts"]), by), "counts")
    base = truth.groupBy(*by).agg(F.count("*").alias("n_hold"))
    rules = frozen.groupBy(*by).agg(F.count("*").alias("n_rules"))
    out = base.join(rules, by, "left").join(counts, by, "left").select(*by, "n_hold", F.coalesce("n_rules", F.lit(0)).alias("n_rules"), F.coalesce("n", F.lit(0)).alias("n"), "hits")
    out = out.withColumns({"coverage": F.col("n") / F.col("n_hold"), "hit": F.when(F.col("n") > 0, F.col("hits") / F.col("n"))}).withColumn("lift", F.col("hit") - 0.5)
    return out, counts


def holdout_test(rows: DataFrame, cfg: Config, n_draws: int = 300, seed: int = 0, p_values: bool = True) -> DataFrame:
    """Rules that are stable on the dev part, frozen and scored on the rest: n_rules, n, hits, hit, lift and the null's p."""
    out, counts = _held_out(*_holdout(rows, cfg), cfg.by)
    return out.join(permutation_p(counts, n_draws, seed, cfg.by).select(*cfg.by, "null_mean", "null_std", "p_value"), list(cfg.by), "left") if p_values else out


def infer_latest(rows: DataFrame, rules: DataFrame, cfg: Config, train: DataFrame | None = None, bins: DataFrame | None = None) -> DataFrame:
    """The newest bar of every series with its matching rules: status, direction, probabilities, rules_used."""
    newest = rows.withColumn("_r", F.row_number().over(over(cfg.by, F.desc("ts")))).where("_r = 1").drop("_r")
    events = build_events(_states(newest, rows if train is None else train, cfg, cfg.by), cfg.atoms, cfg.sizes, [*cfg.by, "ts"])
    preds = mining.predict_calibrated(events, rules, None, bins, cfg.by)
    used = mining.matches(events, rules.select(*cfg.by, "event", "direction", "confidence"), cfg.by).groupBy(*cfg.by).agg(F.array_sort(F.collect_list(F.struct("event", "direction", "confidence"))).alias("rules_used"))
    out = newest.select(*cfg.by, "ts").join(preds.drop("ts"), list(cfg.by), "left").join(used, list(cfg.by), "left")
    return out.withColumns({"status": F.when(F.col("pred").isNull(), "no_rules").otherwise("ok"), "direction": F.when(F.col("pred") == 1, "UP").when(F.col("pred") == 0, "DOWN"), "n_rules": F.coalesce("n_rules", F.lit(0))}).drop("pred")


def replay(rows: DataFrame, cfg: Config, windows: int = 8) -> DataFrame:
    """The walk-forward on growing prefixes, all at once: bars, hit and lift per window, and the lift's change."""
    numbered = rows.withColumns({"_rn": F.row_number().over(over(cfg.by)), "_n": F.count(F.lit(1)).over(Window.partitionBy(*cfg.by))})
    end = F.floor(F.col("_n") * F.col("window") / windows + 1e-9)
    spread = numbered.withColumn("window", F.explode(F.sequence(F.lit(1), F.lit(windows)))).where(F.col("_rn") <= end).drop("_rn", "_n")
    by = (*cfg.by, "window")
    parts = walk_forward(spread, replace(cfg, by=by))
    metrics = parts["fold_metrics"].groupBy(*by).agg(F.sum("n_pred").alias("n"), (F.sum(F.col("model_hit") * F.col("n_pred")) / F.sum("n_pred")).alias("hit_rate"))
    rules = parts["stability"].groupBy(*by).agg(F.count("*").alias("n_rules"))
    out = spread.groupBy(*by).agg(F.count("*").alias("bars")).join(metrics, list(by), "left").join(rules, list(by), "left")
    w = Window.partitionBy(*cfg.by)
    out = out.withColumn("lift", F.col("hit_rate") - 0.5)
    return out.withColumn("lift_trend", F.max_by("lift", "window").over(w) - F.min_by("lift", "window").over(w))


def progressive_learning(rows: DataFrame, cfg: Config, checkpoints: int = 15, seed_frac: float = 0.3, mode: str = "expanding", window: int = 2000) -> DataFrame:
    """Rules mined anew at each checkpoint from all (or the last ``window``) bars before it, scored on the bars up to the next."""
    numbered = rows.withColumns({"_rn": F.row_number().over(over(cfg.by)) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*cfg.by))})
    start = F.floor(F.col("_n") * seed_frac + 1e-9)
    step = F.greatest(F.lit(1), F.floor((F.col("_n") - start) / checkpoints))
    cut = start + F.col("checkpoint") * step
    until = F.when(F.col("checkpoint") == checkpoints - 1, F.col("_n")).otherwise(cut + step)
    spread = numbered.withColumn("checkpoint", F.explode(F.sequence(F.lit(0), F.lit(checkpoints - 1))))
    first = F.lit(0) if mode == "expanding" else cut - window
    role = F.when((F.col("_rn") < cut) & (F.col("_rn") >= first), "train").when((F.col("_rn") >= cut) & (F.col("_rn") < until), "test")
    spread = spread.withColumns({"role": role, "revealed": cut}).where("role is not null")
    by = [*cfg.by, "checkpoint"]
    states = _states(spread, spread.where("role = 'train'"), cfg, by)
    rules = _mine(states.where("role = 'train'"), cfg, by)
    test = states.where("role = 'test' and fwd is not null")
    preds = mining.predict_votes(build_events(test, cfg.atoms, cfg.sizes, [*by, "ts"]), rules, by)
    scored = test.select(*by, "ts", "revealed", "fwd").join(preds.select(*by, "ts", "pred"), [*by, "ts"], "left")
    hit = F.when(F.col("pred").isNotNull(), (F.col("pred") == (F.col("fwd") > 0).cast("int")).cast("int"))
    out = scored.groupBy(*by).agg(F.max("revealed").alias("revealed"), F.count("*").alias("n"), F.count("pred").alias("n_pred"), F.sum(hit).alias("hits"))
    w = Window.partitionBy(*cfg.by).orderBy("checkpoint").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({"coverage": F.col("n_pred") / F.col("n"), "chunk_hit": F.when(F.col("n_pred") > 0, F.col("hits") / F.col("n_pred")), "cum_hit": F.sum("hits").over(w) / F.nullif(F.sum("n_pred").over(w), F.lit(0))})
    third = F.when(F.col("checkpoint") < checkpoints / 3, "early").when(F.col("checkpoint") >= checkpoints * 2 / 3, "late").otherwise("middle")
    return out.withColumn("third", third)


def sweep(frames: dict[str, tuple[DataFrame, Config]], n_draws: int = 300, seed: int = 0) -> DataFrame:
    """Configurations side by side: trained on the first 55 %, ranked by validation skill; the winner alone is scored on the test part, once, with its p.

    ``frames``: name to (rows, Config); each row set may have its own features, horizon and resolution. What a
    configuration leaves is four counts for each part and series, written once; ranks, skills and the winner's
    permutation test come from these.
    """
    parts = None
    for name, (rows, cfg) in frames.items():
        split = stored(three_way(rows, by=cfg.by), "split")
        train = split.where("part = 'train'")
        states = stored(_states(split, train, cfg, cfg.by), "states")
        rules = _mine(states.where("part = 'train'"), cfg, cfg.by)
        later = states.where("part <> 'train' and fwd is not null")
        if cfg.threshold > 0:
            later = later.where(F.abs("fwd") > cfg.threshold)
        preds = mining.predict_votes(build_events(later, cfg.atoms, cfg.sizes, [*cfg.by, "ts"]), rules, cfg.by)
        scored = later.select(*cfg.by, "ts", "part", (F.col("fwd") > 0).cast("int").alias("up")).join(preds.select(*cfg.by, "ts", "pred"), [*cfg.by, "ts"])
        one = permutation_counts(scored, ["asset", "part"]).select("asset", F.lit(name).alias("config"), "part", "n", "n_up", "n_pred_up", "hits")
        parts = one if parts is None else parts.unionByName(one)
    parts = stored(parts, "sweep")
    # skill: the hit rate over that of always saying the commoner side
    hit, up = F.col("hits") / F.col("n"), F.col("n_up") / F.col("n")
    scores = parts.select("asset", "config", "part", "n", hit.alias("hit"), (hit - F.greatest(up, 1 - up)).alias("skill"))
    side = lambda p: scores.where(F.col("part") == p).select("asset", "config", *[F.col(c).alias(f"{p}_{c}") for c in ("n", "hit", "skill")])
    ranked = side("validate").join(side("test"), ["asset", "config"], "full").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("validate_n", "test_n")})
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("asset").orderBy(F.round("validate_skill", 9).desc_nulls_last(), "config")))
    winner = F.col("rank") == 1
    ranked = ranked.withColumns({c: F.when(winner, F.col(c)) for c in ("test_n", "test_hit", "test_skill")})
    chosen = parts.where("part = 'test'").join(ranked.where(winner).select("asset", "config"), ["asset", "config"])
    tested = permutation_p(chosen, n_draws, seed, ["asset", "config"]).select("asset", "config", F.col("null_mean").alias("test_null"), F.col("p_value").alias("test_p"))
    return ranked.join(tested, ["asset", "config"], "left")


def compare_feature_sets(rows: DataFrame, sets: dict[str, Sequence[str]], cfg: Config) -> DataFrame:
    """The holdout test with several sets of features on the same rows (those where all of them are known).

    Rows, splits and so states are the same for all sets, and a rule belongs to every set that has its features. So
    rules are mined and validated once, and the set is a key of the frozen rules and their votes.
    """
    every = sorted({c for s in sets.values() for c in s})
    same = rows.dropna(subset=every)
    whole = replace(cfg, atoms=tuple(every))
    frozen, events, truth = _holdout(same, whole)
    named = F.transform(F.split("event", "\\|"), lambda x: F.substring_index(x, "=", 1))
    fits = F.array_compact(F.array(*[F.when(F.size(F.array_except(named, F.array(*[F.lit(c) for c in cols]))) == 0, F.lit(name)) for name, cols in sets.items()]))
    by = [*cfg.by, "set"]
    keyed = frozen.withColumn("set", F.explode(fits))
    each = F.explode(F.array(*[F.lit(name) for name in sets]))
    return _held_out(keyed, matched_sets(events, keyed, cfg.by), truth.withColumn("set", each), by)[0]


def matched_sets(events: DataFrame, keyed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Events with each set that has a rule for them."""
    return events.join(keyed.select(*by, "event", "set").distinct(), [*by, "event"])


def generalization_why(features: DataFrame, rows: DataFrame, sets: dict[str, Sequence[str]], cfg: Config) -> DataFrame:
    """Per series, on its held-out part: the numbers of its mechanism, the hit rates and rules of two feature sets, and the second's lead.

    ``features`` has what ``streaks.generalization`` reads, ``rows`` what the holdout test reads. delta is null where a
    set has no predictions; wins is false there.
    """
    (first, second), by = sets, list(cfg.by)
    held = chrono_split(features, cfg.holdout, cfg.by).where("part = 'hold'")
    tested = compare_feature_sets(rows, sets, cfg)
    of = lambda name, c: F.max(F.when(F.col("set") == name, F.col(c)))
    scores = tested.groupBy(*by).agg(of(first, "hit").alias("first_hit"), of(second, "hit").alias("second_hit"), of(first, "n_rules").alias("first_rules"), of(second, "n_rules").alias("second_rules"))
    out = generalization(held, cfg.by).join(scores, by, "left").withColumn("delta", F.col("second_hit") - F.col("first_hit"))
    return out.withColumn("wins", F.coalesce(F.col("delta") > 0, F.lit(False)))


def feasibility(rows: DataFrame, cfg: Config, n: int = 10, segments: int = 4, seed: int = 0) -> DataFrame:
    """Does the mined lift exceed that on shuffled outcomes, and in every segment? The replicate is a key (0: the real order).

    A replicate permutes the forward returns: rows ranked by a hash take the return of the row of that rank in time.
    """
    by = list(cfg.by)
    known = rows.where("fwd is not null").withColumn("_rn", F.row_number().over(over(by)))
    targets = known.select(*by, F.col("_rn").alias("_k"), F.col("fwd").alias("_fwd"))
    rep = known.drop("fwd").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n))))
    order = Window.partitionBy(*by, "rep").orderBy(F.when(F.col("rep") == 0, F.col("_rn")).otherwise(F.xxhash64("_rn", "rep", F.lit(seed))))
    mixed = rep.withColumn("_k", F.row_number().over(order)).join(targets, [*by, "_k"]).withColumnRenamed("_fwd", "fwd")
    size = F.count(F.lit(1)).over(Window.partitionBy(*by, "rep"))
    mixed = stored(mixed.withColumn("segment", F.floor((F.col("_rn") - 1) * segments / size)).drop("_k", "_rn"), "replicates")
    parts = walk_forward(mixed.drop("segment"), replace(cfg, by=(*by, "rep")))
    scored = parts["predictions"].join(mixed.select(*by, "rep", "ts", "fwd", "segment"), [*by, "rep", "ts"])
    hit = (F.col("pred") == (F.col("fwd") > 0).cast("int")).cast("double")
    lifts = scored.groupBy(*by, "rep", "segment").agg(F.sum(hit).alias("h"), F.count("*").alias("k"))
    total = stored(lifts, "lifts").groupBy(*by, "rep").agg((F.sum("h") / F.sum("k") - 0.5).alias("lift"), F.sum((F.col("h") / F.col("k") > 0.5).cast("int")).alias("good"))
    real = total.where("rep = 0").select(*by, F.col("lift").alias("real_lift"), (F.col("good") / segments).alias("consistency"))
    null = total.where("rep > 0").join(real, by).groupBy(*by).agg(F.avg("lift").alias("null_lift"), ((1 + F.sum((F.col("lift") >= F.col("real_lift")).cast("int"))) / (1 + F.count("*"))).alias("p_value"))
    return real.join(null, by, "left")


def signal_panel(bars_by_res: dict[str, DataFrame], grid: str = "1h") -> DataFrame:
    """Per asset and grid time each resolution's contrarian signal as s{res}, the grid bars' run, return, volatility regime and next return."""
    base = pct_return(bars_by_res[grid].drop("res"), 1, ["asset"], name="return_1h")
    base = streak_before(base, by=["asset"])
    # the run that is known when the bar has closed
    base = base.withColumn("streak", F.coalesce(F.lead("streak").over(over(["asset"])), F.col("streak")))
    base = vr_regime(forward_return(vol_ratio(base, 6, 24, by=["asset"]), 1, ["asset"]), by=["asset"])
    base = base.select("asset", "ts", "return_1h", "streak", "vol_ratio", "vr", "fwd")
    parts = {}
    for res, b in bars_by_res.items():
        s = streak_before(pct_return(b.drop("res"), 1, ["asset"], name="return_1h"), by=["asset"])
        parts[f"s{res}"] = resample_last(contrarian_signal(s), "sig", grid, ["asset"])
    return align_panel(base, parts, ["asset"])


def conviction_panel(bars_by_res: dict[str, DataFrame], grid: str = "1h", vr_rule: bool = True) -> DataFrame:
    cols = [f"s{r}" for r in bars_by_res]
    return conviction_tier(signal_panel(bars_by_res, grid), cols, vr_rule)


def tier_pair(panel: DataFrame, a: str, b: str, cols: Sequence[str]) -> DataFrame:
    """Two assets' tiers at common times as a_* and b_*, for the catalogue."""
    core = [c for c in cols if c in ("s15m", "s30m", "s1h")]
    signs = F.array_distinct(F.array(*[F.coalesce(F.col(c), F.lit(0)) for c in core]))
    rows = panel.withColumns({"absret": F.abs("return_1h"), "freq": (F.size(signs) == 1) & (signs[0] != 0), "fund_extreme": F.coalesce(F.col("fund_extreme"), F.lit(False)) if "fund_extreme" in panel.columns else F.lit(False)})
    keep = ["tier", "dir", "slen", "tf_agree", "aligned", "vr", "absret", "freq", "fund_extreme", "fwd"]
    pick = lambda name, p: rows.where(F.col("asset") == name).select("ts", *[F.col(c).alias(f"{p}_{c}") for c in keep])
    return pick(a, "a").join(pick(b, "b"), "ts")


def boosted_holdout(rows: DataFrame, cfg: Config, trees: int = 20, depth: int = 3, bins: int = 32) -> DataFrame:
    """Boosted trees of every series, fitted on its dev part and scored on the rest: n, hit, lift."""
    split = chrono_split(rows.where("fwd is not null"), cfg.holdout, cfg.by).withColumn("up", (F.col("fwd") > 0).cast("int"))
    out = boosted(split, cfg.atoms, "up", F.col("part") == "dev", cfg.by, trees, depth, bins=bins).where("part = 'hold'")
    scored = out.groupBy(*cfg.by).agg(F.count("*").alias("n"), F.avg(((F.col("margin") > 0).cast("int") == F.col("up")).cast("int")).alias("hit"))
    return scored.withColumn("lift", F.col("hit") - 0.5)


def gbt_holdout(rows: DataFrame, cfg: Config, asset: str, trees: int = 20, depth: int = 3) -> DataFrame:
    """Gradient-boosted trees on one series' features, scored like the holdout test."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    split = chrono_split(rows.where((F.col("asset") == asset) & F.col("fwd").isNotNull()), cfg.holdout, cfg.by)
    ready = VectorAssembler(inputCols=list(cfg.atoms), outputCol="features").transform(split.withColumn("label", (F.col("fwd") > 0).cast("double")))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=0).fit(ready.where("part = 'dev'"))
    out = model.transform(ready.where("part = 'hold'")).groupBy("asset").agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("int")).alias("hit"))
    return out.withColumn("lift", F.col("hit") - 0.5)

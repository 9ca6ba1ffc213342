"""Rules from conjunctions of states: mining, voting, scoring, validation, memory, calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barweave.functions.discretize import combos, event_key
from barweave.functions.windows import BY, div


def mine_rules(states: DataFrame, names: Sequence[str], sizes: Sequence[int] = (2, 3), half_life_h: float = 720.0, min_support: int = 25, min_conf: float = 0.55, by: Sequence[str] = BY, ref: str | None = None) -> DataFrame:
    """Rules per group: event, support, weighted_support, p_up, confidence, direction, mean_fwd, last_seen.

    ``states`` has the state columns, ``fwd`` and ``ts``; rows without a forward return don't count. Weights halve every
    ``half_life_h`` hours before the group's last row (or the column ``ref``). Conjunctions are grouping sets: each
    row is spread over the combinations as group keys and meets its like in the partial aggregate, before the shuffle;
    the event's text is made for the rules that stay.
    """
    rows = states.where(F.col("fwd").isNotNull()).dropna(subset=list(names))
    if ref is None:
        ends = rows.groupBy(*by).agg(F.max("ts").alias("_ref"))
        rows = rows.join(ends, list(by))
        ref = "_ref"
    weight = F.pow(F.lit(0.5), F.greatest(F.lit(0.0), (F.unix_seconds(ref) - F.unix_seconds("ts")) / 3600.0) / half_life_h)
    rows = rows.select(*by, *names, "ts", "fwd", weight.alias("_w"), (F.col("fwd") > 0).cast("int").alias("_up"))
    picked = combos(names, sizes)
    sets = [[*[F.col(b) for b in by], *[F.col(c) for c in combo]] for combo in picked]
    grouped = rows.groupingSets(sets, *by, *names).agg(
        F.count(F.lit(1)).alias("support"), F.sum("_w").alias("weighted_support"), F.sum(F.col("_w") * F.col("_up")).alias("_wu"), F.avg("fwd").alias("mean_fwd"), F.max("ts").alias("last_seen"), F.grouping_id().alias("_gid")
    )
    # grouping_id has a bit for every key that is not in the set, the first key the highest
    width = len(by) + len(names)
    event = F.lit(None).cast("string")
    for combo in picked:
        gid = sum(1 << (width - 1 - i) for i, n in enumerate([*by, *names]) if n not in by and n not in combo)
        event = F.when(F.col("_gid") == gid, event_key(combo)).otherwise(event)
    known = grouped.where(F.col("support") >= min_support).withColumn("event", event)
    p = div(F.col("_wu"), F.col("weighted_support"))
    rules = known.withColumn("p_up", p).withColumn("confidence", F.greatest(F.col("p_up"), 1 - F.col("p_up"))).withColumn("direction", (F.col("p_up") >= 0.5).cast("int"))
    return rules.where(F.col("confidence") >= min_conf).select(*by, "event", "support", "weighted_support", "p_up", "confidence", "direction", "mean_fwd", "last_seen")


def matches(events: DataFrame, rules: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Events with their rule. The rules are few; Spark broadcasts them if they are below its limit."""
    return events.join(rules, [*by, "event"])


def predict_votes(events: DataFrame, rules: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Per bar the sum of +-confidence over its rules; a tie is down."""
    vote = F.col("confidence") * F.when(F.col("direction") == 1, 1).otherwise(-1)
    out = matches(events, rules.select(*by, "event", "confidence", "direction"), by).groupBy(*by, "ts").agg(F.sum(vote).alias("score"), F.count("*").alias("n_rules"))
    return out.withColumn("pred", (F.round("score", 12) > 0).cast("int"))


def bin_index(p: Column) -> Column:
    return F.least(F.lit(9), F.greatest(F.lit(0), F.floor((p - 0.5) / 0.05 + 1e-9)))


def predict_calibrated(events: DataFrame, rules: DataFrame, memory: DataFrame | None = None, bins: DataFrame | None = None, by: Sequence[str] = BY) -> DataFrame:
    """Per bar the side with more weight (a tie is up), its mean weight and that weight's calibrated probability.

    A rule's weight is its remembered out-of-sample hit rate, else its confidence. ``memory``: (by, event,
    avg_oos_hit); ``bins``: (asset, bin, hits, total).
    """
    known = rules.select(*by, "event", "confidence", "direction")
    if memory is not None:
        known = known.join(memory.select(*by, "event", "avg_oos_hit"), [*by, "event"], "left").withColumn("confidence", F.coalesce("avg_oos_hit", "confidence")).drop("avg_oos_hit")
    up, weight = F.col("direction") == 1, F.col("confidence")
    out = matches(events, known, by).groupBy(*by, "ts").agg(
        F.sum(F.when(up, weight).otherwise(0.0)).alias("_u"), F.sum(F.when(~up, weight).otherwise(0.0)).alias("_d"), F.avg(F.when(up, weight)).alias("_mu"), F.avg(F.when(~up, weight)).alias("_md"), F.count("*").alias("n_rules")
    )
    out = out.withColumn("pred", (F.round("_u", 12) >= F.round("_d", 12)).cast("int")).withColumn("raw_prob", F.when(F.col("pred") == 1, F.col("_mu")).otherwise(F.col("_md")))
    out = out.select(*by, "ts", "pred", "raw_prob", "n_rules")
    return out.withColumn("calibrated_prob", F.col("raw_prob")) if bins is None else calibrate(out, bins, by)


def calibrate(df: DataFrame, bins: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Each probability's Laplace-smoothed hit rate of its bin; its own value where the bin is empty."""
    keys = [b for b in by if b in bins.columns]
    joined = df.withColumn("bin", bin_index(F.col("raw_prob"))).join(bins.select(*keys, "bin", "hits", "total"), [*keys, "bin"], "left")
    return joined.withColumn("calibrated_prob", F.when(F.coalesce("total", F.lit(0)) > 0, (F.col("hits") + 1) / (F.col("total") + 2)).otherwise(F.col("raw_prob"))).drop("bin", "hits", "total")


def calibration_table(samples: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Hits and totals of ten fixed bins from (raw_prob, hit)."""
    out = samples.withColumn("bin", bin_index(F.col("raw_prob"))).groupBy(*by, "bin").agg(F.sum("hit").alias("hits"), F.count("*").alias("total"))
    return out.withColumns({"lo": 0.5 + F.col("bin") * 0.05, "hi": 0.55 + F.col("bin") * 0.05})


def prequential_metrics(samples: DataFrame, prior: DataFrame | None = None, by: Sequence[str] = BY, order: str = "ts") -> DataFrame:
    """ECE and Brier of samples (raw_prob, hit) in order, each scored by its bin as it is just after the sample."""
    rows = samples.withColumn("bin", bin_index(F.col("raw_prob")))
    if prior is not None:
        keys = [b for b in by if b in prior.columns]
        rows = rows.join(prior.select(*keys, "bin", F.col("hits").alias("_h0"), F.col("total").alias("_t0")), [*keys, "bin"], "left")
    else:
        rows = rows.withColumns({"_h0": F.lit(0), "_t0": F.lit(0)})
    w = Window.partitionBy(*by, "bin").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    cal = (F.sum("hit").over(w) + F.coalesce("_h0", F.lit(0)) + 1) / (F.count("*").over(w) + F.coalesce("_t0", F.lit(0)) + 2)
    scored = rows.withColumn("cal", cal)
    per_bin = scored.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.sum("cal").alias("c"), F.sum("hit").alias("h"), F.sum(F.pow(F.col("cal") - F.col("hit"), 2)).alias("b"))
    return per_bin.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum(F.abs(F.col("c") - F.col("h"))) / F.sum("n")).alias("ece"), (F.sum("b") / F.sum("n")).alias("brier"))


def brier_ece(samples: DataFrame, by: Sequence[str] = BY, bins: int = 10) -> DataFrame:
    """Brier score and ECE over equal bins of [0, 1] from (raw_prob, hit); the last bin includes 1."""
    rows = samples.withColumn("_bin", F.least(F.lit(bins - 1), F.floor(F.col("raw_prob") * bins + 1e-9)))
    per_bin = rows.groupBy(*by, "_bin").agg(F.count("*").alias("n"), F.sum("raw_prob").alias("p"), F.sum("hit").alias("h"), F.sum(F.pow(F.col("raw_prob") - F.col("hit"), 2)).alias("b"))
    return per_bin.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("b") / F.sum("n")).alias("brier"), (F.sum(F.abs(F.col("p") - F.col("h"))) / F.sum("n")).alias("ece"))


def n_atoms(event: str = "event") -> Column:
    return F.size(F.split(event, "\\|"))


def weighted_votes(events: DataFrame, rules: DataFrame, by: Sequence[str] = BY, schemes: Sequence[str] = ("equal", "size", "size2", "rarity", "edge", "size_edge")) -> DataFrame:
    """Votes under several weights at once: scheme, ts, pred, score. Without a support column rarity is equal."""
    size, edge = n_atoms().cast("double"), F.col("confidence") - 0.5
    rarity = 1.0 / F.sqrt("support") if "support" in rules.columns else F.lit(1.0)
    weights = {"equal": F.lit(1.0), "size": size, "size2": size * size, "rarity": rarity, "edge": edge, "size_edge": size * edge}
    side = F.when(F.col("direction") == 1, 1).otherwise(-1)
    hit = matches(events, rules, by)
    out = hit.groupBy(*by, "ts").agg(*[F.sum(weights[s] * side).alias(s) for s in schemes])
    stacked = out.select(*by, "ts", F.explode(F.array(*[F.struct(F.lit(s).alias("scheme"), F.col(s).alias("score")) for s in schemes])).alias("r")).select("r.scheme", *by, "ts", "r.score")
    return stacked.withColumn("pred", (F.round("score", 12) > 0).cast("int"))


def argmax_specific(events: DataFrame, rules: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Only the rule with most states counts, then confidence, then the event's name."""
    best = F.max_by(F.struct("direction", "confidence"), F.struct(n_atoms(), "confidence", "event"))
    out = matches(events, rules.select(*by, "event", "direction", "confidence"), by).groupBy(*by, "ts").agg(best.alias("b"))
    return out.select(*by, "ts", F.col("b.direction").alias("pred"), F.when(F.col("b.direction") == 1, F.col("b.confidence")).otherwise(-F.col("b.confidence")).alias("score"))


def mechanism_gate(events: DataFrame, rules: DataFrame, marker: str = "streak", by: Sequence[str] = BY) -> DataFrame:
    """If a rule with the marker fires only such rules vote."""
    vote = F.col("confidence") * F.when(F.col("direction") == 1, 1).otherwise(-1)
    out = matches(events, rules.select(*by, "event", "direction", "confidence"), by).groupBy(*by, "ts").agg(F.sum(F.when(F.col("event").contains(marker), vote)).alias("_m"), F.sum(vote).alias("_a"))
    return out.select(*by, "ts", (F.round(F.coalesce("_m", "_a"), 12) > 0).cast("int").alias("pred"), F.col("_m").isNotNull().alias("gated"))


def evaluate(preds: DataFrame, truth: DataFrame, by: Sequence[str] = BY, momentum: str = "return_6h") -> DataFrame:
    """Coverage, hit rate, the momentum baseline's, lifts and the mean signed edge. Bars without an outcome don't count.

    ``truth``: (by, ts, fwd, momentum column).
    """
    rows = truth.where("fwd is not null").join(preds.select(*by, "ts", "pred"), [*by, "ts"], "left")
    up, m = (F.col("fwd") > 0).cast("int"), (F.col(momentum) > 0).cast("int")
    covered = F.col("pred").isNotNull()
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count("pred").alias("n_pred"), F.avg(covered.cast("double")).alias("coverage"), F.avg(F.when(covered, (F.col("pred") == up).cast("double"))).alias("model_hit"),
        F.avg(F.when(covered & F.col(momentum).isNotNull(), (m == up).cast("double"))).alias("momentum_hit"), F.avg(F.when(covered, F.when(F.col("pred") == 1, F.col("fwd")).otherwise(-F.col("fwd")))).alias("mean_signed_edge"),
    )
    return out.withColumns({"lift_vs_random": F.col("model_hit") - 0.5, "lift_vs_momentum": F.col("model_hit") - F.col("momentum_hit")})


def score_predictions(preds: DataFrame, truth: DataFrame, thr: float = 0.0, by: Sequence[str] = BY) -> DataFrame:
    """Only moves over the threshold are scored."""
    rows = preds.join(truth.select(*by, "ts", "fwd"), [*by, "ts"]).where((F.abs("fwd") > thr) if thr > 0 else F.col("fwd").isNotNull())
    hit = (F.col("pred") == (F.col("fwd") > 0).cast("int")).cast("int")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(hit).alias("hits"), F.avg(hit).alias("hit_rate"))


def oos_rule_hits(events: DataFrame, rules: DataFrame, truth: DataFrame, min_support: int = 5, by: Sequence[str] = BY) -> DataFrame:
    """Each rule's hit rate on later bars, where it fired often enough."""
    rows = matches(events, rules.select(*by, "event", "direction"), by).join(truth.select(*by, "ts", "fwd").where("fwd is not null"), [*by, "ts"])
    hit = (F.col("direction") == (F.col("fwd") > 0).cast("int")).cast("int")
    return rows.groupBy(*by, "event").agg(F.count("*").alias("n"), F.avg(hit).alias("oos_hit")).where(F.col("n") >= min_support)


def stability_table(rules: DataFrame, hits: DataFrame, n_folds: int, by: Sequence[str] = BY) -> DataFrame:
    """Per event over folds: presence, modal direction, consistency, mean out-of-sample hit and confidence, stability."""
    rows = rules.select(*by, "fold", "event", "direction", "confidence").join(hits.select(*by, "fold", "event", "oos_hit"), [*by, "fold", "event"], "left")
    out = rows.groupBy(*by, "event").agg(F.count("*").alias("folds_present"), F.avg("direction").alias("_d"), F.avg("oos_hit").alias("avg_oos_hit"), F.avg("confidence").alias("avg_confidence"))
    out = out.withColumns({"coverage_frac": F.col("folds_present") / n_folds, "direction": F.bround("_d").cast("int"), "consistency": F.greatest(F.col("_d"), 1 - F.col("_d"))})
    return out.withColumn("stability", F.col("coverage_frac") * F.col("consistency")).select(*by, "event", "folds_present", "coverage_frac", "direction", "consistency", "avg_oos_hit", "avg_confidence", "stability")


def select_stable(stability: DataFrame, folds: int = 3, consistency: float = 0.75, min_hit: float = 0.5) -> DataFrame:
    return stability.where((F.col("folds_present") >= folds) & (F.col("consistency") >= consistency) & (F.col("avg_oos_hit") > min_hit))


def update_memory(positive: DataFrame, negative: DataFrame, stability: DataFrame, min_failures: int = 2, folds: int = 3, consistency: float = 0.75, by: Sequence[str] = ("asset",)) -> tuple[DataFrame, DataFrame]:
    """The new positive rules, and the negative patterns with their failure counts.

    Stable events of this run replace the positive ones; events that were seen and aren't stable fail once more and are
    blacklisted after ``min_failures``; what wasn't seen keeps its count.
    """
    stable = select_stable(stability, folds, consistency)
    keep = stable.select(*by, "event", "direction", "consistency", "avg_oos_hit", "avg_confidence", "folds_present", "stability")
    old = positive.select(*keep.columns).join(stability.select(*by, "event"), [*by, "event"], "left_anti")
    failed = stability.join(stable.select(*by, "event"), [*by, "event"], "left_anti").select(*by, "event", F.lit(1).alias("_f"))
    seen = negative.select(*by, "event", F.col("failures").alias("_old")).join(failed, [*by, "event"], "full")
    counts = seen.withColumn("failures", F.coalesce("_old", F.lit(0)) + F.coalesce("_f", F.lit(0))).select(*by, "event", "failures")
    return keep.unionByName(old), counts.withColumn("blacklisted", F.col("failures") >= min_failures)


def evaluate_by_regime(preds: DataFrame, truth: DataFrame, regimes: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Hit rate and lift per regime, and over all (regime ALL)."""
    rows = preds.join(truth.select(*by, "ts", "fwd").where("fwd is not null"), [*by, "ts"]).join(regimes.select(*by, "ts", "regime"), [*by, "ts"])
    hit = (F.col("pred") == (F.col("fwd") > 0).cast("int")).cast("int")
    out = rows.withColumn("hit", hit).groupingSets([[*map(F.col, by), F.col("regime")], [*map(F.col, by)]], *by, "regime").agg(F.count("*").alias("n"), F.avg("hit").alias("hit_rate"))
    return out.withColumn("regime", F.coalesce("regime", F.lit("ALL"))).withColumn("lift", F.col("hit_rate") - 0.5)


def regime_scale(samples: DataFrame, cap: float = 2.0, by: Sequence[str] = BY) -> DataFrame:
    """Per regime the share of the overall lift, in [0, cap], from samples (regime, hit); 1 without an overall lift."""
    per = samples.groupBy(*by, "regime").agg(F.avg("hit").alias("h"), F.count("*").alias("n"))
    total = samples.groupBy(*by).agg(F.avg("hit").alias("a"))
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(cap), (F.col("h") - 0.5) / (F.col("a") - 0.5)))
    return per.join(total, list(by)).select(*by, "regime", "n", F.when(F.col("a") > 0.5, ratio).otherwise(1.0).alias("scale"))


def apply_scale(preds: DataFrame, scales: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Probabilities moved from 1/2 by their regime's scale."""
    joined = preds.join(scales.select(*by, "regime", "scale"), [*by, "regime"], "left")
    return joined.withColumn("adjusted_prob", F.greatest(F.lit(0.5), F.least(F.lit(1.0), 0.5 + (F.col("raw_prob") - 0.5) * F.coalesce("scale", F.lit(1.0)))))

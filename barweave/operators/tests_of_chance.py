"""Permutation nulls from counts, multiple tests, deflated Sharpe ratios, redundancy of features."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from barweave.functions.discretize import quantile_bins
from barweave.functions.windows import BY
from barweave.sources.stored import stored


def permutation_counts(preds: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Of (pred, up) the four margins that a shuffle of outcomes depends on: n, n_up, n_pred_up, hits."""
    return preds.where("pred is not null and up is not null").groupBy(*by).agg(F.count("*").alias("n"), F.sum("up").alias("n_up"), F.sum("pred").alias("n_pred_up"), F.sum((F.col("pred") == F.col("up")).cast("int")).alias("hits"))


def _seeded(keys: Sequence, seed: int) -> np.random.Generator:
    return np.random.default_rng([seed, *[abs(hash_text(str(k))) % (1 << 31) for k in keys]])


def hash_text(x: str) -> int:
    """A hash that is the same in every process."""
    out = 1469598103934665603
    for b in x.encode():
        out = ((out ^ b) * 1099511628211) % (1 << 64)
    return out


def _draw(counts: DataFrame, by: Sequence[str], draws, schema: str, seed: int) -> DataFrame:
    kinds = dict(counts.dtypes)

    def run(batches):
        for rows in batches:
            yield pd.DataFrame([{**{b: r[b] for b in by}, **draws(r, _seeded([r[b] for b in by], seed))} for r in rows.to_dict("records")], columns=[*by, *[x.split()[0] for x in schema.split(", ")]])

    return counts.mapInPandas(run, ", ".join(f"{b} {kinds[b]}" for b in by) + ", " + schema)


def permutation_p(counts: DataFrame, n_draws: int = 300, seed: int = 0, by: Sequence[str] = BY) -> DataFrame:
    """hit, null_mean, null_std, p_value of shuffled outcomes under fixed predictions.

    The number of rises among the predicted rises is hypergeometric, so shuffles are drawn from the counts; rows are
    never shuffled. p = (1 + draws that do as well) / (1 + draws).
    """

    def draws(r, rng):
        n, up, pred = int(r["n"]), int(r["n_up"]), int(r["n_pred_up"])
        both = rng.hypergeometric(up, n - up, pred, n_draws) if n else np.zeros(n_draws)
        hits = (n - up - pred + 2 * both) / max(1, n)
        hit = r["hits"] / max(1, n)
        return {"hit": hit, "null_mean": hits.mean(), "null_std": hits.std(), "p_value": (1 + (hits >= hit - 1e-12).sum()) / (1 + n_draws)}

    return _draw(counts, by, draws, "hit double, null_mean double, null_std double, p_value double", seed)


def exact_null(counts: DataFrame) -> DataFrame:
    """The same null's mean and deviation in closed form."""
    n, up, pred = F.col("n").cast("double"), F.col("n_up"), F.col("n_pred_up")
    mean = (n - up - pred + 2 * up * pred / n) / n
    var = F.when(n > 1, 4 * pred * (up / n) * (1 - up / n) * (n - pred) / (n - 1)).otherwise(0.0)
    return counts.withColumns({"hit": F.col("hits") / n, "null_mean": mean, "null_std": F.sqrt(var) / n})


def sampling_null(counts: DataFrame, n_draws: int = 2000, seed: int = 0, by: Sequence[str] = BY) -> DataFrame:
    """p of a cell's hits (n, hits) among all rows (total, total_hits), drawn without replacement; two-sided."""

    def draws(r, rng):
        n, total, good = int(r["n"]), int(r["total"]), int(r["total_hits"])
        got = rng.hypergeometric(good, total - good, n, n_draws)
        base = n * good / max(1, total)
        return {"rate": r["hits"] / max(1, n), "p_value": (1 + (np.abs(got - base) >= abs(r["hits"] - base) - 1e-9).sum()) / (1 + n_draws)}

    return _draw(counts, by, draws, "rate double, p_value double", seed)


def coin_null(counts: DataFrame, n_draws: int = 2000, seed: int = 0, base: float = 0.5, by: Sequence[str] = BY) -> DataFrame:
    """p of (n, hits) against coin tosses."""

    def draws(r, rng):
        got = rng.binomial(int(r["n"]), base, n_draws)
        return {"rate": r["hits"] / max(1, r["n"]), "p_value": (1 + (got >= r["hits"]).sum()) / (1 + n_draws)}

    return _draw(counts, by, draws, "rate double, p_value double", seed)


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: np.ndarray) -> np.ndarray:
    """Draws without replacement; over 10^9 rows by the normal law of the same mean and variance."""
    total = good + bad
    if total < 1_000_000_000:
        return rng.hypergeometric(good, bad, n)
    share = good / total
    spread = np.sqrt(np.maximum(0.0, n * share * (1 - share) * (total - n) / (total - 1)))
    return np.clip(np.rint(rng.normal(n * share, spread)), np.maximum(0, n - bad), np.minimum(good, n)).astype(np.int64)


def _dealt(rng: np.random.Generator, counts: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """How many of ``ones`` (one number per draw) fall to each of the counts: a row per count, by one conditional draw each."""
    out, rest, left = np.empty((len(counts), len(ones)), dtype=np.int64), int(counts.sum()), ones.astype(np.int64)
    for i, c in enumerate(counts.tolist()):
        rest -= c
        out[i] = _hypergeometric(rng, c, rest, left)
        left = left - out[i]
    return out


def permute_means(df: DataFrame, label: str, value: str, strata: Sequence[str] = (), n: int = 200, seed: int = 0, by: Sequence[str] = (), block: int = 20_000) -> DataFrame:
    """Observed gap of means by a 0/1 label, its mean under labels shuffled inside strata, and its p (at least as large).

    Rows are counted by value and never shuffled: how often a value gets label 1 in a shuffle is a multivariate
    hypergeometric draw. A stratum's values are dealt into blocks of about ``block`` by hash; the ones are dealt to the
    blocks first and then, block by block in as many tasks, to the values. What comes back is ``n`` sums for a block,
    so the shuffle doesn't grow with the draws but for these. Nulls in label or value count for nothing; without rows of
    both labels all is null.
    """
    groups = [*by, *strata]
    rows = df.where(F.col(label).isNotNull() & F.col(value).isNotNull()).select(*groups, F.col(label).cast("int").alias("_l"), F.col(value).cast("double").alias("_v"))
    rows = rows.withColumn("_by", F.struct(*by, F.lit(0).alias("_0"))).withColumn("_in", F.struct(*groups, F.lit(0).alias("_0")))
    counts = rows.groupBy("_by", "_in", "_v").agg(F.count("*").alias("c"), F.sum("_l").cast("long").alias("k"))
    strata_sizes = counts.groupBy("_in").agg(F.count("*").alias("_d"), F.sum("k").alias("_k"))
    dealt = counts.join(strata_sizes, "_in").withColumn("_block", F.pmod(F.xxhash64("_v"), F.ceil(F.col("_d") / block)))
    kinds = {c: dealt.schema[c].dataType.simpleString() for c in ("_by", "_in")}
    blocks = dealt.groupBy("_by", "_in", "_block", "_k").agg(F.sum("c").alias("c"))

    def to_blocks(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_block")
        rng = _seeded([str(sorted(group["_in"].iloc[0].items()))], seed)
        got = _dealt(rng, group["c"].to_numpy(), np.full(n, int(group["_k"].iloc[0])))
        return pd.DataFrame({"_in": group["_in"], "_block": group["_block"], "_ones": list(got)})

    shares = blocks.groupBy("_in").applyInPandas(to_blocks, f"_in {kinds['_in']}, _block long, _ones array<long>")

    def to_values(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_v")
        first = group.iloc[0]
        rng = _seeded([str(sorted(first["_in"].items())), first["_block"]], seed + 1)
        ones, counts, values = np.asarray(first["_ones"]), group["c"].to_numpy(), group["_v"].to_numpy()
        sums = np.concatenate([values @ _dealt(rng, counts, part) for part in np.array_split(ones, max(1, len(values) * n // 2_000_000))])
        return pd.DataFrame({"_by": [first["_by"]] * n, "rep": np.arange(1, n + 1), "s": sums})

    sums = dealt.join(shares, ["_in", "_block"]).groupBy("_in", "_block").applyInPandas(to_values, f"_by {kinds['_by']}, rep int, s double").groupBy("_by", "rep").agg(F.sum("s").alias("s"))
    total = counts.groupBy("_by").agg(F.sum("c").alias("n"), F.sum("k").alias("k"), F.sum(F.col("_v") * F.col("c")).alias("t"), F.sum(F.col("_v") * F.col("k")).alias("s1"))
    gap = lambda s: F.when((F.col("k") > 0) & (F.col("k") < F.col("n")), s / F.col("k") - (F.col("t") - s) / (F.col("n") - F.col("k")))
    joined = sums.join(total.withColumn("observed", gap(F.col("s1"))), "_by").withColumn("g", gap(F.col("s")))
    out = joined.groupBy("_by", "observed").agg(F.avg("g").alias("null_mean"), F.stddev_pop("g").alias("null_std"), ((1 + F.sum((F.col("g") >= F.col("observed") - 1e-12).cast("int"))) / (1 + F.count("*"))).alias("p_value"))
    return out.select(*[F.col("_by")[b].alias(b) for b in by], "observed", "null_mean", "null_std", F.when(F.col("observed").isNotNull(), F.col("p_value")).alias("p_value"))


def adjust_p(df: DataFrame, p: str = "p_value", family: Sequence[str] = ()) -> DataFrame:
    """Adds p_bonferroni and Holm's p_holm within a family; ties share the order of the columns' text."""
    whole = Window.partitionBy(*family)
    order = whole.orderBy(p, F.xxhash64(*[F.col(c) for c in df.columns]))
    m, i = F.count(p).over(whole), F.row_number().over(order)
    out = df.withColumn("p_bonferroni", F.least(F.lit(1.0), F.col(p) * m)).withColumn("_step", F.least(F.lit(1.0), F.col(p) * (m - i + 1)))
    return out.withColumn("p_holm", F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def moments(returns: DataFrame, ret: str = "net_ret", by: Sequence[str] = BY) -> DataFrame:
    """n, mean, sample deviation, skewness and excess kurtosis with the sample deviation inside."""
    base = returns.where(F.col(ret).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(ret).alias("mean"), F.stddev_samp(ret).alias("std"), *[F.avg(F.pow(ret, k)).alias(f"m{k}") for k in (2, 3, 4)])
    m = F.col("mean")
    third = F.col("m3") - 3 * m * F.col("m2") + 2 * F.pow(m, 3)
    fourth = F.col("m4") - 4 * m * F.col("m3") + 6 * m * m * F.col("m2") - 3 * F.pow(m, 4)
    s = F.nullif("std", F.lit(0.0))
    return base.select(*by, "n", "mean", "std", (third / F.pow(s, 3)).alias("skew"), (fourth / F.pow(s, 4) - 3).alias("kurt_excess"))


def expected_max_sharpe(n_trials: int, sr_std: float) -> float:
    """The expected best Sharpe ratio of ``n_trials`` without skill."""
    if n_trials < 2:
        return 0.0
    z = NormalDist().inv_cdf
    g = 0.5772156649015329
    return sr_std * ((1 - g) * z(1 - 1 / n_trials) + g * z(1 - 1 / (n_trials * math.e)))


def normal_cdf(x: Column) -> Column:
    """The normal distribution function, by the error function's series of Abramowitz and Stegun 7.1.26."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-z * z)
    return F.when(x >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def deflated_sharpe(returns: DataFrame, n_trials: int, sr_std: float = 1.0, annualised: float | None = None, ret: str = "net_ret", by: Sequence[str] = BY) -> DataFrame:
    """sr_hat, sr0, dsr and p per series. ``annualised`` (bars per year) feeds yearly Sharpe ratios, which misstates the error term."""
    out = moments(returns, ret, by)
    sr = F.col("mean") / F.nullif("std", F.lit(0.0))
    if annualised:
        sr = sr * math.sqrt(annualised)
    per = out.withColumn("sr_hat", sr)
    error = F.sqrt(F.greatest(F.lit(1e-12), 1 - F.col("skew") * F.col("sr_hat") + F.col("kurt_excess") / 4 * F.pow("sr_hat", 2)) / (F.col("n") - 1))
    per = per.withColumn("sr0", F.lit(expected_max_sharpe(n_trials, sr_std)) * (1.0 if annualised else F.sqrt(1.0 / F.col("n"))))
    return per.withColumn("dsr", (F.col("sr_hat") - F.col("sr0")) / error).withColumn("p", 1 - normal_cdf(F.col("dsr")))


def fold_instability(returns: DataFrame, n: int = 8, ret: str = "net_ret", by: Sequence[str] = BY) -> DataFrame:
    """Per equal chronological fold its mean and share of gains, and whether that share is over 2 points under the whole's."""
    rows = returns.where(F.col(ret).isNotNull()).withColumn("fold", F.ntile(n).over(Window.partitionBy(*by).orderBy("ts")))
    gain = F.avg((F.col(ret) > 0).cast("int"))
    out = rows.groupBy(*by, "fold").agg(F.count("*").alias("n"), F.avg(ret).alias("mean"), gain.alias("positive_rate"))
    whole = rows.groupBy(*by).agg(gain.alias("_m"))
    return out.join(whole, list(by)).withColumns({"under": F.col("positive_rate") < F.col("_m") - 0.02, "non_positive": F.col("mean") <= 0}).drop("_m")


def correlation_matrix(df: DataFrame, cols: Sequence[str], method: str = "pearson", by: Sequence[str] = ()) -> DataFrame:
    """a, b, corr for every pair; Spearman by ranks with ties averaged, values equal at
    10 decimals being ties. ``by`` should hold a series for Spearman.
    """
    rows = df.dropna(subset=list(cols))
    if method == "spearman":
        for c in cols:
            w = Window.partitionBy(*by)
            value = F.round(c, 10)
            rank = F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2
            rows = rows.withColumn(f"_r_{c}", rank)
        rows = rows.select(*by, *[F.col(f"_r_{c}").alias(c) for c in cols])
    pairs = [(a, b) for a in cols for b in cols]
    wide = rows.groupBy(*by).agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return wide.select(*by, F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])).alias("r")).select(*by, "r.*")


def explained_variance(df: DataFrame, cols: Sequence[str], share: float = 0.95, by: Sequence[str] = BY) -> DataFrame:
    """Shares of the correlation matrix's eigenvalues, largest first, and how many reach ``share``."""
    matrix = correlation_matrix(df, cols, by=by).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("a", "b", "corr"))).alias("m"))
    kinds = dict(matrix.dtypes)

    def run(batches):
        for rows in batches:
            out = []
            for r in rows.to_dict("records"):
                values = np.array([x["corr"] if x["corr"] is not None else 0.0 for x in r["m"]]).reshape(len(cols), len(cols))
                ratio = np.clip(np.linalg.eigvalsh(values)[::-1], 0, None)
                ratio = ratio / max(ratio.sum(), 1e-300)
                total = np.cumsum(ratio)
                need = int(np.searchsorted(total, share - 1e-12)) + 1
                out += [{**{b: r[b] for b in by}, "pc": i + 1, "ratio": ratio[i], "cumulative": total[i], "needed": need} for i in range(len(ratio))]
            yield pd.DataFrame(out, columns=[*by, "pc", "ratio", "cumulative", "needed"])

    return matrix.mapInPandas(run, ", ".join(f"{b} {kinds[b]}" for b in by) + ", pc int, ratio double, cumulative double, needed int")


def mutual_information(df: DataFrame, cols: Sequence[str], target: str = "up", bins: int = 20, by: Sequence[str] = BY) -> DataFrame:
    """Mutual information, in nats, of each column's quantile bin with the target."""
    rows = df.dropna(subset=[*cols, target])
    for c in cols:
        rows = quantile_bins(rows, c, bins, by, f"_b_{c}")
    long = rows.select(*by, F.col(target).alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"_b_{c}").alias("bin")) for c in cols])).alias("r")).select(*by, "y", "r.*")
    cells = long.groupBy(*by, "col", "bin", "y").agg(F.count("*").cast("double").alias("c"))
    return _mi(cells, [*by, "col"], "bin")


def _mi(cells: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    sums = cells.withColumns({"n": F.sum("c").over(Window.partitionBy(*keys)), "cx": F.sum("c").over(Window.partitionBy(*keys, x)), "cy": F.sum("c").over(Window.partitionBy(*keys, "y"))})
    return sums.groupBy(*keys).agg(F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy")))).alias("mi"))


def greedy_subset(df: DataFrame, cols: Sequence[str], target: str = "up", bins: int = 4, most: int = 4, by: Sequence[str] = BY) -> DataFrame:
    """(by, step, col, gain): per series the columns that add most joint information on the target, one at a time.

    A step is one job over all series and candidates: the joint cells of what a series has chosen and each candidate are
    counted with the series and the candidate as keys. Of candidates equal at 10 decimals the first of ``cols`` is taken.
    Rows with a null in any column or the target count for nothing.
    """
    rows = df.dropna(subset=[*cols, target])
    for c in cols:
        rows = quantile_bins(rows, c, bins, by, f"_b_{c}")
    rows = stored(rows.select(F.struct(*by).alias("_key"), F.col(target).alias("y"), F.array(*[F.col(f"_b_{c}") for c in cols]).alias("bins")), "bins")
    order = F.array(*[F.lit(c) for c in cols])
    chosen = stored(rows.select("_key").distinct().select("_key", F.array().cast("array<int>").alias("have"), F.lit(0.0).alias("mi")), "chosen")
    out = None
    for step in range(1, min(most, len(cols)) + 1):
        open_ = F.filter(F.array(*[F.lit(i) for i in range(len(cols))]), lambda i: ~F.array_contains("have", i))
        tried = rows.join(chosen.select("_key", "have"), "_key").withColumn("cand", F.explode(open_))
        joint = F.transform(F.concat("have", F.array("cand")), lambda i: F.element_at("bins", i + 1))
        cells = tried.groupBy("_key", "cand", joint.alias("x"), "y").agg(F.count("*").cast("double").alias("c"))
        scored = _mi(cells, ["_key", "cand"], "x")
        best = scored.groupBy("_key").agg(F.max_by(F.struct("cand", "mi"), F.struct(F.round("mi", 10), -F.col("cand"))).alias("b"))
        new = best.join(chosen.withColumnRenamed("mi", "before"), "_key").select("_key", F.concat("have", F.array("b.cand")).alias("have"), F.col("b.mi").alias("mi"), (F.col("b.mi") - F.col("before")).alias("gain"))
        chosen = stored(new, "chosen")
        row = chosen.select(*[F.col("_key")[b].alias(b) for b in by], F.lit(step).alias("step"), F.element_at(order, F.element_at("have", -1) + 1).alias("col"), "gain")
        out = row if out is None else out.unionByName(row)
    return out


def hit_se(hit: Column, n: Column) -> Column:
    return F.sqrt(hit * (1 - hit) / n)


def overfit_gap(holdout_hit: Column, sealed_hit: Column) -> Column:
    """In percentage points."""
    return 100 * (holdout_hit - sealed_hit)

"""States, regimes and splits, with thresholds from earlier rows only."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barweave.functions.slices import numbered
from barweave.functions.windows import BY, over, percentiles, trailing

# Cuts that are not fitted.
FIXED_CUTS = {"streak_signed": (-2.0, 2.0), "streak_big": (-2.0, 2.0), **{k: (0.5, 0.5) for k in ("doji", "bullish_engulfing", "bearish_engulfing", "breakout_up", "breakout_down", "bull_flag", "bear_flag", "double_top", "double_bottom", "trend_hh_hl", "trend_lh_ll")}}


def exact_quantiles(df: DataFrame, names: Sequence[str], q: Sequence[float], by: Sequence[str] = BY, accuracy: int = 10_000) -> DataFrame:
    """(by, a column per name): linear-interpolated quantiles, as ``percentile`` gives them, without a group's values in one buffer.

    A mergeable sketch gives each quantile an interval that holds its ranks for sure (the sketch's error and some ranks
    more on both sides; all values of a group of ``accuracy`` rows or fewer). Rows under the interval are counted, values
    inside it, 8 of ``accuracy``, are counted by value, and the ranks are looked up in their running sum. Nulls count for nothing; a column without values has null.
    """
    key = F.struct(*by).alias("_key") if by else F.struct(F.lit(0).alias("_all")).alias("_key")
    rows = df.select(key, *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(names)])
    wide = 4.0 / accuracy
    sides = [min(1.0, max(0.0, x + d)) for x in q for d in (-wide, wide)]
    cols = [f"_c{i}" for i in range(len(names))]
    sketch = rows.groupBy("_key").agg(*[F.count(c).alias(f"_n{c}") for c in cols], *[F.percentile_approx(c, sides, accuracy).alias(f"_s{c}") for c in cols])
    near = rows.join(sketch, "_key")
    side = lambda c, at, all_: F.when(F.col(f"_n{c}") <= accuracy, F.lit(all_)).otherwise(F.col(f"_s{c}")[at])
    spots = [(i, k, F.col(c), side(c, 2 * k, float("-inf")), side(c, 2 * k + 1, float("inf"))) for i, c in enumerate(cols) for k in range(len(q))]
    under = near.groupBy("_key").agg(*[F.sum((x < lo).cast("long")).alias(f"_u{i}_{k}") for i, k, x, lo, _ in spots])
    spot = lambda i, k, *more: F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), *more)
    inside = F.array_compact(F.array(*[F.when((x >= lo) & (x <= hi), spot(i, k, x.alias("v"))) for i, k, x, lo, hi in spots]))
    found = near.select("_key", F.explode(inside).alias("s")).groupBy("_key", "s.i", "s.k", "s.v").agg(F.count("*").alias("c"))
    heads = sketch.join(under, "_key").select("_key", F.explode(F.array(*[spot(i, k, F.col(f"_n_c{i}").alias("n"), F.col(f"_u{i}_{k}").alias("u")) for i, k, *_ in spots])).alias("h")).select("_key", "h.*")
    found = found.withColumn("upto", F.sum("c").over(Window.partitionBy("_key", "i", "k").orderBy("v"))).join(heads, ["_key", "i", "k"])
    at = F.element_at(F.array(*[F.lit(float(x)) for x in q]), F.col("k") + 1) * (F.col("n") - 1)
    reach = F.col("upto") + F.col("u")
    ranks = found.groupBy("_key", "i", "k").agg(F.max("n").alias("n"), F.max("u").alias("u"), F.max(reach).alias("most"), F.min(F.when(reach > F.floor(at), F.col("v"))).alias("lo"), F.min(F.when(reach > F.ceil(at), F.col("v"))).alias("hi"))
    sure = (F.col("u") <= F.floor(at)) & (F.col("most") > F.ceil(at))
    value = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise((F.ceil(at) - at) * F.col("lo") + (at - F.floor(at)) * F.col("hi"))
    cuts = ranks.select("_key", "i", "k", F.when(sure, value).otherwise(F.raise_error(F.lit("a quantile lies outside its interval"))).alias("x"))
    at_spot = lambda i, k: F.max(F.when((F.col("i") == i) & (F.col("k") == k), F.col("x")))
    filled = cuts.groupBy("_key").agg(*[F.array(*[at_spot(i, k) for k in range(len(q))]).alias(f"_x{i}") for i in range(len(names))])
    out = sketch.select("_key", *[f"_n{c}" for c in cols]).join(filled, "_key", "left")
    return out.select(*[F.col("_key")[b].alias(b) for b in by], *[F.when(F.col(f"_n_c{i}") > 0, F.col(f"_x{i}")).alias(c) for i, c in enumerate(names)])


def fit_thresholds(df: DataFrame, names: Sequence[str], by: Sequence[str] = BY, q: Sequence[float] = (1 / 3, 2 / 3), fixed: dict[str, tuple[float, float]] | None = None, exact: bool = True, large: bool = False) -> DataFrame:
    """(by, atom, lo, hi): quantiles per group, fixed cuts where there are some. One row per group and feature.

    ``large``: exact too, but no task holds a group's values (``exact_quantiles``), for groups of many millions.
    """
    fixed = FIXED_CUTS if fixed is None else fixed
    if large and exact:
        fitted = [n for n in names if n not in fixed]
        wide = exact_quantiles(df, fitted, q, by)
        rows = F.explode(F.array(*[F.struct(F.lit(n).alias("atom"), (F.array(*[F.lit(x) for x in fixed[n]]) if n in fixed else F.col(n)).alias("cuts")) for n in names]))
        return wide.select(*by, rows.alias("r")).select(*by, "r.atom", F.col("r.cuts")[0].alias("lo"), F.col("r.cuts")[1].alias("hi"))
    cuts = [F.array(F.lit(fixed[n][0]), F.lit(fixed[n][1])).alias(n) if n in fixed else percentiles(n, q, exact).alias(n) for n in names]
    wide = df.groupBy(*by).agg(F.count("*").alias("_n"), *[c for c, n in zip(cuts, names, strict=True) if n not in fixed])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("atom"), (c if n in fixed else F.col(n)).alias("cuts")) for n, c in zip(names, cuts, strict=True)]))
    return wide.select(*by, rows.alias("r")).select(*by, "r.atom", F.col("r.cuts")[0].alias("lo"), F.col("r.cuts")[1].alias("hi"))


def state(value: Column, lo: Column, hi: Column) -> Column:
    """LOW at or under lo, else HIGH at or over hi, else MID; compared at 10 decimals, so that rounding noise in a mean
    or quantile flips no state."""
    value, lo, hi = F.round(value, 10), F.round(lo, 10), F.round(hi, 10)
    return F.when(value <= lo, "LOW").when(value >= hi, "HIGH").when(value.isNotNull(), "MID")


def discretize(df: DataFrame, thresholds: DataFrame, names: Sequence[str], by: Sequence[str] = BY) -> DataFrame:
    """Features to states; thresholds are one row per group and feature, and are joined as one map per group."""
    maps = thresholds.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("atom", F.struct("lo", "hi")))).alias("_cuts"))
    joined = df.join(maps, list(by))
    return joined.withColumns({n: state(F.col(n), F.col("_cuts")[n]["lo"], F.col("_cuts")[n]["hi"]) for n in names}).drop("_cuts")


def combos(names: Sequence[str], sizes: Sequence[int] = (2, 3)) -> list[tuple[str, ...]]:
    return [c for size in sizes for c in combinations(names, size)]


def event_key(combo: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.concat(F.lit(f"{c}="), F.col(c)) for c in combo])


def build_events(states: DataFrame, names: Sequence[str], sizes: Sequence[int] = (2, 3), keep: Sequence[str] = ("asset", "res", "ts"), allowed: DataFrame | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """A row per bar and conjunction of states; ``allowed`` and ``blocked`` are tables with an ``event`` column.

    For mining use ``mine_rules``, which aggregates without these rows.
    """
    out = states.select(*keep, F.explode(F.array(*[event_key(c) for c in combos(names, sizes)])).alias("event"))
    if blocked is not None:
        out = out.join(blocked.select("event").distinct(), "event", "left_anti")
    if allowed is not None:
        out = out.join(allowed.select("event").distinct(), "event", "left_semi")
    return out.select(*keep, "event")


def frequent_events(events: DataFrame, min_count: int = 25, by: Sequence[str] = BY) -> DataFrame:
    return events.groupBy(*by, "event").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def significant_changes(pool: DataFrame, sigma: float = 2.5, z: float = 2.0) -> DataFrame:
    r, limit = F.col("return_1h"), sigma * F.col("volatility")
    no = F.lit(False)
    up, down = F.coalesce(r > limit, no), F.coalesce(r < -limit, no)
    spike = F.coalesce(F.abs("volume_zscore") > z, no)
    kind = F.when(up & spike, "COMBINED_UP").when(down & spike, "COMBINED_DOWN").when(up, "PRICE_UP").when(down, "PRICE_DOWN").when(spike, "VOLUME_SPIKE").otherwise("")
    return pool.withColumns({"price_shock": up | down, "volume_shock": spike, "combined": (up | down) & spike, "change_type": kind})


def summarize_changes(changes: DataFrame, recent: int = 5, by: Sequence[str] = BY) -> tuple[DataFrame, DataFrame]:
    """Per kind its count and mean forward return; and each series' last ``recent`` changes."""
    hit = changes.where("change_type <> ''")
    counts = hit.groupBy(*by, "change_type").agg(F.count("*").alias("n"), F.avg("fwd").alias("mean_fwd"))
    last = hit.withColumn("rank", F.row_number().over(over(by, F.desc("ts")))).where(F.col("rank") <= recent)
    return counts, last


def shock_regime(changes: DataFrame, bars: int = 4, by: Sequence[str] = BY) -> DataFrame:
    any_shock = (F.col("price_shock") | F.col("volume_shock")).cast("int")
    before = F.max(any_shock).over(trailing(bars, by, end=-1))
    return changes.withColumn("regime", F.when(any_shock == 1, "SHOCK_ACTIVE").when(before == 1, "POST_SHOCK").otherwise("NORMAL"))


def chrono_split(df: DataFrame, frac: float = 0.3, by: Sequence[str] = BY, name: str = "part", rows: int | None = None) -> DataFrame:
    """dev for each series' first floor(n * (1 - frac)) rows, hold for the rest; ``rows`` numbers a series in slices of about so many."""
    if rows is not None:
        at = numbered(df, rows, by)
        return at.withColumn(name, F.when(F.col("_at") < F.floor(F.col("_n") * (1 - frac) + 1e-9), "dev").otherwise("hold")).select(*df.columns, name)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return df.withColumn("_rn", F.row_number().over(over(by))).withColumn(name, F.when(F.col("_rn") <= F.floor(n * (1 - frac) + 1e-9), "dev").otherwise("hold")).drop("_rn")


def three_way(df: DataFrame, first: float = 0.55, second: float = 0.80, by: Sequence[str] = BY, name: str = "part", rows: int | None = None) -> DataFrame:
    if rows is not None:
        at = numbered(df, rows, by)
        share = lambda x: F.col("_at") < F.floor(F.col("_n") * x + 1e-9)
        return at.withColumn(name, F.when(share(first), "train").when(share(second), "validate").otherwise("test")).select(*df.columns, name)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    rn = F.row_number().over(over(by))
    return df.withColumn(name, F.when(rn <= F.floor(n * first + 1e-9), "train").when(rn <= F.floor(n * second + 1e-9), "validate").otherwise("test"))


def split_at(df: DataFrame, cut: str | Column, name: str = "part") -> DataFrame:
    cut = F.lit(cut).cast("timestamp") if isinstance(cut, str) else cut
    return df.withColumn(name, F.when(F.col("ts") <= cut, "dev").otherwise("hold"))


def split_by_segment(df: DataFrame, frac: float = 0.3, name: str = "part", by: Sequence[str] = BY) -> DataFrame:
    """Whole segments go to dev or hold, the earlier ones to dev."""
    segments = df.select(*by, "segment").distinct()
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("segment"))
    n = F.count("*").over(Window.partitionBy(*by))
    parts = segments.withColumn(name, F.when(rank <= F.floor(n * (1 - frac) + 1e-9), "dev").otherwise("hold"))
    return df.join(parts, [*by, "segment"])


def assign_folds(df: DataFrame, n_folds: int = 5, initial: float = 0.4, by: Sequence[str] = BY) -> DataFrame:
    """A row per bar and fold it is in: role train or test. The first ``initial`` share trains; the last fold takes the rest."""
    numbered = df.withColumns({"_rn": F.row_number().over(over(by)) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    start = F.floor(F.col("_n") * initial + 1e-9)
    step = F.greatest(F.lit(1), F.floor((F.col("_n") - start) / n_folds))
    fold = F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))
    spread = numbered.withColumns({"_start": start, "_step": step}).withColumn("fold", fold)
    begin = F.col("_start") + F.col("fold") * F.col("_step")
    end = F.when(F.col("fold") == n_folds - 1, F.col("_n")).otherwise(begin + F.col("_step"))
    role = F.when(F.col("_rn") < begin, "train").when(F.col("_rn") < end, "test")
    return spread.withColumn("role", role).where("role is not null").drop("_rn", "_n", "_start", "_step")


def dev_quantiles(df: DataFrame, col: str, q: Sequence[float], frac: float = 0.3, by: Sequence[str] = BY) -> DataFrame:
    """Each series with its dev part's quantiles of ``col`` as an array ``cuts``; needs no ``part`` column."""
    split = chrono_split(df, frac, by)
    cuts = split.where("part = 'dev'").groupBy(*by).agg(F.percentile(col, list(q)).alias("cuts"))
    return split.join(cuts, list(by), "left")


def vr_regime(df: DataFrame, low: float | None = None, high: float | None = None, dev_frac: float = 0.3, by: Sequence[str] = BY, name: str = "vr") -> DataFrame:
    """LOW_VR, HIGH_VR or NORMAL by given cuts or the dev part's thirds; NORMAL where the ratio is unknown."""
    x = F.col("vol_ratio")
    if low is not None and high is not None:
        return df.withColumn(name, F.when(x <= low, "LOW_VR").when(x >= high, "HIGH_VR").otherwise("NORMAL"))
    cut = dev_quantiles(df, "vol_ratio", (1 / 3, 2 / 3), dev_frac, by)
    return cut.withColumn(name, F.when(x <= F.col("cuts")[0], "LOW_VR").when(x >= F.col("cuts")[1], "HIGH_VR").otherwise("NORMAL")).drop("cuts")


def decile_state(df: DataFrame, col: str, dev_frac: float = 0.3, q: tuple[float, float] = (0.1, 0.9), by: Sequence[str] = BY, name: str = "bucket") -> DataFrame:
    cut = dev_quantiles(df, col, q, dev_frac, by)
    x = F.col(col)
    return cut.withColumn(name, F.when(x <= F.col("cuts")[0], "EXTREME_NEG").when(x >= F.col("cuts")[1], "EXTREME_POS").when(x.isNotNull(), "NEUTRAL")).drop("cuts")


def news_states(df: DataFrame, dev_frac: float = 0.3, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """A row per day and state it is in: panic, euphoria, tone shocks, attention spike."""
    split = chrono_split(df, dev_frac, by)
    cuts = split.where("part = 'dev'").groupBy(*by).agg(F.percentile("news_tone", [0.1, 0.9]).alias("t"), F.percentile("news_tone_chg", [0.1, 0.9]).alias("c"))
    x = split.join(cuts, list(by))
    flags = {
        "panic_extreme_neg_tone": F.col("news_tone") <= F.col("t")[0], "euphoria_extreme_pos_tone": F.col("news_tone") >= F.col("t")[1], "tone_shock_down": F.col("news_tone_chg") <= F.col("c")[0],
        "tone_shock_up": F.col("news_tone_chg") >= F.col("c")[1], "attention_spike": F.col("news_vol_z") >= 1.5,
    }
    states = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()]))
    return x.withColumn("state", F.explode(states)).withColumn("is_dev", F.col("part") == "dev").drop("t", "c", "part")


def state_key(df: DataFrame) -> DataFrame:
    """The streak's bucket and, with the volatility regime, a state."""
    s = F.col("streak")
    bucket = F.when(s <= -3, "strong_down").when(s >= 3, "strong_up").otherwise("mild")
    return df.withColumn("streak_bucket", bucket).withColumn("state", F.concat_ws("|", "streak_bucket", "vr"))


def contrarian_signal(df: DataFrame, min_len: int = 2, name: str = "sig") -> DataFrame:
    return df.withColumn(name, F.when(F.abs("streak") >= min_len, -F.signum("streak")).otherwise(0).cast("int"))


def quantile_bins(df: DataFrame, col: str, n: int = 20, by: Sequence[str] = BY, name: str = "bin", large: bool = False) -> DataFrame:
    """The number of distinct inner quantile edges at or under the value; ``large`` as in ``fit_thresholds``."""
    inner = [i / n for i in range(1, n)]
    edges = exact_quantiles(df, [col], inner, by).withColumnRenamed(col, "_edges") if large else df.groupBy(*by).agg(F.percentile(col, inner).alias("_edges"))
    edges = edges.withColumn("_edges", F.array_distinct("_edges"))
    return df.join(edges, list(by)).withColumn(name, F.when(F.col(col).isNotNull(), F.size(F.filter("_edges", lambda e: e <= F.col(col))))).drop("_edges")


def asset_symbol(name: Column | str) -> tuple[Column, Column]:
    """"btc_1h" to its symbol and interval; without an interval suffix the interval is null."""
    name = F.col(name) if isinstance(name, str) else name
    interval = F.regexp_extract(name, r"_(\d+[smhdw])$", 1)
    return F.regexp_replace(name, r"_\d+[smhdw]$", ""), F.when(interval != "", interval)

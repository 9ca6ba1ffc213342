"""Gradient boosting on histograms, for many series at once: the series is a key of every sum and every tree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barweave.functions.discretize import exact_quantiles
from barweave.functions.windows import BY
from barweave.sources.stored import stored


def boosted(rows: DataFrame, names: Sequence[str], label: str, train: Column, by: Sequence[str] = BY, trees: int = 20, depth: int = 3, rate: float = 0.1, bins: int = 32, least: int = 20, ridge: float = 1.0) -> DataFrame:
    """The rows with known ``names`` and 0/1 ``label``, with ``margin``: the log odds of label 1 by its series' trees.

    A feature's bin is the number of its series' quantiles (``bins`` - 1 of them, of the rows where ``train`` holds) at
    or under its value. Every level of a tree is one aggregate over all series: gradient and curvature by series, node,
    feature and bin. A node takes the cut with the largest gain (at 9 decimals; ties: the first feature, the lowest bin)
    among those with ``least`` training rows on both sides, if that is over 0; a leaf moves its rows by ``rate`` times
    the Newton step with ``ridge``. A tree is one job, which writes the rows' margins. Null features or labels drop a row.
    """
    known = rows.dropna(subset=[*names, label])
    key = F.struct(*by).alias("_key")
    packed = known.select(key, F.struct(*known.columns).alias("_row"), F.col(label).cast("double").alias("y"), F.coalesce(train, F.lit(False)).alias("train"), F.struct(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)]).alias("x"))
    packed = stored(packed, "boosting")
    cols = [f"c{i}" for i in range(len(names))]
    cuts = exact_quantiles(packed.where("train").select("_key", "x.*"), cols, [i / bins for i in range(1, bins)], ["_key"])
    cuts = stored(cuts.select("_key", F.array(*[F.array_distinct(c) for c in cols]).alias("cuts")), "cuts")
    binned = F.transform(F.arrays_zip(F.array(*[F.col(f"x.{c}") for c in cols]).alias("v"), F.col("cuts").alias("e")), lambda z: F.size(F.filter(z["e"], lambda e: e <= z["v"])))
    data = stored(packed.join(cuts, "_key").select("_key", "_row", "y", "train", binned.alias("b"), F.lit(0.0).alias("m")), "binned")
    for _ in range(trees):
        p = 1 / (1 + F.exp(-F.col("m")))
        now = data.withColumns({"g": p - F.col("y"), "h": p * (1 - p), "node": F.lit(0)})
        for _ in range(depth):
            cuts_of = _splits(now.where("train"), least, ridge)
            cut = F.element_at("cuts", F.col("node"))
            right = (F.element_at("b", cut["f"] + 1) > cut["bin"]).cast("int")
            now = now.join(cuts_of, "_key", "left").withColumn("node", 2 * F.col("node") + F.coalesce(right, F.lit(0))).drop("cuts")
        leaves = now.where("train").groupBy("_key", "node").agg((-rate * F.sum("g") / (F.sum("h") + ridge)).alias("v"))
        leaves = leaves.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("node", "v"))).alias("leaves"))
        data = stored(now.join(leaves, "_key", "left").select("_key", "_row", "y", "train", "b", (F.col("m") + F.coalesce(F.element_at("leaves", F.col("node")), F.lit(0.0))).alias("m")), "boosted")
    return data.select("_row.*", F.col("m").alias("margin"))


def _splits(rows: DataFrame, least: int, ridge: float) -> DataFrame:
    """(_key, cuts): per series a map of the nodes that are cut to their feature and highest left bin; a tree's width bounds it."""
    cells = rows.select("_key", "node", "g", "h", F.posexplode("b").alias("f", "bin")).groupBy("_key", "node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))
    here = Window.partitionBy("_key", "node", "f")
    left = here.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = cells.select("_key", "node", "f", "bin", *[F.sum(c).over(left).alias(f"{c}l") for c in "ghn"], *[F.sum(c).over(here).alias(f"{c}t") for c in "ghn"])
    part = lambda g, h: g * g / (h + ridge)
    gain = part(F.col("gl"), F.col("hl")) + part(F.col("gt") - F.col("gl"), F.col("ht") - F.col("hl")) - part(F.col("gt"), F.col("ht"))
    found = sums.where((F.col("nl") >= least) & (F.col("nt") - F.col("nl") >= least)).withColumn("gain", F.round(gain, 9)).where("gain > 0")
    best = found.groupBy("_key", "node").agg(F.max_by(F.struct("f", "bin"), F.struct("gain", -F.col("f"), -F.col("bin"))).alias("cut"))
    return best.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("node", "cut"))).alias("cuts"))

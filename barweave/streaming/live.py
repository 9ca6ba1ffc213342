"""Live jobs over two streams, and feeds that arrive in slices, some rows late.

A stream's watermark is the newest time that it has seen, less its delay; two streams together have the smaller one. A
row is late when its time isn't after the watermark of the batches before; late rows are dropped, and everything else
gives what the same rows would give in one batch. State is dropped as soon as no row that isn't late can meet it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barweave.operators.resample import seconds
from barweave.streaming.stream import run_available


def _pairs(signals: DataFrame, bars: DataFrame, cols: Sequence[str], reach: int, delay: str, by: Sequence[str], how: str) -> DataFrame:
    """Signals with their series' bars in (ts, ts + reach seconds]; both watermarked, so that both states are evicted."""
    left = signals.withWatermark("ts", delay)
    right = bars.select(*[F.col(b).alias(f"_{b}") for b in by], F.col("ts").alias("_ts"), *[F.col(c).alias(f"_{c}") for c in cols]).withWatermark("_ts", delay)
    near = (F.col("_ts") > F.col("ts")) & (F.col("_ts") <= F.col("ts") + F.expr(f"interval {reach} seconds"))
    for b in by:
        near = near & (F.col(b) == F.col(f"_{b}"))
    return left.join(right, near, how)


def live_scores(signals: DataFrame, bars: DataFrame, rule: str = "1h", delay: str = "90 minutes", by: Sequence[str] = ("asset",)) -> DataFrame:
    """Pending signals scored when the next bar comes: forward_return_pct and outcome (hit, miss), as two streams joined by time.

    ``signals``: by, ts, direction, close (the price at ts); ``bars``: by, ts, close, one for each time. A signal whose
    next bar hasn't come when the watermark passes it by ``rule`` leaves the state unscored, with nulls. A key that is
    null in either stream meets nothing.
    """
    out = _pairs(signals, bars, ["close"], seconds(rule), delay, by, "left_outer")
    gain = 100 * (F.col("_close") / F.col("close") - 1)
    hit = F.signum(gain) == F.col("direction")
    return out.select(*signals.columns, gain.alias("forward_return_pct"), F.when(hit, "hit").when(gain.isNotNull(), "miss").alias("outcome"))


def live_cycles(signals: DataFrame, bars: DataFrame, n: int = 6, fee_bps: float = 5.0, rule: str = "1h", delay: str = "90 minutes", by: Sequence[str] = ("asset",)) -> DataFrame:
    """Hold cycles scored when their ``n`` bars are there: exit_price, pnl and outcome, of two streams joined by time and grouped by signal.

    ``signals`` as for ``live_scores``; ``bars``: by, ts, close, ret (the return since the bar before), one for each
    time. A fee is paid on the first bar and on leaving. A cycle ends when the watermark has passed its last bar; with a
    bar missing by then its result is null. A signal none of whose bars came gives no row.
    """
    span, fee, side = seconds(rule), fee_bps / 1e4, F.col("direction")
    met = _pairs(signals, bars, ["close", "ret"], n * span, delay, by, "inner").withColumn("_k", (F.unix_seconds("_ts") - F.unix_seconds("ts")) / span)
    first, gain = F.col("_k") == 1, 1 + side * F.col("_ret")
    keys = [*by, "ts", "direction", "close"]
    done = met.groupBy(*keys).agg(F.count("_ret").alias("_n"), F.max(F.when(first, gain)).alias("_first"), F.product(F.when(first, 1.0).otherwise(gain)).alias("_later"), F.max(F.when(F.col("_k") == n, F.col("_close"))).alias("exit_price"))
    pnl = F.when(F.col("_n") == n, (F.col("_first") - fee) * F.col("_later") * (1 - fee) - 1)
    return done.select(*keys, "exit_price", pnl.alias("pnl"), F.when(pnl > 0, "profit").when(pnl.isNotNull(), "loss").alias("outcome"))


def arrival_slice(at: Column, first: int, width: int, slices: int) -> Column:
    """Which of ``slices`` parts of ``width`` seconds from ``first`` on an arrival time is in; later ones are in the last."""
    return F.greatest(F.lit(0), F.least(F.lit(slices - 1), F.floor((F.unix_seconds(at) - first) / width))).cast("int")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def replay(feeds: dict[str, DataFrame], slices: int, job: Callable[..., DataFrame], folder: str) -> DataFrame:
    """A streaming job over feeds that arrive slice by slice; ``job`` takes the streams by the feeds' names.

    Each feed has a column ``slice`` from 0 on and is written once, by slice. A slice arrives as a whole (its folder is
    renamed into the stream's), and the job is started anew for each from its checkpoint, as after a restart: what it
    knows of earlier slices is its state and its log. Batches are written again after a failure, never twice.
    """
    spark = next(iter(feeds.values())).sparkSession
    streams = {}
    for name, rows in feeds.items():
        rows.write.partitionBy("slice").parquet(f"{folder}/staged/{name}")
        path, fs = _fs(spark, f"{folder}/{name}")
        fs.mkdirs(path)
        streams[name] = spark.readStream.schema(rows.schema).parquet(f"{folder}/{name}").drop("slice")
    for k in range(slices):
        for name in feeds:
            (here, fs), (there, _) = _fs(spark, f"{folder}/staged/{name}/slice={k}"), _fs(spark, f"{folder}/{name}/slice={k}")
            if fs.exists(here):
                fs.rename(here, there)
        out = run_available(job(**streams), f"{folder}/out", f"{folder}/log")
    return out

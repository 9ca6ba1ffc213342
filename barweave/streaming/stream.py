"""Structured Streaming: bars from ticks, the signal ledger and its scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barweave.operators.chains import Holding
from barweave.operators.positions import hold_cycle_pnl
from barweave.operators.resample import seconds


def stream_bars(ticks: DataFrame, rule: str, slide: str | None = None, delay: str = "10 minutes", by: Sequence[str] = ("asset",)) -> DataFrame:
    """Bars of tumbling (or, with ``slide``, sliding) windows; ticks later than ``delay`` behind the newest are dropped."""
    span = F.window("ts", f"{seconds(rule)} seconds", f"{seconds(slide or rule)} seconds")
    at = F.struct("ts", "seq")
    out = ticks.withWatermark("ts", delay).groupBy(*by, span.alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("qty").cast("double").alias("volume")
    )
    return out.select(*by, F.lit(rule).alias("res"), F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def log_signals(signals: DataFrame, ledger: DataFrame | None = None, keys: Sequence[str] = ("asset", "ts"), delay: str = "1 day") -> DataFrame:
    """One row per key. A stream forgets keys once the watermark has passed them; a batch also leaves out the ledger's keys."""
    if signals.isStreaming:
        return signals.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))
    fresh = signals.dropDuplicates(list(keys))
    return fresh if ledger is None else fresh.join(ledger.select(*keys).distinct(), list(keys), "left_anti")


def score_next_bar(signals: DataFrame, bars: DataFrame, rule: str = "1h", delay: str = "2 hours", by: Sequence[str] = ("asset",)) -> DataFrame:
    """Signals (by, ts, direction) with the return of the next bar: close at ts and at ts + ``rule``.

    Both sides may be streams; the bars' time condition bounds the state of the join.
    """
    n = seconds(rule)
    left, right = signals, bars.select(*[F.col(b).alias(f"_{b}") for b in by], F.col("ts").alias("_ts"), F.col("close").alias("_close"), F.col("next_close").alias("_next"))
    if signals.isStreaming:
        left, right = left.withWatermark("ts", delay), right.withWatermark("_ts", delay)
    same = (F.col("ts") >= F.col("_ts")) & (F.col("ts") < F.col("_ts") + F.expr(f"interval {n} seconds"))
    for b in by:
        same = same & (F.col(b) == F.col(f"_{b}"))
    out = left.join(right, same).withColumn("forward_return_pct", 100 * (F.col("_next") / F.col("_close") - 1))
    hit = F.signum("forward_return_pct") == F.col("direction")
    return out.withColumn("outcome", F.when(hit, "hit").when(F.col("forward_return_pct").isNotNull(), "miss")).drop("_ts", "_close", "_next", *[f"_{b}" for b in by])


def score_hold_cycles(signals: DataFrame, bars: DataFrame, n: int = 6, fee_bps: float = 5.0) -> DataFrame:
    """Cycles whose exit bar is there, scored; for ``foreachBatch`` over the pending part of the ledger."""
    return hold_cycle_pnl(signals, bars, n, fee_bps).where("pnl is not null")


def live_min_hold(targets: DataFrame, n: int, by: str = "asset") -> DataFrame:
    """A stream of targets (by, ts, target) to positions with a minimum hold; a bar that came before is ignored.

    The state per key is the position, the bars that it must still stay and the last bar's time in microseconds. Rows of
    a batch are taken in order of time, two columns of a key's rows at once; the trigger's size bounds them. Missing
    targets are 0; of rows with one time the first counts.
    """
    machine = Holding()

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pos, stay, last = state.get if state.exists else (0.0, 0, -1)
        parts = [(f["ts"].to_numpy("datetime64[us]").astype(np.int64), f["target"].fillna(0.0).to_numpy(float)) for f in frames]
        at, want = (np.concatenate(x) for x in zip(*parts, strict=True))
        at, first = np.unique(at, return_index=True)
        at, want = at[at > last], want[first][at > last]
        if len(at):
            values = {"target": want, "n": np.full(len(want), float(n))}
            _, (held,) = machine.walk(values, 0, len(want), (pos, stay))
            moved = held != np.concatenate([[pos], held[:-1]])
            pos, stay = machine.step((pos, stay), np.array(machine.table(values, 0, len(want))), len(want))
            last = int(at[-1])
            yield pd.DataFrame({by: key[0], "ts": at.astype("datetime64[us]"), "pos": held, "traded": moved})
        state.update((pos, int(stay), last))

    kind = dict(targets.dtypes)[by]
    return targets.groupBy(by).applyInPandasWithState(run, f"{by} {kind}, ts timestamp, pos double, traded boolean", "pos double, stay int, last long", "append", GroupStateTimeout.NoTimeout)


def feed_sessions(ticks: DataFrame, gap: str = "1 hour", by: Sequence[str] = ("asset",), delay: str = "10 minutes") -> DataFrame:
    """Runs of ticks without a gap; two sessions of one key enclose an outage."""
    rows = ticks.withWatermark("ts", delay) if ticks.isStreaming else ticks
    out = rows.groupBy(*by, F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return out.select(*by, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def ledger_report(ledger: DataFrame, recent: int = 30, target_n: int = 100, target_hit: float = 0.55) -> DataFrame:
    """Logged, scored, pending, hit rate and that of the last ones, over all and by asset and by source.

    ``ledger``: asset, source, ts, outcome (hit, miss or null). Counts are merged from partial ones, and every task keeps
    the ``recent`` last rows of a slice only (the window's limit is applied before its shuffle).
    """
    slices = F.explode(F.array(F.lit("all"), F.concat(F.lit("asset="), "asset"), F.concat(F.lit("source="), "source")))
    rows = ledger.withColumn("slice", slices).withColumn("_hit", F.when(F.col("outcome") == "hit", 1).when(F.col("outcome") == "miss", 0))
    out = rows.groupBy("slice").agg(F.count("*").alias("logged"), F.count("_hit").alias("scored"), F.avg("_hit").alias("hit"))
    order = Window.partitionBy("slice").orderBy(F.desc("ts"), "asset", "source")
    last = rows.where("_hit is not null").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= recent)
    out = out.join(last.groupBy("slice").agg(F.avg("_hit").alias("recent_hit")), "slice", "left")
    return out.withColumn("pending", F.col("logged") - F.col("scored")).withColumn("validated", F.coalesce((F.col("scored") >= target_n) & (F.col("hit") >= target_hit), F.lit(False)))


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a streaming query over what is there now, into Parquet under ``out``, and read that.

    In append mode a batch has a folder of its own and may be written again after a failure; in complete mode each
    batch replaces the last one's result.
    """
    spark = df.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}" if mode == "append" else f"{out}/batch=0")

    df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out).select(*df.columns)


def each_batch(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand every micro-batch to ``write``; with idempotent writes a restart repeats nothing."""
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Very long series in slices: numbers, runs, last values and state machines without a series in one task.

A slice is a stretch of time of one series with about so many rows. What a slice passes on is a summary of fixed size;
summaries of one series, a few for each million rows, are put together in order of time, and every slice then starts
from what the slices before it left.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from barweave.functions.windows import BY

ROWS = 1_000_000


def stamp(df: DataFrame, on: str = "ts") -> Column:
    kind = dict(df.dtypes)[on]
    return F.unix_micros(F.col(on).cast("timestamp")) if kind.startswith("timestamp") else F.unix_date(on).cast("long") if kind == "date" else F.col(on).cast("long")


def time_slices(df: DataFrame, rows: int = ROWS, by: Sequence[str] = BY, on: str = "ts") -> DataFrame:
    """Adds _key (the struct of ``by``) and _slice: equal stretches of time, as many as the series has times ``rows`` rows.

    Even where a series' rows are evenly spaced, as bars are. A null time is in the first slice; a key may hold nulls.
    """
    keyed = df.withColumn("_key", F.struct(*by) if by else F.struct(F.lit(0).alias("all")))
    ends = keyed.groupBy("_key").agg(F.min(stamp(df, on)).alias("_a"), F.max(stamp(df, on)).alias("_b"), F.count("*").alias("_n"))
    width = F.greatest(F.lit(1), F.ceil((F.col("_b") - F.col("_a") + 1) / F.ceil(F.col("_n") / rows)))
    spans = ends.select("_key", "_a", width.alias("_width"))
    at = F.coalesce(F.floor((stamp(df, on) - F.col("_a")) / F.col("_width")), F.lit(0)).cast("long")
    return keyed.join(spans, "_key").withColumn("_slice", at).drop("_a", "_width")


def before(summaries: DataFrame, col: str, agg=F.sum) -> Column:
    """``agg`` of a column over the summaries of the slices before."""
    return agg(col).over(Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))


def numbered(df: DataFrame, rows: int = ROWS, by: Sequence[str] = BY, order: Sequence[str] = (), on: str = "ts") -> DataFrame:
    """Adds _key, _slice, _i (the row's number in its slice, from 1), _at (in its series, from 0) and _n (the series' rows).

    Rows are in order of time and then ``order``. Slices are counted first; a slice's count is its summary.
    """
    sliced = time_slices(df, rows, by, on)
    counts = sliced.groupBy("_key", "_slice").agg(F.count("*").alias("_c"))
    counts = counts.select("_key", "_slice", F.coalesce(before(counts, "_c"), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy("_key")).alias("_n"))
    out = sliced.withColumn("_i", F.row_number().over(Window.partitionBy("_key", "_slice").orderBy(on, *order))).join(counts, ["_key", "_slice"])
    return out.withColumn("_at", F.col("_before") + F.col("_i") - 1).drop("_before")


def overlapped(df: DataFrame, before: int, after: int, rows: int = ROWS, by: Sequence[str] = ()) -> DataFrame:
    """Adds _key, _chunk and _home: every row in its own chunk of ``rows`` rows, and in those whose rows look back ``before`` or ahead ``after`` rows to it.

    Windows over (_key, _chunk) are right for the rows of a chunk that are at home there.
    """
    at = numbered(df, rows, by)
    spread = F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("_at") - after) / rows)), F.floor((F.col("_at") + before) / rows)))
    return at.withColumn("_chunk", spread).withColumn("_home", F.floor(F.col("_at") / rows) == F.col("_chunk")).drop("_slice", "_i", "_at", "_n")


def run_lengths(df: DataFrame, sign: Column, name: str, rows: int = ROWS, by: Sequence[str] = BY, shifted: bool = False) -> DataFrame:
    """Signed length of the run of equal signs that ends at each row (0 where the sign is 0 or null), over slices; ``shifted``: at the row before it.

    A slice's summary is its first and last sign, the length of its last run and whether that is the whole slice; a run
    goes on into the next slice if that starts with its sign.
    """
    out = df.withColumn("_sign", F.coalesce(sign.cast("int"), F.lit(0)))
    inside = Window.partitionBy("_key", "_slice").orderBy("ts")
    marked = time_slices(out, rows, by).withColumn("_new", F.when(F.col("_sign") == F.lag("_sign").over(inside), 0).otherwise(1))
    marked = marked.withColumn("_run", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.withColumn("_length", F.row_number().over(Window.partitionBy("_key", "_slice", "_run").orderBy("ts")))
    last = F.struct("_run", "_length")
    ends = marked.groupBy("_key", "_slice").agg(F.min_by("_sign", F.struct("_run")).alias("_head"), F.max_by("_sign", last).alias("_tail"), F.max_by("_length", last).alias("_left"), F.max("_run").alias("_runs"))
    order = Window.partitionBy("_key").orderBy("_slice")
    goes_on = F.col("_head") == F.lag("_tail").over(order)
    ends = ends.withColumns({"_on": F.coalesce(goes_on, F.lit(False)), "_broken": F.when(goes_on & (F.col("_runs") == 1), 0).otherwise(1)})
    ends = ends.withColumn("_chain", F.sum("_broken").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.withColumn("_so_far", F.sum("_left").over(Window.partitionBy("_key", "_chain").orderBy("_slice")))
    carry = ends.select("_key", "_slice", F.when(F.col("_on"), F.lag("_so_far").over(order)).otherwise(0).alias("_carry"), F.coalesce(F.lag(F.col("_tail") * F.col("_so_far")).over(order), F.lit(0)).alias("_past"))
    out = marked.join(carry, ["_key", "_slice"])
    length = F.col("_sign") * (F.col("_length") + F.when(F.col("_run") == 1, F.col("_carry")).otherwise(0))
    out = out.withColumn("_value", length)
    value = F.coalesce(F.lag("_value").over(inside), F.col("_past")) if shifted else F.col("_value")
    return out.withColumn(name, value.cast("int")).drop("_key", "_slice", "_sign", "_new", "_run", "_length", "_carry", "_past", "_value")


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str] = ("asset",), on: str = "ts", tolerance_s: int | None = None, rows: int = ROWS) -> DataFrame:
    """``operators.resample.asof_join`` over slices: each slice's last right row is its summary, the last of those before fills its start.

    Left rows with a null time come first and find right rows with a null time only.
    """
    extra = [c for c in right.columns if c not in by and c != on]
    rest = [c for c in left.columns if c not in by and c != on]
    r = right.select(*by, on, F.struct(F.col(on).alias("_at"), *extra).alias("_r"), F.lit(0).alias("_tag"))
    l = left.select(*by, on, F.struct(F.lit(1).alias("_one"), *rest).alias("_l"), F.lit(1).alias("_tag"))  # noqa: E741
    both = time_slices(l.unionByName(r, allowMissingColumns=True), rows, by, on)
    inside = Window.partitionBy("_key", "_slice").orderBy(on, "_tag", "_r").rowsBetween(Window.unboundedPreceding, 0)
    lasts = both.where("_tag = 0").groupBy("_key", "_slice").agg(F.max("_r").alias("_last"))
    slices = both.select("_key", "_slice").distinct().join(lasts, ["_key", "_slice"], "left")
    filled = slices.select("_key", "_slice", before(slices, "_last", lambda c: F.last(c, True)).alias("_carry"))
    found = F.coalesce(F.last("_r", True).over(inside), F.col("_carry"))
    joined = both.join(filled, ["_key", "_slice"]).withColumn("_found", found).where("_tag = 1")
    if tolerance_s is not None:
        joined = joined.withColumn("_found", F.when(F.unix_seconds(on) - F.unix_seconds("_found._at") <= tolerance_s, F.col("_found")))
    return joined.select(*by, on, *[F.col(f"_l.{c}").alias(c) for c in rest], *[F.col(f"_found.{c}").alias(c) for c in extra])


def through_chunks(df: DataFrame, machine, needs: dict[str, Column], added: dict[str, str], rows: int = ROWS, by: Sequence[str] = BY) -> DataFrame:
    """The rows of ``df`` with the columns that a state machine makes along each series.

    Rows are in order of time, then of ``needs``; only these columns go to Python, and what it makes is joined to the
    rows by their numbers. Chunks of ``rows`` rows are worked three times, each by itself: a chunk becomes a table from
    every state in which it may start to that in which it ends; a series' tables are followed from one to the next; and
    each chunk is walked from its own start. ``machine`` has ``before`` and ``after`` (rows that a chunk must see around
    it), ``start``, ``table(values, first, own)``, ``step(state, table, own)`` and ``walk(values, first, own, state)``,
    which gives the numbers of its rows and the added columns; see ``operators.chains``. ``df`` should be cheap to read
    several times (``sources.stored``).
    """
    values = {f"_v_{k}": F.coalesce(F.nanvl(c.cast("double"), F.lit(None)), F.lit(0.0)) + F.lit(0.0) for k, c in needs.items()}
    whole = F.struct(*[c for c in df.columns if c not in added]).alias("_row")  # so that no column's name matters below
    rows_at = numbered(df.select(*by, "ts", whole, *[c.alias(k) for k, c in values.items()]), rows, by, list(values))
    narrow = rows_at.select("_key", "_slice", "_i", "_at", *values)
    chunk = F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("_at") - machine.after) / rows)), F.floor((F.col("_at") + machine.before) / rows)))
    spread = narrow.withColumn("_chunk", chunk)
    key = df.select(F.struct(*by).alias("_key")).schema["_key"].dataType.simpleString()
    names = list(needs)

    def arrays(group: pa.Table) -> tuple[pa.Table, dict[str, np.ndarray], int, int]:
        at = group.column("_at").to_numpy()
        order = np.argsort(at, kind="stable")
        group, at = group.take(pa.array(order)), at[order]
        begin = int(group.column("_chunk")[0].as_py()) * rows
        first, end = np.searchsorted(at, [begin, begin + rows])
        return group, {k: group.column(f"_v_{k}").to_numpy() for k in names}, int(first), int(end - first)

    def table(group: pa.Table) -> pa.Table:
        group, have, first, own = arrays(group)
        made = machine.table(have, first, own) if own else []
        return pa.table({"_key": group.column("_key").slice(0, 1), "_chunk": group.column("_chunk").slice(0, 1), "own": pa.array([own], pa.int64()), "made": pa.array([list(map(float, made))], pa.list_(pa.float64()))})

    def follow(tables: pa.Table) -> pa.Table:
        tables = tables.sort_by("_chunk")
        state, out = list(machine.start), []
        for own, made in zip(tables.column("own").to_pylist(), tables.column("made"), strict=True):
            out.append(state)
            state = list(machine.step(state, made.values.to_numpy(), own)) if own else state
        return pa.table({"_key": tables.column("_key"), "_chunk": tables.column("_chunk"), "_state": pa.array(out, pa.list_(pa.float64()))})

    def walk(group: pa.Table) -> pa.Table:
        group, have, first, own = arrays(group)
        at, made = machine.walk(have, first, own, group.column("_state")[0].as_py() or list(machine.start)) if own else (np.arange(0), [[] for _ in added])
        part = group.take(pa.array(at)).select(["_key", "_slice", "_i"])
        for (name, kind), column in zip(added.items(), made, strict=True):
            part = part.append_column(name, pa.array(column, {"double": pa.float64(), "string": pa.string()}[kind]))
        return part

    tables = spread.groupBy("_key", "_chunk").applyInArrow(table, f"_key {key}, _chunk long, own long, made array<double>")
    starts = tables.groupBy("_key").applyInArrow(follow, f"_key {key}, _chunk long, _state array<double>")
    made = spread.join(starts, ["_key", "_chunk"], "left").groupBy("_key", "_chunk").applyInArrow(walk, f"_key {key}, _slice long, _i int" + "".join(f", {k} {v}" for k, v in added.items()))
    return rows_at.join(made, ["_key", "_slice", "_i"]).select("_row.*", *added)

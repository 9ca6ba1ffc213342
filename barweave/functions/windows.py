"""Windows over a series and guarded rolling aggregates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

BY = ("asset", "res")


def over(by: Sequence[str] = BY, order: str | Column = "ts") -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order)


def trailing(n: int, by: Sequence[str] = BY, order: str | Column = "ts", end: int = 0) -> WindowSpec:
    """The n rows that end ``end`` rows after the current one (negative: before it)."""
    return over(by, order).rowsBetween(end - n + 1, end)


def so_far(by: Sequence[str] = BY, order: str | Column = "ts") -> WindowSpec:
    return over(by, order).rowsBetween(Window.unboundedPreceding, 0)


def rolling(agg: Callable[[Column], Column], col: Column | str, n: int, by: Sequence[str] = BY, end: int = 0) -> Column:
    """``agg`` over n rows, null until all n hold a value."""
    col = F.col(col) if isinstance(col, str) else col
    w = trailing(n, by, end=end)
    return F.when(F.count(col).over(w) == n, agg(col).over(w))


def div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0).cast("double"))


def clean(df: DataFrame, *cols: str) -> DataFrame:
    """NaN made null in double columns; all of them unless named."""
    names = cols or [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in names})


def percentiles(col: str, qs: Sequence[float], exact: bool = True) -> Column:
    """Linear-interpolated quantiles; ``exact=False`` trades exactness for bounded memory on very large groups."""
    return F.percentile(col, list(qs)) if exact else F.percentile_approx(col, list(qs), 100_000)


def chunked(df: DataFrame, apply: Callable[[DataFrame, Sequence[str]], DataFrame], rows: int, overlap: int, by: Sequence[str] = BY) -> DataFrame:
    """Bounded-window features of few very long series, split into chunks that run in parallel.

    Each chunk of ``rows`` bars is computed with the ``overlap`` bars before it, whose results are dropped. Right for
    features that look back no further than ``overlap`` rows. Bar numbers are found by counting per hour, so that no
    task holds a whole series.
    """
    hours = df.groupBy(*by, F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))
    before = hours.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    keyed = df.withColumn("hour", F.date_trunc("hour", "ts"))
    at = F.col("before") + F.row_number().over(Window.partitionBy(*by, "hour").orderBy("ts")) - 1
    numbered = keyed.join(before, [*by, "hour"]).withColumn("at", at).drop("hour", "before")
    home = F.floor(F.col("at") / rows)
    last = F.floor((F.col("at") + overlap) / rows)
    spread = numbered.withColumn("chunk", F.explode(F.sequence(home, last)))
    out = apply(spread, [*by, "chunk"])
    return out.where(F.col("chunk") == home).drop("chunk", "at")

"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barweave.llm.shared import dropped, written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("hi", "lo"), F.lit(1 << 40))).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(id, component_id) of every vertex that has an edge to another; component_id is the smallest id reachable.

    Edges with a null end and loops count for nothing; repeated edges count once; no edges give an empty table. Every
    round is two shuffles of the edges, written to the shared folder, and takes a vertex's neighbours as a grouped
    minimum and a join, never as a list. The number of rounds grows with the logarithm of the longest path; ending
    without a result after ``most_rounds`` is an error.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = written(edges.select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")).where(x.isNotNull() & y.isNotNull() & (x != y)).distinct(), "edges")
    state = _state(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        least = written(least, "least")  # a table: then Spark can split a hub's side of the join
        large = both.where("lo > hi").join(least.withColumnRenamed("hi", "u"), F.col("hi") == F.col("u")).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        small_least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(small_least.withColumnRenamed("hi", "u"), F.col("hi") == F.col("u")).select("hi", "lo", "m")
        small = small.select(F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*").where("hi <> lo").distinct()
        old, now = now, written(small, "edges")
        dropped(old, least)
        if (new := _state(now)) == state:
            break
        state = new
    else:
        raise RuntimeError(f"components are not complete after {most_rounds} rounds")
    stars = now.select(F.col("hi").alias("id"), F.col("lo").alias("component_id"))
    return stars.unionByName(stars.select(F.col("component_id").alias("id"), "component_id").distinct())

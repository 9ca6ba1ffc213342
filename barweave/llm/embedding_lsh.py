"""Near-duplicate embeddings by cross-polytope hashing.

A hash is the largest coordinate, with its sign, after three rounds of random signs and a fast Hadamard transform; two
hashes make a table's bucket. A vector lies in its own bucket of each table and also looks into buckets with a
runner-up coordinate (multiprobe). Pairs that meet are compared by their cosine in double precision.

Equal vectors are one class throughout. Buckets over a limit are cut into blocks, and every pair of blocks is
compared. A pair counts in the first table where it meets, so links are counted without writing pairs out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barweave.llm.batches import grouped
from barweave.llm.components import connected_components
from barweave.llm.shared import written
from barweave.llm.words import mix

BLOCK, SEED = 1024, 17
FILL = 64  # vectors in a bucket of one table, on average, at most
MOST_HASHES = 5


@dataclass(frozen=True)
class Shape:
    """Tables, hashes in a table, and further buckets that a vector looks into."""

    tables: int = 5
    hashes: int = 2
    probes: int = 3


def shape_for(n: int, d: int) -> Shape:
    """The shape for ``n`` vectors of length ``d``: hashes grow with the logarithm of n, so buckets don't, and tables with what a hash misses.

    One table meets a pair at cosine 0.95 in so many cases, in a simulation with lengths 64 and 384: 0.77 and 0.66 with
    two hashes, 0.67 and 0.51 with three, 0.54 and 0.36 with four, 0.41 with five (64); all tables together in 0.99.
    """
    size = 1 << max(2, (d - 1).bit_length())
    hashes = min(MOST_HASHES, max(2, math.ceil(math.log(max(2, n) / FILL) / math.log(2 * size))))
    return Shape(*((5, 2, 3) if hashes == 2 else (math.ceil(math.log(0.003) / math.log(1 - 0.62 * 0.8 ** (hashes - 2))), hashes, 3 * hashes - 3)))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the length is a power of two."""
    n, d = x.shape
    x = x.copy()
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def codes(unit: np.ndarray, shape: Shape, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """For every vector and table the own bucket, and further ones: arrays (n, T) and (n, T, P) of uint64.

    Further buckets have the second or third coordinate of one hash, or the second of two, the nearest to the largest first.
    """
    n, d = unit.shape
    size = 1 << max(2, (d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = unit
    rng = np.random.default_rng(seed)
    signs = rng.integers(0, 2, (shape.tables, shape.hashes, 3, size)) * 2.0 - 1
    base = np.empty((n, shape.tables), dtype=np.uint64)
    probes = np.empty((n, shape.tables, shape.probes), dtype=np.uint64)
    rows, every = np.arange(n), range(shape.hashes)
    choices = [{a: 1} for a in every] + [{a: 1, b: 1} for a in every for b in range(a)] + [{a: 2} for a in every]
    for t in range(shape.tables):
        ranked, gaps = [], []
        for h in every:
            y = padded
            for r in range(3):
                y = hadamard(y * signs[t, h, r])
            strong = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :3]
            value = y[rows[:, None], strong]
            ranked.append((2 * strong + (value < 0)).astype(np.uint64))
            gaps.append(np.abs(value[:, :1]) - np.abs(value[:, 1:]))

        def name(choice: dict[int, int]) -> np.ndarray:
            out = np.zeros(n, dtype=np.uint64)
            for h in every:
                out = out * np.uint64(4 * size) + ranked[h][:, choice.get(h, 0)]  # noqa: B023
            return mix(out * np.uint64(shape.tables) + np.uint64(t))  # noqa: B023

        base[:, t] = name({})
        options = np.stack([name(x) for x in choices], axis=1)
        cost = np.stack([sum(gaps[h][:, k - 1] for h, k in x.items()) for x in choices], axis=1)
        probes[:, t] = np.take_along_axis(options, np.argsort(cost, axis=1, kind="stable")[:, : shape.probes], axis=1)
    return base, probes


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def _units(column: pa.Array) -> np.ndarray:
    """The vectors with length 1, in double precision."""
    x = _vectors(column)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _meet(base_a, probes_a, base_b, probes_b) -> np.ndarray:
    """Which of these pairs meet in a table: one's own bucket is a bucket of the other."""
    out = base_a == base_b
    for p in range(probes_a.shape[1]):
        out |= (probes_a[:, p] == base_b) | (base_a == probes_b[:, p])
    return out


def _union(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable over pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare(batches: Iterator[pa.RecordBatch], least: float, shapes: dict[int, Shape]) -> Iterator[pa.RecordBatch]:
    """Blocks of one bucket to (id, links, to): links first met here, and a tree of edges that joins what is linked.

    Columns: block, id, copies, table, own, side, vector. ``side`` is 0 or 1 where two blocks meet and 2 where one
    meets itself.
    """
    for group in grouped(batches):
        if group.num_rows < 2:
            continue
        own = group.column(4).to_numpy(zero_copy_only=False)
        if not own.any():
            continue
        ids, copies = group.column(1).to_numpy(), group.column(2).to_numpy()
        table, side = int(group.column(3)[0].as_py()), group.column(5).to_numpy()
        x = _units(group.column(6))
        left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side[0] != 2 else (np.arange(len(x)),) * 2
        found = []
        for at in range(0, len(left), 512):
            rows = left[at : at + 512]
            i, j = np.nonzero(x[rows] @ x[right].T >= least - 1e-9)
            i, j = rows[i], right[j]
            keep = (own[i] | own[j]) & ((i < j) if side[0] == 2 else (i != j))
            found.append(np.stack([i[keep], j[keep]]))
        i, j = np.concatenate(found, axis=1)
        if not len(i):
            continue
        exact = np.einsum("ij,ij->i", x[i], x[j]) >= least
        i, j = i[exact], j[exact]
        if not len(i):
            continue
        used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
        base, probes = codes(x[used], shapes[x.shape[1]])
        a, b = place[: len(i)], place[len(i) :]
        fresh = np.ones(len(i), dtype=bool)
        for t in range(table):
            todo = np.flatnonzero(fresh)
            fresh[todo[_meet(base[a[todo], t], probes[a[todo], t], base[b[todo], t], probes[b[todo], t])]] = False
        # two that look into each other's buckets meet twice in this table: the smaller bucket counts
        looks_a, looks_b = (probes[a, table] == base[b, table][:, None]).any(axis=1), (probes[b, table] == base[a, table][:, None]).any(axis=1)
        fresh &= ~(own[i] & ~own[j] & looks_a & (base[b, table] < base[a, table])) & ~(own[j] & ~own[i] & looks_b & (base[a, table] < base[b, table]))
        links = np.zeros(len(used), dtype=np.int64)
        np.add.at(links, a[fresh], copies[j[fresh]])
        np.add.at(links, b[fresh], copies[i[fresh]])
        root = _union(len(used), a, b)
        yield pa.RecordBatch.from_arrays([pa.array(ids[used]), pa.array(links), pa.array(ids[used][root])], names=["id", "links", "to"])


def near_duplicates(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95) -> DataFrame:
    """Per vector: vec_id, n_links (other vectors with cosine >= ``least`` found), component_id, kept.

    Vectors that are null or zero or hold null or non-finite components link with nothing. Equal vectors, of which
    there may be any number, are one class and link with each other; vectors of different lengths don't compare. An
    empty table gives an empty result. Other columns are not read. Rows with one vec_id count as different vectors
    but share a component. The hashing may miss a pair: with cosine 0.95 fewer than 1 in 100.
    """
    vector = F.col(vector_col)
    sound = vector.isNotNull() & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(vector, lambda v: v != 0)
    # -0.0 + 0.0 is 0.0, so equal vectors have equal bytes
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector, lambda v: v + F.lit(0).cast("float")).alias("vector"), F.coalesce(sound, F.lit(False)).alias("sound"))
    digest = F.sha2(F.array_join(F.transform("vector", lambda v: F.hex(v.cast("string"))), ","), 256)
    rows = rows.withColumn("digest", F.when(F.col("sound"), digest))
    classes = written(rows.where("sound").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector")), "vectors")

    # one number for each length of vectors; a length's shape is the same in every task
    shapes = {r["d"]: shape_for(r["n"], r["d"]) for r in classes.groupBy(F.size("vector").alias("d")).count().withColumnRenamed("count", "n").collect()}

    def hashed(batches):
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column(1)])
            for d in np.unique(sizes):
                part = batch.filter(pa.array(sizes == d))
                base, probes = codes(_units(part.column(1)), shapes[int(d)])
                bucket = mix(np.concatenate([base[:, :, None], probes], axis=2) + np.uint64(d)).view(np.int64)
                n, t, p = bucket.shape
                yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel()), part.column(0).take(pa.array(np.repeat(np.arange(n), t * p))), pa.array(np.tile(np.repeat(np.arange(t, dtype=np.int32), p), n)), pa.array(np.tile(np.arange(p) == 0, n * t))], names=["bucket", "id", "table", "own"])

    spread = written(classes.select("rep", "vector").mapInArrow(hashed, "bucket long, id long, `table` int, own boolean"), "spread")
    # buckets where two can meet, and into how many parts they go; ids find them first, and only then vectors travel
    counted = spread.groupBy("bucket").agg(F.count("*").alias("n"), F.max("own").alias("any_own")).where("n > 1 and any_own").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    live = written(counted, "buckets")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = spread.join(live, "bucket").join(classes.select(F.col("rep").alias("id"), "copies", "vector"), "id").select("*", part.alias("part")).select("*", other.alias("other"))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    dealt = dealt.select(
        F.xxhash64("bucket", low, high).alias("block"), "id", "copies", "table", "own",
        F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 0).otherwise(1).alias("side"), "vector",
    )
    met = written(dealt.repartition("block").sortWithinPartitions("block").mapInArrow(lambda b: compare(b, least, shapes), "id long, links long, to long"), "met")
    links = met.groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(met, "id", "to")
    per_class = classes.select("digest", "rep", "copies").join(links.withColumnRenamed("id", "rep"), "rep", "left").join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    per_class = per_class.select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.select("vec_id", "digest").join(per_class, "digest", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"))

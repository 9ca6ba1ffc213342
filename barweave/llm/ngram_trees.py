"""Jaccard join of documents' word n-gram sets with signature trees.

Equal sets are one class. First, star edges: documents that share a min-hash band with the band's first document are
compared with it, which joins most copies in one linear step. Then every remaining link between different groups is
searched for exactly:

- Routing. In one order of all shingles, two linked sets have a shingle in common among the first
  ``size - ceil(t * size) + 1`` of each; these are a set's keys. The order is that of the hashes, but shingles that a
  large share of the documents have come last, so that a key is shared by few. Which ones are told to be frequent
  changes the work only, never the result. A key's documents are cut into ranges of sizes between which no link is
  possible. Ranges whose documents all lie in one group need no further look, and of those with the same documents one
  is looked at.
- Trees. The documents of a range, in blocks of bounded size, form a tree by size whose nodes hold the size range and
  the OR of their token bitmaps. Two nodes are walked down together and dropped when their largest possible overlap is
  too small. Pairs of different groups that are left are verified on whole sets: the best pair of two groups in each
  block first, and then, in blocks with other pairs of groups that these did not join, every one.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from barweave.llm.batches import grouped, pieces_of
from barweave.llm.components import connected_components
from barweave.llm.shared import dropped, packed, packed_among, written
from barweave.llm.words import as_bytes, mix, shingles, slices, tokenize

BANDS, PER_BAND = 6, 2
FREQUENT = 1 / 1000  # share of documents that makes a shingle frequent
COUNTERS, MOST_FREQUENT = 1 << 18, 1 << 16  # of a task's counter; entries of the order's list, which every task gets
BLOCK = 512
FAN = 8
_SEEDS = mix(np.arange(1, 1 + BANDS * PER_BAND, dtype=np.uint64))
_ODD = _SEEDS | np.uint64(1)


def sets_of(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The distinct n-word shingles of each text as sorted 64-bit hashes."""
    hashes, _, _, first = tokenize(texts)
    return [np.unique(x) for x in shingles(hashes, first, n)]


def linked(a: np.ndarray, b: np.ndarray, least: Fraction) -> bool:
    if not len(a) or not len(b):
        return False
    both = np.intersect1d(a, b, assume_unique=True).size
    return both * least.denominator >= least.numerator * (len(a) + len(b) - both)


def bands(sets: list[np.ndarray]) -> list[list[int]]:
    """The min-hash bands of each set; an empty set has none."""
    full = [i for i, s in enumerate(sets) if len(s)]
    out: list[list[int]] = [[] for _ in sets]
    if full:
        every = np.concatenate([sets[i] for i in full])
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]]).astype(np.int64)
        low = np.stack([np.minimum.reduceat((every ^ seed) * odd, starts) for seed, odd in zip(_SEEDS, _ODD, strict=True)], axis=1).reshape(len(full), BANDS, PER_BAND)
        key = mix((mix(low) * np.arange(1, 2 * PER_BAND, 2, dtype=np.uint64)).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
        for i, row in zip(full, key.view(np.int64).tolist(), strict=True):
            out[i] = row
    return out


class Counter:
    """Counts of the shingles that are frequent in a stream of sets, in bounded memory.

    Counts may be too low by a COUNTERS-th part of the stream's shingles at most; rare shingles are forgotten.
    """

    def __init__(self):
        self.values, self.counts, self.sets = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), 0

    def add(self, sets: list[np.ndarray]) -> None:
        self.sets += len(sets)
        values, counts = np.unique(np.concatenate(sets), return_counts=True)
        values, where = np.unique(np.concatenate([self.values, values]), return_inverse=True)
        counts = np.bincount(where, weights=np.concatenate([self.counts, counts]), minlength=len(values)).astype(np.int64)
        if len(values) > COUNTERS:
            counts -= np.partition(counts, len(counts) - COUNTERS)[len(counts) - COUNTERS]
        self.values, self.counts = values[counts > 0], counts[counts > 0]

    def frequent(self) -> tuple[np.ndarray, np.ndarray]:
        keep = self.counts >= max(2, FREQUENT * self.sets)
        return self.values[keep], self.counts[keep]


def keys_of(s: np.ndarray, least: Fraction, frequent: np.ndarray) -> np.ndarray:
    """The routing keys of a sorted set; ``frequent`` is sorted too."""
    n = len(s) - -(-least.numerator * len(s) // least.denominator) + 1
    if len(frequent):
        late = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
        s = np.concatenate([s[~late], s[late]])
    return s[:n]


def width(size: int) -> int:
    """Bits of a set's bitmap, a power of two that doesn't fall with the size.

    It is near 8 a shingle for small sets, which tells them apart up to a similarity of about 0.77, and near 2 for large
    ones, which does so up to about 0.65 and keeps what travels with each key short.
    """
    return 1 << max(6, min(20, round(np.log2(max(min(8 * size, 2048), 2 * size)))))


def bitmap(s: np.ndarray) -> bytes:
    bits = np.zeros(width(len(s)), dtype=np.uint8)
    bits[(mix(s) & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _fold(raw: bytes, bits: int) -> np.ndarray:
    return np.bitwise_or.reduce(np.frombuffer(raw, dtype=np.uint64).reshape(-1, bits // 64), axis=0)


class Node:
    """A part of the documents sorted by size: sizes, OR of the bitmaps, and the most tokens beyond one per bit."""

    __slots__ = ("bits", "children", "excess", "groups", "high", "low", "rows")

    def __init__(self, rows: np.ndarray, sizes, maps, excess, groups):
        self.rows, self.children = rows, []
        self.low, self.high, self.excess = int(sizes[rows].min()), int(sizes[rows].max()), int(excess[rows].max())
        self.bits = np.bitwise_or.reduce(maps[rows], axis=0)
        first = groups[rows[0]]
        self.groups = first if (groups[rows] == first).all() else None
        if len(rows) > FAN:
            self.children = [Node(x, sizes, maps, excess, groups) for x in np.array_split(rows, min(FAN, -(-len(rows) // FAN)))]


def candidate_pairs(left: np.ndarray, right: np.ndarray, sizes, maps, groups, least: Fraction) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of different groups that may be linked, by walking down two trees together."""
    excess = sizes - np.bitwise_count(maps).sum(axis=1)
    order = lambda rows: rows[np.lexsort((groups[rows], sizes[rows]))]
    a = Node(order(left), sizes, maps, excess, groups)
    b = a if right is left else Node(order(right), sizes, maps, excess, groups)
    num, den = least.numerator, least.denominator
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        if x.groups is not None and x.groups == y.groups:
            continue
        if den * x.high < num * y.low or den * y.high < num * x.low:
            continue
        shared = int(np.bitwise_count(x.bits & y.bits).sum())
        most = min(x.high, y.high, x.excess + shared, y.excess + shared)
        if most * (num + den) < num * (x.low + y.low):
            continue
        if not x.children and not y.children:
            i, j = np.repeat(x.rows, len(y.rows)), np.tile(y.rows, len(x.rows))
            keep = groups[i] != groups[j]
            if x is y:
                keep &= i < j
            i, j = i[keep], j[keep]
            shared = np.bitwise_count(maps[i] & maps[j]).sum(axis=1)
            most = np.minimum(np.minimum(sizes[i], sizes[j]), np.minimum(excess[i], excess[j]) + shared)
            keep = (most * (num + den) >= num * (sizes[i] + sizes[j])) & (den * sizes[i] >= num * sizes[j]) & (den * sizes[j] >= num * sizes[i])
            out.append((i[keep], j[keep]))
        elif x is y:
            todo += [(p, q) for k, p in enumerate(x.children) for q in x.children[k:]]
        elif len(x.rows) >= len(y.rows) and x.children:
            todo += [(p, y) for p in x.children]
        else:
            todo += [(x, q) for q in y.children]
    return out


def _read(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _signed(documents: DataFrame, n: int) -> DataFrame:
    """doc_id, size, a 128-bit digest of the set, and bands; rows of size -1 have a task's frequent shingles and counts instead."""

    def run(batches):
        names = ["doc_id", "size", "d1", "d2", "bands", "frequent", "counts"]
        counter = Counter()
        for batch in pieces_of(batches):
            texts = as_bytes(batch.column(1))
            for a, b in slices(texts):
                sets = sets_of(texts[a:b], n)
                counter.add(sets)
                none = pa.nulls(len(sets), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array([int(mix(s).sum(dtype=np.uint64).view(np.int64)) for s in sets], pa.int64()),
                        pa.array([int(mix(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64).view(np.int64)) for s in sets], pa.int64()), pa.array(bands(sets), pa.list_(pa.int64())), none, none,
                    ], names=names,
                )
        values, counts = counter.frequent()
        if len(values):
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            row = [None, -1, None, None, None]
            yield pa.RecordBatch.from_arrays([*(pa.array([v], k) for v, k in zip(row, kinds, strict=True)), *(pa.array([v.astype(np.int64)], pa.list_(pa.int64())) for v in (values.view(np.int64), counts))], names=names)

    return _read(documents).mapInArrow(run, "doc_id long, size long, d1 long, d2 long, bands array<long>, frequent array<long>, counts array<long>")


def frequent_shingles(signed: DataFrame) -> np.ndarray:
    """The shingles of FREQUENT of the documents or more, MOST_FREQUENT of them at most, sorted."""
    told = signed.where("size = -1").select(F.explode(F.arrays_zip("frequent", "counts")).alias("x")).groupBy(F.col("x.frequent").alias("shingle")).agg(F.sum("x.counts").alias("n"))
    least = FREQUENT * signed.where("size >= 0").count()
    rows = told.where(F.col("n") >= max(2, least)).orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT).collect()
    return np.sort(np.array([r["shingle"] for r in rows], dtype=np.int64).view(np.uint64))


def verify(pairs: DataFrame, documents: DataFrame, n: int, least: Fraction) -> DataFrame:
    """The pairs (a, b) that are linked, by exact comparison of whole sets.

    The texts move compressed: those of the pairs (and few others) once by id, and then the two of a pair to one place. A text that many pairs share is
    one side of a plain join, whose large partitions Spark splits. Of an id with several texts all are compared.
    """
    num, den = least.numerator, least.denominator
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("of"), "a", "b")
    sides = wanted.join(packed_among(documents, wanted.select("of")), F.col("of") == F.col("doc_id")).select("a", "b", (F.col("of") == F.col("b")).cast("int").alias("side"), "packed")
    sides = sides.withColumn("pair", F.xxhash64("a", "b")).repartition("pair").sortWithinPartitions("pair", "a", "b")

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        share = Fraction(num, den)
        for group in grouped(batches, key=4):
            a, b, side = (group.column(i).to_pylist() for i in range(3))
            sets = sets_of([unpack(x) for x in group.column(3).to_pylist()], n)
            met: dict[tuple[int, int], tuple[list, list]] = {}
            for i, s in enumerate(sets):
                met.setdefault((a[i], b[i]), ([], []))[side[i]].append(s)
            found = [pair for pair, (left, right) in met.items() if any(linked(p, q, share) for p in left for q in right)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return sides.mapInArrow(run, "a long, b long")


def near_duplicates(documents: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Two documents link when 100 * intersection >= ``percent`` * union of their sets of ``n``-word shingles; a text of
    fewer words is one shingle. Null texts, texts without words and null ids link with nothing. Equal sets are one
    class, however many; no links between different sets are lost. Rows with one doc_id and different texts link as
    one document under that id, which has the links of each of its texts. An empty table gives an empty result. Columns besides doc_id and text aren't read.
    """
    least = Fraction(percent, 100)
    signed = written(_signed(documents, n), "signed")
    classes = signed.where("size > 0 and doc_id is not null").groupBy("size", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.min("bands").alias("bands"))
    classes = written(classes, "classes")
    edges = search(classes.select(F.col("rep").alias("doc_id"), "size", "bands"), documents, n, least, frequent_shingles(signed))
    # an id with several sets belongs to several classes and joins them
    clashes = signed.where("size > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("size", "d1", "d2")).alias("low"), F.max(F.struct("size", "d1", "d2")).alias("high")).where("low <> high").select("doc_id")
    several = signed.where("size > 0").join(written(clashes, "clashes"), "doc_id").join(classes, ["size", "d1", "d2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    every = edges.select("a", "b").unionByName(several)
    parts = written(connected_components(every, "a", "b").withColumnRenamed("id", "rep"), "parts")
    dropped(edges)
    named = classes.select("size", "d1", "d2", "rep").join(parts, "rep", "left").select("size", "d1", "d2", F.coalesce("component_id", "rep").alias("component_id"))
    # documents of one class with one id more than once stay as rows
    out = signed.where("size >= 0").select("doc_id", "size", "d1", "d2").join(named, ["size", "d1", "d2"], "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def search(reps: DataFrame, documents: DataFrame, n: int, least: Fraction, frequent: np.ndarray) -> DataFrame:
    """Edges (a, b) that join all linked sets; ``reps`` (doc_id, size, bands) has each distinct set once."""
    num, den = least.numerator, least.denominator
    spread = reps.select("doc_id", F.explode("bands").alias("band"))
    centres = spread.groupBy("band").agg(F.min("doc_id").alias("centre"), F.count("*").alias("n")).where("n > 1").select("band", "centre")
    centres = written(centres, "centres")  # a table: then Spark can split a large band's side of the join
    stars = written(spread.join(centres, "band").where("doc_id <> centre").select(F.col("doc_id").alias("a"), F.col("centre").alias("b")).distinct(), "stars")
    edges = written(verify(stars, documents, n, least), "verified")
    parts = written(connected_components(edges, "a", "b"), "groups")
    labelled = reps.select("doc_id").distinct().join(parts.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("group"))
    labelled = written(labelled, "labelled")
    dropped(centres, stars, parts)

    def run(batches):
        import zstandard

        unpack, share = zstandard.ZstdDecompressor().decompress, Fraction(num, den)
        for part in pieces_of(batches, 256):
            sets = sets_of([unpack(x) for x in part.column(2).to_pylist()], n)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([keys_of(s, share, frequent).view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([bitmap(s) for s in sets], pa.binary())], names=["doc_id", "group", "size", "keys", "bits"])

    text = labelled.select(F.col("doc_id").alias("rep"), "group").join(packed(documents), F.col("rep") == F.col("doc_id")).select("doc_id", "group", "packed")
    routed = written(text.mapInArrow(run, "doc_id long, `group` long, size long, keys array<long>, bits binary"), "routed")
    # Keys are shuffled once: the counts read the same columns as the join, so that both use one exchange
    keyed = routed.select("doc_id", "group", "size", F.explode("keys").alias("key")).repartition("key")
    mixed = keyed.groupBy("key").agg(F.min("group").alias("g0"), F.max("group").alias("g1"), F.expr("count(doc_id, size)").alias("n")).where("g0 <> g1")
    shared = written(keyed.join(mixed.select("key", "n"), "key"), "shared")
    met = written(ranges(shared, num, den), "met")
    once = met.where("doc_id = first").groupBy("n", "first", "last", "all").agg(F.min("range").alias("range"))
    open_ranges = written(once.select("range", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "open")
    part, every_part = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = met.select("range", "doc_id").join(open_ranges, "range").select("range", "doc_id", part.alias("part"), F.explode(every_part).alias("other"))
    side = F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 0).otherwise(1)
    hits = written(dealt.select(F.xxhash64("range", F.least("part", "other"), F.greatest("part", "other")).alias("block"), "doc_id", side.alias("side")), "hits")
    dropped(labelled, shared, met, open_ranges)

    def pairs_of(blocks: DataFrame, groups: DataFrame, one_each: bool) -> DataFrame:
        full = blocks.join(groups, "doc_id").join(routed.select("doc_id", "size", "bits"), "doc_id").select("block", "doc_id", "group", "size", "side", "bits")
        return full.repartition("block").sortWithinPartitions("block").mapInArrow(lambda b: tree_pairs(b, Fraction(num, den), one_each), "a long, b long, block long, more boolean")

    # Two groups that many links join need one of them: the best pair of each block first, then whatever may join the rest
    best = written(pairs_of(hits, routed.select("doc_id", "group"), True), "best")
    first = written(verify(best.select("a", "b").distinct(), documents, n, least), "verified")

    def between(pairs: DataFrame, groups: DataFrame) -> DataFrame:
        left, right = (groups.select(F.col("doc_id").alias(k), F.col("group").alias(g)) for k, g in (("a", "x"), ("b", "y")))
        return pairs.join(left, "a").join(right, "b")

    merged = connected_components(between(first, routed.select("doc_id", "group")).select("x", "y"), "x", "y").select(F.col("id").alias("group"), "component_id")
    now = written(routed.select("doc_id", "group").join(merged, "group", "left").select("doc_id", F.coalesce("component_id", "group").alias("group")), "now")
    again = written(between(best.where("more"), now).where("x <> y").select("block").distinct(), "again")
    rest = written(pairs_of(hits.join(again, "block", "left_semi"), now, False).select("a", "b").distinct(), "rest")
    second = written(verify(rest, documents, n, least), "verified")
    every = written(edges.unionByName(first).unionByName(second), "links")
    dropped(routed, hits, edges, best, first, now, again, rest, second)
    return every


def ranges(met: DataFrame, num: int, den: int) -> DataFrame:
    """Parts of the keys (key, n, doc_id, group, size) that hold two groups: doc_id, range, n, first, last, all.

    A key of BLOCK documents or fewer is cut wherever the next larger set is too large for a link; no link crosses such
    a cut. ``n``, ``first``, ``last`` and ``all`` tell which documents a range has.
    """
    small, large = met.where(F.col("n") <= BLOCK), met.where(F.col("n") > BLOCK)
    by_size = Window.partitionBy("key").orderBy("size")
    gap = (den * F.lag("size").over(by_size) < num * F.col("size")).cast("int")
    small = small.withColumn("gap", F.coalesce(gap, F.lit(0))).withColumn("at", F.sum("gap").over(by_size))
    of = Window.partitionBy("key", "at")
    # a sum, as repeated ids would cancel out in an exclusive or; 30 bits each, so that it can't overflow below 2**33 rows
    facts = [F.count("*"), F.min("doc_id"), F.max("doc_id"), F.sum(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))]
    names = ["n", "first", "last", "all"]
    small = small.select("doc_id", F.xxhash64("key", "at").alias("range"), *[f.over(of).alias(x) for f, x in zip(facts, names, strict=True)], (F.min("group").over(of) != F.max("group").over(of)).alias("two"))
    whole = large.groupBy("key").agg(*[f.alias(x) for f, x in zip(facts, names, strict=True)])
    large = large.select("key", "doc_id").join(whole, "key").select("doc_id", F.xxhash64("key", F.lit(0).cast("bigint")).alias("range"), *names)
    return small.where("two").drop("two").unionByName(large)


def tree_pairs(batches: Iterator[pa.RecordBatch], least: Fraction, one_each: bool = False) -> Iterator[pa.RecordBatch]:
    """Blocks (block, doc_id, group, size, side, bits) to the pairs of documents that their trees leave.

    With ``one_each`` that is for two groups the one pair whose bitmaps differ least for its size; ``more`` tells that
    the block has others of these groups.
    """
    for group in grouped(batches):
        if group.num_rows < 2:
            continue
        ids, groups, sizes, side = (group.column(i).to_numpy() for i in (1, 2, 3, 4))
        if (groups == groups[0]).all():
            continue
        raw, sizes = group.column(5).to_pylist(), sizes.astype(np.int64)
        widths = np.array([len(x) * 8 for x in raw])
        found, near_by = [], []
        for bits in np.unique(widths):  # bitmaps of neighbouring widths are compared at the smaller
            near = np.flatnonzero((widths >= bits) & (widths * least.numerator <= 2 * bits * least.denominator))
            maps = np.stack([_fold(raw[i], int(bits)) for i in near])
            small, own = widths[near] == bits, side[near]
            for left, right in ((small, small), (small, ~small)):
                for x, y in ((2, 2),) if own[0] == 2 else ((0, 1),) if left is right else ((0, 1), (1, 0)):
                    p, q = np.flatnonzero(left & (own == x)), np.flatnonzero(right & (own == y))
                    if len(p) and len(q):
                        q = p if left is right and x == y else q
                        for i, j in candidate_pairs(p, q, sizes[near], maps, groups[near], least):
                            found.append((near[i], near[j]))
                            if one_each:
                                near_by.append(np.bitwise_count(maps[i] ^ maps[j]).sum(axis=1) / (sizes[near[i]] + sizes[near[j]]))
        if found:
            i, j = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
            more = np.zeros(len(i), dtype=bool)
            if one_each and len(i):
                x, y = np.minimum(groups[i], groups[j]), np.maximum(groups[i], groups[j])
                order = np.lexsort((np.concatenate(near_by), y, x))
                x, y = x[order], y[order]
                starts = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
                i, j, more = i[order[starts]], j[order[starts]], np.diff(starts, append=len(order)) > 1
            if len(i):
                block = pa.array(np.full(len(i), group.column(0)[0].as_py(), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(ids[i], ids[j])), pa.array(np.minimum(ids[i], ids[j])), block, pa.array(more)], names=["a", "b", "block", "more"])

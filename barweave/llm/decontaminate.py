"""Benchmark passages in documents, by SimHash windows of the items' own sizes; DataFrame functions only.

For an item of m words every window of m words of a document is of its size; a document of fewer words is one window.
A similarity counts shingles in any order, and moving a window on to its first shingle that the item has loses none of
those; so the best window starts at a shared shingle, or is the document's last one. Windows start there if they hold
enough shared shingles for the wanted similarity, so none is lost. A window's SimHash is
looked up among those of the items that made it start, by BLOCKS blocks of its bits, each within BLOCK_RADIUS bits:
every fingerprint within RADIUS bits is found, and a window never meets the other items of its size. Those pairs are
verified by their exact weighted shingle similarity, the sum of the smaller over the sum of the larger numbers of
occurrences.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from barweave.llm.shared import written

SHINGLE = 5
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
STRETCH = 8192  # words of a document whose windows are cut in one row
_MASKS = [sum(1 << b for b in c) for r in range(BLOCK_RADIUS + 1) for c in combinations(range(BLOCK_BITS), r)]


def word_hashes(text: Column) -> Column:
    """Hashes of a text's words: lower case, cut at white space."""
    clean = F.btrim(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(" \t\n\x0b\f\r"))
    return F.when(clean == "", F.array().cast("array<long>")).otherwise(F.transform(F.split(clean, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: F.xxhash64(w)))


def shingle_hashes(words: Column, k: int) -> Column:
    """Hashes of the k-word shingles of an array of word hashes, in order; none if it is shorter.

    ``words`` is a column that stands already: inside the loop an expression would be worked out for every element.
    """
    at = lambda i, j: F.get(words, i + j)
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[at(i, j) for j in range(k)]))).otherwise(F.array().cast("array<long>"))


def simhash(shingles: Column) -> Column:
    """The 64-bit SimHash of an array of hashes; one that occurs twice votes twice."""
    vote = lambda b: F.aggregate(shingles, F.lit(0), lambda acc, s: acc + F.when(F.call_function("shiftright", s, b).bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(F.when(vote(b) >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of the smaller over sum of the larger counts; where nothing occurs twice these are the sizes of sets."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    both = F.size(F.array_intersect(a, b))
    every = F.array_distinct(F.concat(a, b))
    count = lambda array, s: F.size(F.filter(array, lambda x: x == s))
    smaller = F.aggregate(every, F.lit(0), lambda acc, s: acc + F.least(count(a, s), count(b, s)))
    larger = F.aggregate(every, F.lit(0), lambda acc, s: acc + F.greatest(count(a, s), count(b, s)))
    return F.when(plain, both / (F.size(a) + F.size(b) - both)).otherwise(smaller / larger)


def _block(fingerprint: Column, block: Column) -> Column:
    return F.call_function("shiftrightunsigned", fingerprint, (block * BLOCK_BITS).cast("int")).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def found_near(probe: DataFrame, index: DataFrame) -> DataFrame:
    """The probes (item_id, m, block, value, print) that meet their item's fingerprint in the index, each window once.

    A pair can agree in several blocks; the row of the first of them stays, which needs no shuffle.
    """
    differ = F.col("print").bitwiseXOR(F.col("item_print"))
    close = F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda b: F.bit_count(_block(differ, b)) <= BLOCK_RADIUS)
    met = probe.join(index, ["item_id", "m", "block", "value"]).where(F.bit_count(differ) <= RADIUS)
    return met.where(F.array_position(close, True) == F.col("block") + 1)


def leaks(documents: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, item_id, similarity, first_word: each pair with a window of similarity ``least`` or more, at its best.

    A document of fewer words than an item is its one window of that item.
    An item of fewer than five words is one shingle. Null or empty texts and null ids have no leaks; items with equal
    texts are found each. Rows with one doc_id are windowed by themselves and reported under that id. Columns besides
    the ids and texts are not read. Tables that grow with the benchmark or with the leaks are written first, so that
    Spark broadcasts them if they are below its limit and shuffles otherwise.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_hashes(F.col("text")).alias("w")).where("item_id is not null and size(w) > 0")
    items = items.select("item_id", F.size("w").alias("m"), F.least(F.size("w"), F.lit(SHINGLE)).alias("k"), "w")
    parts = [items.where(F.col("k") == k).select("item_id", "m", "k", shingle_hashes(F.col("w"), k).alias("item_shingles")) for k in range(1, SHINGLE + 1)]
    items = parts[0]
    for part in parts[1:]:
        items = items.unionByName(part)
    items = written(items.withColumn("item_print", simhash(F.col("item_shingles"))), "items")
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # five at most
    places = written(items.select("item_id", "m", "k", F.posexplode("item_shingles").alias("item_at", "shingle")), "places")
    wanted = written(places.select("k", "shingle").distinct(), "wanted")

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    hits = None
    for k in sizes:
        grams = texts.select("doc_id", word_hashes(F.col("text")).alias("w")).select("doc_id", F.size("w").alias("n"), F.posexplode(shingle_hashes(F.col("w"), k)).alias("at", "shingle"))
        found = grams.join(wanted.where(F.col("k") == k).select("shingle"), "shingle", "left_semi").withColumn("k", F.lit(k))
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return texts.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("first_word")).where("false")
    shared = written(hits, "hits").join(places.select("item_id", "m", "k", "shingle").distinct(), ["k", "shingle"])
    shared = shared.groupBy("doc_id", "n", "item_id", "m", "k").agg(F.array_sort(F.collect_set("at")).alias("ats"))
    size = F.least(F.col("m"), F.col("n"))
    held = (size - F.col("k") + 1).alias("held")  # shingles of a window
    # in common >= least * (item's + window's - in common)
    need = F.greatest(F.lit(1), F.ceil(F.lit(least / (1 + least)) * (F.col("m") - F.col("k") + 1 + size - F.col("k") + 1) - 1e-9).cast("int")).alias("need")
    shared = shared.select("doc_id", "n", "item_id", "m", "k", "ats", held, need, (F.col("n") - size).alias("last")).where("size(ats) >= need")
    full = F.filter(F.sequence(F.lit(0), F.size("ats") - F.col("need")), lambda i: F.get(F.col("ats"), i + F.col("need") - 1) < F.get(F.col("ats"), i) + F.col("held"))
    begin = F.concat(F.transform(full, lambda i: F.least(F.get(F.col("ats"), i), F.col("last"))), F.array("last"))
    starts = shared.select("doc_id", "n", "item_id", "m", "k", F.explode(F.array_distinct(begin)).alias("start"))
    starts = starts.groupBy("doc_id", "n", "m", "k", "start").agg(F.collect_set("item_id").alias("item_ids"))
    stretch = F.floor(F.col("start") / STRETCH).alias("stretch")
    starts = starts.groupBy(F.col("doc_id").alias("of"), "n", stretch).agg(F.collect_list(F.struct("m", "k", "start", "item_ids")).alias("starts"))
    starts = written(starts, "starts")

    # Windows are cut before the rows multiply, so that no row but a stretch's carries the document
    own = texts.join(starts, F.col("doc_id") == F.col("of")).select("doc_id", "n", "starts", word_hashes(F.col("text")).alias("w")).where("n = size(w)")
    cut = F.transform("starts", lambda s: s.withField("window", F.slice("w", s["start"] + 1, F.least(s["m"], F.col("n")))))
    own = own.select("doc_id", F.explode(cut).alias("s")).select("doc_id", "s.*")
    shaped = F.lit(None).cast("array<long>")
    for k in sizes:
        shaped = F.when(F.col("k") == k, shingle_hashes(F.col("window"), k)).otherwise(shaped)
    windows = own.select("doc_id", "m", "item_ids", "start", shaped.alias("shingles"))
    windows = written(windows.withColumn("print", simhash(F.col("shingles"))), "windows")

    block = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block")
    probe = windows.select("doc_id", "m", "start", "shingles", "print", F.explode("item_ids").alias("item_id")).select("*", block)
    probe = probe.withColumn("value", _block(F.col("print"), F.col("block")))
    index = items.select("item_id", "m", "item_print", block)
    index = written(index.withColumn("value", F.explode(F.transform(F.lit(_MASKS), lambda mask: mask.cast("long").bitwiseXOR(_block(F.col("item_print"), F.col("block")))))), "index")
    near = found_near(probe, index)
    shapes = items.select("item_id", "m", "item_shingles").distinct()
    near = near.join(shapes, ["item_id", "m"])
    scored = near.select("doc_id", "item_id", "start", weighted_similarity(F.col("shingles"), F.col("item_shingles")).alias("similarity")).where(F.col("similarity") >= least)
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", -F.col("start"))).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.col2")).alias("first_word"))


def clean(documents: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """The documents without a leak, with all their columns; documents with a null id stay."""
    found = written(leaks(documents, benchmark, least).select(F.col("doc_id").alias("leaked")).distinct(), "leaked")
    return documents.join(found, F.col("doc_id").cast("long") == F.col("leaked"), "left_anti")

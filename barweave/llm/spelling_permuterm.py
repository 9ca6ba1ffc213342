"""Spelling variants: words one edit apart share a prefix of a rotation, so sorted rotations put them side by side.

A word ``x c y`` with its end marked is turned until the edited character ``c`` comes last: ``y $ x c``. A word that
differs in that place only has the same ``y $ x`` before it, and the word without it, ``x y``, has ``y $ x`` as a whole
rotation. So every rotation is a row under the prefix that skips its last character, every whole rotation a row under
itself; rows are sorted by prefix, and a scan of each run of equal prefixes meets all pairs one edit apart. A run holds
at most one word for each character of the alphabet and one word without it, however large the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from barweave.llm.shared import dropped, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = "$"  # no word has it
TYPO_EVERY = 31
LEAST_LETTERS = 7
LEAST_COUNT = 2
RATIO = 10
MOST_DOUBLINGS = 8
LONG = 64
SLICE = 1 << 16
PRIMES = ((2147483647, 911382323), (2147483629, 972663749), (2147483587, 1000000007 % 2147483587), (2147483579, 357913941))  # prime, base


def counted_words(documents: DataFrame, least: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, typo_every: int | None = None) -> DataFrame:
    """(word, n): runs of letters of whole texts, A-Z in lower case, of ``least`` code points and ``least_count`` occurrences at least.

    With ``typo_every`` a run loses the code point h mod its length if that number divides h, the crc32 of
    ``<doc_id>:<run>``. Null and empty texts have no words; a null doc_id counts as an empty string there. Columns other
    than doc_id and text aren't read. Words are counted within each task before they are shuffled, so a word that a
    third of all rows have is one row from each task.
    """
    run = F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}"), 0))
    low = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), run.alias("run")).select("doc", F.translate("run", UPPER, LOWER).alias("word"))
    if typo_every:
        rows = low.select("word", F.crc32(F.concat("doc", F.lit(":"), "word")).alias("h"))
        at = F.pmod("h", F.char_length("word")).cast("int")
        shorter = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
        low = rows.select(F.when(F.col("h") % typo_every == 0, shorter).otherwise(F.col("word")).alias("word")).where(F.char_length("word") >= least)
    return low.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """(key, c, n, indel): rotations without their last character ``c``, and whole rotations, with ``c`` null; of LONG characters at most.

    The word is ``x c y`` of the key ``y $ x``, so it doesn't travel beside it. ``indel``: the character isn't the one
    before it, so that a letter gone from a run of one letter is met once.
    """
    size = F.char_length("word")
    turn = words.where(size <= LONG).select("word", "n", F.explode(F.sequence(F.lit(0), 2 * size)).alias("t")).where((F.col("t") % 2 == 1) | (size < LONG))
    at, skips = F.shiftright("t", 1), F.col("t") % 2 == 1
    key = F.concat(F.substr("word", at + F.when(skips, 2).otherwise(1)), F.lit(END), F.substr("word", F.lit(1), at))
    rows = turn.select(key.alias("key"), F.when(skips, F.substr("word", at + 1, F.lit(1))).alias("c"), "n")
    return rows.withColumn("indel", F.col("c").isNotNull() & ~F.endswith(F.col("key"), F.col("c")))


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(int(out[-1]) * base % prime) % np.uint64(prime)])
    return out[:n]


def _digests(letters: np.ndarray, at: np.ndarray, skip: int) -> np.ndarray:
    """Polynomial hashes, two 62-bit numbers, of the rotations from ``at`` on, without the character there if ``skip``."""
    n, out = len(letters), []
    for prime, base in PRIMES:
        p, up, down = np.uint64(prime), _powers(base, prime, n + 2), _powers(pow(base, -1, prime), prime, n + 2)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(letters * up[:n] % p, dtype=np.uint64) % p])
        after = (sums[n] + p - sums[at + skip]) % p * down[at + skip] % p
        out.append((after + np.uint64(ord(END)) * up[n - at - skip] + sums[at] * up[n - at - skip + 1]) % p)
    return np.array([out[0] << np.uint64(31) | out[1], out[2] << np.uint64(31) | out[3]]).astype(np.int64)


def _turned(most: int):
    """``rotations`` of words of ``most`` characters and more under digests instead of the keys, in slices."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, n, name in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                letters = np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
                for skip in (1, 0) if len(letters) > most else (0,):
                    turns = np.arange(len(letters) + 1 - skip)
                    keys = _digests(letters, turns, skip)
                    for a in range(0, len(turns), SLICE):
                        at = turns[a : a + SLICE]
                        c = [word[i] for i in at] if skip else [None] * len(at)
                        indel = [bool(skip) and (i == 0 or word[i - 1] != word[i]) for i in at]
                        yield pa.RecordBatch.from_arrays([pa.array(keys[0, at]), pa.array(keys[1, at]), pa.array(c, pa.string()), pa.array([n] * len(at), pa.int64()), pa.array(indel), pa.array([name] * len(at), pa.string())], names=["key", "more", "c", "n", "indel", "id"])

    return run


def _scanned(rows: DataFrame, keys: Sequence[str], me: Column) -> DataFrame:
    """Rows that aren't alone under their key, with the two first words (d1, d2) that skip a character there, the first where that is an indel (e1), the whole rotation (short), and how many there are."""
    whole = Window.partitionBy(*keys).orderBy(F.desc("n"), "c").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    skips = F.col("c").isNotNull()
    first = lambda when, k=1: F.nth_value(F.when(when, me), k, True).over(whole)
    out = rows.select("*", first(skips).alias("d1"), first(skips, 2).alias("d2"), first(F.col("indel")).alias("e1"), first(~skips).alias("short"), F.count("c").over(whole).alias("nd"), F.count(F.when(F.col("indel"), 1)).over(whole).alias("ne"))
    out = out.withColumn("short", F.when(F.col("indel"), F.col("short")))
    near = F.when(skips, F.col("nd") - 1 + F.col("short").isNotNull().cast("long")).otherwise(F.col("ne"))
    return out.withColumn("near", near).where("near > 0")


def _seen(n: Column, word: Column) -> Column:
    """A neighbour; the least is the most frequent one, and of those the smallest word."""
    return F.when(n.isNotNull(), F.struct((-n).alias("less"), word.alias("word")))


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best_n, best): how many words are one insertion, deletion or replacement away, and the most frequent.

    ``words``: (word, n), words distinct and free of ``$``. Ties go to the smallest word in code-point order; best and
    best_n are null without a near word. No pair is written: of a run of equal prefixes each word needs the first two of
    the others only. A replacement has one prefix; an indel inside a run of one letter would have several, and counts
    once. Prefixes of over LONG characters are rows of fixed size, under digests, so that a word's rows take room in
    proportion to its length; a prefix is on one side of LONG for all words that share it.
    """
    skips, other = F.col("c").isNotNull(), F.when(F.col("d1.c") == F.col("c"), F.col("d2")).otherwise(F.col("d1"))
    before, after = F.substring_index("key", END, -1), F.substring_index("key", END, 1)
    word = lambda c: F.concat(before, F.coalesce(c, F.lit("")), after)
    best = lambda name: F.when(skips, F.least(_seen(other["n"], name(other)), _seen(F.col("short.n"), name(F.col("short"))))).otherwise(_seen(F.col("e1.n"), name(F.col("e1"))))
    met = _scanned(rotations(words), ["key"], F.struct("n", "c")).select(word(F.col("c")).alias("word"), "near", best(lambda x: word(x["c"])).alias("best"))
    long = words.where(F.char_length("word") >= LONG).withColumn("id", F.sha2("word", 256))
    if not long.isEmpty():
        turned = long.select("word", "n", "id").mapInArrow(_turned(LONG), "key long, more long, c string, n long, indel boolean, id string")
        found = _scanned(turned, ["key", "more"], F.struct("n", "c", "id"))
        # of a key's two kinds of neighbours each is looked up by its id; the first carries the count
        kinds = F.array(F.struct(F.when(skips, other).otherwise(F.col("e1")).alias("o"), F.col("near").alias("near")), F.struct(F.when(skips, F.col("short")).alias("o"), F.lit(0).cast("long").alias("near")))
        links = found.select("id", F.explode(kinds).alias("k")).select("id", F.col("k.o.id").alias("other"), "k.near")
        names = long.select("id", "word")
        links = links.join(names, "id").join(long.select(F.col("id").alias("other"), F.col("word").alias("w"), F.col("n").alias("wn")), "other", "left")
        met = met.unionByName(links.select("word", "near", _seen(F.col("wn"), F.col("w")).alias("best")))
    own = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("struct<less:bigint,word:string>").alias("best"))
    out = own.unionByName(met.withColumn("n", F.lit(None).cast("long"))).groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return out.select("word", "n", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of forms, by doubling: each round follows twice as many steps.

    ``forms``: (word, form), a word once at most, no circle; else an error after MOST_DOUBLINGS rounds. Where a form is
    ten times as frequent a chain has 18 steps at most, so five rounds suffice.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(MOST_DOUBLINGS):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = written(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        dropped(now)
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        now = new
    raise RuntimeError(f"a chain of forms doesn't end after {MOST_DOUBLINGS} doublings")


def variants(documents: DataFrame, least: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO, typo_every: int | None = None) -> DataFrame:
    """Per word (``counted_words``): word, n, n_near, form, form_n, root.

    The form is the most frequent word one edit away (ties: the smallest), if it is ``ratio`` times as frequent, else
    null, as is form_n; the root is where the chain of forms ends, the word itself without a form. No texts, no rows.
    """
    words = written(counted_words(documents, least, least_count, typo_every), "words")
    found = neighbours(words)
    is_form: Column = F.col("best_n") >= ratio * F.col("n")
    found = written(found.select("word", "n", "n_near", F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "neighbours")
    dropped(words)
    ends = roots(found.where("form is not null").select("word", "form"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

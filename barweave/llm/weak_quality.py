"""Text quality from overlapping heuristic labellers, without gold labels.

Each labeller votes good, bad or neither, or finds nothing to look at. Expectation-maximisation over the counts of vote patterns, of which there
are at most 4 to the number of labellers, estimates how often each labeller votes what in either class. The
posteriors of a bounded sample of documents train a linear scorer on hashed features, which decides on every document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barweave.llm.batches import pieces_of
from barweave.llm.toxicity_cnn import FUNCTION_WORDS, _hash_words
from barweave.llm.words import as_bytes, mix, slices, tokenize

LABELLERS = ("capitals", "symbols", "repeated_shingles", "repeated_lines", "lone_marks", "exclamations", "line_ends", "function_words", "long_words", "repeated_neighbours")
GOOD, BAD, NONE, MISSING = 0, 1, 2, 3
SIZE = 1 << 16  # hashed features
_MARKS = np.zeros(256, dtype=bool)
_MARKS[[ord(c) for c in "#$%&*+/<=>@\\^_`{|}~[]!"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text the numbers that the labellers look at (NaN where there is nothing to look at); word hashes; first words."""
    hashes, starts, ends, first = tokenize(texts)
    known = np.sort(np.concatenate([_hash_words(x) for x in FUNCTION_WORDS.values()]))
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    common = np.concatenate([[0], np.cumsum(known[at] == hashes)])
    length = np.concatenate([[0], np.cumsum(ends - starts)])
    grams = mix(hashes[:-4] + mix(hashes[1:-3]) * np.uint64(3) + mix(hashes[2:-2]) * np.uint64(5) + mix(hashes[3:-1]) * np.uint64(7) + mix(hashes[4:]) * np.uint64(9)) if len(hashes) > 4 else hashes[:0]
    out = np.full((len(texts), len(LABELLERS)), np.nan)
    for i, text in enumerate(texts):
        a, b = first[i], first[i + 1]
        n = b - a
        if not n:
            continue
        raw = np.frombuffer(text, dtype=np.uint8)
        letters = _LETTER[raw].sum()
        lines = [x for x in text.split(b"\n") if x.strip()]
        if letters >= 20:
            out[i, 0] = _UPPER[raw].sum() / letters
        out[i, 1] = _MARKS[raw].sum() / len(raw)
        if n >= 24:
            out[i, 2] = 1 - len(np.unique(grams[a : b - 4])) / (n - 4)
        if len(lines) >= 3:
            out[i, 3] = 1 - len(set(lines)) / len(lines)
        out[i, 4] = ((ends[a:b] - starts[a:b] == 1) & _MARKS[raw[starts[a:b]]]).sum() / n
        out[i, 5] = text.count(b"!") / n
        if len(lines) >= 3:
            out[i, 6] = sum(x.rstrip()[-1:] in b".!?:;\"" for x in lines) / len(lines)
        if n >= 20:
            out[i, 7] = (common[b] - common[a]) / n
            out[i, 8] = (length[b] - length[a]) / n
        if n >= 6:
            out[i, 9] = (hashes[a + 1 : b] == hashes[a : b - 1]).mean()
    return out, hashes, first


def votes(stats: np.ndarray) -> np.ndarray:
    """Votes of the labellers, one column each."""
    # For each labeller, good on the one side of the first number, bad on the other side of the second.
    limits = [(0.12, 0.40), (0.02, 0.08), (0.08, 0.30), (0.34, 0.50), (0.03, 0.15), (0.10, 0.50), (0.60, 0.20), (0.15, 0.04), (6.5, 9.0), (0.05, 0.20)]
    out = np.full(stats.shape, NONE, dtype=np.int8)
    for j, (good, bad) in enumerate(limits):
        x = stats[:, j]
        with np.errstate(invalid="ignore"):
            out[:, j] = np.where(np.isnan(x), MISSING, np.where(x <= good if good < bad else x >= good, GOOD, np.where(x >= bad if good < bad else x <= bad, BAD, NONE)))
    return out


def pattern(v: np.ndarray) -> np.ndarray:
    return (v.astype(np.int64) * 4 ** np.arange(v.shape[1])).sum(axis=1)


def unpattern(p: np.ndarray) -> np.ndarray:
    return (p[:, None] // 4 ** np.arange(len(LABELLERS))) % 4


@dataclass
class LabelModel:
    prior: float  # of bad
    table: np.ndarray  # class x labeller x vote: how often

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """The probability that a document with these votes is good; a labeller that finds nothing says nothing."""
        logs = np.concatenate([np.log(self.table), np.zeros((2, self.table.shape[1], 1))], axis=2)
        score = [np.log(p) + logs[c][np.arange(v.shape[1])[None], v].sum(axis=1) for c, p in ((0, 1 - self.prior), (1, self.prior))]
        return 1 / (1 + np.exp(np.clip(score[1] - score[0], -50, 50)))

    def accuracies(self) -> dict[str, tuple[float, float]]:
        """For each labeller: of its votes on good documents the share that are good, on bad ones that are bad."""
        return {x: tuple(float(self.table[c, j, c] / self.table[c, j, :2].sum()) for c in (0, 1)) for j, x in enumerate(LABELLERS)}


def expectation_maximisation(v: np.ndarray, counts: np.ndarray, rounds: int = 100, smooth: float = 0.1) -> LabelModel:
    """Class shares and vote frequencies from patterns and their counts; it starts from bad where a labeller says so."""
    good = np.where((v == BAD).any(axis=1), 0.1, 0.9)
    model = LabelModel(0.5, np.full((2, v.shape[1], 3), 1 / 3))
    for _ in range(rounds):
        weight = np.stack([good * counts, (1 - good) * counts])
        table = np.stack([[[(weight[c] * (v[:, j] == k)).sum() + smooth for k in range(3)] for j in range(v.shape[1])] for c in (0, 1)])
        model = LabelModel(float(np.clip((weight[1].sum() + smooth) / (counts.sum() + 2 * smooth), 1e-3, 0.999)), table / table.sum(axis=2, keepdims=True))
        new = model.posterior(v)
        if np.abs(new - good).max() < 1e-6:
            break
        good = new
    return model


def _features(stats: np.ndarray) -> np.ndarray:
    """Hashed places of a document's statistics, in steps of a logarithmic scale; 0, whose weight stays 0, for none."""
    step = np.where(np.isnan(stats), -1, np.floor(np.log2(np.maximum(np.nan_to_num(stats), 1e-3)) * 2) + 20).astype(np.int64)
    place = (mix((step + 1).astype(np.uint64) * np.uint64(1000) + np.arange(stats.shape[1], dtype=np.uint64)) % np.uint64(SIZE - 1)).astype(np.int64) + 1
    return np.where(step < 0, 0, place)


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, stats: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The probability of good: places of the statistics, and the mean over the words' places."""
        sums = np.concatenate([[0.0], np.cumsum(self.weights[(hashes % np.uint64(SIZE)).astype(np.int64)], dtype=np.float64)])
        mean = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(1, np.diff(first))
        return 1 / (1 + np.exp(-np.clip(self.bias + self.weights[_features(stats)].sum(axis=1) + mean, -40, 40)))


def train_scorer(stats: np.ndarray, words: list[np.ndarray], target: np.ndarray, steps: int = 32_000, rate: float = 0.3, seed: int = 5) -> Scorer:
    """Logistic regression with soft targets, by about ``steps`` stochastic gradients with adaptive steps."""
    weights, square, bias = np.zeros(SIZE), np.full(SIZE, 1e-2), 0.0
    places, rng = _features(stats), np.random.default_rng(seed)
    counted = [np.unique((x % np.uint64(SIZE)).astype(np.int64), return_counts=True) for x in words]
    for _ in range(-(-steps // max(1, len(words)))):
        for i in rng.permutation(len(words)):
            at, n = counted[i]
            part = n / max(1, n.sum())
            miss = target[i] - 1 / (1 + np.exp(-np.clip(bias + weights[places[i]].sum() + (weights[at] * part).sum(), -40, 40)))
            bias += 0.01 * miss
            square[places[i]] += miss * miss
            weights[places[i]] += rate * miss / np.sqrt(square[places[i]])
            square[at] += (miss * part) ** 2
            weights[at] += 0.1 * rate * miss * part / np.sqrt(square[at])
            weights[0] = 0.0
    return Scorer(weights, bias)


def _read(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fit(documents: DataFrame, sample_rows: int = 4000) -> tuple[LabelModel, Scorer]:
    """Vote patterns are counted over all documents; the scorer is fitted to at most ``sample_rows`` of them.

    The sample is the first documents by hash of id and text, so patterns have about their share in it. Null and empty
    texts count like others; an empty table gives a scorer that knows nothing. Of what comes to the driver the patterns
    are at most 4**10 and the sample is bounded.
    """

    def run(batches):
        for batch in pieces_of(batches):
            texts = as_bytes(batch.column(1))
            for a, b in slices(texts):
                found = pattern(votes(statistics(texts[a:b])[0]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found)], names=["doc_id", "pattern"])

    def words(batches):
        for batch in pieces_of(batches):
            texts = as_bytes(batch.column(1))
            for a, b in slices(texts):
                stats, hashes, first = statistics(texts[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(pattern(votes(stats))), pa.array(list(stats), pa.list_(pa.float64())), pa.array([hashes[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["pattern", "stats", "words"])

    voted = _read(documents).mapInArrow(run, "doc_id long, pattern long")
    # one pass: each pattern's count and one sampling bound, the hash below which about enough of its documents lie
    counted = voted.groupBy("pattern").agg(F.count("*").alias("n")).collect()
    if not counted:
        return expectation_maximisation(np.zeros((1, len(LABELLERS)), dtype=np.int64), np.zeros(1)), Scorer(np.zeros(SIZE), 0.0)
    patterns, counts = np.array([r["pattern"] for r in counted]), np.array([float(r["n"]) for r in counted])
    model = expectation_maximisation(unpattern(patterns), counts)
    share = float(min(1.0, sample_rows / counts.sum()))
    spread = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) < int(share * 1_000_003) + 1
    got = _read(documents).where(spread).orderBy(F.xxhash64("doc_id", "text")).limit(sample_rows).select("doc_id", "text").mapInArrow(words, "pattern long, stats array<double>, words binary").toArrow()
    stats = np.array([[np.nan if x is None else x for x in row] for row in got.column("stats").to_pylist()], dtype=np.float64).reshape(-1, len(LABELLERS))
    sample = [np.frombuffer(x, dtype=np.uint64) for x in got.column("words").to_pylist()]
    target = model.posterior(unpattern(np.array(got.column("pattern").to_pylist(), dtype=np.int64))) if sample else np.empty(0)
    return model, train_scorer(stats, sample, target)


def score(documents: DataFrame, model: LabelModel, scorer: Scorer, least: float = 0.5) -> DataFrame:
    """Per document: doc_id, score (probability of good), posterior (of its votes alone), good (score >= ``least``).

    Null and empty texts get no votes and are scored by their missing statistics; repeated rows repeat; columns besides
    doc_id and text are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast((model, scorer))

    def run(batches):
        model, scorer = shared.value
        for batch in pieces_of(batches):
            texts = as_bytes(batch.column(1))
            for a, b in slices(texts):
                stats, hashes, first = statistics(texts[a:b])
                value = scorer.score(stats, hashes, first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(value), pa.array(model.posterior(votes(stats))), pa.array(value >= least)], names=["doc_id", "score", "posterior", "good"])

    return _read(documents).mapInArrow(run, "doc_id long, score double, posterior double, good boolean")


def keep_good(documents: DataFrame, model: LabelModel, scorer: Scorer, least: float = 0.5) -> DataFrame:
    """The documents that the scorer finds good, with all their columns; decided row by row, without a join.

    Null and empty texts are decided by their missing statistics, repeated rows alike, and null ids stay as they are.
    """
    shared = documents.sparkSession.sparkContext.broadcast((model, scorer))
    place = documents.columns.index("text")

    def run(batches):
        _, scorer = shared.value
        for batch in pieces_of(batches):
            texts = as_bytes(batch.column(place))
            for a, b in slices(texts):
                stats, hashes, first = statistics(texts[a:b])
                yield batch.slice(a, b - a).filter(pa.array(scorer.score(stats, hashes, first) >= least))

    return documents.mapInArrow(run, documents.schema)

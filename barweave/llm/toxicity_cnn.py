"""Toxicity by a small convolutional text classifier, trained on all labelled rows by numpy in Spark's tasks.

Words become rows of a hashed embedding table; words that the labelled texts hardly have share one row. Filters over
one, two and three words, a rectifier and a maximum over the whole text feed a logistic unit. Thresholds are calibrated
by language, which is told from the text's own function words; no column but the text enters a score.

Applied to a text, a filter's part for one word depends on the word's row only, so those products are made once as
tables and a text is scored by adding table rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barweave.llm.batches import grouped
from barweave.llm.shared import dropped, packed_among, written
from barweave.llm.words import as_bytes, slices, tokenize

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with as was on are be this by from at or have not".split(),
    "fr": "le la les de des du et un une est que qui dans pour par sur pas avec au ou".split(),
    "de": "der die das und ist ein eine von zu mit auf für den dem nicht sich des im als auch".split(),
    "es": "el la los las de del y en que un una es por con para no se su al lo".split(),
}
LANGUAGES = [*FUNCTION_WORDS, "other"]
PAD = 0  # row of the padding between texts
RARE = 1  # row of words that the labelled texts hardly have
STEPS = 256  # of a logit's unit, when thresholds are chosen
WIDTHS = (1, 2, 3)
_BARE = bytes(32 if 32 < i < 127 and not chr(i).isalnum() else i for i in range(256))
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def _hash_words(words: list[str]) -> np.ndarray:
    return tokenize([" ".join(words).encode()])[0]


def read_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, without ASCII punctuation, and each text's first one."""
    hashes, _, _, first = tokenize([x.translate(_BARE) for x in texts])
    return hashes, first


def _language_table() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of function words, sorted, and for each the languages that have it, one column each."""
    own = {k: set(_hash_words(v).tolist()) for k, v in FUNCTION_WORDS.items()}
    every = np.array(sorted(set().union(*own.values())), dtype=np.uint64)
    return every, np.array([[h in own[k] for k in FUNCTION_WORDS] for h in every.tolist()], dtype=np.float32)


def languages(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text the index in LANGUAGES of the language whose function words it has most."""
    every, table = _language_table()
    at = np.minimum(np.searchsorted(every, hashes), len(every) - 1)
    hit = np.where((every[at] == hashes)[:, None], table[at], 0)
    sums = np.concatenate([np.zeros((1, table.shape[1])), np.cumsum(hit, axis=0, dtype=np.float64)])
    counts = sums[first[1:]] - sums[first[:-1]]
    return np.where(counts.max(axis=1) > 0, counts.argmax(axis=1), len(FUNCTION_WORDS))


@dataclass
class Network:
    known: np.ndarray  # hashes of the labelled texts' words, sorted
    rows: int
    embed: np.ndarray
    filters: list[np.ndarray]  # for each width: width x dimensions x filters
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: np.ndarray  # of the logit, by language
    scale: float = 1.0

    def index(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(hashes), RARE, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, 2 + (hashes % np.uint64(self.rows - 2)).astype(np.int64), RARE)

    def tables(self) -> list[list[np.ndarray]]:
        return [[self.embed @ w[j] for j in range(len(w))] for w in self.filters]

    def logits(self, index: np.ndarray, first: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """Of texts whose words' rows are ``index``, text i from ``first[i]`` to ``first[i + 1]``."""
        n, gap = len(first) - 1, max(WIDTHS)
        place = np.arange(len(index)) + gap * np.repeat(np.arange(n), np.diff(first))
        padded = np.full(len(index) + gap * n + gap, PAD, dtype=np.int64)
        padded[place] = index
        starts = first[:-1] + gap * np.arange(n)
        total = np.full(n, self.out_bias, dtype=np.float64)
        at = 0
        for table, bias in zip(tables, self.bias, strict=True):
            size = len(padded) - gap
            z = table[0][padded[:size]]
            for j in range(1, len(table)):
                z += table[j][padded[j : j + size]]
            best = np.maximum(np.maximum.reduceat(z, starts, axis=0) + bias, 0)
            total += best @ self.out[at : at + len(bias)]
            at += len(bias)
        return total


@dataclass
class Training:
    """A network and its optimisers' state, as a step leaves them."""

    net: Network
    m: list[np.ndarray]
    v: list[np.ndarray]
    square: np.ndarray  # of the embedding rows' gradients
    scalars: np.ndarray  # the output bias, its two moments, and the steps so far

    def dense(self) -> list[np.ndarray]:
        return [*self.net.filters, *self.net.bias, self.net.out]


def begin(known: np.ndarray, *, rows: int = 1 << 15, dims: int = 12, per_width: int = 6, seed: int = 11) -> Training:
    rng = np.random.default_rng(seed)
    net = Network(known, rows, (rng.normal(size=(rows, dims)) * 0.1).astype(np.float32), [(rng.normal(size=(w, dims, per_width)) * (0.6 / np.sqrt(w * dims) * 2)).astype(np.float32) for w in WIDTHS], [np.zeros(per_width, np.float32) for _ in WIDTHS], (rng.normal(size=per_width * len(WIDTHS)) * 0.5).astype(np.float32), 0.0, np.zeros(len(LANGUAGES)))
    net.embed[PAD] = 0
    dense = [*net.filters, *net.bias, net.out]
    return Training(net, [np.zeros_like(x) for x in dense], [np.zeros_like(x) for x in dense], np.full(rows, 1e-6, dtype=np.float32), np.zeros(4))


def epoch(state: Training, index: list[np.ndarray], labels: np.ndarray, part: np.ndarray, rng: np.random.Generator, batch: int = 48, rate: float = 0.01) -> np.ndarray:
    """One pass over texts given as rows of the embedding, in place; ``part`` weighs them. Tells which rows were met."""
    net, m, v, square, dense = state.net, state.m, state.v, state.square, state.dense()
    dims, per_width, gap = net.embed.shape[1], len(net.bias[0]), max(WIDTHS)
    bias_m, bias_v, step = state.scalars[1], state.scalars[2], int(round(state.scalars[3]))
    met = np.zeros(len(net.embed), dtype=bool)
    met[RARE] = True
    for at in np.array_split(rng.permutation(len(index)), max(1, len(index) // batch)):
        step += 1
        lengths = np.array([len(index[i]) for i in at])
        padded = np.concatenate([np.concatenate([index[i], np.full(gap, PAD)]) for i in at])
        starts = np.concatenate([[0], np.cumsum(lengths + gap)])
        padded = np.concatenate([padded, np.full(gap, PAD)])
        size = len(padded) - gap
        tops, where = [], []
        for w, filt in enumerate(net.filters):
            z = net.embed[padded[:size]] @ filt[0]
            for j in range(1, len(filt)):
                z += net.embed[padded[j : j + size]] @ filt[j]
            pos = np.stack([starts[i] + z[starts[i] : starts[i + 1]].argmax(axis=0) for i in range(len(at))])
            where.append(pos)
            tops.append(np.take_along_axis(z, pos, axis=0) + net.bias[w])
        pre = np.concatenate(tops, axis=1)
        kept = rng.random(pre.shape) < 0.8
        act = np.maximum(pre, 0) * kept / 0.8
        logit = act @ net.out + net.out_bias
        miss = ((1 / (1 + np.exp(-logit)) - labels[at]) * part[at] / len(at)).astype(np.float32)
        g_out = act.T @ miss + 1e-4 * net.out
        back = (miss[:, None] * net.out[None]) * (pre > 0) * kept / 0.8
        g_filters, g_bias, g_rows, g_vals = [], [], [], []
        for w, filt in enumerate(net.filters):
            g = back[:, w * per_width : (w + 1) * per_width]
            g_bias.append(g.sum(axis=0))
            grad = np.zeros_like(filt)
            for j in range(len(filt)):
                word = padded[where[w] + j]  # text x filter
                grad[j] = np.einsum("tfd,tf->df", net.embed[word], g)
                g_rows.append(word.ravel())
                g_vals.append((g[:, :, None] * filt[j].T[None]).reshape(-1, dims))
            g_filters.append(grad)
        for i, g in enumerate([*g_filters, *g_bias, g_out]):
            m[i] += 0.1 * (g - m[i])
            v[i] += 0.001 * (g * g - v[i])
            dense[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        g = float(miss.sum())
        bias_m += 0.1 * (g - bias_m)
        bias_v += 0.001 * (g * g - bias_v)
        net.out_bias -= rate * (bias_m / (1 - 0.9**step)) / (np.sqrt(bias_v / (1 - 0.999**step)) + 1e-8)
        touched, turn = np.unique(np.concatenate(g_rows), return_inverse=True)
        total = np.zeros((len(touched), dims), dtype=np.float32)
        np.add.at(total, turn, np.concatenate(g_vals))
        square[touched] += (total * total).mean(axis=1)
        met[touched] = True
        net.embed[touched] -= rate * 6 * total / (np.sqrt(square[touched])[:, None] + 1e-6)
        net.embed[PAD] = 0
        net.embed[RARE] *= 0.5  # a rare word says little
    state.scalars[:] = net.out_bias, bias_m, bias_v, step
    return met


def least_texts(texts: int, share: float = 0.003, bounds: tuple[int, int] = (2, 8), floor: float = 0.001) -> int:
    """How many of so many texts must have a word to make it known: a share kept within bounds, but not under ``floor``.

    The last bounds the known words by the mean number of distinct words of a text over ``floor``.
    """
    return max(min(max(bounds[0], round(share * texts)), bounds[1]), int(np.ceil(floor * texts)))


def constant(label: int) -> Network:
    """A network that gives every text the same label."""
    net = begin(np.empty(0, np.uint64), rows=2).net
    net.out[:] = 0
    net.out_bias = 10.0 if label else -10.0
    return net


def calibrate(net: Network, logits: np.ndarray, labels: np.ndarray, weights: np.ndarray, langs: np.ndarray) -> None:
    """Thresholds by language from logits that stand for ``weights`` texts each; the common one where a language has few."""
    overall = best_threshold(logits, labels, weights)
    for k in range(len(LANGUAGES)):
        own = langs == k
        enough = all(weights[own & (labels == y)].sum() >= 20 for y in (0, 1))
        net.thresholds[k] = best_threshold(logits[own], labels[own], weights[own]) if enough else overall


def train(samples: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, langs: np.ndarray, *, epochs: int = 4, seed: int = 11, **shape: int) -> Network:
    """Fit a network here to texts given as arrays of word hashes; ``weights``: how many rows each one stands for.

    A table's rows are trained on by ``fit`` instead, with the same steps.
    """
    if not len(samples) or labels.min() == labels.max():
        return constant(int(len(samples) > 0 and labels.max() == 1))
    words, texts = np.unique(np.concatenate([np.unique(x) for x in samples]), return_counts=True)
    state, rng = begin(words[texts >= least_texts(len(samples))], seed=seed, **shape), np.random.default_rng(seed)
    index = [state.net.index(x) for x in samples]
    part = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    for _ in range(epochs):
        epoch(state, index, labels, part, rng)
    calibrate(state.net, _logits(state.net, index, state.net.tables()), labels, weights, langs)
    return state.net


def _logits(net: Network, index: list[np.ndarray], tables: list[list[np.ndarray]]) -> np.ndarray:
    out = [np.empty(0)]
    for a in range(0, len(index), 512):
        first = np.concatenate([[0], np.cumsum([len(x) for x in index[a : a + 512]])]).astype(np.int64)
        out.append(net.logits(np.concatenate([*index[a : a + 512], np.empty(0, np.int64)]).astype(np.int64), first, tables))
    return np.concatenate(out)


def best_threshold(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The logit with the best F1, in the middle of the gap between the neighbouring texts."""
    order = np.argsort(-logits, kind="stable")
    hit, wrong = np.cumsum(labels[order] * weights[order]), np.cumsum((1 - labels[order]) * weights[order])
    f1 = 2 * hit / (hit + wrong + (labels * weights).sum())
    f1[:-1][logits[order][:-1] == logits[order][1:]] = -1  # no cut between equal logits
    k = int(f1.argmax())
    low = logits[order[k + 1]] if k + 1 < len(order) else logits[order[k]] - 1
    return float((logits[order[k]] + low) / 2)


CHUNK = 1024  # embedding rows that travel together


def _chunks(state: Training, met: np.ndarray) -> list[tuple[int, bytes]]:
    """A worker's state in parts that can be added up: embedding rows it met with their squares and a one, then the rest."""
    rows = np.concatenate([state.net.embed, state.square[:, None], np.ones((len(met), 1))], axis=1, dtype=np.float32) * met[:, None]
    rest = np.concatenate([*(x.ravel() for x in (*state.dense(), *state.m, *state.v)), state.scalars, [1.0]]).astype(np.float64)
    return [(-1, rest.tobytes()), *((at // CHUNK, rows[at : at + CHUNK].tobytes()) for at in range(0, len(rows), CHUNK) if met[at : at + CHUNK].any())]


def _set(state: Training, sums: dict[int, np.ndarray]) -> None:
    """The mean of the workers' states; an embedding row's is over those that met it."""
    for k, rows in sums.items():
        if k >= 0:
            rows, at = rows.reshape(-1, state.net.embed.shape[1] + 2), k * CHUNK
            own = np.flatnonzero(rows[:, -1] > 0)
            mean = rows[own, :-1] / rows[own, -1:]
            state.net.embed[at + own], state.square[at + own] = mean[:, :-1], mean[:, -1]
    rest, at = sums[-1][:-1] / sums[-1][-1], 0
    for x in (*state.dense(), *state.m, *state.v):
        x[...] = rest[at : at + x.size].reshape(x.shape)
        at += x.size
    state.scalars[:] = rest[at:]
    state.net.out_bias = float(state.scalars[0])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts (chunk, worker, part), sorted by chunk and worker, to one sum for each chunk."""
    now, total = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["chunk", "total"])
    for batch in batches:
        for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            value = np.frombuffer(raw.as_py(), dtype=np.float64 if chunk < 0 else np.float32).astype(np.float64)
            if chunk == now:
                total += value
                continue
            if total is not None:
                yield row()
            now, total = chunk, value
    if total is not None:
        yield row()


def fit(documents: DataFrame, labels: DataFrame, target: str = "toxic", epochs: int = 4, worker_rows: int = 8000) -> Network:
    """Train on every labelled row outside the held-out fifth.

    Rows are dealt by their id's hash to workers of about ``worker_rows`` each. A worker makes one pass over its rows from
    the common state; the states' means, summed by Spark in parts of fixed size, are the next pass's start. With one
    worker that is plain stochastic descent. Known words are counted over all of these rows, and thresholds are chosen from
    the counts of all their logits at steps of 1 / STEPS. What comes to the driver is the network, the known words (see
    ``least_texts``) and those counts. Rows with null ids or labels don't count; without labelled rows the network's
    scores are all 0.
    """
    spark = documents.sparkSession
    train_rows = labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)).select(F.col("doc_id").cast("long").alias("id"), F.col(target).cast("int").alias("y")).groupBy("id").agg(F.max("y").alias("y"))
    rows = written(packed_among(documents, train_rows.select("id")).join(train_rows, F.col("doc_id") == F.col("id")).select("doc_id", "y", "packed"), "labelled")
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        dropped(rows)
        return constant(max(totals, default=0))
    n = sum(totals.values())
    workers = -(-n // worker_rows)

    def read(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts = [unpack(x) for x in batch.column(2).to_pylist()]
            for a, b in slices(texts):
                yield batch.slice(a, b - a), *read_words(texts[a:b])

    def count(batches):
        for _, hashes, first in read(batches):
            found = [np.unique(hashes[x:y]) for x, y in zip(first[:-1], first[1:], strict=True)]
            words, texts = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(texts)], names=["word", "texts"])

    known = rows.mapInArrow(count, "word long, texts long").groupBy("word").agg(F.sum("texts").alias("texts")).where(F.col("texts") >= least_texts(n)).select("word").toArrow()
    state = begin(np.sort(known.column("word").to_numpy().view(np.uint64)))
    shared = spark.sparkContext.broadcast(state)

    def indexed(batches):
        net = shared.value.net
        for batch, hashes, first in read(batches):
            index = net.index(hashes).astype(np.uint16 if net.rows <= 1 << 16 else np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(languages(hashes, first), pa.int32()), pa.array([index[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["doc_id", "y", "lang", "words"])

    kind = np.uint16 if state.net.rows <= 1 << 16 else np.int32

    def gathered(batches):
        for group in grouped(batches, key=4):
            sizes = np.array([len(x) for x in group.column(3).to_pylist()], dtype=np.int64) // np.dtype(kind).itemsize
            parts = [group.column(1).to_numpy().astype(np.int8).tobytes(), group.column(2).to_numpy().astype(np.int8).tobytes(), sizes.tobytes(), b"".join(group.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([group.column(4).slice(0, 1), *(pa.array([x], pa.binary()) for x in parts)], names=["worker", "y", "lang", "sizes", "words"])

    def texts_of(batches):
        """Each worker's number, labels, languages and texts."""
        for batch in batches:
            for worker, y, lang, sizes, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cuts = np.cumsum(np.frombuffer(sizes, dtype=np.int64))[:-1]
                yield worker, np.frombuffer(y, dtype=np.int8), np.frombuffer(lang, dtype=np.int8), np.split(np.frombuffer(words, dtype=kind), cuts)

    dealt = rows.mapInArrow(indexed, "doc_id long, y int, lang int, words binary").withColumn("worker", F.pmod(F.xxhash64("doc_id"), F.lit(workers)).cast("int"))
    dealt = dealt.repartition("worker").sortWithinPartitions("worker", "doc_id", "words")
    table = written(dealt.mapInArrow(gathered, "worker int, y binary, lang binary, sizes binary, words binary"), "indexed")  # a row for each worker
    dropped(rows)
    for k in range(epochs):
        now = spark.sparkContext.broadcast(state)

        def walk(batches, k=k, now=now):
            for worker, y, _, texts in texts_of(batches):
                own = deepcopy(now.value)
                part = np.where(y == 1, 0.5 / totals[1], 0.5 / totals[0]) * n
                parts = _chunks(own, epoch(own, texts, y.astype(np.float32), part, np.random.default_rng([k, worker])))
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in parts], pa.int32()), pa.array([worker] * len(parts), pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=["chunk", "worker", "part"])

        sums = table.mapInArrow(walk, "chunk int, worker int, part binary").repartition("chunk").sortWithinPartitions("chunk", "worker").mapInArrow(_added, "chunk int, total binary")
        _set(state, {r["chunk"]: np.frombuffer(r["total"], dtype=np.float64) for r in sums.collect()})
        state.net.embed[PAD] = 0
    now = spark.sparkContext.broadcast(state.net)

    def judge(batches):
        net = now.value
        tables = net.tables()
        for _, y, lang, texts in texts_of(batches):
            logit = _logits(net, texts, tables)
            yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(np.rint(np.clip(logit, -30, 30) * STEPS).astype(np.int64))], names=["lang", "y", "at"])

    counts = table.mapInArrow(judge, "lang int, y int, at long").groupBy("lang", "y", "at").agg(F.count("*").alias("n")).orderBy("at", "y", "lang").toArrow()
    dropped(table)
    at, y, lang, weight = (counts.column(c).to_numpy() for c in ("at", "y", "lang", "n"))
    calibrate(state.net, at / STEPS, y, weight, lang)
    return state.net


def score(documents: DataFrame, net: Network) -> DataFrame:
    """A score for every whole text: doc_id, held_out, score, predicted.

    Null and empty texts are scored like any other, from the padding alone. Repeated rows repeat. A null doc_id isn't
    held out. Columns besides doc_id and text are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(net)  # its size is set by the parameters of train()

    def run(batches):
        own = shared.value
        tables = own.tables()
        for batch in batches:
            texts = as_bytes(batch.column(2))
            for a, b in slices(texts):
                hashes, first = read_words(texts[a:b])
                logit = own.logits(own.index(hashes), first, tables) - own.thresholds[languages(hashes, first)]
                value = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(value), pa.array((value >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)

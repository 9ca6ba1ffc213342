"""Words of many texts at once, as 64-bit numbers, in numpy.

A word is a run of bytes other than white space (0x20, 0x09-0x0D); A-Z count as a-z. Equal words have equal hashes
in every task and session. Two different words share a hash with a probability of about 2**-64.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

_WORD = np.ones(256, dtype=bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_powers: dict[str, np.ndarray] = {}
SLICE_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES * 2)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def tokenize(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words in order; the words' start and end bytes in their own text; each text's first word.

    The last array has one more entry than there are texts. Keep the texts of one call near ``SLICE_BYTES`` together;
    a longer text is read in parts that end at white space, so that the work needs some 25 bytes a word beside it.
    """
    if sum(map(len, texts)) <= 2 * SLICE_BYTES:
        return _tokenize(texts)
    found, counts = [], []
    for text in texts:
        at, own = 0, 0
        while at < len(text):
            end = _SPACE.search(text, at + SLICE_BYTES) if at + SLICE_BYTES < len(text) else None
            end = end.start() if end else len(text)
            hashes, starts, ends, _ = _tokenize([text[at:end]])
            found.append((hashes, starts + at, ends + at))
            own += len(hashes)
            at = end
        counts.append(own)
    hashes, starts, ends = (np.concatenate([x[k] for x in found]) for k in range(3))
    return hashes, starts, ends, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _tokenize(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    buffer = b" " + b" ".join(texts).lower() + b" "
    raw = np.frombuffer(buffer, dtype=np.uint8)
    word = _WORD[raw]
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    up, down = _power(len(raw))
    sums = np.empty(len(raw) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    at = np.concatenate([[1], 1 + np.cumsum(lengths + 1)])
    first = np.searchsorted(starts, at)
    own = np.repeat(at[:-1], np.diff(first))
    return hashes, starts - own, ends - own, first


def slices(texts: list[bytes], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together, at least one text each."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) > most:
            yield begin, i
            begin, size = i, 0
        size += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the hashes of its k-word shingles in order; a text of fewer words has one, of all its words."""
    total = np.zeros(max(0, len(hashes) - k + 1), dtype=np.uint64)
    for j in range(k):
        total += mix(hashes[j : j + len(total)] + np.uint64(j + 1)) * np.uint64(2 * j + 3)
    total = mix(total)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            out.append(total[a : b - k + 1])
        elif b > a:
            part = hashes[a:b] + np.arange(1, b - a + 1, dtype=np.uint64)
            whole = (mix(part) * (np.arange(b - a, dtype=np.uint64) * np.uint64(2) + np.uint64(3))).sum(dtype=np.uint64)
            out.append(mix(np.array([whole + np.uint64(b - a)], dtype=np.uint64)))
        else:
            out.append(total[:0])
    return out


def as_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null is empty."""
    return [x or b"" for x in column.cast("binary").to_pylist()]

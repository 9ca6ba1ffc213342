"""Exact dedup: compressed radix tries over whole texts, whose terminal nodes know their text's owner.

Every task puts the texts that it reads into one trie, so that a text which it has met a thousand times is one terminal
node with a count. A trie over its bytes gives up whole subtrees to the shuffle. What arrives is dealt by length and
content hash, and sorted by them; each run of one length and hash is again a trie, mostly of a single text, and closed
as soon as the run ends. Texts are told apart by their bytes in the tries, never by the hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barweave.llm.batches import pieces_of
from barweave.llm.shared import written
from barweave.llm.words import as_bytes

TRIE_BYTES = 48 << 20
NODE_BYTES = 300


class Node:
    __slots__ = ("children", "count", "label", "owner")

    def __init__(self, label: bytes, owner: int | None = None, count: int = 0) -> None:
        self.label, self.owner, self.count = label, owner, count
        self.children: dict[int, Node] = {}


def _shared(a: bytes, b: bytes, at: int) -> int:
    """How many first bytes ``a`` and ``b`` from ``at`` have in common, by halving."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _larger(a: int | None, b: int | None) -> int | None:
    return a if b is None else b if a is None else max(a, b)


class Trie:
    """A Patricia trie of byte strings; a terminal node holds the largest identifier and how often the string came."""

    def __init__(self, most_bytes: int = TRIE_BYTES) -> None:
        self.root, self.most, self.held = Node(b""), most_bytes, 0

    def insert(self, text: bytes, owner: int | None, count: int = 1) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                self.held += len(child.label) + NODE_BYTES
            elif not text.startswith(child.label, at):
                k = _shared(child.label, text, at)
                upper = node.children[text[at]] = Node(child.label[:k])
                child.label = child.label[k:]
                upper.children[child.label[0]] = child
                self.held += NODE_BYTES
                child = upper
            at += len(child.label)
            node = child
        node.owner, node.count = _larger(node.owner, owner), node.count + count

    def terminals(self, top: Node | None = None, before: bytes = b"") -> Iterator[tuple[bytes, int | None, int]]:
        """(string, owner, count) of each terminal node below ``top``, itself included."""
        stack = [(top or self.root, before)]
        while stack:
            node, path = stack.pop()
            path += node.label
            if node.count:
                yield path, node.owner, node.count
            stack.extend((child, path) for child in node.children.values())

    def _weights(self, top: Node) -> dict[int, int]:
        order, stack = [], [top]
        while stack:
            order.append(node := stack.pop())
            stack.extend(node.children.values())
        out: dict[int, int] = {}
        for node in reversed(order):
            out[id(node)] = len(node.label) + NODE_BYTES + sum(out[id(x)] for x in node.children.values())
        return out

    def spilled(self) -> Iterator[tuple[bytes, int | None, int]]:
        """While over ``most`` bytes: the heaviest subtrees' terminals, until half is free; they are pruned.

        The cut is made below the last node that holds over half of the trie, so that a common prefix stays.
        """
        if self.held <= self.most:
            return
        weights = self._weights(self.root)
        node, path = self.root, b""
        while (heavy := max(node.children.values(), key=lambda x: weights[id(x)])).children and weights[id(heavy)] > self.most // 2:
            node, path = heavy, path + heavy.label
        for child in sorted(node.children.values(), key=lambda x: -weights[id(x)]):
            del node.children[child.label[0]]
            self.held -= weights[id(child)]
            yield from self.terminals(child, path)
            if self.held <= self.most // 2:
                break


_PACKED = "size long, hash long, packed binary, owner long, n long"
_SCHEMA = pa.schema([("size", pa.int64()), ("hash", pa.int64()), ("packed", pa.binary()), ("owner", pa.int64()), ("n", pa.int64())])
OUT_BYTES = 4 << 20


def _partial(most_bytes: int):
    """(doc_id, text) batches to the packed terminals of a task's trie."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        trie, rows, size = Trie(most_bytes), [], 0

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)

        def drained(found: Iterable[tuple[bytes, int | None, int]]) -> Iterator[pa.RecordBatch]:
            nonlocal rows, size
            for text, owner, n in found:
                rows.append((len(text), xxhash.xxh3_64_intdigest(text) - (1 << 63), small := pack(text), owner, n))
                size += len(small) + 64
                if size >= OUT_BYTES:
                    yield sent()
                    rows, size = [], 0

        for part in pieces_of(batches, 256):
            for doc, text in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), strict=True):
                trie.insert(text.lower(), doc)
                if trie.held > trie.most:
                    yield from drained(trie.spilled())
        yield from drained(trie.terminals())
        if rows:
            yield sent()

    return run


def _owners(least: int):
    """Sorted packed terminals to (text_sha256, owner, n) of texts that came ``least`` times; one trie for each length and hash."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        trie, key = Trie(), None

        def closed() -> list[tuple[str, int | None, int]]:
            return [(hashlib.sha256(text).hexdigest(), owner, n) for text, owner, n in trie.terminals() if n >= least]

        for part in pieces_of(batches, 256):
            done = []
            for size, content, packed, owner, n in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True):
                if (size, content) != key:
                    done += closed()
                    trie, key = Trie(), (size, content)
                trie.insert(unpack.decompress(packed), owner, n)
            yield _named(done)
        yield _named(closed())

    return run


def _named(rows: list[tuple[str, int | None, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["text_sha256", "owner", "n"])


def owners(documents: DataFrame, least: int = 2, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(text_sha256, owner, n) of texts, A-Z in lower case, that ``least`` rows have; the owner is their largest doc_id.

    A null text is empty; the owner is null if all their ids are. One shuffle moves each distinct text of a task once
    (and again only where ``trie_bytes`` made the task give up its subtree), compressed; a text that a third of all rows
    have is one row from each task.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = rows.mapInArrow(_partial(trie_bytes), _PACKED)
    return parts.repartition("size", "hash").sortWithinPartitions("size", "hash").mapInArrow(_owners(least), "text_sha256 string, owner long, n long")


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in pieces_of(batches, 256):
        shas = [hashlib.sha256(x.lower()).hexdigest() for x in as_bytes(part.column(1))]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shas, pa.string())], names=["doc_id", "text_sha256"])


def membership(documents: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """A row for each row of ``documents``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after lower-casing A-Z; a null text is empty, and all empty texts are one group.
    keep_id is the group's largest doc_id, null if all are null; kept says that the row's doc_id is keep_id (of
    repeated rows with one id all are kept; rows with a null id are kept only where keep_id is null). Columns besides
    doc_id and text aren't read. An empty table gives an empty one.
    """
    groups = written(owners(documents, trie_bytes=trie_bytes), "owners")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(_digests, "doc_id long, text_sha256 string")
    out = rows.join(groups, "text_sha256", "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("owner"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def oracle() -> str:
    return """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents) AS x WINDOW w AS (PARTITION BY t)"""

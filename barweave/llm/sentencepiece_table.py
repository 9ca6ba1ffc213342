"""SentencePiece encoding and decoding by a table of distinct chunks.

In the model's vocabulary no piece holds a white-space marker after another character, and none holds a line feed.
So no merge crosses the start of a marked word or a line feed, and a text's pieces are those of its chunks in order.
Each worker process keeps a table of the distinct chunks that it has met in any of its tasks, segments each new one once
with the library and joins the ids back by position.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
_CHUNK = re.compile(r"\n| *[^ \n]+| +")
_BEFORE = "\n"  # in front of a chunk: the library's own leading marker then stays apart from it
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class ChunkTable:
    """Ids and decoded text of whole texts.

    Between texts chunks of ``longest`` characters at most are kept, and about ``most_bytes`` in all; then it starts anew.
    """

    def __init__(self, model: bytes, most_bytes: int = 96 << 20, longest: int = 64):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any(MARK in x.lstrip(MARK) or "\n" in x for x in pieces):
            raise ValueError("a piece crosses a white-space marker; its texts can't be cut into chunks")
        self.most_bytes, self.longest, self.bytes = most_bytes, longest, 0
        self.ids, self.odd, self.long = {}, {}, []
        self.begin, self.end = (x.to_bytes(4, "little") for x in (self.library.bos_id(), self.library.eos_id()))

    def learn(self, chunks: set[str]) -> None:
        for chunk in self.long:
            self.ids.pop(chunk, None)
            self.odd.pop(chunk, None)
        self.long = []
        if self.bytes > self.most_bytes:
            self.ids.clear()
            self.odd.clear()
            self.bytes = 0
        new = [x for x in chunks if x not in self.ids]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            found = self.library.encode([_BEFORE + x for x in part], num_threads=1)
            back = self.library.decode(found, num_threads=1)
            for chunk, ids, text in zip(part, found, back, strict=True):
                self.ids[chunk] = b"".join([x.to_bytes(4, "little") for x in ids[2:]])
                if text[1:] != chunk:
                    self.odd[chunk] = text[1:]
                if len(chunk) > self.longest:
                    self.long.append(chunk)
                else:
                    self.bytes += 200 + 2 * len(chunk) + 4 * len(ids)  # with what Python adds

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """For each text its ids, with begin and end, as little-endian 32-bit numbers, and their decoded text."""
        cut = [_CHUNK.findall(" " + x.replace(MARK, " ")) if x else [] for x in texts]
        self.learn({chunk for x in cut for chunk in x})
        for text, chunks in zip(texts, cut, strict=True):
            ids = b"".join(map(self.ids.__getitem__, chunks))
            if self.odd and not self.odd.keys().isdisjoint(chunks):
                back = "".join([self.odd.get(x, x) for x in chunks])[1:]
            else:
                back = text.replace(MARK, " ")
            yield self.begin + ids + self.end, back


_kept: dict[str, ChunkTable] = {}


def worker_table(model: bytes) -> ChunkTable:
    """The worker process's table for a model; Spark's workers go on from task to task."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _kept:
        _kept.clear()  # one model at a time
        _kept[key] = ChunkTable(model)
    return _kept[key]


def encode_documents(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each whole text; one row per input row.

    Null and empty texts have the begin and end ids only and decode to the empty text. Repeated rows stay. A null id
    stays null. Other columns of ``df``, whatever their names, are not read. ``model`` goes to the tasks as it is: its
    size is the model file's. See ``ChunkTable`` for the ids themselves.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        table = worker_table(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts, hashes, decoded = [], [], []
                for ids, text in table.encode([x or "" for x in part.column(1).to_pylist()]):
                    counts.append(len(ids) // 4)
                    hashes.append(hashlib.sha256(ids).hexdigest())
                    decoded.append(hashlib.sha256(text.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, SCHEMA)


def encode_ids(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids themselves: doc_id, ids array<int>, decoded string; nulls and ties as in ``encode_documents``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import numpy as np

        table = worker_table(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = list(table.encode([x or "" for x in part.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([np.frombuffer(x, dtype="<i4") for x, _ in got], pa.list_(pa.int32())), pa.array([x for _, x in got], pa.string())], names=["doc_id", "ids", "decoded"])

    return df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")

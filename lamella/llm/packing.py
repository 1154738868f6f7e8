"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

Lengths fall into reciprocal-capacity classes: a document of class k is longer than 1 / (k + 1) of a sequence and not
longer than 1 / k, and a bin of class k holds exactly k documents, whole. Which bin a document goes to depends only on
what its own task has seen, so every task packs for itself and nothing is shuffled.

A document longer than a sequence is cut into whole sequences and a tail. What k documents leave free of their bin is
filled with pieces of such tails, or, where there is none, of the next document; free space below a 64th of the
capacity stays. At its end a task strings together what waits in incomplete bins and cuts it into sequences, the last
of them into powers of two, which need no padding.

Null text is an empty text, which is one end token. Null doc_ids and repeated rows are packed like any other row.
Extra columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import re
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import slices

#: Words whose ids a worker remembers; the memory is emptied when it is full.
REMEMBERED = 400_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ENCODERS: dict = {}


class Encoder:
    """Byte-level BPE ids as the tokenizers library gives them, word by word with a memory.

    A space that follows a non-space ends a pre-token and no merge crosses it, so a text without other runs of
    spaces is encoded piece by piece. Unknown pieces go through the same vocabulary's ranks, which takes a tenth
    of the time for a single word. Texts with runs of white space or special-token marks go through the
    tokenizers library whole.
    """

    def __init__(self, tokenizer: str, ranks: str, pattern: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer)
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.word = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=table, special_tokens={})._core_bpe.encode_ordinary
        self.memory: dict[str, bytes] = {}
        self.odd = re.compile(r"\s |<\|")

    def ids(self, text: str) -> np.ndarray:
        if self.odd.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4")
        if not text:
            return np.zeros(0, "<u4")
        memory = self.memory
        if len(memory) > REMEMBERED:
            memory.clear()
        head, *rest = text.split(" ")
        out = [np.array(self.word(head), dtype="<u4").tobytes()]
        for piece in rest:
            known = memory.get(piece)
            if known is None:
                known = memory[piece] = np.array(self.word(" " + piece), dtype="<u4").tobytes()
            out.append(known)
        return np.frombuffer(b"".join(out), dtype="<u4")


def encoder(tokenizer: str | None = None, ranks: str | None = None, pattern: str | None = None) -> Encoder:
    """One encoder for each worker process; the files default to the public ones of byte_bpe_50k."""
    import public_tokenizers

    key = (tokenizer or public_tokenizers.path("byte_bpe_50k.json"), ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


class Piece:
    """Tokens of a document from `start` on: four bytes each in data, of `total` in the document."""

    def __init__(self, doc_id, start: int, data: bytes, total: int):
        self.doc_id, self.start, self.data, self.total = doc_id, start, data, total

    def __len__(self) -> int:
        return len(self.data) // 4

    def head(self, n: int) -> Piece:
        """Take n tokens off the start."""
        out = Piece(self.doc_id, self.start, self.data[: 4 * n], self.total)
        self.start, self.data = self.start + n, self.data[4 * n :]
        return out


class Bins:
    """The open bins of one task; finished ones come out of add() and rest() as rows."""

    #: Tails that wait as filling; older ones are classed as documents.
    WAITING = 64

    def __init__(self, first_id: int, capacity: int):
        self.next_id, self.capacity, self.least = first_id, capacity, max(1, capacity // 64)
        self.classes: dict[int, list[Piece]] = {}
        self.filling: deque[Piece] = deque()
        self.gaps: deque[list[Piece]] = deque()  # bins with their k documents and free space

    def _row(self, pieces: list[Piece]) -> list[tuple]:
        out, offset = [], 0
        for p in pieces:
            out.append((p.doc_id, p.start, len(p), zlib.crc32(p.data), p.total, self.next_id, offset))
            offset += len(p)
        self.next_id += 1
        return out

    def _class(self, piece: Piece) -> list[tuple]:
        k = self.capacity // len(piece)
        waiting = self.classes.setdefault(k, [])
        waiting.append(piece)
        if len(waiting) < k:
            return []
        self.classes[k] = []
        if self.capacity - sum(map(len, waiting)) < self.least:
            return self._row(waiting)
        self.gaps.append(waiting)
        return []

    def _fill(self) -> list[tuple]:
        """Fill bins as long as there is filling; no piece of less than the least length is cut off or left."""
        out = []
        while self.gaps and self.filling:
            pieces = self.gaps.popleft()
            free = self.capacity - sum(map(len, pieces))
            while free >= self.least and self.filling:
                piece = self.filling[0]
                n = len(piece)
                if n > free:
                    n = free if n - free >= self.least else n - self.least
                    if n < self.least:
                        out += self._class(self.filling.popleft())
                        continue
                    pieces.append(piece.head(n))
                else:
                    pieces.append(self.filling.popleft())
                free -= n
            if free < self.least:
                out += self._row(pieces)
            else:
                self.gaps.append(pieces)
        return out

    def add(self, doc_id, data: bytes) -> list[tuple]:
        out, piece = [], Piece(doc_id, 0, data, len(data) // 4)
        while len(piece) >= self.capacity:
            out += self._row([piece.head(self.capacity)])
        if len(piece):
            if piece.start or self.gaps:
                self.filling.append(piece)
            else:
                out += self._class(piece)
            out += self._fill()
            if len(self.filling) > self.WAITING:
                out += self._class(self.filling.popleft())
        return out

    def rest(self) -> list[tuple]:
        """What waits, in whole sequences and at last powers of two."""
        self.filling.extend(p for k in sorted(self.classes) for p in self.classes[k])
        self.classes = {}
        out = self._fill()
        for k in sorted(self.classes):  # what was too short to be cut
            self.filling.extend(self.classes[k])
        for pieces in self.gaps:
            self.filling.extend(pieces)
        left = sum(map(len, self.filling))
        while left:
            size = min(self.capacity, 1 << (left.bit_length() - 1))
            pieces, free = [], size
            while free:
                n = min(free, len(self.filling[0]))
                pieces.append(self.filling[0].head(n))
                if not len(self.filling[0]):
                    self.filling.popleft()
                free -= n
            out += self._row(pieces)
            left -= size
        return out


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 1, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row for each piece; capacity is a power of two.

    sequence_id is the task's number and the bin's number in the task; a task that runs again gives the same rows.
    """
    if capacity < 2 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    names = [c.split()[0] for c in PIECES.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    def run(batches):
        ids_of = encoder(tokenizer, ranks).ids
        bins = Bins(TaskContext.get().partitionId() << 40, capacity)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in slices(batches, "text"):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows += bins.add(doc_id, ids_of(text or "").tobytes() + end)
            if rows:
                yield batch_of(rows)
        if rows := bins.rest():
            yield batch_of(rows)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, PIECES)

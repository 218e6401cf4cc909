"""Sum-of-squares online packing of token sequences into windows.

Every partition of the scan packs its own stream, so nothing is shuffled and no window depends on another task. A document
is cut at the window size; each full window closes at once and the rest (under one window) goes, as it comes, to the fill
level whose choice makes the sum of squared counts of partly filled windows smallest. The counts stand in one array
indexed by level. When more than MOST_OPEN windows are open the fullest are retired, down to half: their gaps are filled with what
is cut from the emptiest, and the others stay as they are. At a partition's end all are, so one partly filled window is
left per partition.

Defined results: null text is the empty text, one token (the closing id); documents of any length are packed whole; equal
rows are packed each for itself; an empty table gives no pieces. Sequence ids are partition number x 2^40 + count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.llm.bpe import Encoder
from auditweave.llm.common import give_back

WINDOW = 2048
END_ID = 1
MOST_OPEN = 4096

Piece = tuple[int, int, np.ndarray]  # row of the document, start in it, ids


class Packer:
    """One stream's windows. add() and close() yield (piece, sequence, offset)."""

    def __init__(self, window: int = WINDOW, most_open: int = MOST_OPEN):
        self.window, self.most_open = window, most_open
        self.counts = np.zeros(window + 1, np.int64)  # partly filled windows at each level
        self.open: list[list[tuple[int, list[Piece]]]] = [[] for _ in range(window)]
        self.n_open = 0
        self.next = 0

    def level_for(self, size: int) -> int:
        """The level whose window, filled by size more, gives the least sum of squares; 0 opens a window. Fuller wins ties."""
        counts, window = self.counts, self.window
        change = 2 * (counts[size:] - counts[: window + 1 - size]) + 2
        change[-1] -= 1  # a full window counts no more
        change[0] = 2 * counts[size] + 1 if size < window else 0
        change[1:][counts[1 : window + 1 - size] == 0] = np.iinfo(np.int64).max
        return len(change) - 1 - int(change[::-1].argmin())

    def add(self, doc: int, ids: np.ndarray) -> Iterator[tuple[Piece, int, int]]:
        whole = len(ids) // self.window * self.window
        for start in range(0, whole, self.window):
            yield (doc, start, ids[start : start + self.window]), self.next, 0
            self.next += 1
        size = len(ids) - whole
        if size:
            level = self.level_for(size)
            if level:
                sequence, pieces = self.open[level].pop()
                self.counts[level] -= 1
                self.n_open -= 1
            else:
                sequence, pieces = self.next, []
                self.next += 1
            pieces.append((doc, whole, ids[whole:].copy()))
            if level + size == self.window:
                yield from self._placed(sequence, pieces)
            else:
                self.open[level + size].append((sequence, pieces))
                self.counts[level + size] += 1
                self.n_open += 1
                if self.n_open > self.most_open:
                    yield from self.close(self.most_open // 2)

    @staticmethod
    def _placed(sequence: int, pieces: list[Piece]) -> Iterator[tuple[Piece, int, int]]:
        at = 0
        for piece in pieces:
            yield piece, sequence, at
            at += len(piece[2])

    def close(self, keep: int = 0) -> Iterator[tuple[Piece, int, int]]:
        """Fills the fullest open windows with what is cut from the emptiest, until at most `keep` are open."""
        left = [(level, s, p) for level, found in enumerate(self.open) for s, p in found]  # emptiest first
        emptiest = 0
        while len(left) - emptiest > keep:
            level, sequence, pieces = left.pop()
            while level < self.window and emptiest < len(left):
                have, other, source = left[emptiest]
                doc, start, ids = source[-1]
                take = min(len(ids), self.window - level)
                pieces.append((doc, start + len(ids) - take, ids[len(ids) - take :]))
                if take == len(ids):
                    source.pop()
                else:
                    source[-1] = (doc, start, ids[: len(ids) - take])
                level += take
                left[emptiest] = (have - take, other, source)
                emptiest += not source
            yield from self._placed(sequence, pieces)
        left = left[emptiest:]
        self.counts[:], self.open, self.n_open = 0, [[] for _ in range(self.window)], len(left)
        for level, sequence, pieces in left:
            self.counts[level] += 1
            self.open[level].append((sequence, pieces))


def pack(docs: DataFrame, vocabulary: str, *, window: int = WINDOW, end_id: int = END_ID, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids themselves."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = Encoder(vocabulary)
        packer, base, end = Packer(window), TaskContext.get().partitionId() << 40, np.uint32(end_id)
        sizes: list[int] = []
        keys: list = []

        def batch_of(placed):
            out: list[list] = [[] for _ in range(8)]
            for (doc, start, ids), sequence, offset in placed:
                data = ids.astype("<u4")
                for column, x in zip(out, (keys[doc], start, len(ids), zlib.crc32(data.tobytes()), sizes[doc], base + sequence, offset, data.view(np.int32))):
                    column.append(x)
            kinds = [key_type, *[pa.int64()] * 6, pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=columns)

        for batch in batches:
            key_type, placed = batch.schema.field(0).type, []
            for key, ids in zip(batch.column(0).to_pylist(), encoder.documents(batch.column(1))):
                keys.append(key)
                sizes.append(len(ids) + 1)
                placed += packer.add(len(keys) - 1, np.append(ids, end))
                if len(placed) >= 512:
                    yield batch_of(placed)
                    placed = []
            yield batch_of(placed)
        if keys:
            yield batch_of(packer.close())
        del encoder, packer
        give_back()

    columns = [doc_id, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    source = docs.select(F.col(doc_id), F.col(text))
    kinds = [source.schema[0].dataType.simpleString(), *["long"] * 6, "array<int>"]
    return source.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in zip(columns, kinds)))

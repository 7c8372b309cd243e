"""Sum-of-squares online packing of token sequences into fixed windows (operator 1).

Every task packs the documents of its own scan partition, so the corpus is never shuffled. A level
array holds N(h), the number of open windows filled to level h. A document tail of s tokens goes to
the level h that makes the sum of the squared N smallest after the move, a new window being h = 0
and a full window counting nothing. Whole windows of a long document leave at once. At the end of
the task the open windows are merged by cutting the emptiest into the gaps of the fullest; the single
rest is cut at powers of two, which need no padding. Documents that all are a little longer than half a
window fit nowhere and would open a window each: beyond ``max_open`` the fullest and the emptiest are merged
in the same way until half are left, which bounds what a task holds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import map_rows, rows, table
from tidemark.llm.tokens import encoder

DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
WIDTH = 4  # bytes of an id


class Piece:
    __slots__ = ("doc_id", "start", "ids", "doc_tokens")

    def __init__(self, doc_id: int | None, start: int, ids: bytes | memoryview, doc_tokens: int):
        # A view is cut without a copy, so cutting a very long document takes time in proportion to its length.
        self.doc_id, self.start, self.ids, self.doc_tokens = doc_id, start, ids, doc_tokens

    def __len__(self) -> int:
        return len(self.ids) // WIDTH

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[: n * WIDTH], self.doc_tokens), Piece(self.doc_id, self.start + n, self.ids[n * WIDTH :], self.doc_tokens)


class LevelPacker:
    """Packs pieces online; ``add`` and ``finish`` yield closed windows, each a list of pieces."""

    def __init__(self, capacity: int, max_open: int = 8192):
        self.capacity, self.max_open, self.n_open = capacity, max_open, 0
        self.count = np.zeros(capacity + 1)
        self.count[capacity] = -0.5  # a full window adds nothing to the sum; half of the difference is compared
        self.open: dict[int, list[list[Piece]]] = {}

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        while len(piece) > self.capacity:
            whole, piece = piece.cut(self.capacity)
            yield [whole]
        s, n = len(piece), self.count
        if s == self.capacity:
            yield [piece]
            return
        if not s:
            return
        level = self._best(s)
        if level:
            window = self.open[level].pop()
            n[level] -= 1
        else:
            window = []
            self.n_open += 1
        window.append(piece)
        if level + s == self.capacity:
            self.n_open -= 1
            yield window
            return
        n[level + s] += 1
        self.open.setdefault(level + s, []).append(window)
        if self.n_open > self.max_open:
            yield from self._merge(max(1, self.max_open // 2))

    def _best(self, s: int) -> int:
        """The level to fill: smallest change of the sum of squares, the fullest of equals; 0 opens a window."""
        n = self.count
        at = n[1 : self.capacity - s + 1]
        change = np.where(at > 0, n[s + 1 :] - at + 1, np.inf)[::-1]
        best = int(np.argmin(change)) if change.size else 0
        return self.capacity - s - best if change.size and change[best] <= n[s] + 0.5 else 0

    def _merge(self, keep: int) -> Iterator[list[Piece]]:
        """Cut the emptiest windows into the gaps of the fullest until ``keep`` open windows are left."""
        windows = [(level, w) for level in sorted(self.open, reverse=True) for w in self.open[level]]
        self.open, self.n_open = {}, 0
        self.count[: self.capacity] = 0
        first, last = 0, len(windows) - 1
        while last - first >= keep:
            level, window = windows[first]
            gap, (low, source) = self.capacity - level, windows[last]
            piece = source.pop()
            if len(piece) > gap:
                piece, rest = piece.cut(gap)
                source.append(rest)
            window.append(piece)
            windows[first], windows[last] = (level + len(piece), window), (low - len(piece), source)
            if level + len(piece) == self.capacity:
                yield window
                first += 1
            if not source:
                last -= 1
        for level, window in windows[first : last + 1]:
            self.count[level] += 1
            self.open.setdefault(level, []).append(window)
            self.n_open += 1

    def finish(self) -> Iterator[list[Piece]]:
        yield from self._merge(1)
        for level, (window,) in self.open.items():
            queue = window[::-1]
            while level:
                size = 1 << (level.bit_length() - 1)
                level -= size
                part: list[Piece] = []
                while size:
                    piece = queue.pop()
                    if len(piece) > size:
                        piece, rest = piece.cut(size)
                        queue.append(rest)
                    size -= len(piece)
                    part.append(piece)
                yield part
        self.open, self.n_open = {}, 0


def pack(docs: DataFrame, tokenizer: str, separator: int = 2, capacity: int = 4096, max_open: int = 8192, with_ids: bool = True) -> DataFrame:
    """One row for each piece, its ids included (little-endian unsigned 32-bit) unless ``with_ids`` is false: then they never leave the task.

    ``tokenizer`` is the path of a tokenizer file on the executors. A null or empty text is the
    separator alone. A null doc_id is packed like any other and stays null; repeated rows are packed
    as often as they occur; very long texts are encoded in slices and cut without copies; an empty table gives no rows; other columns are ignored. sequence_id is
    unique over the result: the partition in the upper bits, a counter below.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encode, packer = encoder(tokenizer).encode, LevelPacker(capacity, max_open)
        end, number = np.array([separator], "<u4").tobytes(), TaskContext.get().partitionId() << 36

        def made(windows: Iterator[list[Piece]]) -> Iterator[tuple]:
            nonlocal number
            for window in windows:
                offset = 0
                for p in window:
                    row = p.doc_id, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, number, offset
                    yield (*row, bytes(p.ids)) if with_ids else row
                    offset += len(p)
                number += 1

        for batch in rows(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                yield from made(packer.add(Piece(doc_id, 0, memoryview(ids), len(ids) // WIDTH)))
        yield from made(packer.finish())

    texts = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    if with_ids:
        return map_rows(texts, run, DDL + ", ids binary", SCHEMA.append(pa.field("ids", pa.binary())), size=256)  # 4 MB of ids
    return map_rows(texts, run, DDL, SCHEMA)


def op1_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each piece of ``documents``; see ``pack``."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)

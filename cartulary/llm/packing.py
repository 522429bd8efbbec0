"""Packing documents into windows by the sum-of-squares rule.

Each task packs its own documents as they come. A document with more ids than
a window first fills whole windows; what is left goes to the fill level that
makes the sum of squared counts of partially filled windows smallest. The
counts lie in one array with an entry for each level, so a placement is one
vector expression. The number of open windows is bounded: at the bound, a
document is cut to complete the fullest one. At the end of a task the fullest
open windows are completed from the emptiest ones, and the last few ids become
windows with a power of two as length, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from .base import column, pieces, texts
from .vocabulary import ChunkIds, library_encoder

WINDOW = 4096
OPEN = 512
END = 2
COLUMNS = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class SumOfSquares:
    """Windows of one task; pieces are (document, start in it, ids, ids of the document)."""

    def __init__(self, window: int = WINDOW, most: int = OPEN):
        self.window, self.most = window, most
        self.counts = np.zeros(window + 1, np.int64)  # of open windows by level
        self.open: dict[int, list[list]] = {}  # by level
        self.n_open = 0
        self.n_done = 0
        self.n_moved = 0  # ids that did not stay where the rule put them
        self.done: list[tuple] = []  # (document, start, ids, total, sequence, offset)

    def _close(self, parts: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in parts:
            self.done.append((doc, start, ids, total, self.n_done, offset))
            offset += len(ids)
        self.n_done += 1

    def level_for(self, size: int) -> int:
        """The level whose choice adds least to the sum of squares; 0 is a new window."""
        counts, room = self.counts, self.window - size
        after = counts[size:].copy()
        after[room] = 0  # a full window counts no more
        change = 2 * (after - counts[: room + 1]) + 2
        change[room] -= 1
        change[0] = 2 * counts[size] + 1 if room else 0
        change[1:][counts[1 : room + 1] == 0] = np.iinfo(np.int64).max
        return int(len(change) - 1 - np.argmin(change[::-1]))

    def _take(self, level: int) -> list[tuple]:
        parts = self.open[level].pop()
        self.counts[level] -= 1
        self.n_open -= 1
        return parts

    def _put(self, level: int, parts: list[tuple]) -> None:
        if level == self.window:
            self._close(parts)
            return
        self.open.setdefault(level, []).append(parts)
        self.counts[level] += 1
        self.n_open += 1

    def add(self, doc, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.window:
            self._close([(doc, at, ids[at : at + self.window], total)])
            at += self.window
        while at < total:
            size = total - at
            level = self.level_for(size)
            if level == 0 and self.n_open >= self.most:
                level = int(np.flatnonzero(self.counts)[-1])
                size = min(size, self.window - level)
            parts = self._take(level) if level else []
            parts.append((doc, at, ids[at : at + size].copy(), total))
            self._put(level + size, parts)
            at += size

    def finish(self) -> None:
        """Empty the open windows: the fullest are completed with what lies in the emptiest.

        Documents stay where the rule put them, but for those of the emptiest
        windows, which are cut as far as gaps have to be filled. What is left
        of the last window becomes windows with a power of two as length.
        """
        windows = [parts for level in sorted(self.open, reverse=True) for parts in self.open[level]]
        self.open, self.n_open = {}, 0
        self.counts[:] = 0
        at, last = 0, len(windows) - 1
        while at < last:
            room = self.window - sum(len(p[2]) for p in windows[at])
            while room and at < last:
                doc, start, ids, total = windows[last].pop()
                n = min(room, len(ids))
                windows[at].append((doc, start, ids[:n], total))
                room -= n
                self.n_moved += n
                if n < len(ids):
                    windows[last].append((doc, start + n, ids[n:], total))
                if not windows[last]:
                    last -= 1
            if not room:
                self._close(windows[at])
                at += 1
        if at > last:
            return
        rest = windows[at]
        while rest:
            size = 1 << (sum(len(p[2]) for p in rest).bit_length() - 1)
            parts = []
            while size:
                doc, start, ids, total = rest.pop(0)
                n = min(size, len(ids))
                parts.append((doc, start, ids[:n], total))
                size -= n
                if n < len(ids):
                    rest.insert(0, (doc, start + n, ids[n:], total))
            self._close(parts)


def packed(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END) -> DataFrame:
    """One row per piece: ``key, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document's ids are those of ``tokenizer`` (a file of the tokenizers
    library whose ids never cross white space) and then ``end``; null and empty
    texts have that one id. Each id lies in exactly one piece; sequences have
    ``window`` ids at most. Rows that repeat a key are packed one by one; null
    keys are kept; an empty table gives no piece; other columns are not read.
    A task's result depends only on its rows, so it can run again.
    """
    schema = StructType([StructField(key, docs.schema[key].dataType), *(StructField(c, LongType()) for c in COLUMNS)])
    kind = docs.schema[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, packer = ChunkIds(library_encoder(tokenizer)), SumOfSquares(window)
        base = TaskContext.get().partitionId() << 33
        arrow = None

        def told() -> pa.RecordBatch:
            found, packer.done = packer.done, []
            sizes = [len(x[2]) for x in found]
            sums = [zlib.crc32(np.ascontiguousarray(x[2], "<u4")) for x in found]
            data = [[x[1] for x in found], sizes, sums, [x[3] for x in found], [base + x[4] for x in found], [x[5] for x in found]]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], arrow), *(pa.array(d, pa.int64()) for d in data)], [kind.name, *COLUMNS])

        for piece in pieces(batches, "__text"):
            arrow = column(piece, key).type
            ids, offsets = ids_of.of(texts(piece, "__text"))
            for i, doc in enumerate(column(piece, key).to_pylist()):
                packer.add(doc, np.append(ids[offsets[i] : offsets[i + 1]], np.int32(end)))
            yield told()
        if arrow is not None:
            packer.finish()
            yield told()

    return docs.select(key, docs[text].alias("__text")).mapInArrow(run, schema)

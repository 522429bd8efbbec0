"""Token counts of a sentence-piece BPE model by rank-synchronous array merging.

The pre-tokens of a batch lie in one ragged numpy array of symbols. In each
round every pre-token applies its pair of lowest rank, at all its places where
the order cannot matter and at the leftmost one otherwise; a pre-token without
a known pair is done, and its surviving symbols are its tokens.

A text is cut into pre-tokens where no piece of the vocabulary holds the two
characters side by side: no merge can cross such a place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from . import flat
from .base import column, pieces, texts

#: The library's stand-in for a space.
MARK = "▁"
#: Bytes of text looked at together.
TOGETHER = 8 << 20
#: Characters of chunks whose counts a task remembers; beyond that it starts anew.
MEMORY = 32_000_000
#: Rank of a pair that makes no piece.
NONE = np.iinfo(np.int32).max
#: Kinds of pieces in a model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE_MODEL = 2


class PieceModel:
    """Symbols, ranks and pairs of a model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules = model.normalizer_spec
        if model.trainer_spec.model_type != BPE_MODEL or not model.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte pieces is wanted")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a model that leaves texts as they are is wanted")
        if {p.type for p in model.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("a model with user-defined or unused pieces is not handled")
        self.leading_space = rules.add_dummy_prefix
        scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        rank_of = {score: i for i, score in enumerate(sorted(set(scores.values()), reverse=True))}
        strings = dict.fromkeys([*sorted({c for p in scores for c in p}), *scores])
        number = {s: i for i, s in enumerate(strings)}
        # Symbol of each code point; 0 stands for all that the vocabulary lacks.
        self.symbol = np.zeros(0x110000, np.int32)
        # A character that is only part of pieces is a symbol, but ends up as its bytes.
        self.weight = np.ones(len(number) + 1, np.int64)
        for s, i in number.items():
            if len(s) == 1:
                self.symbol[ord(s)] = i + 1
                self.weight[i + 1] = 1 if s in scores else len(s.encode("utf-8"))
        self.symbol[ord(" ")] = self.symbol[ord(MARK)]
        pairs = [(number[p[:k]] + 1, number[p[k:]] + 1, rank_of[score], number[p] + 1)
                 for p, score in scores.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        left, right, rank, made = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.empty(0, np.int64),) * 4
        keys = left << 32 | right
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], rank[order].astype(np.int32), made[order].astype(np.int32)
        # Symbols that can at once go into a piece of the same or a lower rank: such pairs are merged one by one.
        own = np.full(len(number) + 1, -1, np.int64)
        own[self.made] = self.rank
        early = np.zeros(len(number) + 1, bool)
        for side in (left, right):
            early[side[rank <= own[side]]] = True
        self.careful = np.zeros(len(rank_of) + 1, bool)
        self.careful[own[early & (own >= 0)]] = True
        beside = np.array(sorted({(number[a] + 1) << 32 | number[b] + 1 for p in scores for a, b in zip(p, p[1:])}), np.int64)
        self.beside = beside
        mark = int(self.symbol[ord(MARK)])
        #: No piece has a space after something else: a space begins a pre-token.
        self.space_begins = not np.any((beside & 0xFFFFFFFF == mark) & (beside >> 32 != mark))

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of pairs of symbols."""
        if not len(self.keys):
            return np.full(len(left), NONE, np.int32), np.zeros(len(left), np.int32)
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.rank[at], NONE), self.made[at]

    def count(self, chunks: list[str]) -> np.ndarray:
        """Tokens of each chunk, which are cut where no merge can cross."""
        sizes = np.array([len(c) for c in chunks], np.int64)
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        chunk = np.repeat(np.arange(len(chunks)), sizes)
        symbols = self.symbol[points]
        weight = self.weight[symbols]
        unknown = symbols == 0
        weight[unknown] = 1 + (points[unknown] > 0x7F) + (points[unknown] > 0x7FF) + (points[unknown] > 0xFFFF)
        counts = flat.total(chunk, weight, len(chunks))
        if len(symbols) < 2 or not len(self.beside):
            return counts
        near = symbols[:-1].astype(np.int64) << 32 | symbols[1:]
        at = np.searchsorted(self.beside, near)
        at[at == len(self.beside)] = 0
        joined = (self.beside[at] == near) & (chunk[:-1] == chunk[1:])
        word = np.concatenate(([0], np.cumsum(~joined)))
        owner = chunk[flat.runs(word)]
        alone = np.bincount(word)[word] == 1
        symbols, word, weight = symbols[~alone], word[~alone], weight[~alone]
        if not len(symbols):
            return counts
        rank, made = self._look_up(symbols[:-1], symbols[1:])
        rank[word[:-1] != word[1:]] = NONE
        rank, made = np.append(rank, np.int32(NONE)), np.append(made, np.int32(0))
        while len(symbols):
            begin = flat.runs(word)
            length = np.diff(np.append(begin, len(word)))
            best = np.minimum.reduceat(rank, begin)
            going = best != NONE
            if not going.all():
                keep = np.repeat(going, length)
                symbols, word, weight, rank, made = symbols[keep], word[keep], weight[keep], rank[keep], made[keep]
                begin = flat.runs(word)
                length, best = length[going], best[going]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, length))
            # Of places that overlap, every second one from the left; of a rank that asks for care, only the first.
            chain = np.cumsum(np.concatenate(([True], np.diff(hit) != 1))) - 1
            first = hit[flat.runs(chain)][chain]
            careful = self.careful[rank[hit]]
            leftmost = np.zeros(len(hit), bool)
            leftmost[flat.runs(word[hit])] = True
            hit = hit[((hit - first) % 2 == 0) & (leftmost | ~careful)]
            # A merge makes one token of two symbols; a character that is no piece counted as its bytes.
            lost = weight[hit] + weight[hit + 1] - 1
            counts -= flat.total(owner[word[hit]], lost, len(counts))
            symbols[hit], weight[hit] = made[hit], 1
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            symbols, word, weight, rank, made = symbols[keep], word[keep], weight[keep], rank[keep], made[keep]
            # Only pairs beside a new symbol have changed.
            new = place[hit]
            again = np.unique(np.concatenate((new, new[new > 0] - 1)))
            last = again == len(symbols) - 1
            rank[again[last]] = NONE
            again = again[~last]
            found, piece = self._look_up(symbols[again], symbols[again + 1])
            rank[again] = np.where(word[again] == word[again + 1], found, NONE)
            made[again] = piece
        return counts


class PieceCounts:
    """Token counts of texts, with the counts of chunks met before."""

    def __init__(self, path: str, memory: int = MEMORY):
        self.model, self.memory = PieceModel(path), memory
        self.known: dict[str, int] = {}
        self.held = 0

    def _chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Byte-equal distinct runs that begin with a space or a text, and per text the offsets into their numbers."""
        data, offsets = flat.joined(texts)
        filled = np.flatnonzero(np.diff(offsets))
        starts = offsets[filled]
        if self.model.leading_space:
            data = np.insert(data, starts, 32)
            starts = starts + np.arange(len(starts))
        cut = np.zeros(len(data), bool)
        if self.model.space_begins:
            space = data == 32
            cut[1:] = space[1:] & ~space[:-1]
            # A stand-in for a space in the text itself is a space too.
            mark = MARK.encode("utf-8")
            if len(data) > 3:
                after = (data[:-3] == mark[0]) & (data[1:-2] == mark[1]) & (data[2:-1] == mark[2])
                cut[3:] &= ~after
        cut[starts] = True
        begin = np.flatnonzero(cut)
        chunks = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, len(data)).astype(np.int64)), pa.py_buffer(data))
        per_text = np.zeros(len(texts), np.int64)
        per_text[filled] = np.searchsorted(begin, np.append(starts[1:], len(data))) - np.searchsorted(begin, starts) if len(filled) else 0
        return chunks.dictionary_encode(), np.concatenate(([0], np.cumsum(per_text)))

    def of(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text without nulls."""
        coded, offsets = self._chunks(texts)
        if not len(coded):
            return np.zeros(len(texts), np.int64)
        if self.held > self.memory:
            self.known, self.held = {}, 0
        chunks = coded.dictionary.to_pylist()
        new = [c for c in chunks if c not in self.known]
        if new:
            self.known.update(zip(new, self.model.count(new).tolist()))
            self.held += sum(map(len, new))
        each = np.fromiter((self.known[c] for c in chunks), np.int64, len(chunks))
        sums = np.concatenate(([0], np.cumsum(each[coded.indices.to_numpy(zero_copy_only=False)])))
        return sums[offsets[1:]] - sums[offsets[:-1]]


def token_counts(docs: DataFrame, model: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` for each row, as the sentencepiece library counts with ``model``.

    Null and empty texts have no bytes and no tokens. Rows that repeat a key
    and rows without one are counted one by one; an empty table gives an empty
    result; other columns are not read. No shuffle; a task's memory is bounded
    by its longest text and the chunks it remembers. Chunks are compared by
    their bytes.
    """
    schema = StructType([StructField(key, docs.schema[key].dataType), *(StructField(c, LongType()) for c in ("n_bytes", "n_tokens")), StructField("over_limit", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PieceCounts(model)
        for piece in pieces(batches, "__text", TOGETHER):
            own = texts(piece, "__text")
            tokens = counts.of(own)
            sizes = np.diff(flat.joined(own)[1])
            yield pa.RecordBatch.from_arrays([column(piece, key), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)], schema.names)

    return docs.select(key, F.col(text).alias("__text")).mapInArrow(run, schema)

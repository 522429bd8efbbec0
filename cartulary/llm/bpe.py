"""BPE encoding and decoding in numpy merge rounds over many words at once.

The symbols of all distinct words lie in one flat array. In each round every
word merges its one pair of lowest rank (the leftmost of them); ranks come from
a binary search over the sorted keys of all pairs. A word without a known pair
is done and leaves the array. That is the order in which a queue of pairs works
a single word, so the ids are the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from . import flat
from .base import column, pieces, texts
from .vocabulary import ChunkIds, Splitter, byte_letters


class WordBpe:
    """A word-end BPE vocabulary: normalising, splitting, merging and decoding."""

    def __init__(self, path: str):
        self.splitter = Splitter(path)
        told = self.splitter.told
        model = told["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"] if t["special"]}
        self.mark = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special))) + ")") if self.special else None
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + self.end] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        # Every token's string, by id.
        strings = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in self.special.items()}}
        self.strings = [strings.get(i, "") for i in range(max(strings) + 1)]

    def words(self, chunk: str) -> list[bytes | int]:
        """Pre-tokens of a chunk in UTF-8; a special token is its id."""
        found: list[bytes | int] = []
        for part in self.mark.split(chunk) if self.mark and "<|" in chunk else [chunk]:
            if part in self.special:
                found.append(self.special[part])
                continue
            found += self.splitter.words(part)
        return found

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words flat, and their offsets."""
        sizes = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(sizes)
        symbols[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = len(self.made)
        while len(symbols):
            # Rank of each symbol with the next of its word.
            keys = symbols[:-1] << 32 | symbols[1:]
            at = np.searchsorted(self.keys, keys)
            at[at == len(self.keys)] = 0
            rank = np.append(np.where((self.keys[at] == keys) & (word[:-1] == word[1:]), self.ranks[at], none), none)
            begin = flat.runs(word)
            length = np.diff(np.append(begin, len(word)))
            best = np.minimum.reduceat(rank, begin)
            over = np.repeat(best == none, length)
            if over.any():
                done.append((word[over], symbols[over]))
            hit = np.flatnonzero((rank == np.repeat(best, length)) & ~over)
            hit = hit[flat.runs(word[hit])]  # the leftmost of a word
            symbols[hit] = self.made[rank[hit]]
            keep = ~over
            keep[hit + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done:
            return np.empty(0, np.int64), np.zeros(len(words) + 1, np.int64)
        owner = np.concatenate([w for w, _ in done])
        found = np.concatenate([s for _, s in done])
        order = np.argsort(owner, kind="stable")
        return found[order], np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(words)))))

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many chunks without white space, flat, and their offsets."""
        index: dict[bytes, int] = {}
        wanted: list[int] = []  # a word's number, or -1 - id of a special token
        sizes = np.zeros(len(chunks), np.int64)
        for i, chunk in enumerate(chunks):
            found = self.words(chunk)
            sizes[i] = len(found)
            wanted += [index.setdefault(w, len(index)) if isinstance(w, bytes) else -1 - w for w in found]
        special = np.array([-1 - w for w in wanted if w < 0], np.int64)
        ids, offsets = self.merge(list(index)) if index else (np.empty(0, np.int64), np.zeros(1, np.int64))
        number = np.array(wanted, np.int64)
        number[number < 0] = len(offsets) - 1 + np.arange(len(special))
        ids = np.concatenate((ids, special))
        offsets = np.concatenate((offsets, offsets[-1] + 1 + np.arange(len(special))))
        each = offsets[number + 1] - offsets[number]
        ends = np.cumsum(each)
        source = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(offsets[number] - (ends - each), each)
        borders = np.concatenate(([0], np.cumsum(sizes)))
        return ids[source], np.concatenate(([0], ends))[borders]

    def decode(self, ids: list[int]) -> str:
        """The library's decode() without a decoder: token strings with spaces between them."""
        strings = self.strings
        return " ".join([strings[i] for i in ids])


def coded(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` for each row, and ``ids`` on demand.

    Whole texts are encoded, and what the ids decode to is hashed. Null and
    empty texts have no ids and decode to the empty string; rows that repeat a
    key are encoded alike; an empty table gives an empty result; other columns
    are not read. No shuffle; a task's memory is bounded by its longest text
    and the chunks it remembers.
    """
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]
    schema = StructType([StructField(key, docs.schema[key].dataType), StructField("n_tokens", LongType()), *(StructField(c, StringType()) for c in names[1:3])])
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(tokenizer)
        ids_of = ChunkIds(bpe.encode)
        decimals = [str(i) for i in range(len(bpe.strings))]
        for piece in pieces(batches, "__text"):
            ids, offsets = ids_of.of(texts(piece, "__text"))
            flat_ids, borders = ids.tolist(), offsets.tolist()
            hashes, decoded = [], []
            for i in range(piece.num_rows):
                own = flat_ids[borders[i] : borders[i + 1]]
                hashes.append(hashlib.sha256(" ".join([decimals[x] for x in own]).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(own).encode("utf-8")).hexdigest())
            data = [column(piece, key), pa.array(np.diff(offsets)), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                data.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())))
            yield pa.RecordBatch.from_arrays(data, [key, *names])

    return docs.select(key, docs[text].alias("__text")).mapInArrow(run, schema)

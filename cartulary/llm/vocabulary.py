"""Token ids of whole texts through their distinct chunks.

The tokenizer here never joins anything across white space, so a text's ids
are the ids of its chunks ``[^\\x20\\x09-\\x0D]+`` one after the other. A task
keeps the ids of chunks it has met, known by their bytes; only new chunks are
encoded.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex

from . import flat
from .base import release

#: Kinds of bytes for pre-tokens: space, letter, digit, other; 4 where the byte alone does not tell.
_KINDS = np.full(256, 3, np.uint8)
_KINDS[32] = 0
_KINDS[[*range(65, 91), *range(97, 123)]] = 1
_KINDS[48:58] = 2
_KINDS[[39, *range(128, 256)]] = 4

#: Chunks a task remembers, and their letters; beyond that it starts anew.
MEMORY, LETTERS = 1_000_000, 32_000_000


class ChunkIds:
    """``encode`` gets a list of distinct chunks (str) and gives their ids flat, with offsets."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], memory: int = MEMORY):
        self.encode, self.memory = encode, memory
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.letters = 0
        self.offsets = np.zeros(1, np.int64)
        self.ids = np.empty(0, np.int32)

    def _numbers(self, chunks: list[str]) -> np.ndarray:
        """Each distinct chunk's number in ``offsets``."""
        if len(self.known) > self.memory or self.letters > LETTERS:
            self._clear()
        new = [c for c in chunks if c not in self.known]
        if new:
            ids, offsets = self.encode(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.letters += sum(map(len, new))
            self.offsets = np.concatenate((self.offsets, offsets[1:] + self.offsets[-1]))
            self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
        return np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts without nulls, and the offsets of the texts in them."""
        chunks, which, doc = flat.coded(column, ~flat.SPACE)
        number = self._numbers(chunks.to_numpy(zero_copy_only=False).tolist())[which]
        sizes = self.offsets[number + 1] - self.offsets[number]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        source = np.arange(total) + np.repeat(self.offsets[number] - (ends - sizes), sizes)
        per_text = flat.total(doc, sizes, len(column))
        return self.ids[source], np.concatenate(([0], np.cumsum(per_text)))


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class Splitter:
    """Pre-tokens of chunks as the library makes them.

    Below U+0250 every code point is assigned for good, none composes with
    another, and the tables of all versions agree; so such chunks are split
    here. Others go through the library's own normaliser and splitter, whose
    tables may be newer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            self.told = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        pattern = next(p["pattern"]["Regex"] for p in self.told["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"), regex.V0)
        self.settled = regex.compile("[\0-\u024f]*")
        self.bytes_of = {ord(letter): byte for byte, letter in enumerate(byte_letters())}

    def words(self, text: str) -> list[bytes]:
        """Pre-tokens of a text without special tokens, in UTF-8."""
        if self.settled.fullmatch(text):
            return [w.encode("utf-8") for w in self.split.findall(text.lower())]
        found = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
        return [w.translate(self.bytes_of).encode("latin-1") for w, _ in found]

    def counts(self, chunks: list[str]) -> np.ndarray:
        """How many pre-tokens each chunk has.

        In plain ASCII they begin where the kind of character changes, and at
        each digit; a quote may begin a word of its own, so those chunks and
        all others are split.
        """
        kind = _KINDS[np.frombuffer(" ".join(["", *chunks]).encode("utf-8"), np.uint8)]
        begin = np.flatnonzero(kind == 0)
        starts = (kind[1:] != 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
        found = np.add.reduceat(np.append(False, starts), begin, dtype=np.int64) if len(begin) else np.empty(0, np.int64)
        for i in np.unique(np.searchsorted(begin, np.flatnonzero(kind == 4), "right") - 1).tolist():
            found[i] = len(self.split.findall(chunks[i].lower()) if self.settled.fullmatch(chunks[i]) else self.words(chunks[i]))
        return found


@functools.lru_cache(maxsize=1)
def library_encoder(path: str) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Encode distinct chunks by the tokenizers library, many in one call.

    Chunks are joined by spaces. The last token of each pre-token carries the
    word end, so a chunk's ids are found by counting its pre-tokens. A chunk
    with the marks of special tokens is encoded alone, and so are those of a
    call whose count is not the expected one. A worker reads the file once.
    """
    splitter = Splitter(path)
    tokenizer = splitter.tokenizer
    end = splitter.told["model"]["end_of_word_suffix"]
    vocab = tokenizer.get_vocab()
    ends = np.zeros(max(vocab.values()) + 1, bool)
    ends[[i for t, i in vocab.items() if t.endswith(end)]] = True
    # What the file says takes many times its size, and is not needed any more.
    del splitter.told, vocab
    release()

    def ids_of(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        odd = [i for i, c in enumerate(chunks) if "<|" in c or "|>" in c]
        own = dict(zip(odd, ids_of([chunks[i] for i in odd])))
        plain = [i for i in range(len(chunks)) if i not in own] if own else range(len(chunks))
        groups = [plain[i : i + 500] for i in range(0, len(plain), 500)]
        parts, sizes = [], np.zeros(len(chunks), np.int64)
        expected = splitter.counts([chunks[i] for i in plain])
        for number, (group, ids) in enumerate(zip(groups, ids_of([" ".join([chunks[i] for i in g]) for g in groups]))):
            borders = np.concatenate(([0], np.flatnonzero(ends[ids]) + 1))
            counts = np.cumsum(expected[500 * number : 500 * number + len(group)])
            if counts[-1] != len(borders) - 1 or borders[-1] != len(ids):
                own.update(zip(group, ids_of([chunks[i] for i in group])))
                continue
            sizes[group] = np.diff(borders[counts], prepend=0)
            parts.append(ids)
        ids = np.concatenate(parts) if parts else np.empty(0, np.int32)
        if own:
            at = np.cumsum(sizes) - sizes
            ids = np.concatenate([own[i] if i in own else ids[at[i] : at[i] + sizes[i]] for i in range(len(chunks))])
            sizes[list(own)] = [len(x) for x in own.values()]
        return ids, np.concatenate(([0], np.cumsum(sizes)))

    return encode

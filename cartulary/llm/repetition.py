"""Quality rules on repetition: characters inside repeated n-grams and lines.

One pass over the texts, no shuffle. Words of many texts lie in one flat
array; prefix sums over word hashes give all n-grams of any length; one sort
per length finds those that occur more than once in their text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from . import flat
from .base import column, pieces, texts

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Limits:
    """Largest share of a text's word characters inside later occurrences of n-grams and of lines."""

    grams: dict[int, float] = field(default_factory=lambda: {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10})
    lines: float = 0.30


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: its group's size, and whether an equal key stands before it."""
    order = np.argsort(keys)
    begin = flat.runs(keys[order])
    if not len(begin):
        return np.empty(0, np.int64), np.empty(0, bool)
    sizes = np.diff(np.append(begin, len(keys)))
    size, later = np.empty(len(keys), np.int64), np.ones(len(keys), bool)
    size[order] = np.repeat(sizes, sizes)
    later[np.minimum.reduceat(order, begin)] = False
    return size, later


def _covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words lie in a window of ``n`` words at one of ``starts``."""
    steps = np.zeros(words + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + n, -1)
    return np.cumsum(steps[:-1]) > 0


def measure(column: pa.Array, limits: Limits) -> dict[str, np.ndarray]:
    """All figures of some texts without nulls."""
    w = flat.Words(column)
    docs, words = w.docs, len(w.start)
    lead = np.concatenate(([0], np.cumsum((w.data & 0xC0) != 0x80)))  # code points before each byte
    chars = lead[w.end] - lead[w.start]
    out = {"n_words": w.count(), "word_chars": flat.total(w.doc, chars, docs)}
    marks = np.concatenate(([0], np.cumsum(SYMBOLS[w.data])))
    out["n_symbols"] = marks[w.offsets[1:]] - marks[w.offsets[:-1]]

    # Lines: between line ends and document borders.
    breaks = np.flatnonzero(w.data == 10)
    edges = np.unique(np.concatenate((breaks + 1, w.offsets)))
    start, end = edges[:-1], edges[1:].copy()
    if len(start):
        end -= w.data[end - 1] == 10
    first = np.searchsorted(w.start, start)
    has = np.searchsorted(w.start, end) > first
    start, end = start[has], end[has]
    doc = np.searchsorted(w.offsets, start, "right") - 1
    _, later = _groups(flat.mix(flat.hashed(w.data, start, end) + doc.astype(flat.U)))
    out["n_dup_lines"] = flat.total(doc, later, docs)
    many = np.maximum(out["word_chars"], 1)
    inside = np.zeros(words + 1, np.int64)
    np.add.at(inside, np.searchsorted(w.start, start[later]), 1)
    np.add.at(inside, np.searchsorted(w.start, end[later]), -1)
    out["line_share"] = flat.total(w.doc, chars * (np.cumsum(inside[:-1]) > 0), docs) / many

    sums, own = flat.prefix(w.hash), flat.mix(w.doc.astype(flat.U) + flat.U(1))
    out["n_repeat_words"] = np.zeros(docs, np.int64)
    for n in sorted({5, *limits.grams}):
        keys = flat.grams(sums, n)
        at = np.flatnonzero(w.doc[n - 1 :] == w.doc[: words - n + 1]) if words >= n else np.empty(0, np.int64)
        size, later = _groups(keys[at] ^ own[at])
        if n == 5:
            out["n_repeat_words"] = flat.total(w.doc, _covered(at[size > 1], n, words), docs)
        if n in limits.grams:
            out[f"share_{n}"] = flat.total(w.doc, chars * _covered(at[later], n, words), docs) / many
    return out


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", limits: Limits | None = None) -> DataFrame:
    """``key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` and the shares, for each row.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text. ``base_failed``: under ten
    words, or over a fifth of them in five-word windows found twice or more.
    ``kept``: not that, and no share over its limit. Null and empty texts have
    no word and fail; rows that repeat a key are judged alike; an empty table
    gives an empty result; other columns are not read.
    """
    limits = limits or Limits()
    names = ["line_share", *(f"share_{n}" for n in limits.grams)]
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "__text"):
            found = measure(texts(piece, "__text"), limits)
            failed = (found["n_words"] < 10) | (100 * found["n_repeat_words"] > 20 * found["n_words"])
            kept = ~failed & (found["line_share"] <= limits.lines)
            for n, most in limits.grams.items():
                kept &= found[f"share_{n}"] <= most
            data = [found[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            yield pa.RecordBatch.from_arrays(
                [column(piece, key), *map(pa.array, [*data, failed, kept, *(found[c] for c in names)])],
                [key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *names])

    schema = StructType([StructField(key, kind), *(StructField(c, LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))])
    for c in ("base_failed", "kept"):
        schema = schema.add(c, "boolean")
    for c in names:
        schema = schema.add(c, "double")
    return docs.select(key, docs[text].alias("__text")).mapInArrow(run, schema)

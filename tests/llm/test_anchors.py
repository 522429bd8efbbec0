"""Anchors found by runs of windows, against every window on its own."""

from __future__ import annotations

import numpy as np
import pytest

from cartulary.llm import flat, suffixes


def _plain(texts: list[bytes], width: int, size: int) -> list[tuple[int, int, int]]:
    """Anchor, first window's begin and last window's end, from every window on its own."""
    found: dict[int, list[int]] = {}
    grams = flat.grams(flat.prefix_bytes(np.frombuffer(b"".join(texts), np.uint8)), size) | flat.U(1)
    base = 0
    for text in texts:
        for start in range(base, base + len(text) - width + 1):
            at = start + int(np.argmin(grams[start : start + width - size + 1]))
            found.setdefault(at, []).append(start)
        base += len(text)
    return [(at, min(starts), max(starts) + width) for at, starts in sorted(found.items())]


@pytest.mark.parametrize("texts", [
    [b"x" * 60, b"y" * 60], [b"", b"a" * 300, b"", b"ab" * 90, b"abc" * 10], [b"one fish two fish " * 20, b"red fish blue fish " * 20], [b"q" * 100],
    [bytes(np.random.default_rng(i).integers(97, 97 + 2 + 8 * i, 150 + 40 * i, dtype=np.uint8)) for i in range(6)]])
def test_anchors_are_those_of_every_window(texts):
    for width, size in ((100, 24), (20, 6)):
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        at, _, begin, end, _ = suffixes.anchors(np.frombuffer(b"".join(texts), np.uint8), offsets, width, size)
        assert list(zip(at.tolist(), begin.tolist(), end.tolist())) == _plain(texts, width, size)


def test_only_texts_shorter_than_a_passage(spark):
    docs = spark.createDataFrame([(i, "y" * 60) for i in range(4)], "doc_id long, text string").coalesce(1)
    assert [(r.n_bytes, r.n_removed) for r in suffixes.trimmed(docs).collect()] == [(60, 0)] * 4

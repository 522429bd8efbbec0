"""Pre-tokens counted by bytes, against the splitter itself."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from cartulary.llm import base, flat, vocabulary
from cartulary.llm.queries import tokenizer_file


@pytest.fixture(scope="module")
def splitter():
    return vocabulary.Splitter(tokenizer_file())


def test_counts_are_those_of_the_split(splitter):
    rng = random.Random(5)
    letters = "abZ09'\"!.\x00\x1c\x7f§İé中՘s"
    chunks = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(3000)] + ["it's", "'tis", "!'s", "''S", "a1b22", "x" * 300]
    assert splitter.counts(chunks).tolist() == [len(splitter.words(c)) for c in chunks]
    assert splitter.counts([]).tolist() == []


def test_plain_chunks_are_not_split_one_by_one(splitter, monkeypatch):
    monkeypatch.setattr(splitter, "split", None)
    assert splitter.counts(["Plain", "words,", "a-1", "(x)"]).tolist() == [1, 2, 3, 3]


def test_a_worker_reads_the_tokenizer_once():
    assert vocabulary.library_encoder(tokenizer_file()) is vocabulary.library_encoder(tokenizer_file())


def test_runs_are_coded_in_memory_near_the_texts_own():
    column = pa.array([("word " * 1000 + "x" * 3000) * 30] * 8)
    size = sum(len(t) for t in column.to_pylist())
    tracemalloc.start()
    chunks, which, doc = flat.coded(column, ~flat.SPACE)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(chunks.to_pylist()) == {"word", "x" * 3000 + "word", "x" * 3000} and len(which) == len(doc)
    # Numbers of eight bytes for every byte of text were held before, twice.
    assert peak < 10 * size


def test_a_task_gives_back_what_earlier_ones_freed(monkeypatch):
    told = []
    monkeypatch.setattr(base, "release", lambda: told.append("released"))
    for piece in base.pieces(iter([pa.RecordBatch.from_arrays([pa.array(["a", "b"])], ["text"])]), "text", 1):
        told.append(piece.num_rows)
    assert told == ["released", 1, 1, "released"]


def test_powers_of_long_texts_are_not_kept():
    flat.prefix_bytes(np.zeros(300_000, np.uint8))
    assert len(flat._powers) > 300_000
    base.release()
    assert len(flat._powers) == len(flat._inverses) == 1
    again = flat.prefix_bytes(np.frombuffer(b"abcabc", np.uint8))
    assert flat.ranges(again, np.array([0]), np.array([3])) == flat.ranges(again, np.array([3]), np.array([6]))

"""Token counts against the library: random strings, odd texts, every code point."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from cartulary.llm import pieces

sentencepiece = pytest.importorskip("sentencepiece")
PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "   ", "▁", "▁ ▁", " ▁▁  ▁x", "a▁ b", "a  ▁ b\n\n  c", "<s>x</s><unk>", "<0x0A>", "\0a\0", "a" * 5000, "ab" * 3000, " " * 1000, "\n\t" * 100, "日本語" * 50, "=-" * 200, "🙂é" * 9, "lock " * 5000]


@pytest.fixture(scope="module")
def counts():
    return pieces.PieceCounts(PATH, memory=50_000)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def wrong(counts, library, texts: list[str]) -> list[str]:
    found = counts.of(pa.array(texts, pa.string()))
    return [t for t, n, ids in zip(texts, found.tolist(), library.encode(texts, num_threads=8)) if n != len(ids)]


def test_every_code_point(counts, library):
    assert not wrong(counts, library, [f"a{chr(i)}b" for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000])


def test_random_strings(counts, library):
    random = np.random.default_rng(5)
    for letters in ("ethano ▁", "etaoinshrdlu ▁ \n,.éèñ日本🙂1234<>/=*-_#xyzXYZ", [library.id_to_piece(i) for i in range(259, 32000)]):
        choice = np.array(list(letters), object)
        assert not wrong(counts, library, ["".join(choice[random.integers(0, len(choice), random.integers(1, 60))]) for _ in range(5000)])


def test_long_text_without_a_space(counts, library):
    random = np.random.default_rng(6)
    assert not wrong(counts, library, ["".join(random.choice(list("abcdefghijklmnopqrstuvwxyz"), 200_000))])


def test_rows(spark, library):
    rows = [(i % 7 if i % 5 else None, t, "x") for i, t in enumerate([*ODD, None, *ODD])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    found = pieces.token_counts(frame.repartition(3), PATH, limit=1000).collect()
    wanted = [(d, len((t or "").encode()), n := len(library.encode(t or "")), n > 1000) for d, t, _ in rows]
    order = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    assert order(found) == order(wanted)
    assert pieces.token_counts(frame.limit(0), PATH).count() == 0


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.trainer_spec.model_type = 1
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        pieces.PieceModel(str(tmp_path / "m"))

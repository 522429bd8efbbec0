"""Rows without a key of their own, and texts made to collide: by brute force on bytes."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from cartulary.llm import bpe, flat, minhash, packing, repetition, suffixes
from cartulary.llm.queries import tokenizer_file
from cartulary.llm.vocabulary import ChunkIds, library_encoder

random = np.random.default_rng(11)
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def prose(n: int) -> str:
    return " ".join("".join(random.choice(list("abcdefghij"), random.integers(2, 9))) for _ in range(n))


PASSAGE, BASE = prose(40), prose(120).split()
NEAR = " ".join([*BASE[:60], "other", *BASE[61:]])
TEXTS = [f"{prose(20)} {PASSAGE}", prose(70), f"{PASSAGE} {prose(20)}", prose(60), " ".join(BASE), NEAR, prose(80), "short", "", None, PASSAGE, f"x {PASSAGE}"]
KEYS = {
    "one each": list(range(len(TEXTS))), "all null": [None] * len(TEXTS), "all equal": [5] * len(TEXTS),
    "mixed": [3, None, None, 3, 9, None, None, 1, 1, None, 9, 0]}


def frame(spark, keys):
    return spark.createDataFrame([(k, t, 1, 2) for k, t in zip(keys, TEXTS)], "doc_id long, text string, __id long, n int").repartition(3)


def ordered(spark, keys) -> list[tuple]:
    """Rows in the order of key (null last), then of the hash that parts rows of one key."""
    from pyspark.sql import functions as F

    rows = frame(spark, keys).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    told = rows.select("doc_id", "text", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("h")).collect()
    return [(r.doc_id, r.text) for r in sorted(told, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.h))]


def cut(rows: list[tuple]) -> list[tuple]:
    seen, out = set(), []
    for key, text in rows:
        data = text.encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(data[i : i + 100])
        out.append((key, len(data), sum(gone), hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", list(KEYS))
def test_passages(spark, name):
    found = suffixes.trimmed(frame(spark, KEYS[name])).collect()
    wanted = cut(ordered(spark, KEYS[name]))
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in found], key=repr) == wanted
    assert sum(r.n_removed > 0 for r in found) == 4


@pytest.mark.parametrize("name", list(KEYS))
def test_passage_stage_keeps_clean_texts(spark, name):
    found = suffixes.drop_repeats(frame(spark, KEYS[name])).collect()
    whole = {t for t in TEXTS if t is not None and PASSAGE not in t and BASE[0] not in t.split()[:1]}
    assert whole <= {r.text for r in found} and len(found) == len(TEXTS) and {(r["__id"], r.n) for r in found} == {(1, 2)}


def shingles(text):
    words = WORD.findall(text or "")
    n = min(4, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


@pytest.mark.parametrize("name", list(KEYS))
def test_near_groups(spark, name):
    found = minhash.near_groups(frame(spark, KEYS[name])).collect()
    # A text with one word changed and a passage with one word before it are the near copies; all other rows stay.
    linked = {KEYS[name][TEXTS.index(t)] for t in (" ".join(BASE), NEAR)}
    first = min((k for k in linked if k is not None), default=None)
    assert sum(r.kept for r in found) == len(TEXTS) - 2
    assert sorted((r.n_shingles for r in found)) == sorted(len(shingles(t)) for t in TEXTS)
    assert sum(r.component_id == first for r in found if r.n_shingles == 117) >= 2 or first is None


def morse(n: int, a: str, b: str) -> tuple[str, str]:
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


@pytest.mark.parametrize("n", [1024, 4096])
def test_texts_made_to_collide(n):
    one, two = morse(n, "a", "b")
    data = np.frombuffer((one + two).encode(), np.uint8)
    assert len(set(flat.hashed(data, np.array([0, n]), np.array([n, 2 * n])).tolist())) == 2
    words = flat.Words(pa.array([one, two]))
    assert words.hash[0] != words.hash[1]
    assert repetition.measure(pa.array([f"{one}\n{two}\n{one}"]), repetition.Limits())["n_dup_lines"].tolist() == [1]


def test_hashes_of_ranges_do_not_know_their_place():
    data = np.frombuffer(b"abcdefghijklmnopq..abcdefghijklmnopq.", np.uint8)
    start = np.array([0, 19, 0, 1, 5, 5])
    found = flat.hashed(data, start, start + [17, 17, 16, 16, 0, 8]).tolist()
    assert found[0] == found[1] and len(set(found)) == 5


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


@pytest.mark.parametrize("coder", ["own", "library"])
def test_every_code_point(coder, library):
    encode = bpe.WordBpe(tokenizer_file()).encode if coder == "own" else library_encoder(tokenizer_file())
    texts = [f"a{chr(i)}b" for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    texts += [*morse(1024, "a", "b"), *morse(4096, "x", "é"), "Don't <|endoftext|> STOP <|x|>", "ΑΣ ΟΔΥΣΣΕΥΣ", "İ ǅ ẞ", "éa ́"]
    ids, offsets = ChunkIds(encode).of(pa.array(texts))
    wanted = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert [t for i, (t, w) in enumerate(zip(texts, wanted)) if ids[offsets[i] : offsets[i + 1]].tolist() != w] == []


def test_few_ids_move_at_the_end():
    packer = packing.SumOfSquares(256)
    sizes = random.integers(1, 400, 300).tolist()
    for doc, n in enumerate(sizes):
        packer.add(doc, np.arange(n))
    placed = sum(len(p[2]) for parts in packer.open.values() for w in parts for p in w)
    packer.finish()
    assert 0 < packer.n_moved < 0.6 * placed
    by = {}
    for doc, start, ids, total, sequence, offset in packer.done:
        by.setdefault(sequence, []).append((offset, len(ids)))
        assert ids.tolist() == list(range(start, start + len(ids))) and total == sizes[doc]
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 256 or at & (at - 1) == 0
    assert sum(len(p[2]) for p in packer.done) == sum(sizes)


@pytest.mark.parametrize("many", [1, 4, 1000])
def test_hot_anchors(spark, many, monkeypatch):
    """One phrase in all texts, in many surroundings that agree on one side, on both or on none."""
    phrase = prose(12)
    sides = [prose(18) for _ in range(4)]
    texts = [f"{sides[i % 4]} {phrase} {sides[i // 4 % 4]} {prose(i % 5)}" for i in range(40)] + [f"{prose(9)} {phrase} {prose(9)}" for _ in range(10)]
    rows = list(enumerate(texts))
    monkeypatch.setattr(suffixes.repeats, "__defaults__", (100, many))
    found = suffixes.trimmed(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in found], key=repr) == cut(rows)


@pytest.mark.parametrize("tile", [200, 2_000_000])
def test_links_across_tiles(spark, tile):
    """Members of long lists in different components, in one tile and in many."""
    sets = {i: np.unique(random.integers(0, 60, 40).astype(np.uint64)) for i in range(120)}
    sets |= {1000 + i: np.unique(np.append(s, np.uint64(77))) for i, s in sets.items() if i % 3 == 0}
    stored = spark.createDataFrame([(i, len(s), minhash.pack(s << np.uint64(16))) for i, s in sets.items()], "id long, n long, set binary")
    entries = spark.createDataFrame([(v, i, i // 2, len(s)) for v in (1, 2) for i, s in sets.items()], "value long, cls long, comp long, size long")
    found = {tuple(r) for r in minhash._across(entries, stored, 80, tile).collect()}
    wanted = {(a, b) for a in sets for b in sets if a < b and a // 2 != b // 2 and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert joined(found) == joined(wanted) and len(wanted) >= 40
    if tile > 1000:
        assert len(found) <= len(sets)


def joined(links) -> dict:
    """The smallest member that each one reaches."""
    least = {x: x for link in links for x in link}
    for _ in least:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return least


def test_spanning_links():
    for n in (0, 1, 30, 400):
        a, b = random.integers(0, 300, n), random.integers(300, 600, n)
        one, two = minhash.spanning(a, b)
        assert len(one) <= len(np.unique(np.concatenate((a, b))))
        assert joined(set(zip(one.tolist(), two.tolist()))) == joined(set(zip(a.tolist(), b.tolist())))

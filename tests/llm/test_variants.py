"""Spelling variants against all pairs of words on small tables."""

from __future__ import annotations

import collections
import re
import zlib

import numpy as np
import pytest
from cartulary.llm import variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows: list[tuple], noise: int = 97) -> dict[str, int]:
    counts = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def brute(rows: list[tuple], noise: int = 97) -> set[tuple]:
    counts = counted(rows, noise)
    beside = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(beside[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(beside[w]), counts.get(form[w])) for w, n in counts.items()}


def found(spark, rows: list[tuple], noise: int = 97) -> set[tuple]:
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(5)
    got = variants.variants(frame, noise=noise).collect()
    assert len({r.word for r in got}) == len(got)
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


@pytest.fixture(scope="module")
def rows():
    random = np.random.default_rng(8)
    words = ["".join(random.choice(list("aabé"), random.integers(4, 9))) for _ in range(300)]
    words += ["aaaaaa", "aaaaa", "aaaaaaa", "Straße", "STRASSE", "ÿéÿéÿ", "ÉCOLE", "école"]
    chosen = [words[min(int(random.exponential(60)), len(words) - 1)] for _ in range(12000)]
    texts = [" ".join(chosen[i : i + 60]) for i in range(0, len(chosen), 60)]
    keys = [None if i % 9 == 0 else i % 40 for i in range(len(texts))]
    return [*zip(keys, texts), (7, None), (8, ""), (9, "×÷ ab, 12"), (10, "x" * 3000), (10, "x" * 3000), (10, "x" * 3000), (11, "x" * 3001 + " " + "x" * 3001 + " " + "x" * 3001), *[(12, "x" * 1500 + "y" + "x" * 1499)] * 3]


def test_against_all_pairs(spark, rows):
    wanted = brute(rows)
    assert len(wanted) > 150 and any(r[1] != r[2] and r[1] for r in wanted)
    assert found(spark, rows) == wanted


def test_without_noise_and_empty(spark, rows):
    assert found(spark, rows[:60], 0) == brute(rows[:60], 0)
    assert found(spark, [(1, "one two"), (None, None)]) == set()
    assert variants.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_nodes_over_partitions(spark, parts):
    """Equal prefixes have one number, whatever partitions the words fall into."""
    random = np.random.default_rng(parts)
    words = sorted({"aaaa" + "".join(random.choice(list("ab"), random.integers(1, 9))) for _ in range(120)})
    frame = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        trie, names = variants._numbered_trie(frame, variants.F.col("word"), "trie")
        renamed = {r["node"]: r["name"] for r in names.collect()}
        nodes = {r.word: [renamed.get(x, x) for x in r.nodes] for r in trie.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    number = {}
    for w, own in nodes.items():
        assert len(own) == len(w)
        for i, x in enumerate(own):
            assert number.setdefault(w[: i + 1], x) == x
    assert len(set(number.values())) == len(number)


def test_blocks_of_a_task_are_one_trie():
    words = sorted({w.encode("latin-1") for w in ("abbey", "abbot", "abc", "abcd", "b", "ba", "é")})
    whole = variants._Trie(0).add(words)
    by_one, trie = [], variants._Trie(0)
    for w in words:
        by_one += trie.add([w])
    assert [x.tolist() for x in whole] == [x.tolist() for x in by_one]

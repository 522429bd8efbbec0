"""Ranked search against scores of all documents, and the SQL against both."""

from __future__ import annotations

import collections
import math
import re

import numpy as np
import pytest
from cartulary.llm import search
from cartulary.llm.sql import SQL

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs: list[tuple], items: list[tuple], top: int = 10) -> list[tuple]:
    counted = [(d, collections.Counter(terms(t))) for d, t in docs]
    counted = [(d, c, c.total()) for d, c in counted if c]
    length, df = sum(n for _, _, n in counted), collections.Counter(t for _, c, _ in counted for t in c)
    rows = []
    for item, text in items:
        scores = []
        for d, c, n in counted:
            m = 25 + 75 * n * len(counted) // length
            score = 0
            for t in terms(text):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * len(counted) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, d is None, d))
        rows += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def tables():
    random = np.random.default_rng(4)
    words = np.array([*(f"w{i}" for i in range(400)), "É", "日本", "Ab", "a"], object)

    def text(n: int) -> str:
        return random.choice([" ", "-", "\n", "_"]).join(words[np.minimum(random.exponential(40, n).astype(int), 403)])

    base = text(60)
    texts = [text(int(random.integers(1, 90))) for _ in range(250)] + [base] * 40 + [base + " " + text(3) for _ in range(30)]
    texts += ["", None, " .,;", "w1", "w1", "W1 w1", "\0w2\0", text(30_000), "x" * 100_000]
    docs = [(None if i % 50 == 7 else i // 2 if i % 11 else i, t) for i, t in enumerate(texts)]
    items = [(i, text(int(random.integers(1, 40)))) for i in range(25)] + [(3, base), (None, "w1 w1 w1"), (90, None), (91, "zzz"), (92, "É 日本 ab"), (93, base + " " + base)]
    return docs, items


def frames(spark, tables):
    docs, items = tables
    return (spark.createDataFrame([(d, t, 1, "y") for d, t in docs], "doc_id long, text string, n int, item_id string").repartition(5),
            spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int"))


def got(frame) -> list[tuple]:
    return sorted(map(tuple, frame.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_against_all_scores(spark, tables):
    docs, items = frames(spark, tables)
    wanted = brute(*tables)
    assert len(wanted) > 150
    assert got(search.ranked(docs, items)) == wanted


def test_blocks_of_items_and_small_tries(spark, tables, monkeypatch):
    docs, items = frames(spark, tables)
    monkeypatch.setattr(search, "ENTRIES", 300)
    assert got(search.ranked(docs.coalesce(1), items, block=1500, top=3)) == brute(*tables, top=3)


def test_empty_tables(spark, tables):
    docs, items = frames(spark, tables)
    assert got(search.ranked(docs.limit(0), items)) == got(search.ranked(docs, items.limit(0))) == []


def test_sql(tables):
    import duckdb
    import pandas as pd

    docs, items = tables
    with duckdb.connect() as base:
        base.register("documents", pd.DataFrame([(d, t) for d, t in docs if d is not None and "\0" not in (t or "")], columns=["doc_id", "text"]).astype({"doc_id": "int64"}))
        base.register("benchmark", pd.DataFrame([x for x in items[:25]], columns=["item_id", "text"]))
        found = sorted(base.sql(SQL["op12_fp_tree_search"]).fetchall(), key=repr)
    assert found == brute([x for x in docs if x[0] is not None and "\0" not in (x[1] or "")], items[:25])


def test_bounds_hold_and_prune():
    """No document scores above the bound of a node over it, and most nodes stay closed."""
    random = np.random.default_rng(7)
    sizes = random.integers(1, 30, 600)
    terms_of = [random.choice(300, n, replace=False, p=(w := 1 / np.arange(300, 0, -1)) / w.sum()) for n in sizes]
    terms_of[100:160] = [terms_of[100]] * 60
    sizes = np.array([len(t) for t in terms_of])
    flat_terms, tfs = np.concatenate(terms_of).astype(np.int64), random.integers(1, 6, sizes.sum())
    m = random.integers(25, 400, 600)
    tree = search.Tree(np.arange(600), m, sizes, flat_terms, tfs)
    assert sorted(tree.doc[tree.node < 0].tolist()) == list(range(600))
    ends = np.cumsum(sizes)
    for _ in range(20):
        ranks = random.choice(300, 8, replace=False)
        weights, repeats = random.integers(1, 9000, 8), random.integers(1, 3, 8)
        scores = np.zeros(600, np.int64)
        for d in range(600):
            own = {t: f for t, f in zip(terms_of[d].tolist(), tfs[ends[d] - sizes[d] : ends[d]].tolist())}
            scores[d] = sum(int(r) * (int(w) * int(search.share(own[t], m[d]))) for t, w, r in zip(ranks.tolist(), weights, repeats) if t in own)

        def under(node: int) -> list[int]:
            return [d for c in range(tree.first[node], tree.first[node + 1]) for d in ([int(tree.doc[c])] if tree.node[c] < 0 else under(tree.node[c]))]

        for node in range(len(tree.first) - 1):
            for c, bound in enumerate(tree.bounds(node, ranks, weights, repeats), int(tree.first[node])):
                below = [int(tree.doc[c])] if tree.node[c] < 0 else under(tree.node[c])
                assert bound >= scores[below].max() if tree.node[c] >= 0 else bound == scores[below[0]]
        best = search.Best(10)
        opened = search.search(tree, ranks, weights, repeats, best)
        order = np.lexsort((np.arange(600), -scores))[:10]
        assert best.doc.tolist() == [d for d in order if scores[d] > 0] and opened < len(tree.first) / 2

"""The pipeline on the smallest driver data: each stage against what its operator promises."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver data not present")
WORD = re.compile(r"[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.base.land(stage(spark, docs, FOLDER), name.replace(" ", "-"))
        seen.append(docs.collect())
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    return seen


def test_stages_only_drop(stages):
    ids = [{r.doc_id for r in s} for s in stages]
    assert all(later <= before for before, later in zip(ids, ids[1:]))
    assert ids[4] == ids[3] == ids[5]


def test_exact(stages):
    texts = [re.sub(r"[\x20\x09-\x0d]", "", r.text or "") for r in stages[2]]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0d]", "", r.text or "") for r in stages[1]})


def test_near(stages):
    def shingles(text):
        w = WORD.findall((text or "").lower())
        n = min(5, len(w))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()

    kept, all_ = {r.doc_id for r in stages[3]}, {r.doc_id: shingles(r.text) for r in stages[2]}
    ids = sorted(all_)
    best = {d: d for d in ids}
    links = [(a, b) for a in ids for b in ids if a < b and all_[a] and 100 * len(all_[a] & all_[b]) >= 80 * len(all_[a] | all_[b])]
    for _ in ids:
        for a, b in links:
            best[a] = best[b] = min(best[a], best[b])
    assert kept == set(best.values())


def test_passages(stages):
    seen = set()
    cut = {r.doc_id: r for r in stages[4]}
    for r in sorted(stages[3], key=lambda r: r.doc_id):
        data = (r.text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(data[i : i + 100])
        left = bytes(b for b, g in zip(data, gone) if not g).decode("utf-8", "ignore")
        assert cut[r.doc_id].text == (left if r.text is not None else None) and cut[r.doc_id].n_chars == len(left)


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))

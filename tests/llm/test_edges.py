"""Empty tables, rows without a key, repeated rows and one very long text, for operators that other tests only see with clean keys."""

from __future__ import annotations

import collections
import hashlib

import pytest
from cartulary.llm import archives, blocks, bpe, classifier, packing, repetition, suffixes
from cartulary.llm.queries import tokenizer_file

DOCS = "doc_id long, text string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(120_000))
ROWS = [(None, "a b c"), (None, "a b c"), (None, None), (3, "a b c"), (3, "other words here"), (3, ""), (4, LONG), (5, LONG)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(*r, "x") for r in ROWS], DOCS + ", n_tokens string").repartition(3)


def counted(rows) -> collections.Counter:
    return collections.Counter(tuple(r) for r in rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    for made in (packing.packed(none, tokenizer_file()), bpe.coded(none, tokenizer_file()), suffixes.trimmed(none), blocks.exact_groups(none), repetition.judged(none)):
        assert made.count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert classifier.scored(none, classifier.train(none, labels)).count() == 0
    assert archives.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_codes_go_with_the_text(spark, frame):
    found = counted(bpe.coded(frame, tokenizer_file()).select("doc_id", "n_tokens", "ids_sha256").collect())
    encoder = bpe.WordBpe(tokenizer_file())
    wanted = collections.Counter()
    for key, text in ROWS:
        ids = encoder.encode((text or "").split())[0].tolist()
        wanted[key, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()] += 1
    assert found == wanted


def test_every_row_is_packed(spark, frame):
    found = packing.packed(frame, tokenizer_file(), window=256).collect()
    first = collections.Counter((r.doc_id, r.doc_tokens) for r in found if r.start == 0)
    coded = collections.Counter((r.doc_id, r.n_tokens + 1) for r in bpe.coded(frame, tokenizer_file()).collect())
    assert first == coded
    assert sum(r.length for r in found) == sum(n * k for (_, n), k in coded.items())


def test_a_long_text_told_twice_is_cut_once(spark, frame):
    rows = {r.doc_id: r for r in suffixes.trimmed(frame.filter("doc_id > 3")).collect()}
    assert rows[5].n_removed == len(LONG) and rows[5].n_spans == 1 and rows[4].n_bytes == len(LONG)
    groups = {r.doc_id: r for r in blocks.exact_groups(frame.filter("doc_id > 3")).collect()}
    assert (groups[4].keep_id, groups[5].keep_id, groups[5].group_size) == (4, 4, 2)


def test_scores_go_with_the_text(spark):
    rows = [(i, "good plain words " * 5 if i % 2 else "buy ### now !!! " * 5) for i in range(80)]
    docs = spark.createDataFrame(rows + [(None, rows[1][1]), (None, rows[0][1]), (7, rows[0][1]), (7, None)], DOCS).repartition(2)
    labels = spark.createDataFrame([(i, i % 2) for i in range(80) if i != 7] + [(None, 0)], "doc_id long, quality int")
    found = classifier.scored(docs, classifier.train(docs, labels)).collect()
    by_text = {round(r.score, 4) for r in found if r.doc_id is None}
    assert len(found) == 84 and by_text <= {round(r.score, 4) for r in found if r.doc_id in (10, 11)} and len(by_text) == 2


def test_pages_without_a_key(spark):
    pages = spark.createDataFrame([(None, "u", "same"), (None, "u", "same"), (2, None, "same"), (2, "u", None), (9, "u", "own")], "page_id long, url string, html string")
    found = archives.archived(pages).collect()
    assert sorted(((r.page_id, r.payload_bytes) for r in found), key=repr) == sorted([(None, 4), (None, 4), (2, 4), (2, 0), (9, 3)], key=repr)
    assert {(r.page_id, r.record_type) for r in found if r.payload_bytes == 3} == {(9, "response")}

"""Scrubbing by a table of secrets."""

from __future__ import annotations

import re

import numpy as np
import pytest

from cartulary.operators.scrub import rewrite, scrub_all


def plain(text, secrets):
    """Longest first, one after the other, over what is not hidden yet."""
    if text is None:
        return None
    parts = [text]
    for secret in sorted(filter(None, set(secrets)), key=lambda s: (-len(s), s)):
        parts = [q for p in parts for q in (re.split("(" + re.escape(secret) + ")", p) if p is not None else [None])]
        parts = [None if p == secret else p for p in parts]
    return "".join("***" if p is None else p for p in parts)


@pytest.mark.parametrize("block", [10, 2_000_000])
def test_many_secrets(spark, tmp_path, block):
    random = np.random.default_rng(2)
    secrets = sorted({"".join(random.choice(list("xyz"), random.integers(4, 7))) + "k" for _ in range(25)}) + ["é+日", "a.b", "", None]
    texts = [" ".join(random.choice([s or "-" for s in secrets], 4)) + "".join(random.choice(list("xyzk"), 30)) for _ in range(60)] + ["", None, "aXb", "no secret", "x" * 50_000 + "a.ba.b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, message string").repartition(4)
    given = spark.createDataFrame([(s, 1) for s in secrets], "secret string, at int")
    found = {r.id: r.message for r in scrub_all(rows, given, "id", "message", "secret", str(tmp_path), block).collect()}
    # Equal lengths that overlap are taken from the left; the plain way takes them by name.
    overlapping = {i for i, t in enumerate(texts) if t and found[i] != plain(t, secrets)}
    assert set(found) == set(range(len(texts))) and len(overlapping) < 10
    for i, text in enumerate(texts):
        assert text is None or not any(s and s in found[i] for s in secrets)
    assert found[61] is None and [found[i] for i in (60, 62, 63)] == ["", "aXb", "no secret"] and found[64].endswith("x******")


def test_longer_secrets_win():
    assert rewrite("hunter11 hunter1", [(0, 7), (0, 8), (9, 7)]) == "*** ***"
    assert rewrite("abc", []) == "abc"


def test_no_secrets(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, message string")
    none = spark.createDataFrame([(None,)], "secret string")
    assert sorted(map(tuple, scrub_all(rows, none, "id", "message", "secret", str(tmp_path)).collect())) == [(1, "a"), (2, None)]

"""Every operator against a plain version of its contract on small tables with odd rows."""

from __future__ import annotations

import base64
import collections
import hashlib
import io
import math
import re
import zipfile
import zlib

import numpy as np
import pytest
from cartulary.llm import archives, blocks, bpe, classifier, components, hilbert, minhash, mixing, packing, repetition, suffixes
from cartulary.llm.queries import tokenizer_file
from cartulary.llm.vocabulary import library_encoder

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
random = np.random.default_rng(3)
STEMS = ["an", "ther", "ing", "é", "ou", "la", "ß", "to", "#", "re"]


def prose(n: int) -> str:
    return " ".join("".join(random.choice(STEMS, random.integers(1, 4))) for _ in range(n))


def corpus() -> list[tuple]:
    passage, base = prose(60), prose(80).split()
    rows = [prose(int(random.integers(1, 120))) for _ in range(30)]
    rows += [f"{prose(20)} {passage} {prose(15)}" for _ in range(4)] + [passage, "", None, "   \n\t", "one", "a b c", "日本語 x\x85y  z", "a" * 900]
    for i in range(12):  # near copies
        changed = list(base)
        for at in random.choice(80, i // 2, replace=False):
            changed[at] = "new" + str(i)
        rows.append(" ".join(changed))
    rows += [rows[0], rows[0], rows[0].replace(" ", "  "), "line one two\n" * 12, "Don't <|endoftext|> STOP", prose(9000)]
    return [(i * 3, text, "en", "s", i) for i, text in enumerate(rows)]


ROWS = corpus()
TEXT = {d: t or "" for d, t, *_ in ROWS}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    # Columns whose names the operators use inside must not disturb them.
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in ROWS], SCHEMA + ", __id long, __name int, value int")
    return frame.repartition(3)


def words(text: str) -> list[str]:
    return WORD.findall(text.translate(LOWER))


def test_packing(docs):
    encoder = bpe.WordBpe(tokenizer_file())
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.packed(docs, tokenizer_file(), window=256).collect():
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(by) == set(TEXT)
    for d, text in TEXT.items():
        ids, _ = encoder.encode(WORD.findall(text))
        ids, at = np.append(ids, 2).astype("<u4"), 0
        for r in sorted(by[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 256 or at & (at - 1) == 0


def test_packing_places_by_sum_of_squares():
    packer = packing.SumOfSquares(10)
    for d, n in enumerate([3, 4, 6, 7, 4, 6, 3, 2]):
        before, options = packer.counts.copy(), []
        for level in [0, *np.flatnonzero(before)]:
            if level + n <= 10:
                after = before.copy()
                after[level] -= level > 0
                if level + n < 10:
                    after[level + n] += 1
                options.append((int((after[1:10] ** 2).sum()), level))
        chosen = packer.level_for(n)
        assert min(options)[0] == next(s for s, level in options if level == chosen)
        packer.add(d, np.arange(n))


def test_library_ids_agree_with_merge_rounds(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    chunks = sorted({w for t in TEXT.values() for w in WORD.findall(t)})[:3000] + ["don't", "ΣΑΣ", "İx", "ﬁ", "<|endoftext|>a<|startoftext|>", "½x²", "\x85", "🙂"]
    own, by_library = bpe.WordBpe(tokenizer_file()).encode(chunks), library_encoder(tokenizer_file())(chunks)
    for i, chunk in enumerate(chunks):
        want = tokenizer.encode(chunk, add_special_tokens=False).ids
        for ids, offsets in (own, by_library):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == want, chunk


def test_coding(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    found = {r.doc_id: r for r in bpe.coded(docs, tokenizer_file(), with_ids=True).collect()}
    for d, text in TEXT.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert found[d].ids == ids and found[d].n_tokens == len(ids)
        assert found[d].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found[d].decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_archives(spark):
    rows = [(1, "http://a/\r\nx", "same"), (2, None, "same"), (3, "u", ""), (4, "u", None), (5, "u", "é" * 5000), (6, "u", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    found = {r.page_id: r for r in archives.archived(pages).collect()}
    for page, _, html in rows:
        data = (html or "").encode()
        best = max(p for p, _, h in rows if (h or "") == (html or ""))
        want = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if best == page else "revisit", None if best == page else best)
        assert (found[page].payload_bytes, found[page].payload_digest, found[page].record_type, found[page].refers_to) == want
    limited = {r.page_id: r.record_type for r in archives.archived(pages, least=1).collect()}
    assert limited[3] == limited[4] == "response" and limited[1] == "revisit"
    assert archives.archived(pages.limit(0)).count() == 0


def test_zip64_directory(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as packed:
        packed.comment = b"PK\5\6 not the end"
        for i in range(5):
            packed.writestr(f"m{i}", bytes(range(i, i + 100)))
        packed.writestr("small", "deflated " * 100, zipfile.ZIP_DEFLATED)
    archive = archives.StoredZip(out, len(out.getvalue()))
    assert archive.whole("m3") == bytes(range(3, 103)) and archive.range("m4", 10, 5) == bytes(range(14, 19))
    with pytest.raises(ValueError):
        archive.range("m4", 99, 2)
    with pytest.raises(ValueError):
        archive.whole("small")
    with pytest.raises(ValueError):
        archives.StoredZip(io.BytesIO(b"nothing here" * 10), 120)


def brute_groups(n: int, percent: int) -> dict[int, tuple]:
    sets = {}
    for d, text in TEXT.items():
        w = words(text)
        m = min(n, len(w))
        sets[d] = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
    best = {d: d for d in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(best[a], best[b])
            changed |= best[a] != low or best[b] != low
            best[a] = best[b] = low
    return {d: (len(sets[d]), best[d], best[d] == d) for d in sets}


@pytest.mark.parametrize(("short", "tile"), [(32, 256), (2, 4)])
def test_near_groups(docs, monkeypatch, short, tile):
    monkeypatch.setattr(minhash, "SHORT", short)
    monkeypatch.setattr(minhash._across, "__defaults__", (tile,))
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_groups(docs).collect()}
    assert found == brute_groups(4, 80)


def test_near_groups_odd_tables(spark, docs):
    assert minhash.near_groups(docs.limit(0)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in minhash.near_groups(rows).filter("n_shingles > 0").collect()) == [
        (-1, 7, False), (7, 7, True), (7, 7, True)]


def test_near_groups_plan_long_lists_only_where_there_are_some(spark, docs, monkeypatch):
    """Without an open list, or without a long one, what they need is not planned."""
    monkeypatch.setattr(minhash, "_across", lambda *_: pytest.fail("no list is long"))
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_groups(docs).collect()}
    assert found == brute_groups(4, 80)
    monkeypatch.setattr(minhash, "_short_pairs", lambda *_: pytest.fail("no list is open"))
    apart = spark.createDataFrame([(3, "a b c d e"), (1, "a  b c d e"), (2, "f g h i j k")], "doc_id long, text string")
    assert sorted(tuple(r) for r in minhash.near_groups(apart).collect()) == [(1, 2, 1, True), (2, 3, 2, True), (3, 2, 1, False)]


def test_tile_links():
    left, right = [np.unique(random.integers(0, 60, 40).astype(np.uint64)) for _ in range(9)], [np.unique(random.integers(0, 60, 40).astype(np.uint64)) for _ in range(7)]
    i, j = minhash.tile_links(left, right, 40)
    want = {(a, b) for a in range(9) for b in range(7) if 100 * len(np.intersect1d(left[a], right[b])) >= 40 * len(np.union1d(left[a], right[b]))}
    assert set(zip(i.tolist(), j.tolist())) == want and want


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 103)]
    found = dict(components.components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert {found[i] for i in range(1, 41)} == {1} and found[103] == 1 and found[101] == 100


def test_mixing(docs):
    rows = {r.doc_id: r for r in mixing.scored(docs).collect()}
    tokens = {d: [*words(t), None] for d, t in TEXT.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in TEXT}
    counts = collections.Counter(w for d in tokens if not held[d] for w in tokens[d])
    total, distinct = sum(counts.values()), len(counts)
    for d, r in rows.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(tokens[d]), sum(counts[w] > 0 for w in tokens[d]), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens[d]))
        assert r.score < 0
    assert mixing.scored(docs.limit(0)).count() == 0


def test_shards(docs):
    rows = hilbert.hilbert_shards(docs).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        data = TEXT[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
        slots[r.shard].append(r.slot)
    assert sorted(map(len, slots.values()))[0] + 1 >= max(map(len, slots.values())) and len(rows) == len(ROWS)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert hilbert.hilbert_shards(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2)])
def test_curve_is_a_walk(spark, dims, bits):
    """Each cell once, and neighbours on the curve differ by one step in one dimension."""
    side = 1 << bits
    cells = [tuple((i // side**k) % side for k in range(dims)) for i in range(side**dims)]
    names = [f"d{k}" for k in range(dims)]
    placed = hilbert.curve(spark.createDataFrame(cells, names), names, bits, "at").orderBy("at").collect()
    assert [r["at"] for r in placed] == list(range(side**dims))
    assert all(sum(abs(a[n] - b[n]) for n in names) == 1 for a, b in zip(placed, placed[1:]))


def test_written_shards(spark, docs, tmp_path):
    hilbert.write_shards(docs, str(tmp_path / "out"), shards=4)
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(TEXT)


def test_repetition(docs):
    found = {r.doc_id: r for r in repetition.judged(docs).collect()}
    for d, text in TEXT.items():
        w = WORD.findall(text)
        counts = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        inside = {i + k for i in range(len(w) - 4) if counts[tuple(w[i : i + 5])] > 1 for k in range(5)}
        seen, lines = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                lines += line in seen
                seen.add(line)
        failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
        r = found[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), lines, len(inside), failed)
        assert not (r.kept and failed)
        for n in (5, 10):
            first, covered = set(), set()
            for i in range(len(w) - n + 1):
                gram = tuple(w[i : i + n])
                covered |= set(range(i, i + n)) if gram in first else set()
                first.add(gram)
            assert r[f"share_{n}"] == pytest.approx(sum(len(w[i]) for i in covered) / max(sum(map(len, w)), 1))
    assert repetition.judged(docs.limit(0)).count() == 0


def brute_cut() -> dict[int, tuple]:
    seen, out = set(), {}
    for d in sorted(TEXT):
        data = TEXT[d].encode()
        gone = np.zeros(len(data) + 2, bool)
        for i in range(len(data) - 99):
            gone[i + 1 : i + 101] |= data[i : i + 100] in seen
            seen.add(data[i : i + 100])
        inside = gone[1:-1]
        kept = bytes(np.frombuffer(data, np.uint8)[~inside])
        out[d] = (len(data), int(inside.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("many", [1000, 2])
def test_repeated_passages(docs, monkeypatch, many):
    monkeypatch.setattr(suffixes.repeats, "__defaults__", (100, many))
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.trimmed(docs).collect()}
    assert found == brute_cut()


def test_suffix_array():
    data = random.integers(97, 99, 3000).astype(np.uint8)
    data[500:900] = data[100:500]
    order = suffixes.suffix_array(data, 100)
    text = data.tobytes()
    assert sorted(order.tolist()) == list(range(3000))
    assert all(text[a : a + 100] <= text[b : b + 100] for a, b in zip(order, order[1:]))
    shared = suffixes.common_prefixes(data, order, 100)
    for k in range(1, 3000, 17):
        a, b = text[order[k - 1] :], text[order[k] :]
        n = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        assert shared[k] == min(n, 100)


def test_classifier(spark):
    rows = [(i, prose(40) if i % 3 else " ".join([prose(1)] * 40).upper() + "!!") for i in range(400)]
    frame = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)] + [(5, None), (None, 1)], "doc_id long, quality int")
    found = {r.doc_id: r for r in classifier.scored(frame, classifier.train(frame, labels)).collect()}
    held = [r for d, r in found.items() if r.held_out and d < 400]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for d, r in found.items())
    assert sum(r.predicted == (r.doc_id % 3 > 0) for r in held) >= 0.95 * len(held) > 50
    # Held-out labels are not learned from.
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    again = {r.doc_id: r.score for r in classifier.scored(frame, classifier.train(frame, turned)).collect()}
    assert all(again[d] == pytest.approx(r.score) for d, r in found.items())
    assert classifier.scored(frame.limit(0), classifier.train(frame.limit(0), labels)).count() == 0


@pytest.mark.parametrize("block", [2048, 7])
def test_exact_groups(docs, block):
    groups = collections.defaultdict(list)
    for d, text in TEXT.items():
        groups[re.sub(r"[\x20\x09-\x0d]", "", text)].append(d)
    want = {}
    for norm, members in groups.items():
        keep = min(members, key=lambda d: (-len(TEXT[d]), d))
        want |= {d: (keep, len(members), d == keep, hashlib.sha256(norm.encode()).hexdigest()) for d in members}
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in blocks.exact_groups(docs, block=block).collect()}
    assert found == want
    assert blocks.exact_groups(docs.limit(0)).count() == 0


def test_null_and_repeated_keys(spark):
    rows = spark.createDataFrame([(None, "x y"), (4, "xy"), (4, "xy"), (None, None)], "doc_id long, text string")
    found = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in blocks.exact_groups(rows).collect())
    assert found == [(0, 0, 1, True), (0, 0, 3, True), (4, 0, 3, False), (4, 0, 3, False)]
    assert packing.packed(rows, tokenizer_file()).count() >= 4
    assert suffixes.trimmed(rows).count() == repetition.judged(rows).count() == mixing.scored(rows).count() == 4
    assert hilbert.hilbert_shards(rows, tags=()).count() == bpe.coded(rows, tokenizer_file()).count() == 4


@pytest.mark.parametrize("drop", [blocks.drop_exact, minhash.drop_near])
def test_rows_of_one_key_are_dropped_one_by_one(spark, drop):
    a, b, c, d = (prose(40) for _ in range(4))
    rows = spark.createDataFrame([(3, a), (5, a), (5, b), (5, b), (None, a), (None, c), (None, d), (None, d), (7, d)], "doc_id long, text string")
    kept = sorted(((r.doc_id or 0, r.text) for r in drop(rows.repartition(4)).collect()), key=str)
    assert kept == sorted([(3, a), (5, b), (0, c), (7, d)], key=str)


def test_start_is_learned_from_training_texts(spark):
    rows = [(i, "a b c d " * 30) for i in range(20)]
    found = mixing.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len({round(r.score, 3) for r in found}) == 1
    few = mixing.scored(spark.createDataFrame([(i, "a b") for i in range(20)], "doc_id long, text string")).collect()
    assert len({round(r.score, 4) for r in few}) == 1


def test_tags_order_by_their_whole_strings(spark):
    tags = [None, *(f"https://site/{i:04d}" for i in range(63))]
    rows = spark.createDataFrame([(1, "x", t) for t in tags], "doc_id long, text string, source string")
    found = hilbert.tag_places(rows, "source", "at").orderBy("at").collect()
    assert [r.source for r in found] == tags and [r["at"] for r in found] == list(range(64))
    assert len({r.curve for r in hilbert.hilbert_shards(rows, tags=("source",)).collect()}) == 16

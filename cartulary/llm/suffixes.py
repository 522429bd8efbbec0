"""Repeated passages by suffix arrays.

A passage is a string of ``WIDTH`` bytes. Where it occurs again, all its
occurrences hold the same anchor: a short string whose hash is smallest in the
window. So texts meet by anchors, not by all their suffixes:

1. One pass gives the anchors of each text, with a hash of the context: the
   bytes of all windows that have this anchor.
2. Anchors that occur once are done. If an anchor has one context everywhere,
   all occurrences but the first are repeated as a whole.
3. The first occurrence of each of several contexts goes, as bytes, to a shard
   that holds all contexts of its anchors. A shard sorts its suffixes
   (Larsson-Sadakane: only groups not yet sorted are refined, the depth doubles
   each round), takes the common prefixes of neighbours, and compares places in
   each run with ``WIDTH`` common bytes or more.
4. An anchor with very many contexts would make a shard too large. Two equal
   windows agree on half of what is beside the anchor, on its left or on its
   right; so its contexts are dealt again, by the anchor and that half on each
   side. Where very many still agree on a side, the windows of those contexts
   meet as hashes, combined before the shuffle.
5. Repeated windows are merged to spans in their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import flat
from .base import column, identified, land, marked, pieces, texts

WIDTH = 100
ANCHOR = 24
#: Contexts of an anchor that go to one shard at most; with more, its sides count too.
MANY = 1000
#: Bytes of text whose anchors are sought together; each byte takes some hundred bytes of arrays meanwhile.
TOGETHER = 1 << 20
#: Bytes of contexts that are sorted together, likewise.
SHARD = 1 << 19


# --- numpy -------------------------------------------------------------------


def _slide(values: np.ndarray, n: int, op) -> np.ndarray:
    """``op`` over each run of ``n`` values."""
    done, size = values, 1
    while size * 2 <= n:
        done = op(done[:-size], done[size:])
        size *= 2
    return op(done[: len(values) - n + 1], done[n - size :][: len(values) - n + 1]) if size < n else done


def anchors(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, size: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, hashes, context borders and context hashes of all anchors of some texts."""
    empty = np.empty(0, np.int64)
    if len(data) < width:
        return empty, empty.astype(flat.U), empty, empty, empty.astype(flat.U)
    sums = flat.prefix_bytes(data)
    grams = flat.grams(sums, size) | flat.U(1)
    span = width - size + 1
    low = _slide(grams, span, np.minimum)  # by start of window
    # Windows that reach into the next text have no anchor.
    for border in offsets[1:-1].tolist():
        low[max(border - width + 1, 0) : max(border, 0)] = 0
    # Neighbouring windows of one smallest hash are looked at together, by the first of them.
    begin = flat.runs(low)
    until = np.append(begin[1:], len(low))
    some = low[begin] != 0
    begin, until = begin[some], until[some]
    at = begin + np.lib.stride_tricks.sliding_window_view(grams, span)[begin].argmin(axis=1)
    # Its leftmost place holds until windows begin behind it; where the same string comes again, further places follow.
    end = np.minimum(until, at + 1)
    rest = np.flatnonzero(end < until)
    if len(rest):
        sizes = until[rest] - end[rest] + span - 1
        run = np.repeat(np.arange(len(rest)), sizes)
        where = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + end[rest][run]
        same = np.flatnonzero(grams[where] == low[begin[rest]][run])
        run, where = run[same], where[same]
        # A place is leftmost for the windows from behind the place before it.
        after = np.empty_like(where)
        after[1:] = where[:-1] + 1
        heads = flat.runs(run)
        after[heads] = end[rest][run[heads]]
        known = after < until[rest][run]
        run, where, after = run[known], where[known], after[known]
        at, begin = np.concatenate((at, where)), np.concatenate((begin, after))
        end = np.concatenate((end, np.minimum(until[rest][run], where + 1)))
        order = np.argsort(at)
        at, begin, end = at[order], begin[order], end[order]
    end = end - 1 + width
    # The place of the anchor in its context is part of what must agree.
    context = flat.mix(flat.ranges(sums, begin, end) + (at - begin).astype(flat.U))
    return at, grams[at], begin, end, context


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``data`` in the order of their first ``depth`` bytes at least.

    The first round sorts by eight bytes. After that each round takes the names
    of the suffixes ``h`` bytes further on, and only groups that are not yet
    single are sorted again.
    """
    n = len(data)
    wide = np.concatenate((data, np.zeros(8, np.uint8)))
    keys = np.zeros(n, flat.U)
    for i in range(8):
        keys = keys << flat.U(8) | wide[i : i + n].astype(flat.U)
    order = np.argsort(keys)
    begin = flat.runs(keys[order])
    name = np.empty(n, np.int64)
    name[order] = np.repeat(begin, np.diff(np.append(begin, n)))
    h = 8
    # A group's name is the place of its first member; sizes tell which are single.
    sizes = np.diff(np.append(begin, n))
    places = np.repeat(begin, sizes)
    todo = np.flatnonzero(np.repeat(sizes, sizes) > 1)
    while h < depth and len(todo):
        suffix = order[todo]
        further = suffix + h
        second = np.where(further < n, name[np.minimum(further, n - 1)] + 1, 0)
        by = places[todo].astype(flat.U) << flat.U(32) | second.astype(flat.U)
        again = np.argsort(by)
        order[todo], by = suffix[again], by[again]
        start = flat.runs(by)
        count = np.diff(np.append(start, len(by)))
        # Members of a group stand side by side, so the new group begins where its first member stands.
        new = np.repeat(todo[start], count)
        places[todo] = new
        name[order[todo]] = new
        todo = todo[np.repeat(count, count) > 1]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Common bytes of each suffix in ``order`` with the one before it there, up to ``limit``; ``order`` may leave suffixes out.

    All neighbours are compared at once, eight bytes a step; those that differ
    leave.
    """
    n = len(data)
    wide = np.concatenate((data, np.zeros(limit + 16, np.uint8)))
    words = np.zeros(n + limit + 8, flat.U)
    for i in range(8):
        words |= wide[i : i + len(words)].astype(flat.U) << flat.U(8 * i)
    found = np.zeros(len(order), np.int64)
    active = np.arange(1, len(order))
    for step in range(0, limit, 8):
        x = words[order[active] + step] ^ words[order[active - 1] + step]
        same = x == 0
        low = x[~same] & (~x[~same] + flat.U(1))
        found[active[~same]] = step + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        active = active[same]
        if not len(active):
            break
    found[active] = limit
    if len(order) > 1:
        found[1:] = np.minimum(found[1:], n - np.maximum(order[1:], order[:-1]))
    return np.minimum(found, limit)


def repeated(contexts: list[bytes], key: np.ndarray, start: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """For each context, the places of its windows that also occur earlier among the contexts.

    ``key`` and ``start`` say where a context begins; earlier means a smaller
    key, or the same key and an earlier place.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    owner = np.repeat(np.arange(len(contexts)), sizes)
    place = np.arange(len(data)) - np.repeat(ends - sizes, sizes)
    order = suffix_array(data, width)
    # Only places where a window begins are compared; the others were needed to sort these.
    suffix = order[(place + width <= sizes[owner])[order]]
    group = np.cumsum(common_prefixes(data, suffix, width) < width)
    own, at = owner[suffix], place[suffix]
    where, whose = start[own] + at, key[own]
    ranked = np.lexsort((where, whose, group))
    suffix, group, where, whose, own, at = (x[ranked] for x in (suffix, group, where, whose, own, at))
    first = np.repeat(flat.runs(group), np.diff(np.append(flat.runs(group), len(group)))) if len(group) else np.empty(0, np.int64)
    again = (whose != whose[first]) | (where != where[first])
    out = [np.empty(0, np.int64)] * len(contexts)
    own, at = own[again], at[again]
    sort = np.lexsort((at, own))
    own, at = own[sort], at[sort]
    begin = flat.runs(own)
    for a, b in zip(begin, np.append(begin[1:], len(own))):
        out[own[a]] = at[a:b]
    return out


def spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as maximal runs."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    new = np.concatenate(([True], starts[1:] > ends[:-1])) if len(starts) else np.empty(0, bool)
    at = np.flatnonzero(new)
    return starts[at], ends[np.append(at[1:] - 1, len(ends) - 1)] if len(at) else ends[:0]


# --- Spark -------------------------------------------------------------------

def _anchor_rows(rows: DataFrame, width: int, borders: bool = True) -> DataFrame:
    """``__id, at, lo, hi, a, c`` of all anchors of ``__id, __text``; places count in the text. Without ``borders`` no ``lo, hi``."""
    names = ["__id", "at", *(["lo", "hi"] if borders else []), "a", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "__text", TOGETHER):
            data, offsets = flat.joined(texts(piece, "__text"))
            at, a, lo, hi, c = anchors(data, offsets, width)
            doc = np.searchsorted(offsets, at, "right") - 1
            ids = column(piece, "__id").to_numpy(zero_copy_only=False)[doc]
            for i in range(0, max(len(at), 1), 50_000):
                s = slice(i, i + 50_000)
                places = [pa.array((x[s] - offsets[doc[s]]).astype(np.int32)) for x in ((at, lo, hi) if borders else (at,))]
                yield pa.RecordBatch.from_arrays([pa.array(ids[s], pa.int64()), *places, pa.array(a[s].view(np.int64)), pa.array(c[s].view(np.int64))], names)

    kinds = {"__id": "long", "at": "int", "lo": "int", "hi": "int", "a": "long", "c": "long"}
    return rows.select("__id", "__text").mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names))


def _contexts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``a, __id, lo, bytes`` of the wanted contexts ``a, __id, lo, hi``, from the texts."""
    ranges = wanted.groupBy("__id").agg(F.collect_list(F.struct("a", "lo", "hi")).alias("__ranges"))
    kept = marked(rows, "__id", wanted, "__id").filter("__maybe").select("__id", F.col("__text").cast("binary").alias("__data"))
    cut = kept.join(ranges, "__id").select("__id", "__data", F.explode("__ranges").alias("r"))
    return cut.select("__id", F.col("r.a").alias("a"), F.col("r.lo").alias("lo"), F.substring("__data", F.col("r.lo") + 1, F.col("r.hi") - F.col("r.lo")).alias("bytes"))


def _sorted_shards(contexts: DataFrame, width: int) -> DataFrame:
    """Repeated stretches ``__id, lo, hi`` of contexts, by suffix arrays of whole anchors."""

    def told(rows: list[tuple]) -> pa.RecordBatch:
        key, start = (np.array([r[i] for r in rows], np.int64) for i in (1, 2))
        out: list[tuple[int, int, int]] = []
        for i, at in enumerate(repeated([r[3] for r in rows], key, start, width)):
            if len(at):
                a, b = spans(at, at + width)
                out += [(rows[i][1], rows[i][2] + int(x), rows[i][2] + int(y)) for x, y in zip(a, b)]
        columns = list(zip(*out)) if out else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.int32()) for c in columns[1:])], ["__id", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if size >= SHARD and row[0] != held[-1][0]:
                    yield told(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield told(held)

    shards = contexts.select("a", "__id", "lo", "bytes").repartition("a").sortWithinPartitions("a", "__id", "lo")
    return shards.mapInArrow(run, "__id long, lo int, hi int")


def _by_sides(contexts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Contexts ``a, __id, lo, bytes`` dealt again: ``a`` then stands for the anchor and what is next to it on one side.

    A window holds at least half of ``width - ANCHOR`` bytes on one side of its
    anchor, so all places of a window meet under that side.
    """
    half = (width - ANCHOR + 1) // 2
    placed = contexts.join(wanted.select("a", "__id", "lo", "at"), ["a", "__id", "lo"])
    before = F.col("at") - F.col("lo")
    left = F.when(before >= half, F.xxhash64("a", F.lit(0), F.substring("bytes", before - half + 1, F.lit(half))))
    after = F.substring("bytes", before + ANCHOR + 1, F.lit(half))
    right = F.when(F.octet_length(after) == half, F.xxhash64("a", F.lit(1), after))
    return placed.select(F.explode(F.array_compact(F.array(left, right))).alias("a"), "__id", "lo", "bytes")


def _hashed_windows(contexts: DataFrame, width: int) -> DataFrame:
    """Repeated windows ``__id, lo, hi`` of contexts whose anchors have too many of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                values = column(part, "bytes").to_pylist()
                sizes = np.array([len(v) for v in values], np.int64)
                ends = np.cumsum(sizes)
                hashes = flat.grams(flat.prefix_bytes(np.frombuffer(b"".join(values), np.uint8)), width)
                owner = np.repeat(np.arange(len(values)), np.maximum(sizes - width + 1, 0))
                at = np.arange(len(owner)) - np.repeat(np.cumsum(np.maximum(sizes - width + 1, 0)) - np.maximum(sizes - width + 1, 0), np.maximum(sizes - width + 1, 0))
                ids = column(part, "__id").to_numpy(zero_copy_only=False)[owner]
                lo = column(part, "lo").to_numpy(zero_copy_only=False)[owner] + at
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(lo.astype(np.int32)), pa.array(hashes[(ends - sizes)[owner] + at].view(np.int64))], ["__id", "lo", "w"])

    windows = contexts.select("__id", "lo", "bytes").mapInArrow(run, "__id long, lo int, w long")
    first = windows.groupBy("w").agg(F.min(F.struct("__id", "lo")).alias("__first"), F.max(F.struct("__id", "lo")).alias("__last")).filter("__first != __last")
    again = windows.join(first.select("w", "__first"), "w").filter(F.struct("__id", "lo") != F.col("__first"))
    return again.select("__id", "lo", (F.col("lo") + width).cast("int").alias("hi")).distinct()


def repeats(rows: DataFrame, width: int = WIDTH, many: int = MANY) -> DataFrame:
    """``__id, __spans``: intervals ``lo, hi`` of bytes in windows that occur earlier, for the texts ``__id, __text``; landed."""
    found = _anchor_rows(rows, width)
    place = F.struct("__id", "at")
    # Most anchors occur once: their borders are worked out only for those that are shared.
    shared = _anchor_rows(rows, width, borders=False).groupBy("a").agg(F.count(F.lit(1)).alias("__n"), F.min("c").alias("__c0"), F.max("c").alias("__c1"), F.min(place).alias("__first")).filter("__n > 1")
    shared = land(shared.drop("__n"), "shared")
    asked = marked(found, "a", shared, "a").filter("__maybe").drop("__maybe")
    met = land(asked.join(shared, "a"), "anchors")
    one = met.filter("__c0 = __c1").filter(F.struct("__id", "at") != F.col("__first")).select("__id", "lo", "hi")
    several = met.filter("__c0 != __c1").select("a", "c", "__id", "at", "lo", "hi")
    firsts = several.groupBy("a", "c").agg(F.min(F.struct("__id", "at", "lo", "hi")).alias("f"))
    firsts = land(firsts.select("a", "c", F.col("f.__id").alias("__fid"), F.col("f.at").alias("__fat"), F.col("f.lo").alias("lo"), F.col("f.hi").alias("hi")), "contexts")
    # All but the first of equal contexts: told apart by their place, so that a passage in many texts is no hot key.
    spot = ["a", "c", "__id", "at", "lo", "hi"]
    marks = firsts.select("a", "c", F.col("__fid").alias("__id"), F.col("__fat").alias("at"), "lo", "hi", F.lit(True).alias("__is_first"))
    copies = several.select(*spot, F.lit(False).alias("__is_first")).unionByName(marks).groupBy(*spot).agg(
        F.max("__is_first").alias("__is_first")).filter("not __is_first").select("__id", "lo", "hi")
    counts = firsts.groupBy("a").agg(F.count(F.lit(1)).alias("__contexts"))
    wanted = firsts.join(counts, "a").select("a", F.col("__fid").alias("__id"), "lo", "hi", F.col("__fat").alias("at"), "__contexts")
    few = wanted.filter(F.col("__contexts") <= many)
    lots = wanted.filter(F.col("__contexts") > many)
    sided = land(_by_sides(_contexts(rows, lots), lots, width), "sides")
    hot = sided.groupBy("a").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > many).select("a")
    few = _sorted_shards(_contexts(rows, few).select("a", "__id", "lo", "bytes").unionByName(sided.join(hot, "a", "left_anti")), width)
    lots = _hashed_windows(sided.join(hot, "a", "left_semi").select("__id", "lo", "bytes").distinct(), width)
    every = one.unionByName(copies).unionByName(few).unionByName(lots)
    return land(every.groupBy("__id").agg(F.collect_list(F.struct("lo", "hi")).alias("__spans")), "spans")


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``__id, __key, __text`` of every row."""
    rows = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    return identified(rows, "__key", "__text")[0].select("__id", "__key", "__text")


def _cut(data: bytes, intervals) -> tuple[int, int, bytes]:
    """Bytes removed, maximal runs of them, and what is left."""
    lo, hi = (np.array([x[c] for x in intervals], np.int64) for c in ("lo", "hi"))
    lo, hi = spans(lo, hi)
    edges = [0, *np.column_stack((lo, hi)).ravel().tolist(), len(data)]
    return int((hi - lo).sum()), len(lo), b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def trimmed(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """For each row: ``key, n_bytes, n_removed, n_spans, kept_sha256``.

    Every byte in a string of ``width`` bytes that also starts earlier (smaller
    key, or earlier in the same text) is removed; overlaps count, and strings
    are judged on the whole input. Null is an empty text; texts under ``width``
    bytes stay whole. A null key comes last. Rows that share a key, or have none,
    are documents of their own, ordered by a hash of their text; rows that
    agree in key and text are one document told twice and cut alike. An empty
    table gives an empty result; other columns are not read. Keys are integers.
    """
    rows = _rows(docs, key, text)
    found = repeats(rows, width)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(*_cut(data.as_buffer().to_pybytes(), told.as_py() or []),) for data, told in zip(column(batch, "__data"), column(batch, "__spans"))]
            columns = [pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)] + [pa.array([hashlib.sha256(o[2]).hexdigest() for o in out], pa.string())]
            yield pa.RecordBatch.from_arrays([column(batch, "__key"), column(batch, "n_bytes"), *columns], ["__key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    split = marked(rows, "__id", found, "__id").withColumn("n_bytes", F.octet_length("__text").cast("long"))
    plain = split.filter("not __maybe").select(
        "__key", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.col("__text"), 256).alias("kept_sha256"))
    touched = split.filter("__maybe").select("__id", "__key", "n_bytes", F.col("__text").cast("binary").alias("__data")).join(found, "__id", "left")
    done = touched.select("__key", "n_bytes", "__data", "__spans").mapInArrow(run, f"__key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return plain.unionByName(done).select(F.col("__key").alias(key), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with repeated bytes cut out of ``text``; parts of characters that a cut leaves go too.

    Every row stays, with all its other columns; rows are told apart as in ``trimmed``.
    """
    others = [c for c in docs.columns if c != text]
    rows, _ = identified(docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"), F.struct(*others).alias("__rest")), "__key", "__text")
    found = repeats(rows.select("__id", F.coalesce("__text", F.lit("")).alias("__text")), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [
                None if value is None else _cut(value.encode("utf-8"), told)[2].decode("utf-8", "ignore") if told else value
                for value, told in zip(column(batch, "__text").to_pylist(), column(batch, "__spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()), column(batch, "__rest")], ["__text", "__rest"])

    split = marked(rows, "__id", found, "__id")
    touched = split.filter("__maybe").join(found, "__id", "left").select("__text", "__rest", "__spans")
    schema = split.select("__text", "__rest").schema
    done = split.filter("not __maybe").select("__text", "__rest").unionByName(touched.mapInArrow(run, schema))
    return done.select(*[F.col("__text").alias(c) if c == text else F.col("__rest")[c].alias(c) for c in docs.columns])

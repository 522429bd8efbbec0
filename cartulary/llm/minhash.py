"""Near-duplicates by bottom-k sketches from one hash function.

1. One pass over the texts gives each document the hash of its shingle set and
   its ``k`` smallest shingle hashes. Documents with equal sets are one class.
2. Retained values make inverted lists. A pair over the threshold shares at
   least ``t`` of ``k`` values (five standard deviations below the mean; all
   of them counted exactly in sets not larger than ``k``), so with the values
   of a class in order of frequency, its first ``k - t + 1`` are enough.
3. Each list links its members to its smallest one: overlaps are filtered by
   the estimate from the union's sketch, then verified on full shingle sets.
   Verified links make components; a list inside one component is done.
4. Members of the other lists are compared across components only. Short lists
   give their pairs, a bounded number for each entry. For long ones the whole
   sets of their members, ordered by frequency, make lists by the first
   ``n - t + 1`` shingles, and what is still long is compared in tiles of
   bounded size. No table of all pairs is made.

The sketches may leave out a pair: one whose sets are larger than ``k`` and are
alike by exactly 80 % falls below the five standard deviations with a
probability of some 10^-6, and the closer the sets the less. Shingles are
compared by 64 bits of their hash in lists and by 48 when pairs are verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from . import flat
from .base import column, identified, land, marked, pieces, texts
from .components import components

K = 32
SIGMAS = 5
#: Shingles of a tile's sets together; sets of one component or list beyond that are several tiles.
TILE = 2_000_000
#: Sets that a matrix product compares with as many others at once.
SIDE = 512
#: Lists with so many members at most are paired directly, longer ones in tiles.
SHORT = 32


def shingle_sets(batch: pa.RecordBatch, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (lower case A-Z, ``n`` words, fewer words as one)."""
    words = flat.Words(texts(batch, "__text"), lower=True)
    sums = flat.prefix(words.hash)
    borders = np.concatenate(([0], np.cumsum(words.count())))
    out = []
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
        size = min(n, b - a)
        start = np.arange(a, b - size + 1) if size else np.empty(0, np.int64)
        out.append(np.unique(flat.ranges(sums, start, start + size)))
    return out


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def sketches(rows: DataFrame, n: int, k: int) -> DataFrame:
    """``__id, n_shingles, __a, __b, __sketch`` of each row of ``__id, __text``."""
    schema = StructType([*(StructField(c, LongType()) for c in ("__id", "n_shingles", "__a", "__b")), StructField("__sketch", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "__text"):
            sets = shingle_sets(piece, n)
            with np.errstate(over="ignore"):
                a = np.array([flat.mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                b = np.array([flat.mix(s ^ flat.U(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64)
            heads = [s[:k] for s in sets]
            offsets = np.concatenate(([0], np.cumsum([len(h) for h in heads])))
            values = _signed(np.concatenate(heads)) if heads else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [column(piece, "__id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(_signed(a)), pa.array(_signed(b)),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))],
                ["__id", "n_shingles", "__a", "__b", "__sketch"])

    return rows.select("__id", "__text").mapInArrow(run, schema)


def pack(values: np.ndarray) -> bytes:
    """The upper six bytes of each hash."""
    return (values >> flat.U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(data) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view("<u8").reshape(-1)


def full_sets(rows: DataFrame, n: int) -> DataFrame:
    """``id, n, set``: whole shingle sets, 48 bits of hash a shingle.

    Two texts of a thousand shingles have a false common one with a
    probability of some 10^-9.
    """
    schema = StructType([StructField("id", LongType()), StructField("n", LongType()), StructField("set", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "__text"):
            sets = shingle_sets(piece, n)
            yield pa.RecordBatch.from_arrays(
                [column(piece, "__id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([pack(s) for s in sets], pa.binary())], ["id", "n", "set"])

    return rows.select("__id", "__text").mapInArrow(run, schema)


def needed(size: F.Column, k: int, percent: int) -> F.Column:
    """Values that two linked sets must share at least, of the ``size`` retained."""
    share = percent / 100
    likely = int(np.floor(share * k - SIGMAS * np.sqrt(share * (1 - share) * k)))
    return F.least(F.floor((size * percent + 99) / 100), F.lit(max(likely, 1))).cast("int")


def prefix_lists(items: DataFrame, size: F.Column, need: F.Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """``value, cls`` and what is to ``keep`` for the rarest values of each class that any linked class must meet.

    ``items``: one row per ``cls, size, value``, and the columns to keep, of which a class has one value. Values of one class alone come
    first in the order and need no list, so only shared ones are joined.
    """
    shared = items.groupBy("value").agg(F.count(F.lit(1)).alias("__df")).filter("__df > 1")
    told = items.join(shared, "value").groupBy(*dict.fromkeys(("cls", "size", *keep))).agg(F.sort_array(F.collect_list(F.struct("__df", "value"))).alias("__all"))
    most = F.greatest(F.lit(0), size - need + 1 - (size - F.size("__all"))).cast("int")
    entries = told.select("cls", *keep, F.explode(F.slice("__all", F.lit(1), most)).alias("__e"))
    return entries.select("cls", *keep, F.col("__e.value").alias("value"))


def _estimate(pairs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose estimate from the sketch of the union does not exclude the threshold."""
    a = classes.select(F.col("cls").alias("a"), F.col("sketch").alias("__sa"))
    b = classes.select(F.col("cls").alias("b"), F.col("sketch").alias("__sb"))
    union = F.slice(F.array_sort(F.array_union(F.transform("__sa", _flip), F.transform("__sb", _flip))), 1, k)
    common = F.array_intersect(F.transform("__sa", _flip), F.transform("__sb", _flip))
    joined = pairs.join(b, "b").join(a, "a").withColumns({"__u": union, "__c": common})
    size, inside = F.size("__u"), F.size(F.array_intersect("__u", "__c"))
    share = percent / 100
    return joined.filter(inside >= share * size - SIGMAS * F.sqrt(share * (1 - share) * size)).select("a", "b")


def _flip(value: F.Column) -> F.Column:
    """Signed order for what are unsigned hashes."""
    return value.bitwiseXOR(F.lit(-(1 << 63)))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that are linked, by their whole sets."""
    one = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    two = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(column(batch, "sa"), column(batch, "sb")):
                x, y = unpack(x.as_buffer()), unpack(y.as_buffer())
                both = np.concatenate((x, y))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one, "b").join(two, "a").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def tile_links(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``left`` and ``right`` are linked: exact intersections by matrix products over shared shingles."""
    found = [np.empty((2, 0), np.int64)]
    for i in range(0, len(left), SIDE):
        for j in range(0, len(right), SIDE):
            found.append(np.stack(_block_links(left[i : i + SIDE], right[j : j + SIDE], percent)) + [[i], [j]])
    return tuple(np.concatenate(found, axis=1))


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer links that join what the links ``a, b`` join: each member with the smallest one that it reaches."""
    nodes, number = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = number[: len(a)], number[len(a) :]
    label, before = np.arange(len(nodes)), None
    while before is None or (label != before).any():
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
    linked = label != np.arange(len(nodes))
    return nodes[label[linked]], nodes[linked]


def _block_links(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = [np.array([len(s) for s in side], np.int64) for side in (left, right)]
    # Sets whose sizes differ too much are not linked, whatever they hold.
    able = 100 * np.minimum(sizes[0][:, None], sizes[1][None, :]) >= percent * np.maximum(sizes[0][:, None], sizes[1][None, :])
    if not able.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    values, number = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    rows = [np.repeat(np.arange(len(side)), n) for side, n in zip((left, right), sizes)]
    cut = int(sizes[0].sum())
    columns = number[:cut], number[cut:]
    # Only shingles on both sides count.
    both = np.flatnonzero((np.bincount(columns[0], minlength=len(values)) > 0) & (np.bincount(columns[1], minlength=len(values)) > 0))
    place = np.full(len(values), -1)
    place[both] = np.arange(len(both))
    common = np.zeros((len(left), len(right)), np.float64)
    for at in range(0, len(both), 8192):
        made = []
        for side, row, col in zip((left, right), rows, columns):
            p = place[col] - at
            inside = (p >= 0) & (p < 8192) & (place[col] >= 0)
            m = np.zeros((len(side), min(8192, len(both) - at)), np.float32)
            m[row[inside], p[inside]] = 1
            made.append(m)
        common += made[0] @ made[1].T
    return np.nonzero(able & (100 * common >= percent * (sizes[0][:, None] + sizes[1][None, :] - common)))


def _open(entries: DataFrame) -> DataFrame:
    """The lists ``value, cls, comp`` with more than one component, and their ``__size``; landed."""
    open_ = entries.groupBy("value").agg(F.min("comp").alias("__lo"), F.max("comp").alias("__hi"), F.count(F.lit(1)).alias("__size"))
    return land(entries.join(open_.filter("__lo != __hi").select("value", "__size"), "value"), "open")


def _short_pairs(entries: DataFrame) -> DataFrame:
    """Distinct pairs ``a, b`` across components in the lists with ``SHORT`` members at most: a bounded number for each entry."""
    short = entries.filter(F.col("__size") <= SHORT)
    one, two = short.select("value", F.col("cls").alias("a"), F.col("comp").alias("__ca")), short.select("value", F.col("cls").alias("b"), F.col("comp").alias("__cb"))
    return one.join(two, "value").filter("a < b and __ca != __cb").select("a", "b").distinct()


def _across(entries: DataFrame, sets: DataFrame, percent: int, tile: int = TILE) -> DataFrame:
    """Links ``a, b`` that join what is linked between members of a list ``value, cls, comp, size`` in different components.

    A list is cut into tiles of some ``tile`` shingles: a component with more
    has tiles of its own, the rest is dealt by component. Two tiles of one
    component are not compared. A set goes once to each pair that its tile is
    part of, and a list that fits into one tile is compared within itself. Two
    tiles give at most a link for each member, however many are linked.
    """
    per = entries.groupBy("value", "comp").agg(F.sum("size").alias("__c"))
    small = per.groupBy("value").agg(
        F.sum(F.when(F.col("__c") <= tile, F.col("__c")).otherwise(0)).alias("__small"), F.count(F.lit(1)).alias("__comps")).filter("__comps > 1")
    dealt = per.join(small, "value")
    own = F.col("__c") > tile
    # A group of equal keys goes into one tile, so tiles are small only with some room: half of the bound is aimed at beyond the first.
    total = F.when(own, F.col("__c")).otherwise(F.col("__small"))
    pieces_of = F.when(total <= tile, 1).otherwise(F.ceil(total * 2 / tile))
    by = F.when(own, F.xxhash64("cls")).otherwise(F.xxhash64("comp"))
    placed = entries.join(dealt, ["value", "comp"]).select(
        "value", "cls", "comp", F.when(own, F.col("comp")).alias("__own"), F.pmod(by, pieces_of).alias("__k"))
    placed = land(placed.withColumn("__tile", F.concat_ws(":", F.coalesce(F.col("__own").cast("string"), F.lit("-")), "__k")), "tiles")
    tiles = placed.select("value", "__own", "__tile").distinct()
    other = tiles.select("value", F.col("__own").alias("__own2"), F.col("__tile").alias("__tile2"))
    met = tiles.join(other, "value").filter((F.col("__tile") <= F.col("__tile2")) & ~F.coalesce(F.col("__own") == F.col("__own2"), F.lit(False)))
    met = met.select("value", F.col("__tile").alias("__t1"), F.col("__tile2").alias("__t2"))
    first = met.withColumns({"__tile": F.col("__t1"), "side": F.lit(0)})
    second = met.filter("__t1 != __t2").withColumns({"__tile": F.col("__t2"), "side": F.lit(1)})
    rows = first.unionByName(second).join(placed.select("value", "__tile", "cls", "comp"), ["value", "__tile"])
    full = rows.join(sets.select(F.col("id").alias("cls"), "set"), "cls")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sides = [frame[frame["side"] == s] for s in (0, 1)]
        if frame["__t1"].iloc[0] == frame["__t2"].iloc[0]:
            sides[1] = sides[0]
        i, j = tile_links(*([unpack(x) for x in s["set"]] for s in sides), percent)
        a, b = sides[0]["cls"].to_numpy()[i], sides[1]["cls"].to_numpy()[j]
        cross = sides[0]["comp"].to_numpy()[i] != sides[1]["comp"].to_numpy()[j]
        one, two = spanning(a[cross], b[cross])
        return pd.DataFrame({"a": one, "b": two})

    return full.groupBy("value", "__t1", "__t2").applyInPandas(run, "a long, b long")


def _late_links(lists: DataFrame, sets: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame | None:
    """Links ``a, b`` across components of the open ``lists``; none where no list is open.

    What only long lists need is planned only if there is one: a plan costs the
    driver threads and memory for each of its exchanges, also over no rows.
    """
    if lists.isEmpty():
        return None
    short, tiled = _short_pairs(lists), None
    left = land(lists.filter(F.col("__size") > SHORT).select("cls", "comp").distinct(), "open")
    if not left.isEmpty():
        shingles = sets.join(left, F.col("id") == F.col("cls")).select("cls", "comp", F.col("n").alias("size"), F.explode(_longs(F.col("set"))).alias("value"))
        exact = prefix_lists(shingles, F.col("size"), F.floor((F.col("size") * percent + 99) / 100), ("comp", "size"))
        exact = _open(exact)
        short = short.unionByName(_short_pairs(exact)).distinct()
        long = exact.filter(F.col("__size") > SHORT).drop("__size")
        if not long.isEmpty():
            tiled = land(_across(long, sets, percent), "links")
    more = land(_verified(_estimate(short, classes, k, percent), sets, percent), "links")
    return more if tiled is None else more.unionByName(tiled)


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4, percent: int = 80, k: int = K) -> DataFrame:
    """For each row: ``key, n_shingles, component_id, kept``.

    A document's set are its distinct shingles of ``n`` words (A-Z in lower
    case); with fewer words the whole sequence is one. Documents are linked if
    ``100 * intersection >= percent * union``; ``component_id`` is the smallest
    key that links reach. Without words, and for null texts, the set is empty
    and linked with nothing. Every row is judged by its own text: rows that
    share a key, or have none, are nodes of their own, a null key comes last
    and is given back null; of equal keys one row stays for the group. An empty
    table gives an empty result; other columns are not read. Keys are integers.
    """
    rows, numbers = identified(docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")), "__key", "__text")
    found = land(sketches(rows, n, k), "sketches")
    groups = found.filter("n_shingles > 0").groupBy("__a", "__b").agg(F.min("__id").alias("cls"), F.min_by("__sketch", "__id").alias("sketch"))
    groups = land(groups, "classes")
    items = groups.select("cls", F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
    lists = prefix_lists(items, F.col("size"), needed(F.col("size"), k, percent))
    heads = land(lists, "lists")
    hubs = heads.groupBy("value").agg(F.min("cls").alias("a"), F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("value", "a")
    entries = land(heads.join(hubs, "value").select("value", "cls", F.col("a").alias("hub")), "entries")
    pairs = entries.filter("cls != hub").select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct()

    members = entries.select("cls").distinct()
    told = marked(rows, "__id", members, "cls").filter("__maybe")
    # Rows that share a number have one text: one of them gives the set.
    sets = land(full_sets(told if numbers is None else told.dropDuplicates(["__id"]), n), "sets")
    classes = land(groups.join(members.withColumnRenamed("cls", "__m"), F.col("cls") == F.col("__m"), "left_semi"), "members")
    links = land(_verified(_estimate(pairs, classes, k, percent), sets, percent), "links")

    label = components(links)
    known = entries.select("value", "cls").join(label, F.col("cls") == F.col("node"), "left").select(
        "value", "cls", F.coalesce("component", "cls").alias("comp"))
    open_lists = _open(known)
    late = _late_links(open_lists, sets, classes, k, percent)
    out = found.join(groups.select("__a", "__b", "cls"), ["__a", "__b"], "left").join(label, F.col("cls") == F.col("node"), "left")
    out = out.withColumn("component", F.coalesce("component", "cls")).drop("node")
    if late is not None:
        # Late links join components, each known by its smallest member, which stays the smallest.
        between = late
        for end in "ab":
            of = label.select(F.col("node").alias(end), F.col("component").alias("__of"))
            between = between.join(of, end, "left").withColumn(end, F.coalesce("__of", end)).drop("__of")
        joined = components(between).withColumnRenamed("component", "__joined")
        out = out.join(joined, F.col("component") == F.col("node"), "left").withColumn("component", F.coalesce("__joined", "component"))
    reached = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("__id"))
    out = out.select("__id", "n_shingles", reached.alias("__reached"))
    if numbers is None:
        out = out.withColumns({"__key": F.col("__id"), "__first": F.col("__reached")})
    else:
        out = out.join(numbers, "__id").join(numbers.select(F.col("__id").alias("__reached"), F.col("__key").alias("__first")), "__reached")
    kind = docs.schema[key].dataType
    return out.select(
        F.col("__key").cast(kind).alias(key), "n_shingles", F.col("__first").cast(kind).alias("component_id"), (F.col("__id") == F.col("__reached")).alias("kept"))


def _longs(data: F.Column) -> F.Column:
    """A number for each six bytes of a packed set."""
    at = F.sequence(F.lit(0), (F.octet_length(data) / 6 - 1).cast("int"))
    return F.transform(at, lambda i: F.xxhash64(F.substring(data, i * 6 + 1, F.lit(6))))


def drop_near(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, the one with the smallest key (null last), with the columns of ``docs``.

    A node is a key and a text, known by a 64-bit hash of both: rows that share
    a key, or have none, are judged one by one.
    """
    rows = docs.withColumn("__row", F.xxhash64(F.col(key).isNull(), key, text))
    groups = near_groups(rows, "__row", text, n, percent).select("__row", "component_id").distinct()
    order = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("d"), F.col("__row").alias("r"))
    kept = rows.select("__row", key).join(groups, "__row").groupBy("component_id").agg(F.min(order)["r"].alias("__row")).select("__row")
    return rows.join(kept, "__row", "left_semi").dropDuplicates(["__row"]).select(*docs.columns)

"""Ranked lexical search by branch and bound in document FP-trees.

Only terms of the asked items count for the order, so a document is a vector of
those terms, ordered by frequency (rarest first: they carry the weight, and
what is left below a shared path is small). A task puts a bounded run of such
vectors into a trie. Documents with the same first terms share a path, a path
without branches is one node, and a document hangs below the last node that it
shares. Each node knows, for each term below it, the largest tf, and the
smallest m; both together bound the score of every document there.

An item is searched depth first: a step bounds all children of a node at once,
a document's bound being its score; nodes that cannot reach the ten best so far
are left out, the others wait on a stack with the best on top. The ten best go
on from one trie of the task to the next; at most ten rows for each item leave a
task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from . import flat
from .base import NONE, column, land, numbered, pieces, texts

TOP = 10
#: Bytes of item texts that are asked together; a longer item is a block of its own.
BLOCK = 4 << 20
#: Entries of document vectors in one trie.
ENTRIES = 400_000
#: Bytes of a term: letters, digits and all that is not ASCII.
_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Terms:
    """Terms of some texts without nulls, as distinct strings and a number for each occurrence."""

    def __init__(self, column: pa.Array):
        self.distinct, self.number, self.doc = flat.coded(column, _TERM, lower=True)
        self.count = np.bincount(self.doc, minlength=len(column)).astype(np.int64)


def _terms_of(text: str | None) -> Counter[str]:
    """An item's terms with their repeats."""
    found = Terms(pa.array([text or ""], pa.string()))
    return Counter(found.distinct.take(pa.array(found.number)).to_pylist())


def _vectors(batches: Iterator[pa.RecordBatch], wanted: pa.Array) -> Iterator[pa.RecordBatch]:
    """Documents that have a term: their terms among ``wanted`` with tf, and the count of all."""
    for piece in pieces(batches, "__text"):
        terms = Terms(texts(piece, "__text"))
        known = pc.fill_null(pc.index_in(terms.distinct, value_set=wanted), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        number = known[terms.number] if len(known) else np.empty(0, np.int64)
        asked = number >= 0
        keys, tf = np.unique(terms.doc[asked] * len(wanted) + number[asked], return_counts=True)
        doc, term = np.divmod(keys, max(len(wanted), 1))
        some = terms.count > 0
        sizes = np.bincount(doc, minlength=piece.num_rows)[some]
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [column(piece, "__doc").filter(pa.array(some)), pa.array(terms.count[some]), pa.ListArray.from_arrays(offsets, pa.array(term.astype(np.int32))),
             pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))], ["__doc", "n", "terms", "tfs"])


@dataclass
class Asked:
    """The items of a block: term ranks (rarest first), weights and repeats."""

    rank: np.ndarray  # of each wanted term
    items: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]  # number, ranks, weights, repeats
    documents: int
    length: int

    def m(self, n: np.ndarray) -> np.ndarray:
        # Python's integers: 75 * n * N may pass 64 bits before it is divided.
        return np.array([25 + 75 * x * self.documents // self.length for x in n.tolist()], np.int64)


def share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term's weight is multiplied by: grows with tf, falls with m."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Tree:
    """The FP-tree of some document vectors.

    ``children`` are numbered by parent; ``entries`` hold, for each parent and
    term, its children below which the term occurs, with the largest tf there.
    A child is a node or (``node`` is -1) a document.
    """

    def __init__(self, doc: np.ndarray, m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray):
        ends = np.cumsum(sizes)
        offsets = ends - sizes
        # Each vector by frequency, and equal term lists under one number.
        order = np.lexsort((terms, np.repeat(np.arange(len(doc)), sizes)))
        terms, tfs = terms[order], tfs[order]
        packed = terms.astype(">u4").tobytes()
        lists: dict[bytes, int] = {}
        alike = np.array([lists.setdefault(packed[4 * s : 4 * e], len(lists)) for s, e in zip(offsets, ends)], np.int64)
        parent_of_doc = np.zeros(len(doc), np.int64)
        parents, depths = [-1], [0]
        at = np.arange(len(doc))
        node = np.zeros(len(doc), np.int64)
        depth = 0
        while len(at):
            inside = sizes[at] > depth
            term = np.where(inside, terms[np.minimum(offsets[at] + depth, max(len(terms) - 1, 0))] if len(terms) else 0, -1)
            order = np.lexsort((alike[at], term, node))
            at, term, node, inside = at[order], term[order], node[order], inside[order]
            begin = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (node[1:] != node[:-1]))))
            size = np.diff(np.append(begin, len(at)))
            own = node[begin]
            whole = size == np.bincount(own, minlength=len(parents))[own]
            one_list = alike[at[begin]] == alike[at[begin + size - 1]]
            going = (size > 1) & inside[begin]
            # A branch with several documents is a node; where all of a node go one way, the path has no branch yet.
            named = np.flatnonzero(going & ~whole)
            below = own.copy()
            below[named] = len(parents) + np.arange(len(named))
            parents += own[named].tolist()
            depths += [depths[x] + 1 for x in own[named].tolist()]
            node = np.repeat(below, size)
            stays = np.repeat(going & ~one_list, size)
            parent_of_doc[at[~stays]] = node[~stays]
            at, node = at[stays], node[stays]
            depth += 1
        self._maxima(doc, m, sizes, terms, tfs, parent_of_doc, np.array(parents, np.int64), np.array(depths, np.int64))

    def _maxima(self, doc, m, sizes, terms, tfs, parent_of_doc, parents, depths) -> None:
        """Number children by parent, and carry tf maxima and m minima from the leaves to the root."""
        n = len(parents)
        parent = np.concatenate((parents[1:], parent_of_doc))
        order = np.argsort(parent, kind="stable")
        child_of = np.empty(len(order), np.int64)
        child_of[order] = np.arange(len(order))
        self.first = np.searchsorted(parent[order], np.arange(n + 1))
        self.node = np.concatenate((np.arange(1, n), np.full(len(doc), -1)))[order]
        self.doc = np.concatenate((np.zeros(n - 1, np.int64), doc))[order]
        self.m = np.concatenate((np.full(n - 1, NONE), m))[order]
        # Entries: parent and term as one key, the child, the largest tf.
        width = int(terms.max()) + 1 if len(terms) else 1
        self.width = width
        owner = np.repeat(np.arange(len(doc)), sizes)
        above = [(parent_of_doc[owner] * width + terms, child_of[n - 1 + owner], tfs)]
        own_depth = depths[parent_of_doc[owner]] if len(owner) else np.empty(0, np.int64)
        pending = [(own_depth, above[0][0], tfs)]
        for depth in range(int(depths.max()), 0, -1):
            keys = np.concatenate([k[d == depth] for d, k, _ in pending])
            tops = np.concatenate([t[d == depth] for d, _, t in pending])
            pending = [(d[d != depth], k[d != depth], t[d != depth]) for d, k, t in pending]
            order = np.argsort(keys, kind="stable")
            keys, tops = keys[order], tops[order]
            begin = flat.runs(keys)
            top = np.maximum.reduceat(tops, begin) if len(keys) else tops
            at, term = np.divmod(keys[begin], width)
            up = parents[at] * width + term
            above.append((up, child_of[at - 1], top))
            pending.append((np.full(len(up), depth - 1), up, top))
            nodes = np.flatnonzero(depths == depth)
            # All children of these nodes are known by now.
            self.m[child_of[nodes - 1]] = [int(self.m[self.first[x] : self.first[x + 1]].min()) for x in nodes.tolist()]
        keys, child, top = (np.concatenate(x) for x in zip(*above))
        order = np.argsort(keys, kind="stable")
        self.keys, self.child, self.top = keys[order], child[order], top[order].astype(np.int64)

    def bounds(self, node: int, ranks: np.ndarray, weights: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        """For each child of ``node`` the most that a document there can score; for a document its score."""
        first, last = self.first[node], self.first[node + 1]
        ranks, weights, repeats = (x[ranks < self.width] for x in (ranks, weights, repeats))
        lo = np.searchsorted(self.keys, node * self.width + ranks)
        size = np.searchsorted(self.keys, node * self.width + ranks, "right") - lo
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(lo - (ends - size), size)
        child = self.child[at]
        out = np.zeros(last - first, np.int64)
        np.add.at(out, child - first, np.repeat(repeats, size) * (np.repeat(weights, size) * share(self.top[at], self.m[child])))
        return out


class Best:
    """The best documents of one item so far: score, then the smaller key."""

    def __init__(self, top: int):
        self.top = top
        self.score = np.empty(0, np.int64)
        self.doc = np.empty(0, np.int64)

    def least(self) -> int:
        """What a score must reach to matter."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate((self.score, score)), np.concatenate((self.doc, doc))
        order = np.lexsort((doc, -score))[: self.top]
        self.score, self.doc = score[order], doc[order]


def search(tree: Tree, ranks: np.ndarray, weights: np.ndarray, repeats: np.ndarray, best: Best) -> int:
    """Depth-first branch and bound; gives the number of nodes that were opened."""
    stack, opened = [(NONE, 0)], 0
    while stack:
        bound, node = stack.pop()
        if bound < best.least():
            continue
        opened += 1
        bounds = tree.bounds(node, ranks, weights, repeats)
        first = tree.first[node]
        hit = np.flatnonzero(bounds >= best.least())
        inner = tree.node[first + hit]
        leaves = hit[inner < 0]
        if len(leaves):
            best.add(bounds[leaves], tree.doc[first + leaves])
        hit, inner = hit[inner >= 0], inner[inner >= 0]
        order = np.argsort(bounds[hit], kind="stable")
        stack += zip(bounds[hit[order]].tolist(), inner[order].tolist())
    return opened


def _searched(batches: Iterator[pa.RecordBatch], asked: Asked, top: int) -> Iterator[pa.RecordBatch]:
    best = [Best(top) for _ in asked.items]
    held: list[tuple[np.ndarray, ...]] = []
    entries = 0

    def flush() -> None:
        nonlocal held, entries
        if held:
            tree = Tree(*(np.concatenate(x) for x in zip(*held)))
            for (_, ranks, weights, repeats), own in zip(asked.items, best):
                search(tree, ranks, weights, repeats, own)
        held, entries = [], 0

    for batch in batches:
        offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(column(batch, "terms")).to_numpy(zero_copy_only=False))))
        start = 0
        while start < batch.num_rows:
            end = max(int(np.searchsorted(offsets, offsets[start] + ENTRIES - entries, "right")) - 1, start + 1)
            part = batch.slice(start, end - start)
            terms, tfs = (pc.list_flatten(column(part, c)).to_numpy(zero_copy_only=False) for c in ("terms", "tfs"))
            doc = pc.fill_null(column(part, "__doc"), NONE).to_numpy(zero_copy_only=False)
            held.append((doc, asked.m(column(part, "n").to_numpy(zero_copy_only=False)), np.diff(offsets[start : end + 1]), asked.rank[terms], tfs.astype(np.int64)))
            entries += len(terms)
            if entries >= ENTRIES or end < batch.num_rows:
                flush()
            start = end
    flush()
    number = np.repeat(np.array([x[0] for x in asked.items], np.int64), [len(b.score) for b in best])
    found = [np.concatenate(x) if x else np.empty(0, np.int64) for x in ([b.doc for b in best], [b.score for b in best])]
    yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(found[0], mask=found[0] == NONE), pa.array(found[1])], ["__item", "doc_id", "score"])


def _ask(spark: SparkSession, docs: DataFrame, items: list[tuple[int, str | None]], key: str, text: str, top: int) -> DataFrame:
    """``__item, rank, doc_id, score`` for a block of items of bounded size."""
    counted = [(number, _terms_of(own)) for number, own in items]
    vocabulary = sorted({t for _, terms in counted for t in terms})
    wanted = pa.array(vocabulary, pa.large_string())
    rows = docs.select(F.col(key).cast("long").alias("__doc"), F.col(text).alias("__text"))
    vectors = land(rows.mapInArrow(lambda b: _vectors(b, wanted), "__doc long, n long, terms array<int>, tfs array<int>"), "vectors")
    documents, length = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # As many rows as the block has terms.
    df = np.zeros(len(vocabulary), np.int64)
    for term, n in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        df[term] = n
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    number_of = {t: i for i, t in enumerate(vocabulary)}
    told = []
    for number, terms in counted:
        own = np.array([number_of[t] for t in terms if df[number_of[t]]], np.int64)
        repeats = np.array([n for t, n in terms.items() if df[number_of[t]]], np.int64)
        told.append((number, rank[own], weight[own], repeats))
    asked = Asked(rank, told, documents, max(length, 1))
    found = vectors.filter(F.size("terms") > 0).mapInArrow(lambda b: _searched(b, asked, top), "__item long, doc_id long, score long")
    place = Window.partitionBy("__item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top)


def ranked(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", top: int = TOP, block: int = BLOCK) -> DataFrame:
    """``item, rank, doc_id, score``: for each item the ``top`` documents of highest score above 0.

    Every row of ``items`` is asked, also rows that repeat an id or have none;
    every row of ``docs`` is a document of its own, and one without a key comes
    last among equal scores. Null and empty texts have no terms: such documents
    do not count, such items get no row. Empty tables give no row. Items are
    asked in blocks of ``block`` bytes, which is what a task and the driver hold
    of them; all documents answer each block. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = items.select(F.col(item).alias("__id"), F.col(item_text).alias("__text"), F.coalesce(F.octet_length(item_text), F.lit(0)).alias("__bytes"))
    asked = land(numbered(rows.withColumn("__spread", F.xxhash64("__id", "__text")), ["__spread"], "__item").drop("__spread"), "items")
    ids = asked.select("__item", F.col("__id").alias(item))
    found, start, count = [], 0, asked.count()
    while start < count:
        # As many further items as the block takes; sizes of a bounded run of rows are looked at.
        sizes = asked.filter((F.col("__item") >= start) & (F.col("__item") < start + 100_000)).select("__item", "__bytes").orderBy("__item").collect()
        end, held = start, 0
        for row in sizes:
            if end > start and held + row["__bytes"] > block:
                break
            held += row["__bytes"]
            end += 1
        own = asked.filter((F.col("__item") >= start) & (F.col("__item") < end)).select("__item", "__text").collect()
        found.append(_ask(spark, docs, [(r["__item"], r["__text"]) for r in own], key, text, top))
        start = end
    schema = "__item long, doc_id long, score long, rank int"
    all_found = land(found[0], "found") if len(found) == 1 else spark.createDataFrame([], schema)
    if len(found) > 1:
        all_found = land(found[0], "found")
        for more in found[1:]:
            all_found = all_found.unionByName(land(more, "found"))
    return all_found.join(ids, "__item").select(item, "rank", F.col("doc_id").alias(key), "score")

"""Spelling variants by a dictionary of pairs of trie nodes.

The words are sorted over range partitions, forwards and reversed; each order
is a trie whose nodes get integers. A node is named after the first word that
goes through it: by that word's letters before it and the node's depth. Only a
partition's left edge can hold nodes that began in an earlier partition; these
few are renamed by a table of one row per shared letter of a border.

Leaving out letter i of a word gives the pair (node before i, node of what
follows, read from the end). Two words that differ in letter i have this pair
in common; a word that lacks letter i has it at the gap i. The pairs are long
integers, equal exactly if the spellings are, so the join gives all
neighbours and nothing else. Words of one pair differ in one letter, so there
are at most as many as the alphabet has letters, and the gap's word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .base import column, land, numbered, pieces, texts

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Distinct words a task counts before it hands them on.
HELD = 400_000
#: Letters of words whose nodes are worked out together.
LETTERS = 1 << 20


def _counted(batches: Iterator[pa.RecordBatch], least: int, noise: int) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def told() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return batch

    for piece in pieces(batches, "__text"):
        for doc, text in zip(column(piece, "__doc").to_pylist(), texts(piece, "__text").to_pylist()):
            start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            for run, n in Counter(RUN.findall(text)).items():
                if len(run) >= least:
                    word = run.lower() if run.isascii() else run.translate(_LOWER)
                    if noise:
                        h = zlib.crc32(word.encode("utf-8"), start)
                        if h % noise == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least:
                                continue
                    counts[word] += n
            if len(counts) > HELD:
                yield told()
    yield told()


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 5, times: int = 3, noise: int = 97) -> DataFrame:
    """``word, n``: the words of all texts with ``least`` letters and ``times`` occurrences at least.

    ``noise``: every so many-th run by its checksum with the document's key
    loses a letter (0: none). Tasks count before the shuffle.
    """
    rows = docs.select(F.col(key).alias("__doc"), F.col(text).alias("__text")).mapInArrow(lambda b: _counted(b, least, noise), "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix of two arrays."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


class _Trie:
    """Nodes of sorted words, which come in blocks; words are Latin-1 bytes."""

    def __init__(self, first: int):
        self.letters = first  # letters of all words before
        self.word = np.empty(0, np.uint8)  # the last word
        self.nodes = np.empty(0, np.int64)  # and its nodes by depth, from 1

    def add(self, words: list[bytes]) -> list[np.ndarray]:
        """The nodes of each word, by depth from 1."""
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        offsets = ends - sizes
        data = np.frombuffer(b"".join(words), np.uint8)
        nodes = np.empty(len(data), np.int64)
        # Letters shared with the word before: depth by depth, over the words that still agree.
        shared = np.zeros(len(words), np.int64)
        alive = np.flatnonzero((sizes[1:] > 0) & (sizes[:-1] > 0)) + 1
        depth = 0
        while len(alive):
            alive = alive[data[offsets[alive] + depth] == data[offsets[alive - 1] + depth]]
            depth += 1
            shared[alive] = depth
            alive = alive[(sizes[alive] > depth) & (sizes[alive - 1] > depth)]
        shared[0] = _common(self.word, np.frombuffer(words[0], np.uint8))
        names = self.letters + offsets
        of = np.arange(len(words))
        depth = 0
        while len(of):
            # A node deeper than what a word shares begins at this word; others began at the last such word.
            begins = shared[of] <= depth
            begins[0] |= of[0] > 0
            begun = np.maximum.accumulate(np.where(begins, np.arange(len(of)), -1))
            nodes[offsets[of] + depth] = np.where(begun < 0, self.nodes[depth] if depth < len(self.nodes) else -1, names[of[begun]] + depth)
            depth += 1
            of = of[sizes[of] > depth]
        self.letters += len(data)
        found = [nodes[s:e] for s, e in zip(offsets, ends)]
        self.word, self.nodes = np.frombuffer(words[-1], np.uint8), found[-1]
        return found


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    trie, seen = _Trie(part << 40), 0
    for batch in batches:
        spelled = batch.column(batch.schema.names.index("__way")).to_pylist()
        start = 0
        while start < len(spelled):
            end, held = start, 0
            while end < len(spelled) and (end == start or held + len(spelled[end]) <= LETTERS):
                held += len(spelled[end])
                end += 1
            found = trie.add([w.encode("latin-1") for w in spelled[start:end]])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in found]))), pa.int32()), pa.array(np.concatenate(found)))
            block = batch.slice(start, end - start)
            yield pa.RecordBatch.from_arrays(
                [column(block, "word"), column(block, "n"), lists, pa.array(np.full(end - start, part), pa.int32()), pa.array(np.arange(seen, seen + end - start))],
                ["word", "n", "nodes", "__part", "__at"])
            seen += end - start
            start = end


def _renamed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes at the left edge of partitions that go on from earlier ones, with their first names.

    One row per partition comes here: its first and last word with their nodes.
    """
    edges = [row for frame in frames for row in frame.itertuples(index=False)]
    edges.sort(key=lambda row: row.part)
    word, nodes = b"", np.empty(0, np.int64)
    for row in edges:
        first, last = row.first_word.encode("latin-1"), row.last_word.encode("latin-1")
        n = _common(np.frombuffer(word, np.uint8), np.frombuffer(first, np.uint8))
        own = np.asarray(row.first_nodes, np.int64)[:n]
        if n:
            yield pd.DataFrame({"node": own, "name": nodes[:n]})
        kept = min(n, _common(np.frombuffer(first, np.uint8), np.frombuffer(last, np.uint8)))
        nodes = np.concatenate((nodes[:kept], np.asarray(row.last_nodes, np.int64)[kept:]))
        word = last


def _numbered_trie(words: DataFrame, way: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """``word, n, nodes`` in the order of ``way``, and ``node, name`` for nodes that partitions share."""
    ranged = words.withColumn("__way", way).repartitionByRange("__way").sortWithinPartitions("__way")
    trie = land(ranged.mapInArrow(_nodes, "word string, n long, nodes array<long>, __part int, __at long"), name)
    # One row per partition: its edges.
    ends = trie.groupBy("__part").agg(F.min("__at").alias("__first"), F.max("__at").alias("__last"))
    told = trie.join(ends, "__part").filter("__at = __first OR __at = __last").withColumn("__way", way)
    edges = told.groupBy(F.col("__part").alias("part")).agg(
        F.min_by("__way", "__at").alias("first_word"), F.min_by("nodes", "__at").alias("first_nodes"),
        F.max_by("__way", "__at").alias("last_word"), F.max_by("nodes", "__at").alias("last_nodes"))
    renamed = land(edges.coalesce(1).mapInPandas(_renamed, "node long, name long"), name + "-edges")
    return trie.select("word", "n", "nodes"), renamed


def near_words(words: DataFrame) -> DataFrame:
    """``id, word, n, n_near, form_id, form_n`` of distinct ``word, n``: how many words are near, and the form among them.

    Words are not empty and have letters below U+0100 only, as ``RUN`` finds them.

    Near words differ by exactly one inserted, deleted or replaced letter. The
    form is the near word of largest ``n`` (ties: first in code-point order) if
    it has twice the word's ``n`` at least.
    """
    words = land(numbered(words.select("word", "n"), ["word"], "id"), "words")
    forward, forward_names = _numbered_trie(words, F.col("word"), "trie")
    backward, backward_names = _numbered_trie(words, F.reverse("word"), "trie-back")
    both = forward.join(backward.select("word", F.col("nodes").alias("__back")), "word").join(words.select("word", "id"), "word")
    size = F.length("word")
    # Node before letter i and node of the letters from i on; the roots are -1.
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get("nodes", i - 1))
    after = lambda i: F.when(i == size, F.lit(-1)).otherwise(F.get("__back", size - i - 1))
    letter = lambda i: F.substring(F.col("word"), i + 1, F.lit(1))
    # Of equal letters in a row, leaving out one or another gives one word: the first stands for them.
    left_out = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(
        before(i).alias("p"), after(i + 1).alias("s"), F.lit(True).alias("out"), ((i == 0) | (letter(i) != letter(i - 1))).alias("first")))
    gaps = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(before(i).alias("p"), after(i).alias("s"), F.lit(False).alias("out"), F.lit(False).alias("first")))
    rows = both.select("id", "n", F.inline(F.concat(left_out, gaps)))
    for side, names in (("p", forward_names), ("s", backward_names)):
        rows = rows.join(names.select(F.col("node").alias(side), F.col("name").alias("__name")), side, "left").withColumn(side, F.coalesce("__name", side)).drop("__name")
    member = F.struct("n", (-F.col("id")).alias("less"), "out", "first")
    # At most one word for each letter of the alphabet and one for the gap.
    pairs = rows.groupBy("p", "s").agg(F.sort_array(F.collect_list(member), asc=False).alias("m")).filter(F.size("m") > 1)
    outs = F.filter("m", lambda x: x["out"])
    firsts = F.filter("m", lambda x: x["first"])
    gap = F.get(F.filter("m", lambda x: ~x["out"]), 0)
    told = pairs.select("m", outs.alias("outs"), firsts.alias("firsts"), gap.alias("gap"))
    best = lambda x: F.struct(x["n"].alias("n"), x["less"].alias("less"))
    none = F.lit(None).cast("struct<n:bigint,less:bigint>")

    def answer(x: Column) -> Column:
        other = F.when(F.get("outs", 0)["less"] == x["less"], F.get("outs", 1)).otherwise(F.get("outs", 0))
        shorter = F.when(x["first"] & F.col("gap").isNotNull(), best(F.col("gap"))).otherwise(none)
        longer = F.get("firsts", 0)
        near = F.when(x["out"], F.size("outs") - 1 + shorter.isNotNull().cast("int")).otherwise(F.size("firsts"))
        top = F.when(x["out"], F.greatest(F.when(other.isNotNull(), best(other)).otherwise(none), shorter)).otherwise(F.when(longer.isNotNull(), best(longer)).otherwise(none))
        return F.struct((-x["less"]).alias("id"), near.cast("long").alias("near"), top.alias("top"))

    answers = told.select(F.inline(F.transform("m", answer))).groupBy("id").agg(F.sum("near").alias("n_near"), F.max("top").alias("top"))
    found = words.join(answers, "id", "left")
    form = F.when(F.col("top.n") >= 2 * F.col("n"), F.col("top"))
    return found.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), (-form["less"]).alias("form_id"), form["n"].alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``id, root_id`` for all rows ``id, form_id`` that have a form.

    A form has twice the occurrences, so chains are short; each round doubles
    how far a row looks and is landed.
    """
    at = land(forms.filter("form_id IS NOT NULL").select("id", F.col("form_id").alias("root_id")), "roots")
    while True:
        further = at.select(F.col("id").alias("root_id"), F.col("root_id").alias("__next"))
        moved = land(at.join(further, "root_id", "left").select("id", F.coalesce("__next", "root_id").alias("root_id"), F.col("__next").isNotNull().alias("__moved")), "roots")
        at = moved.select("id", "root_id")
        if not moved.filter("__moved").limit(1).count():
            return at


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 5, times: int = 3, noise: int = 97) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word of all texts.

    Null texts have no words, and an empty table gives no rows. Rows that
    repeat a key count with all their texts; a null key stands as an empty
    string in the checksum. Words of any length are numbered in time that goes
    with their letters. Other columns are not read.
    """
    near = land(near_words(word_counts(docs, key, text, least, times, noise)), "near")
    names = near.select(F.col("id").alias("form_id"), F.col("word").alias("form"))
    ends = roots(near).join(near.select(F.col("id").alias("root_id"), F.col("word").alias("root")), "root_id").select("id", "root")
    return near.join(names, "form_id", "left").join(ends, "id", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

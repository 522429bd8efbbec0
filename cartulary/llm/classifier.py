"""Quality classifier: supervised subword embeddings.

Each word and each of its character n-grams is hashed to a row of an embedding
table; the rows of a document are averaged, and a softmax over that average
says how likely each class is. Both tables are learned by stochastic gradient
descent in numpy, one document a step. As the output is linear in the average,
a trained model scores with one number for each row of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import flat
from .base import column, pieces, texts


#: Number, before the division by the table's rows, of the word that stands for a direct repetition.
REPEAT = 0x2545F4914F6CDD1D


@dataclass(frozen=True)
class Settings:
    rows: int = 1 << 18
    size: int = 16
    grams: tuple[int, ...] = (3, 4, 5)
    epochs: int = 4
    #: Steps of training at least.
    steps: int = 3000
    rate: float = 0.3
    #: Labelled documents of each class that are learned from at most.
    sample: int = 3000
    threshold: float = 0.7


class Features:
    """Rows of the embedding table for the distinct words of some texts."""

    def __init__(self, batch: pa.RecordBatch, text: str, settings: Settings):
        w = flat.Words(texts(batch, text))
        self.docs, self.doc = w.docs, w.doc
        _, first, self.word = flat.distinct(w.hash)
        # Distinct words one after the other, each between the same two border bytes.
        sizes = w.end[first] - w.start[first] + 2
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        data = w.data[np.clip(np.arange(total) + np.repeat(w.start[first] - 1 - (ends - sizes), sizes), 0, max(len(w.data) - 1, 0))]
        data[ends - sizes], data[ends - 1] = 2, 3
        owner = np.repeat(np.arange(len(first)), sizes)
        sums = flat.prefix_bytes(data)
        rows = [flat.mix(flat.ranges(sums, ends - sizes, ends))]
        owners = [np.arange(len(first))]
        for n in settings.grams:
            if total >= n:
                inside = np.flatnonzero(owner[n - 1 :] == owner[: total - n + 1])
                # The whole word has a row of its own already.
                inside = inside[sizes[owner[inside]] > n]
                rows.append(flat.grams(sums, n)[inside])
                owners.append(owner[inside])
        self.row = (np.concatenate(rows) % flat.U(settings.rows)).astype(np.int64)
        self.owner = np.concatenate(owners)
        self.words = len(first)
        # A word that stands directly after itself also counts as one more word, always the same one.
        again = np.flatnonzero((self.word[1:] == self.word[:-1]) & (self.doc[1:] == self.doc[:-1])) + 1
        self.doc = np.concatenate((self.doc, self.doc[again]))
        order = np.argsort(self.doc, kind="stable")
        self.doc, self.word = self.doc[order], np.concatenate((self.word, np.full(len(again), self.words)))[order]
        self.row, self.owner = np.append(self.row, REPEAT % settings.rows), np.append(self.owner, self.words)
        self.words += 1

    def scores(self, weight: np.ndarray) -> np.ndarray:
        """Mean of ``weight`` over the rows of each document; 0 without words."""
        each = np.bincount(self.owner, weights=weight[self.row], minlength=self.words)
        count = np.bincount(self.owner, minlength=self.words)
        total = np.bincount(self.doc, weights=each[self.word], minlength=self.docs)
        n = np.bincount(self.doc, weights=count[self.word], minlength=self.docs)
        return total / np.maximum(n, 1)

    def of_documents(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Distinct rows of each document and their shares in it."""
        order = np.argsort(self.owner, kind="stable")
        row = self.row[order]
        borders = np.concatenate(([0], np.cumsum(np.bincount(self.owner, minlength=self.words))))
        out, at = [], np.concatenate(([0], np.cumsum(np.bincount(self.doc, minlength=self.docs))))
        for a, b in zip(at[:-1], at[1:]):
            words, counts = np.unique(self.word[a:b], return_counts=True)
            found = np.concatenate([row[borders[w] : borders[w + 1]] for w in words]) if len(words) else np.empty(0, np.int64)
            weights = np.repeat(counts, borders[words + 1] - borders[words])
            rows, place = np.unique(found, return_inverse=True)
            shares = np.bincount(place, weights=weights, minlength=len(rows))
            out.append((rows, (shares / max(shares.sum(), 1)).astype(np.float32)))
        return out


def learn(documents: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, settings: Settings) -> tuple[np.ndarray, float]:
    """One weight for each row of the table and a bias: the log-odds of label 1."""
    random = np.random.default_rng(7)
    table = ((random.random((settings.rows, settings.size), np.float32) - 0.5) / settings.size).astype(np.float32)
    out = np.zeros((settings.size, 2), np.float32)
    bias = np.zeros(2, np.float32)
    # Few documents are gone through more often: the weights need some number of steps to leave their start.
    epochs = max(settings.epochs, -(-settings.steps // max(len(documents), 1)))
    steps, total = 0, max(epochs * len(documents), 1)
    # Both classes weigh the same, however many of each there are.
    share = np.maximum(np.bincount(labels, minlength=2), 1) / max(len(labels), 1)
    for _ in range(epochs):
        for i in random.permutation(len(documents)):
            rate = settings.rate * (1 - steps / total)
            steps += 1
            rows, shares = documents[i]
            hidden = shares @ table[rows] if len(rows) else np.zeros(settings.size, np.float32)
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= np.float32(rate * min(0.5 / share[labels[i]], 4))
            back = out @ p
            out -= np.outer(hidden, p)
            bias -= p
            if len(rows):
                # A row's share is small; scaled so that a document moves its rows by as much as a single word would.
                table[rows] -= np.outer(shares * (1 / max(float(shares @ shares), 1e-6)) ** 0.5, back)
    return (table @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def labelled(docs: DataFrame, labels: DataFrame, settings: Settings, key: str, text: str, label: str) -> DataFrame:
    """The bounded training sample: ``__text, __label, __rank``; only keys whose crc32 mod 4 is not 2."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__label"))
    known = known.filter(F.crc32(F.col("__key").cast("string").cast("binary")) % 4 != 2).distinct()
    known = known.withColumn("__rank", F.xxhash64("__key"))
    ranked = [known.filter(F.col("__label") == c).orderBy("__rank", "__key").limit(settings.sample) for c in (0, 1)]
    chosen = ranked[0].unionByName(ranked[1])
    # At most twice ``sample`` rows of three numbers.
    return docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__key")


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[np.ndarray, float]:
    """A model from at most ``settings.sample`` labelled documents of each class.

    Features are made where the documents lie; their rows and shares, not the
    texts, meet in the one task that learns. Without labelled documents every
    score is one half.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "__text"):
            found = Features(piece, "__text", settings).of_documents()
            yield pa.RecordBatch.from_arrays(
                [column(piece, "__rank"), column(piece, "__label"), pa.array([r.astype(np.int32).tobytes() for r, _ in found], pa.binary()),
                 pa.array([s.tobytes() for _, s in found], pa.binary())], ["rank", "label", "rows", "shares"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((row for batch in batches for row in batch.to_pylist()), key=lambda r: (r["rank"], r["label"], r["rows"]))
        documents = [(np.frombuffer(r["rows"], np.int32), np.frombuffer(r["shares"], np.float32)) for r in got]
        if documents:
            weight, bias = learn(documents, np.array([r["label"] for r in got]), settings)
            yield pa.RecordBatch.from_arrays([pa.array([weight.tobytes()], pa.binary()), pa.array([bias])], ["weight", "bias"])

    sample = labelled(docs, labels, settings, key, text, label).select("__rank", "__label", "__text")
    made = sample.mapInArrow(features, "rank long, label int, rows binary, shares binary")
    model = made.repartition(1).mapInArrow(fit, "weight binary, bias double").first()
    return (np.zeros(settings.rows, np.float32), 0.0) if model is None else (np.frombuffer(model["weight"], np.float32), model["bias"])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def scored(docs: DataFrame, model: tuple[np.ndarray, float], settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: ``key, held_out, score, predicted``.

    ``held_out``: crc32 of the key as text is 2 modulo 4 (a null key as the
    empty text). Null and empty texts get the score of the bias; rows that
    repeat a key are scored by their own texts; an empty table gives an empty
    result; other columns are not read. The model that each task gets has
    ``settings.rows`` numbers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = shared.value
        for piece in pieces(batches, "__text"):
            score = _sigmoid(Features(piece, "__text", settings).scores(weight) + bias)
            yield pa.RecordBatch.from_arrays([column(piece, "__key"), pa.array(score)], ["__key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInArrow(run, f"__key {kind}, score double")
    held = F.crc32(F.coalesce(F.col("__key").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    return out.select(F.col("__key").alias(key), held.alias("held_out"), "score", (F.col("score") >= settings.threshold).cast("int").alias("predicted"))


def select_quality(docs: DataFrame, model: tuple[np.ndarray, float], settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model accepts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = shared.value
        for piece in pieces(batches, text):
            keep = _sigmoid(Features(piece, text, settings).scores(weight) + bias) >= settings.threshold
            yield piece.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)

"""Quality: neighbours vote in a latent-semantic space, by exact blocked cosine products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograph.llm.toxicity import held_out, scored
from tempograph.llm.training import labelled_sample
from tempograph.llm.words import LOWER, WORD, Words, mix, split_words

#: Hashed terms: word shapes, repeats and, with less weight, the words themselves.
TERMS = 1 << 13
SHAPES = 1 << 11
DIM = 48
WORD_WEIGHT = 0.3
NEIGHBOURS = 15
#: Documents of either class whose vectors are broadcast, at most: 2 * PER_CLASS * DIM floats.
PER_CLASS = 1500
BLOCK = 512
THRESHOLD = 0.3

#: Bytes of text that are embedded together; each distinct term of a row takes a row of the projection.
CHUNK = 1 << 18
_IDS = np.arange(256)
#: Byte classes of a word's shape: upper, lower or non-ASCII letter, digit; other bytes stand for themselves.
CLASS = np.where((_IDS >= 0x41) & (_IDS <= 0x5A), 0x41, np.where(((_IDS >= 0x61) & (_IDS <= 0x7A)) | (_IDS >= 0x80), 0x61, np.where((_IDS >= 0x30) & (_IDS <= 0x39), 0x30, _IDS))).astype(np.uint8)


def terms(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(word index, term) for every term of a chunk.

    A word gives its shape (runs of one class collapsed), the word in lower
    case, and REPEAT when it equals the word before it in the same row.
    """
    classes = CLASS[words.data]
    new = np.ones(len(classes), bool)
    new[1:] = classes[1:] != classes[:-1]
    new[words.starts] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    shape = WORD.spans(WORD.values[classes[new]], kept[words.starts], kept[words.ends])
    low = WORD.spans(WORD.values[LOWER[words.data]], words.starts, words.ends)
    again = np.flatnonzero((low[1:] == low[:-1]) & (np.diff(words.rows()) == 0)) + 1
    n = np.arange(len(words))
    shapes = (shape % np.uint64(SHAPES - 1)).astype(np.int64) + 1
    named = (mix(low) % np.uint64(TERMS - SHAPES)).astype(np.int64) + SHAPES
    return np.concatenate([n, n, again]), np.concatenate([shapes, named, np.zeros(len(again), np.int64)])


def counts(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of the distinct terms of each row; a weight is the term's share of the row's words, rooted."""
    at, term = terms(words)
    key, n = np.unique(words.rows()[at] * TERMS + term, return_counts=True)
    row, term = key // TERMS, key % TERMS
    weight = np.sqrt(n / words.counts[row])
    return row, term, np.where(term >= SHAPES, WORD_WEIGHT, 1.0) * weight


class Model:
    """Projection of terms to the latent space, and labelled unit vectors with their votes' weights."""

    def __init__(self, projection: np.ndarray, vectors: np.ndarray, labels: np.ndarray, votes: np.ndarray, share: float):
        self.projection, self.vectors, self.labels, self.votes, self.share = projection, vectors, labels, votes, share

    def embed(self, column) -> np.ndarray:
        out = np.zeros((len(column), self.projection.shape[1]), np.float32)
        for words in split_words(column, limit=CHUNK):
            if not len(words):
                continue
            row, term, weight = counts(words)
            first = np.flatnonzero(np.concatenate([[True], np.diff(row) != 0]))
            out[words.lo + row[first]] = np.add.reduceat(self.projection[term] * weight[:, None].astype(np.float32), first, axis=0)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)

    def score(self, column) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, weighted by similarity; `share` where nothing is similar."""
        vectors, out = self.embed(column), np.full(len(column), self.share)
        k = min(NEIGHBOURS, len(self.vectors))
        for lo in range(0, len(vectors) if k else 0, BLOCK):
            cosine = vectors[lo : lo + BLOCK] @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0) ** 4 * self.votes[near]
            total = weight.sum(1)
            yes = (weight * self.labels[near]).sum(1)
            some = total > 0
            out[lo : lo + BLOCK][some] = yes[some] / total[some]
        return np.clip(out, 0, 1)


def fit(texts: pa.Array, y: np.ndarray, share: float, seed: int = 11) -> Model:
    """Latent semantic analysis of a sample by subspace iteration on its term matrix."""
    matrix = np.zeros((len(texts), TERMS), np.float32)
    for words in split_words(texts):
        if len(words):
            row, term, weight = counts(words)
            matrix[words.lo + row, term] = weight
    idf = np.log((1 + len(matrix)) / (1 + (matrix > 0).sum(0))).astype(np.float32) + 1
    matrix *= idf
    dim = min(DIM, *matrix.shape)
    if not dim:
        return Model(np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0), share or 0.5)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(TERMS, dim)).astype(np.float32))[0]
    for _ in range(6):
        basis = np.linalg.qr(matrix.T @ (matrix @ basis))[0]
    model = Model((idf[:, None] * basis).astype(np.float32), np.zeros((0, dim), np.float32), np.zeros(0), np.zeros(0), share)
    del matrix
    vectors = model.embed(texts)
    ones = max(1, int((y == 1).sum()))
    zeros = max(1, int((y == 0).sum()))
    # classes may be sampled at other rates than they occur at
    votes = np.where(y == 1, max(share, 1e-3) / ones, max(1 - share, 1e-3) / zeros)
    return Model(model.projection, vectors, y.astype(float), votes, share)


def train(docs: DataFrame, labels: DataFrame, learn) -> Model:
    return fit(*labelled_sample(docs, labels, "quality", learn, PER_CLASS))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Texts without words score as the share of good labels says. Repeated rows
    are scored alike; without labels every score is 0.5.
    """
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = scored(docs.select("doc_id", "text"), train(docs, labels, ~held_out(5, 0)))
    return found.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose quality is predicted 1, unchanged; the model learns from all labels outside the held-out fold."""
    others = F.struct(*(c for c in docs.columns if c != "text"))
    found = scored(docs.select(others.alias("row"), "text"), train(docs, labels, ~held_out(5, 0))).where(F.col("score") >= THRESHOLD)
    return found.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))

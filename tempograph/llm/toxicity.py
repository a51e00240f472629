"""Toxicity: averaged subword embeddings and a linear softmax, trained jointly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograph.llm.training import labelled_sample
from tempograph.llm.words import LOWER, SPACED, WORD, Words, runs, split_words

BUCKETS = 1 << 20
DIM = 4
GRAMS = (3,)
#: Documents of either class that the model is fitted on, at most.
PER_CLASS = 3000
#: The worst passages are chosen anew in each round of so many steps.
ROUNDS, STEPS = 6, 12
RATE, MOMENTUM, DECAY = 1000.0, 0.9, 1e-5
#: Subwords of fewer sample documents say nothing about unseen ones and get no embedding.
MIN_DOCS = 30
THRESHOLD = 0.3
#: Words of a passage; a document scores as its worst passage, so that a long text cannot dilute an insult.
PASSAGE = 64
EDGE = np.frombuffer(b"<>", np.uint8)


def distinct_words(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """For each word of a chunk the number of its distinct spelling; a word standing for each."""
    _, first, which = np.unique(words.hashes(WORD), return_index=True, return_inverse=True)
    return which, first


def subwords(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of `<word>` and of the word itself, for the given words; their number for each."""
    sizes = (words.ends - words.starts)[which]
    ends = np.cumsum(sizes + 2)
    starts = ends - sizes - 2
    padded = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    padded[starts], padded[ends - 1] = EDGE[0], EDGE[1]
    padded[runs(starts + 1, sizes)] = words.data[runs(words.starts[which], sizes)]
    symbols = WORD.values[padded]
    owner, gram = [np.arange(len(which))], [WORD.spans(symbols, starts, ends)]
    for n in GRAMS:
        count = np.maximum(sizes + 2 - n + 1, 0)
        at = runs(starts, count)
        owner.append(np.repeat(np.arange(len(which)), count))
        gram.append(WORD.spans(symbols, at, at + n))
    owner, gram = np.concatenate(owner), np.concatenate(gram)
    order = np.argsort(owner, kind="stable")
    return (gram[order] % np.uint64(BUCKETS)).astype(np.int64), np.bincount(owner, minlength=len(which))


def passages(words: Words, step: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each passage, `step` words apart, and its row."""
    n = words.counts
    count = np.where(n == 0, 0, 1 + np.maximum(-(-(n - PASSAGE) // step), 0))
    row = np.repeat(np.arange(len(n)), count)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return words.first[row] + step * inside, row


class Model:
    """A weight for each subword bucket: the embedding's product with the difference of the two output vectors."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def margin(self, column) -> np.ndarray:
        """Log-odds of label 1: the bias and the highest passage mean of each text, 0 for a text without words."""
        out = np.full(len(column), self.bias)
        for words in split_words(column, SPACED, lower=True):
            if not len(words):
                continue
            which, first = distinct_words(words)
            grams, counts = subwords(words, first)
            each = np.add.reduceat(self.weights[grams].astype(np.float64), np.cumsum(counts) - counts) / counts
            total = np.concatenate([[0.0], np.cumsum(each[which])])
            start, row = passages(words, PASSAGE // 2)
            end = np.minimum(start + PASSAGE, words.first[row + 1])
            mean = (total[end] - total[start]) / (end - start)
            best = np.full(words.hi - words.lo, -np.inf)
            np.maximum.at(best, row, mean)
            some = words.counts > 0
            out[words.lo : words.hi][some] += best[some]
        return out

    def score(self, column) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(column), -500, 500)))


def _entries(column) -> Iterator[tuple[np.ndarray, ...]]:
    """Row of each passage of a piece of a column; passage, bucket and weight of each sparse entry."""
    for words in split_words(column, SPACED, lower=True, limit=1 << 18):
        if not len(words):
            continue
        which, first = distinct_words(words)
        grams, counts = subwords(words, first)
        begin = np.cumsum(counts) - counts
        start, row = passages(words, PASSAGE)
        end = np.minimum(start + PASSAGE, words.first[row + 1])
        at = runs(start, end - start)
        passage = np.repeat(np.arange(len(start)), end - start)
        w = which[at]
        keys = np.repeat(passage, counts[w]) * BUCKETS + grams[runs(begin[w], counts[w])]
        value = np.repeat(1 / (counts[w] * (end - start)[passage]), counts[w])
        keys, inverse = np.unique(keys, return_inverse=True)
        yield row + words.lo, keys // BUCKETS, keys % BUCKETS, np.bincount(inverse, value)


def _bags(column, least: int) -> tuple[np.ndarray, ...]:
    """Owner of each passage; passage, bucket and weight of each entry; idf factor and original bucket of each bucket used.

    Two passes over the texts: the first counts, so that the second only keeps
    buckets of at least `least` documents and memory is bounded by those.
    """
    spread, seen, mass = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS)
    for row, bag, bucket, weight in _entries(column):
        spread += np.bincount(np.unique(row[bag] * BUCKETS + bucket) % BUCKETS, minlength=BUCKETS)
        seen += np.bincount(bucket, minlength=BUCKETS)
        mass += np.bincount(bucket, weight, minlength=BUCKETS)
    used = np.flatnonzero(spread >= least)
    factor = np.log((len(column) + 1) / spread[used]) * seen[used] / mass[used]
    number = np.full(BUCKETS, -1, np.int32)
    number[used] = np.arange(len(used))
    parts, n = [], 0
    for row, bag, bucket, weight in _entries(column):
        ok = number[bucket] >= 0
        bag, bucket, weight = bag[ok], number[bucket[ok]], weight[ok]
        keep, bag = np.unique(bag, return_inverse=True)
        parts.append((row[keep], (bag + n).astype(np.int32), bucket, (weight * factor[bucket]).astype(np.float32)))
        n += len(keep)
    if not parts:
        parts.append((np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32)))
    return (*map(np.concatenate, zip(*parts)), factor.astype(np.float32), used)


def _choose(bag: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of the wanted passages, in order; where each passage's entries start."""
    begin, end = np.searchsorted(bag, wanted.astype(bag.dtype)), np.searchsorted(bag, wanted.astype(bag.dtype), "right")
    return runs(begin, end - begin), np.cumsum(end - begin) - (end - begin)


def fit(texts: pa.Array, y: np.ndarray, share: float, seed: int = 7) -> Model:
    """Gradient descent on embeddings and output weights together.

    A bag averages its subwords' embeddings, each weighted by its idf. The
    loss of a document is that of its worst passage, chosen anew in each
    round. Classes weigh alike in the sample; the bias is then moved to the
    share of label 1. Without both classes, or without any subword that is
    frequent enough, every score is the share.
    """
    share = min(max(share, 1e-3), 1 - 1e-3)
    prior = float(np.log(share / (1 - share)))
    nothing = Model(np.zeros(BUCKETS, np.float32), prior)
    if len(np.unique(y)) < 2:
        return nothing
    owner, bag, bucket, weight, factor, used = _bags(texts, max(2, min(MIN_DOCS, len(y) // 40)))
    if not len(bag):
        return nothing
    rng = np.random.default_rng(seed)
    y, balance = y[owner], np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))[owner]
    embed = rng.normal(0, 0.01, (DIM, len(used))).astype(np.float32)
    out = (rng.choice([-1.0, 1.0], DIM) * np.array([[-1.0], [1.0]]) / np.sqrt(2 * DIM)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    all_at = np.searchsorted(bag, np.arange(len(owner)))
    for _ in range(ROUNDS):
        linear = (out[1] - out[0]) @ embed
        margin = np.add.reduceat(linear[bucket] * weight, all_at)
        order = np.lexsort((margin, owner))
        worst = np.sort(order[np.append(np.flatnonzero(np.diff(owner[order])), len(order) - 1)])
        entry, start = _choose(bag, worst)
        b, w = bucket[entry], weight[entry]
        by_bucket = np.argsort(b, kind="stable")
        here, first = np.unique(b[by_bucket], return_index=True)
        passage = np.repeat(np.arange(len(worst)), np.diff(np.append(start, len(entry))))[by_bucket]
        w_t = w[by_bucket]
        rate = np.float32(RATE / np.average(np.add.reduceat(w * w, start), weights=balance[worst]))
        speed = [np.zeros_like(p) for p in (embed, out, bias)]
        for _ in range(STEPS):
            vectors = np.stack([np.add.reduceat(embed[k][b] * w, start) for k in range(DIM)], 1)
            logits = vectors @ out.T + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(worst)), y[worst]] -= 1
            p *= balance[worst][:, None]
            d_vectors = (p @ out).astype(np.float32)
            d_embed = np.float32(DECAY) * embed
            for k in range(DIM):
                d_embed[k][here] += np.add.reduceat(d_vectors[:, k][passage] * w_t, first)
            for x, g, r, m in zip((embed, out, bias), (d_embed, p.T @ vectors, p.sum(0)), (rate, np.float32(0.01), np.float32(0.5)), speed):
                m *= np.float32(MOMENTUM)
                m += g.astype(np.float32)
                x -= r * m
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = (out[1] - out[0]) @ embed * factor
    return Model(weights, float(bias[1] - bias[0]) + prior)


def held_out(parts: int, left: int):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts)) == left, F.lit(False))


def scored(docs: DataFrame, model) -> DataFrame:
    """Docs and score, from 0 to 1, of the whole text (null: empty); a column named score is replaced."""
    names = [c for c in docs.columns if c != "score"]
    # a text that is kept is not sent twice
    source = docs.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(model.score(batch.column("text")))], names=[*names, "score"])

    schema = docs.select(*names).withColumn("score", F.lit(0.0)).schema
    return source.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, learn) -> Model:
    return fit(*labelled_sample(docs, labels, "toxic", learn, PER_CLASS))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Texts without words score as the share of toxic labels says. Repeated rows
    are scored alike; without labels every score is that of an empty text.
    """
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels, ~held_out(4, 2))
    found = scored(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Benchmark decontamination: phrases of test items located by an FM-index of each training shard."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempograph.llm import store
from tempograph.llm.fmindex import FMIndex
from tempograph.llm.words import ALNUM, Words, member, runs, split_words

WINDOW = 13
#: Characters of benchmark text that are held at a time; a larger benchmark is searched block by block.
BLOCK_CHARS = 4 << 20
#: Bytes of document text in one training shard, that is one FM-index.
SHARD = 1_000_000


class Phrases:
    """The distinct windows of a block of items, over a vocabulary 1..top of the block's words.

    `matrix` has a row for each window, padded at the left with 0; phrase p
    belongs to the items names[owners[first[p]:first[p + 1]]].
    """

    def __init__(self, ids: list, texts: list):
        parts = list(split_words(pa.array(texts, pa.string()), ALNUM, lower=True))
        hashes = [w.hashes() for w in parts]
        self.words = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))
        rows, sizes, owner = [np.zeros((0, WINDOW), np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for w, h in zip(parts, hashes):
            symbols = (member(self.words, h) + 1).astype(np.int32)
            size = np.minimum(w.counts, WINDOW)
            n = np.where(w.counts > 0, w.counts - size + 1, 0)
            at, size = runs(w.first[:-1], n), np.repeat(size, n)
            column = at[:, None] + np.arange(WINDOW) - (WINDOW - size)[:, None]
            rows.append(np.where(column >= at[:, None], symbols[np.maximum(column, 0)] if len(symbols) else 0, 0).astype(np.int32))
            sizes.append(size)
            owner.append(w.lo + np.repeat(np.arange(len(n)), n))
        self.matrix, phrase = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.lengths = (self.matrix > 0).sum(1)
        self.shortest = int(self.lengths.min()) if len(self.matrix) else 0
        self.names, item = np.unique(np.array([str(i) for i in ids], dtype=object), return_inverse=True) if ids else (np.zeros(0, object), np.zeros(0, np.int64))
        pairs = np.unique(np.stack([phrase.ravel(), item[np.concatenate(owner)]]), axis=1) if len(phrase) else np.zeros((2, 0), np.int64)
        self.owners, self.first = pairs[1], np.searchsorted(pairs[0], np.arange(len(self.matrix) + 1))

    def items(self, phrases) -> set[str]:
        return {self.names[o] for p in phrases for o in self.owners[self.first[p] : self.first[p + 1]]}


def _reduced(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a shard and the word each stands for.

    Words that no item has cannot lie inside an occurrence: they become
    separators, as do the ends of documents. Runs of benchmark words that are
    shorter than the shortest phrase hold no occurrence and are left out.
    """
    known = member(phrases.words, words.hashes()) + 1
    inside = known > 0
    begin, finish = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    finish[:-1] &= ~inside[1:]
    cuts = words.first[(words.first > 0) & (words.first < len(words))]
    begin[cuts] = inside[cuts]
    finish[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    long = ends - starts >= phrases.shortest
    starts, sizes = starts[long], (ends - starts)[long]
    at = runs(starts, sizes + 1)  # each run and one place for its separator
    symbols = np.zeros(len(at), np.int64)
    last = np.cumsum(sizes + 1) - 1
    body = np.ones(len(at), bool)
    body[last] = False
    symbols[body] = known[at[body]]
    return symbols, at


def find(words: Words, phrases: Phrases) -> tuple[np.ndarray, list[set[int]]]:
    """Which words of a shard lie in an occurrence, and the phrases found in each row."""
    found: list[set[int]] = [set() for _ in range(words.hi - words.lo)]
    cover = np.zeros(len(words) + 1, np.int64)
    symbols, at = _reduced(words, phrases)
    if len(symbols):
        index = FMIndex(symbols, len(phrases.words))
        lo, hi = index.search(phrases.matrix, phrases.lengths)
        phrase = np.repeat(np.arange(len(lo)), hi - lo)
        place = at[index.locate(runs(lo, hi - lo))]
        np.add.at(cover, place, 1)
        np.add.at(cover, place + phrases.lengths[phrase], -1)
        row = np.searchsorted(words.first, place, "right") - 1
        for r, p in np.unique(np.stack([row, phrase]), axis=1).T.tolist():
            found[r].add(p)
    return np.cumsum(cover[:-1]) > 0, found


SPANS = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))


def _spans(hit: np.ndarray) -> list[dict]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return [{"begin": a, "end": b} for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())]


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list, list]]:
    """Items with text, in blocks of at most BLOCK_CHARS characters (a longer item alone)."""
    ids, texts, size = [], [], 0
    for row in benchmark.where("text is not null").select("item_id", "text").toLocalIterator():
        if size and size + len(row.text) > BLOCK_CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row.item_id)
        texts.append(row.text)
        size += len(row.text)
    if ids:
        yield ids, texts


KIND = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _search(docs: DataFrame, items: tuple[list, list]) -> DataFrame:
    """Adds __n (words), __spans and __items, what one block of items has in each document.

    The block's windows are worked out once and broadcast; BLOCK_CHARS bounds
    their size.
    """
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(Phrases(*items))

    def run(batches):
        phrases = shared.value
        for batch in batches:
            n, spans, found = np.zeros(batch.num_rows, np.int64), [], []
            for words in split_words(batch.column("__text"), ALNUM, lower=True, limit=SHARD):
                hit, rows = find(words, phrases) if len(phrases.lengths) and len(words) else (np.zeros(len(words), bool), [set()] * (words.hi - words.lo))
                n[words.lo : words.hi] = words.counts
                for r, ps in enumerate(rows):
                    spans.append(_spans(hit[words.first[r] : words.first[r + 1]]) if ps else [])
                    found.append(sorted(phrases.items(ps)))
            new = [pa.array(n), pa.array(spans, KIND), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *new], names=[*names, "__n", "__spans", "__items"])

    schema = docs.select("*", F.lit(0).cast("long").alias("__n"), F.array().cast(SPANS).alias("__spans"), F.array().cast("array<string>").alias("__items")).schema
    return docs.select("*", F.col("text").alias("__text")).mapInArrow(run, schema)


def _united(found: DataFrame) -> DataFrame:
    """__key, __spans and __items of rows (__key, lists of spans, lists of items): overlapping spans are merged."""

    def run(batches):
        for batch in batches:
            spans, items = [], []
            for some, names in zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist()):
                merged: list[dict] = []
                for s in sorted((s for part in some for s in part), key=lambda s: s["begin"]):
                    if merged and s["begin"] <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], s["end"])
                    else:
                        merged.append(s)
                spans.append(merged)
                items.append(sorted({i for part in names for i in part}))
            yield pa.RecordBatch.from_arrays([batch.column("__key"), pa.array(spans, KIND), pa.array(items, pa.list_(pa.string()))], names=["__key", "__spans", "__items"])

    schema = T.StructType([T.StructField("__key", T.StringType()), T.StructField("__spans", SPANS), T.StructField("__items", T.ArrayType(T.StringType()))])
    return found.groupBy("__key").agg(F.collect_list("__spans").alias("spans"), F.collect_list("__items").alias("items")).mapInArrow(run, schema)


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Docs with __n (words), __spans (removal spans in words, merged) and __items (sorted item ids).

    A document word inside any occurrence of a window of WINDOW consecutive
    item words is in a span; an item of fewer words, but some, is one window.
    Null texts have no words; items with null or no words have no windows; an
    empty benchmark finds nothing. Repeated rows and items change nothing.

    A benchmark of one block is one map over the documents. Of a larger one
    each block's finds are written as a table before the next block is
    fetched, so the driver and a task hold one block, however many there are;
    the finds are then joined to the documents by a digest of the text.
    """
    blocks = _blocks(benchmark)
    first, second = next(blocks, ([], [])), next(blocks, None)
    if second is None:
        return _search(docs, first)
    key = F.sha2(F.coalesce("text", F.lit("")), 256).alias("__key")
    paths, found = [], None
    for items in itertools.chain([first, second], blocks):
        part = _search(docs.select("text"), items).where("size(__items) > 0").select(key, "__spans", "__items").dropDuplicates(["__key"])
        found = store.table(part, "finds")
        paths.append(found.shared_path)
    every = docs.sparkSession.read.schema(found.schema).parquet(*paths)
    counted = _search(docs, ([], [])).drop("__spans", "__items").withColumn("__digest", key)
    joined = counted.join(_united(every), F.col("__digest") == F.col("__key"), "left").drop("__digest", "__key")
    return joined.withColumns({"__spans": F.coalesce("__spans", F.array().cast(SPANS)), "__items": F.coalesce("__items", F.array().cast("array<string>"))})


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Docs and n_words, n_hit, n_items, items_sha256, contaminated, spans (a clashing column is replaced)."""
    hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.begin)
    out = search(docs, benchmark).withColumns({"n_words": F.col("__n"), "n_hit": hit, "n_items": F.size("__items").cast("long"), "items_sha256": F.sha2(F.array_join("__items", ","), 256), "spans": F.col("__spans")})
    return out.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words")).drop("__n", "__spans", "__items")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, unchanged."""
    return contamination(docs.select(F.struct("*").alias("row"), "text"), benchmark).where("not contaminated").select("row.*")


_WORDS = r"list_filter(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, list_aggregate(w[i:i + least(13, len(w)) - 1], 'string_agg', ' ') AS win
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM q),
p AS (SELECT r, i, k, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS win
      FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT p.r, p.i, p.k, q.item_id FROM p JOIN q ON p.win = q.win AND p.k = q.k),
n AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""

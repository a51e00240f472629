"""Substring dedup: a log-structured index of window fingerprints, merge-joined batch by batch."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograph.llm import store
from tempograph.llm.words import GRAM, WORD, WORD2, Words, member, split_words

WINDOW = 35
#: Words of a gram; the lowest gram hash in a window is the window's fingerprint.
GRAM_WORDS = 8
GRAMS = WINDOW - GRAM_WORDS + 1
TOP = np.iinfo(np.uint64).max
#: Parts in which a whole table is added to an index.
BATCHES = 2


def _slide(values: np.ndarray, width: int, op) -> np.ndarray:
    """op over values[i:i+width] for each i up to len - width."""
    done = 1
    while done * 2 <= width:
        values = op(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return op(values[: len(values) - rest], values[rest:]) if rest else values


def window_prints(words: Words) -> tuple[np.ndarray, ...]:
    """Word hashes, windows, their fingerprints, and hashes and places of the grams that are the lowest of some window.

    Equal windows have equal fingerprints, wherever they stand. A gram that
    would leave its row counts as TOP.
    """
    h = words.hashes(WORD)
    at = words.windows(WINDOW)
    if not len(at):
        return h, at, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = np.full(len(words), TOP, np.uint64)
    inner = words.windows(GRAM_WORDS)
    grams[inner] = np.minimum(GRAM.spans(h, inner, inner + GRAM_WORDS), TOP - np.uint64(1))
    low = _slide(grams, GRAMS, np.minimum)[at]
    highest = np.zeros(len(words) + GRAMS - 1, np.uint64)
    highest[at + GRAMS - 1] = low
    chosen = np.flatnonzero((_slide(highest, GRAMS, np.maximum)[: len(grams)] == grams) & (grams != TOP))
    return h, at, low, grams[chosen], chosen


def _anchors(docs: DataFrame) -> DataFrame:
    """doc_id, th and prints: the fingerprint of each place that stands for some window, once per place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, counts = [np.zeros(0, np.uint64)], np.zeros(batch.num_rows, np.int64)
            for words in split_words(batch.column("text")):
                prints, places = window_prints(words)[3:]
                flat.append(prints)
                counts[words.lo : words.hi] = np.diff(np.searchsorted(places, words.first))
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            prints = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(flat).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), prints], names=["doc_id", "th", "prints"])

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, prints array<long>")


class WindowIndex:
    """Immutable sorted runs (print, n) of how often each window fingerprint has occurred so far.

    `add` merge-joins a batch with the runs of all batches before it, tells
    which fingerprints now repeat, and writes the batch as a new run. Two runs
    of one level are merged into one of the next level, so each fingerprint is
    rewritten about log2(batches) times. Runs lie in `folder`, by default the
    shared one; `save` notes them there and `open` goes on with them later.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder, self.runs = spark, folder, []

    def add(self, prints: DataFrame) -> DataFrame:
        """prints: a column `print`, one row for each place in the batch. Returns the fingerprints of the batch (print)
        that it or a batch before it has at another place."""
        run = prints.groupBy("print").agg(F.count("*").alias("n"))
        run = store.table(run.sortWithinPartitions("print"), "run", self.folder)
        found = run.where("n > 1").select("print")
        for _, old in self.runs:
            found = found.unionByName(run.hint("merge").join(old.select("print"), "print", "left_semi").select("print"))
        found = store.table(found.distinct(), "found")
        self._push(0, run)
        return found

    def _push(self, level: int, run: DataFrame) -> None:
        if self.runs and self.runs[-1][0] == level:
            _, old = self.runs.pop()
            merged = old.hint("merge").join(run.withColumnRenamed("n", "m"), "print", "full_outer")
            new = merged.select("print", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n")).sortWithinPartitions("print")
            new = store.table(new, "run", self.folder)
            for gone in (old, run):
                store.drop(gone)
            self._push(level + 1, new)
        else:
            self.runs.append((level, run))

    def compact(self) -> DataFrame:
        """All runs as one."""
        while len(self.runs) > 1:
            level, run = self.runs.pop()
            self.runs[-1] = (level, self.runs[-1][1])
            self._push(level, run)
        return self.runs[0][1]

    def save(self) -> None:
        """Notes the runs in the folder; the last note counts."""
        rows = [(level, run.shared_path) for level, run in self.runs]
        notes = self.spark.createDataFrame(rows, "level int, path string").withColumn("at", F.lit(time.time_ns()))
        notes.coalesce(1).write.mode("append").parquet(f"{self.folder.rstrip('/')}/notes")

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> WindowIndex:
        """The index as it was last saved."""
        index, notes = cls(spark, folder), spark.read.parquet(f"{folder.rstrip('/')}/notes")
        for row in sorted(notes.where(F.col("at") == notes.agg(F.max("at")).first()[0]).collect(), key=lambda r: -r.level):
            run = spark.read.parquet(row.path)
            run.shared_path = row.path
            index.runs.append((row.level, run))
        return index

    def drop(self) -> None:
        for _, run in self.runs:
            store.drop(run)
        self.runs = []


def _candidates(docs: DataFrame) -> DataFrame:
    """One row for each run of windows whose fingerprint repeats: where it starts, its digest, its windows' hashes.

    docs has doc_id, th, text and hits, the repeated fingerprints of the document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "th", "print", "span", "start", "windows"]
        for batch in batches:
            hits = batch.column("hits")
            known = np.unique(hits.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            ids, th = batch.column("doc_id"), batch.column("th")
            for words in split_words(batch.column("text")):
                _, at, low, *_ = window_prints(words)
                # fingerprints come from one family of word hashes, what verifies them from another
                h = words.hashes(WORD2)
                ok = np.flatnonzero(member(known, low) >= 0)
                at, low = at[ok], low[ok]
                if not len(at):
                    continue
                row = np.searchsorted(words.first, at, "right") - 1
                new = np.concatenate([[True], (np.diff(at) != 1) | (low[1:] != low[:-1]) | (row[1:] != row[:-1])])
                first = np.flatnonzero(new)
                inside = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
                first = np.flatnonzero(inside % GRAMS == 0)
                size = np.diff(np.append(first, len(at)))
                start = at[first]
                span = GRAM.spans(h, start, start + size - 1 + WINDOW)
                windows = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array(GRAM.spans(h, at, at + WINDOW).view(np.int64)))
                take = pa.array(row[first] + words.lo)
                place = pa.array(start - words.first[row[first]])
                yield pa.RecordBatch.from_arrays([ids.take(take), th.take(take), pa.array(low[first].view(np.int64)), pa.array(span.view(np.int64)), place, windows], names=names)

    return docs.select("doc_id", "th", "text", "hits").mapInArrow(run, "doc_id long, th long, print long, span long, start long, windows array<long>")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_id, th, spans: starts (in words) and bit masks of the windows that also start elsewhere in docs.

    docs has doc_id, text and th, a hash of text; documents without such a
    window are absent. The fingerprint narrows the search; a window counts as
    repeated when its fingerprint and a 64-bit hash of its 35 words, from word
    hashes of another family, both agree.
    Groups of equal passages are counted before they are dealt out, so a
    passage that a third of all documents share is one row of an aggregate.
    """
    spark = docs.sparkSession
    anchors = store.table(_anchors(docs), "anchors")
    index, found = WindowIndex(spark), []
    for b in range(BATCHES):
        found.append(index.add(anchors.where(F.pmod(F.xxhash64("doc_id", "th"), F.lit(BATCHES)) == b).select(F.explode("prints").alias("print"))))
    repeated = spark.read.schema("print long").parquet(*(f.shared_path for f in found)).distinct()
    prints = anchors.select("doc_id", "th", F.explode(F.array_distinct("prints")).alias("print"))
    hits = store.table(prints.hint("merge").join(repeated, "print").groupBy("doc_id", "th").agg(F.collect_list("print").alias("hits")), "hits")
    index.drop()
    for gone in (anchors, *found):
        store.drop(gone)
    with_hits = docs.join(hits.withColumnsRenamed({"doc_id": "d", "th": "t"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))
    found = store.table(_candidates(with_hits), "candidates")
    store.drop(hits)
    distinct = store.table(found.groupBy("print", "span").agg(F.count("*").alias("n"), F.first("windows").alias("windows")), "distinct")
    places = store.table(found.drop("windows"), "places")
    store.drop(found)
    each = distinct.select("print", "span", "n", F.posexplode("windows").alias("i", "window"))
    twice = store.table(each.groupBy("print", "window").agg(F.sum("n").alias("n")).where("n > 1").select("print", "window"), "twice")
    masks = each.drop("n").join(twice, ["print", "window"]).groupBy("print", "span").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask"))
    masks = store.table(masks, "masks")
    for gone in (distinct, twice):
        store.drop(gone)
    spans = places.join(masks, ["print", "span"]).groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "mask")).alias("spans"))
    spans = store.table(spans, "spans")
    for gone in (places, masks):
        store.drop(gone)
    return spans


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text, the words left joined by one space, of every row of docs.

    Words are runs of anything but ASCII white space, unchanged. Null and
    empty texts have no words and an empty kept_text. Repeated rows repeat
    every window, so their words go from all of them. Other columns of docs
    are ignored; an empty table gives an empty table.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    spans = repeated_windows(docs).withColumnsRenamed({"doc_id": "d", "th": "t"})
    joined = docs.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            n_words, n_removed, texts = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), []
            size = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(size)
            flat = spans.flatten()
            starts = flat.field("start").to_numpy(zero_copy_only=False).astype(np.int64)
            masks = flat.field("mask").to_numpy(zero_copy_only=False).astype(np.int64)
            for words in split_words(batch.column("text")):
                a, b = (ends - size)[words.lo], ends[words.hi - 1]
                at = np.repeat(words.first[:-1], size[words.lo : words.hi]) + starts[a:b]
                cover = np.zeros(len(words) + 1, np.int64)
                for bit in range(GRAMS):
                    here = at[(masks[a:b] >> bit) & 1 == 1] + bit
                    np.add.at(cover, here, 1)
                    np.add.at(cover, here + WINDOW, -1)
                kept = np.cumsum(cover[:-1]) == 0
                n_words[words.lo : words.hi] = words.counts
                left = np.diff(np.concatenate([[0], np.cumsum(kept)])[words.first])
                n_removed[words.lo : words.hi] = words.counts - left
                texts += _joined(words, kept)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words), pa.array(n_removed), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def _joined(words: Words, kept: np.ndarray) -> list[str]:
    """The kept words of each row, joined by one space."""
    starts, sizes = words.starts[kept], (words.ends - words.starts)[kept]
    total = int(sizes.sum()) + len(sizes)
    ends = np.cumsum(sizes + 1) - 1
    out = np.full(total, 0x20, np.uint8)
    body = np.ones(total, bool)
    body[ends] = False
    mark = np.zeros(len(words.data) + 1, np.int8)
    mark[starts] += 1
    mark[starts + sizes] -= 1
    out[body] = words.data[np.cumsum(mark[:-1], dtype=np.int8).astype(bool)]
    raw = out.tobytes()
    last = np.concatenate([[0], np.cumsum(sizes + 1)])[np.concatenate([[0], np.cumsum(kept)])[words.first]]
    return [raw[a : b - 1].decode() if b > a else "" for a, b in zip(last[:-1].tolist(), last[1:].tolist())]


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(list_filter(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), lambda x: x <> ''), []) AS w FROM documents),
p AS (SELECT r, i, md5(list_aggregate(w[i:i + 34], 'string_agg', ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
x AS (SELECT h FROM p GROUP BY h HAVING count(*) > 1),
g AS (SELECT r, list(DISTINCT j) AS gone FROM (SELECT r, unnest(range(i, i + 35)) AS j FROM p JOIN x USING (h)) GROUP BY r),
k AS (SELECT r, string_agg(v, ' ' ORDER BY i) AS kept, count(*) AS n_kept
      FROM (SELECT d.r, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS i FROM d) u
      LEFT JOIN (SELECT r, unnest(gone) AS i, true AS bad FROM g) b USING (r, i) WHERE bad IS NULL GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""

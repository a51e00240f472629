"""SimHash near-duplicates: 64-bit fingerprints compared as vertical bit planes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograph.llm import nearcopies, store
from tempograph.llm.components import components
from tempograph.llm.words import LOWER, SPACED, U64, Words, split_words
from tempograph.llm.xxh64 import xxh64

SHINGLE = 3
RADIUS = 2
#: Two fingerprints that differ in at most 2 bits agree on at least two of these four fields.
FIELDS = 4
TILE = 2048
LANES = np.uint64(0x0101010101010101)


def shingle_spans(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the words joined by single spaces; start and end of every shingle there; shingles per row.

    A row of fewer words than `width`, but some, has one shingle of them all.
    """
    sizes = words.ends - words.starts
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    mark = np.zeros(len(words.data) + 1, np.int8)
    np.add.at(mark, words.starts, 1)
    np.add.at(mark, words.ends, -1)
    inside = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
    joined = np.full(int(sizes.sum()) + len(sizes), 0x20, np.uint8)
    spaces = np.zeros(len(joined), bool)
    spaces[ends] = True
    joined[~spaces] = words.data[inside]
    n = words.counts
    shingles = np.where(n == 0, 0, np.maximum(n - width + 1, 1))
    row = np.repeat(np.arange(len(n)), shingles)
    first = np.arange(len(row)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + words.first[row]
    last = np.minimum(first + width, words.first[row + 1]) - 1
    return joined, starts[first], ends[last], shingles


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of `counts` hashes, the bits set in more than half of them; 0 for an empty run.

    Eight byte lanes of a 64-bit word count eight bits at a time, over pieces
    of at most 255 hashes so that no lane overflows.
    """
    out = np.zeros(len(counts), np.uint64)
    rows = np.flatnonzero(counts)
    if not len(rows):
        return out
    starts = (np.cumsum(counts) - counts)[rows]
    pieces = -(-counts[rows] // 255)
    at = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    first = np.cumsum(pieces) - pieces
    for k in range(8):
        lanes = np.add.reduceat((hashes >> U64(k)) & LANES, at).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(lanes.astype(np.int64), first, axis=0)
        for byte in range(8):
            out[rows] |= (2 * ones[:, byte] > counts[rows]).astype(np.uint64) << U64(8 * byte + k)
    return out


def fingerprints_of(column) -> np.ndarray:
    """Unsigned 64-bit fingerprint of each text of an Arrow column."""
    out = np.zeros(len(column), np.uint64)
    for words in split_words(column, SPACED, lower=True):
        if len(words):
            data, starts, ends, counts = shingle_spans(words, SHINGLE)
            out[words.lo : words.hi] = majority(xxh64(data, starts, ends), counts)
    return out


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints_of(batch.column("__text")).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fp)], names=[*keep, "fp"])

    source = docs.select(*keep, F.col("text").alias("__text"))
    schema = docs.select(*keep).withColumn("fp", F.lit(0).cast("long")).schema
    return source.mapInArrow(run, schema)


def transpose(values: np.ndarray) -> np.ndarray:
    """64 bit planes; bit i of plane p is bit p of values[i]."""
    n = -(-max(len(values), 1) // 64) * 64
    padded = np.zeros(n, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def close_pairs(values: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j, of the same group whose values differ in at most `radius` bits.

    `group` is sorted. For each distance d between positions, element i is
    compared with i + d for all i at once: 64 pairs to a machine word, one bit
    plane after another into carry-save counters (ones, twos and a sticky
    `over`). Words in which every pair is over the radius are left out of the
    remaining planes.
    """
    if radius > 2:
        raise ValueError("the counters tell distances up to 2")
    if len(values) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = np.flatnonzero(np.diff(group)) + 1
    firsts = np.concatenate([[0], cuts])
    sizes = np.diff(np.concatenate([firsts, [len(values)]]))
    left = np.repeat(firsts + sizes, sizes) - np.arange(len(values)) - 1
    planes, found = transpose(values), []
    for d in range(1, int(sizes.max())):
        lanes = np.zeros(planes.shape[1] * 64, bool)
        lanes[: len(left)] = left >= d
        wanted = np.packbits(lanes, bitorder="little").view(np.uint64)
        block = np.flatnonzero(wanted)
        words, shift = divmod(d, 64)
        ahead, after = np.minimum(block + words, planes.shape[1] - 1), np.minimum(block + words + 1, planes.shape[1] - 1)
        ones, twos, over = (np.zeros(len(block), np.uint64) for _ in range(3))
        over |= ~wanted[block]
        for p in range(64):
            plane = planes[p]
            other = plane[ahead] >> U64(shift)
            if shift:
                other |= plane[after] << U64(64 - shift)
            x = plane[block] ^ other
            twos |= ones & x
            ones ^= x
            over |= (ones | twos, twos, ones & twos)[radius]
            if p % 8 == 7:
                alive = over != ~U64(0)
                if not alive.all():
                    block, ahead, after, ones, twos, over = (a[alive] for a in (block, ahead, after, ones, twos, over))
                if not len(block):
                    break
        if len(block):
            ok = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
            b, lane = np.nonzero(ok)
            found.append((i := block[b] * 64 + lane, i + d))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node) with the same components as the edges (a, b)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            break
        root = low
    linked = root != np.arange(len(nodes))
    return nodes[linked], nodes[root[linked]]


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within the radius.

    `prints` has distinct fingerprints in column fp. A pair within the radius
    agrees on two of four 16-bit fields, so each fingerprint is dealt to six
    tables by the pair of fields. A key with many fingerprints is split into
    chunks, and every two chunks meet in a tile of bounded size; nothing is
    left out.
    """
    spark: SparkSession = prints.sparkSession
    fields = [F.shiftrightunsigned("fp", 64 // FIELDS * i).bitwiseAND(F.lit(0xFFFF)) for i in range(FIELDS)]
    pairs = [(i, j) for i in range(FIELDS) for j in range(i)]
    keys = F.array(*(F.lit(t) * F.lit(1 << 32) + fields[i] * F.lit(1 << 16) + fields[j] for t, (i, j) in enumerate(pairs)))
    dealt = prints.select("fp", F.explode(keys).alias("key"))
    crowded = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / TILE).cast("int")
    tiles = (
        dealt.join(crowded, "key")
        .select("key", "fp", chunks.alias("chunks"))
        .withColumn("c", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        .select("key", "fp", "c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o"))
        .select(F.xxhash64("key", F.least("c", "o"), F.greatest("c", "o")).alias("tile"), "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def compared(tile, fp):
            i, j = close_pairs(fp.view(np.uint64), tile)
            a, b = _forest(fp[i], fp[j])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            tile = np.concatenate([tile, batch.column("tile").to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column("fp").to_numpy(zero_copy_only=False)])
            done = int(np.searchsorted(-(tile != tile[-1]).astype(int), 0)) if len(tile) else 0
            if done:
                yield compared(tile[:done], fp[:done])
                tile, fp = tile[done:], fp[done:]
        if len(tile):
            yield compared(tile, fp)

    n = store.shuffle_partitions(spark)
    return tiles.repartition(n, "tile").sortWithinPartitions("tile", "fp").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, fp and component_id, the smallest id reachable over links of at most RADIUS differing bits.

    Null and empty texts have fingerprint zero and are linked like any other.
    Repeated rows give repeated rows; a row with a null id keeps a null id and
    gets its component's smallest id (null if all are null). Other columns of
    docs are ignored. An empty table gives an empty table.
    """
    prints = store.table(fingerprints(docs.select(F.col(id_col).alias("doc_id"), "text"), ["doc_id"]), "simhash")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("low")).transform(lambda d: store.table(d, "simhash-distinct"))
    roots = components(links(distinct.select("fp"))).checkpoint()
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return prints.join(rooted.join(lows, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex16(col: str):
    return F.lpad(F.lower(F.hex(col)), 16, "0")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", hex16("fp").alias("fingerprint"), "component_id")


def dedup_documents(docs: DataFrame) -> DataFrame:
    """Docs without near copies (five-word shingles, Jaccard index of at least 0.8).

    Fingerprints within RADIUS bits are linked as in near_duplicates and
    verified; an exact filter adds what lies beyond; see nearcopies.
    """
    return nearcopies.one_of_each(docs)

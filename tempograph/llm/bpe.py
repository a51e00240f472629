"""Byte-level BPE over length-bucketed, padded matrices of token ids."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograph.llm.words import U64, pieces, runs, text_bytes

NONE = np.iinfo(np.int32).max
#: Bytes of text whose pre-tokens are gathered before their new ones are merged together.
TEXT_CHUNK = 1 << 20
#: Merged pre-tokens that a Python worker remembers before it starts anew; this bounds memory, not results.
REMEMBERED = 300_000
#: Bytes of the longest pre-token that goes to a matrix, whose rounds cost the square of its width. A longer one is merged
#: alone, its pairs in a heap by rank and place, which takes them in the same order.
LONG_PIECE = 256
CELLS = 1 << 18


class PairTable:
    """Open-addressing table from (left id, right id) to the merged id."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = self._key(left, right)
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        self.keys = np.full(1 << self.bits, ~U64(0), np.uint64)
        self.merged = np.full(1 << self.bits, NONE, np.int32)
        slot, todo, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            self.probes += 1
            free = self.keys[slot[todo]] == ~U64(0)
            _, one = np.unique(slot[todo], return_index=True)
            placed = np.zeros(len(todo), bool)
            placed[one] = True
            placed &= free
            at = slot[todo[placed]]
            self.keys[at], self.merged[at] = keys[todo[placed]], merged[todo[placed]]
            todo = todo[~placed]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << U64(32)) | right.astype(np.uint64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where the pair has none; ids below 0 are padding."""
        keys = self._key(left, right)
        slot = self._slot(keys)
        kept = self.keys[slot]
        out = np.where(kept == keys, self.merged[slot], NONE)
        todo = np.flatnonzero((kept != keys) & (kept != ~U64(0)) & (left >= 0) & (right >= 0))
        for _ in range(self.probes - 1):
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            kept = self.keys[slot[todo]]
            hit = kept == keys[todo]
            out[todo[hit]] = self.merged[slot[todo[hit]]]
            todo = todo[~hit & (kept != ~U64(0))]
        return np.where((left < 0) | (right < 0), NONE, out)


class Vocabulary:
    """Ranks of a byte-level BPE; an id is its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        triples = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, merged = np.array(triples, np.int64).T if triples else np.zeros((3, 0), np.int64)
        self.pairs = PairTable(left, right, merged.astype(np.int32))
        self.triples = left, right, merged
        ids = np.array(sorted(ranks.values()))
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.length = np.zeros(int(ids.max()) + 1, np.int64)
        parts = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.length[ids] = [len(t) for t in parts]
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(parts), np.uint8)
        self.known: dict[str, bytes] = {}

    @cached_property
    def merges(self) -> dict[int, int]:
        """The pairs as a plain table, for rows that are merged alone."""
        return {a << 32 | b: c for a, b, c in zip(*(x.tolist() for x in self.triples))}

    def merge_matrix(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row numbers, their final ids) of a matrix padded with -1; no row is empty.

        Each round merges the leftmost pair of lowest rank of every row. A row
        then is one id shorter, so the matrix loses its last column; rows with
        nothing left to merge are handed out and leave it.
        """
        row = np.arange(len(ids))
        rank = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while ids.shape[1] > 1:
            at = rank.argmin(1)
            low = rank[np.arange(len(row)), at]
            live = low != NONE
            if not live.all():
                yield row[~live], ids[~live]
                row, ids, rank, at, low = row[live], ids[live], rank[live], at[live], low[live]
                if not len(row):
                    return
            n, column = np.arange(len(row)), np.arange(ids.shape[1] - 1)
            ids = np.where(column > at[:, None], ids[:, 1:], ids[:, :-1])
            ids[n, at] = low
            rank = np.where(column[:-1] >= at[:, None], rank[:, 1:], rank[:, :-1])
            inner = at > 0
            rank[n[inner], at[inner] - 1] = self.pairs.get(ids[n[inner], at[inner] - 1], low[inner])
            inner = at < ids.shape[1] - 1
            rank[n[inner], at[inner]] = self.pairs.get(low[inner], ids[n[inner], at[inner] + 1])
        yield row, ids

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """Final ids of one row: always the leftmost pair of lowest rank, in time n log n."""
        n, find = len(ids), self.merges.get
        token = [*ids.tolist(), -1]
        after, before = list(range(1, n + 2)), list(range(-1, n))
        # the place in the low bits, so that of equal ranks the leftmost comes first
        bits = n.bit_length()
        low = (1 << bits) - 1
        rank = self.pairs.get(ids[:-1], ids[1:])
        at = np.flatnonzero(rank != NONE)
        heap = (rank[at].astype(np.int64) << bits | at).tolist()
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i, new = top & low, top >> bits
            j = after[i]
            # entries of pairs that are no more are passed over
            if token[i] < 0 or j >= n or find(token[i] << 32 | token[j]) != new:
                continue
            token[i], token[j] = new, -1
            k = after[i] = after[j]
            before[k] = i
            if k < n and (r := find(new << 32 | token[k])) is not None:
                heapq.heappush(heap, r << bits | i)
            h = before[i]
            if h >= 0 and (r := find(token[h] << 32 | new)) is not None:
                heapq.heappush(heap, r << bits | h)
        out = np.array(token[:n], np.int32)
        return out[out >= 0]

    def merge(self, texts: list[str]) -> dict[str, bytes]:
        """Little-endian 32-bit ids of each pre-token."""
        out, rest = {}, []
        for text in texts:
            raw = text.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                out[text] = whole.to_bytes(4, "little")
            elif len(raw) > LONG_PIECE:
                out[text] = self.merge_long(self.byte_id[np.frombuffer(raw, np.uint8)]).astype("<u4").tobytes()
            else:
                rest.append((len(raw), text, raw))
        rest.sort(key=lambda x: x[0])
        lo = 0
        while lo < len(rest):
            # rows of a bucket differ by at most a quarter in length
            widest = max(rest[lo][0] * 5 // 4, 4)
            hi = lo
            while hi < len(rest) and rest[hi][0] <= widest and (hi - lo + 1) * widest <= CELLS:
                hi += 1
            block = rest[lo:hi]
            sizes = np.array([x[0] for x in block])
            matrix = np.full((len(block), int(sizes.max())), -1, np.int32)
            matrix[np.arange(matrix.shape[1]) < sizes[:, None]] = self.byte_id[np.frombuffer(b"".join(x[2] for x in block), np.uint8)]
            for row, ids in self.merge_matrix(matrix):
                used = (ids >= 0).sum(1)
                flat, ends = ids[ids >= 0].astype("<u4").tobytes(), np.cumsum(used) * 4
                for i, a, b in zip(row.tolist(), (ends - used * 4).tolist(), ends.tolist()):
                    out[block[i][1]] = flat[a:b]
            lo = hi
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each whole text."""
        split = [self.split(text) for text in texts]
        new = set().union(*split) - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set().union(*split)
        self.known.update(self.merge(list(new)))
        return [b"".join(map(self.known.__getitem__, s)) for s in split]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.flat[runs(self.start[ids], self.length[ids])].tobytes()


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def vocabulary(ranks: bytes, pattern: str) -> Vocabulary:
    table = {base64.b64decode(t): int(r) for t, r in (line.split() for line in ranks.splitlines() if line)}
    return Vocabulary(table, pattern)


def encoded(column: pa.Array, ranks: bytes, pattern: str) -> Iterator[tuple[Vocabulary, int, list[bytes]]]:
    """(vocabulary, first row, ids of the rows) for chunk after chunk of a text column."""
    voc = vocabulary(ranks, pattern)
    offsets, data = text_bytes(column)
    for lo, hi in pieces(offsets, TEXT_CHUNK):
        raw = data[offsets[lo] : offsets[hi]].tobytes()
        base = offsets[lo]
        yield voc, lo, voc.encode([raw[offsets[i] - base : offsets[i + 1] - base].decode() for i in range(lo, hi)])


def tokenize(docs: DataFrame, ranks: bytes, pattern: str, keep: list[str]) -> DataFrame:
    """The columns `keep` and ids, array<int>: the whole text (null: empty) without special tokens."""

    def run(batches):
        for batch in batches:
            parts = [i for _, _, rows in encoded(batch.column("__text"), ranks, pattern) for i in rows]
            flat = np.frombuffer(b"".join(parts), "<u4").astype(np.int32)
            ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), ids], names=[*keep, "ids"])

    schema = docs.select(*keep).withColumn("ids", F.array().cast("array<int>")).schema
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks: bytes, pattern: str, keep: list[str]) -> DataFrame:
    """The columns `keep`, n_tokens, ids_sha256 and decoded_sha256 of every whole text.

    Rows keep their order and number; a null or empty text has no ids and the
    digests of no bytes. A pure map: no shuffle, and one batch of texts in
    memory at a time.
    """

    def run(batches):
        for batch in batches:
            counts, ids_hex, text_hex = [], [], []
            for voc, _, rows in encoded(batch.column("__text"), ranks, pattern):
                for ids in rows:
                    counts.append(len(ids) // 4)
                    ids_hex.append(hashlib.sha256(ids).hexdigest())
                    text_hex.append(hashlib.sha256(voc.decode(np.frombuffer(ids, "<u4"))).hexdigest())
            columns = [*(batch.column(c) for c in keep), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    kept = docs.select(*keep)
    schema = kept.select("*", F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def public_ranks(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[bytes, str]:
    import public_tokenizers

    return read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_ranks()
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks, pattern, ["doc_id"])

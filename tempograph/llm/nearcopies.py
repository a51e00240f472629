"""Near copies: texts whose sets of five-word shingles have a Jaccard index of at least 0.8, all of them.

SimHash comes first: fingerprints of the sets, linked by the bit planes of
op2's operator, each link verified on whole sets. It cannot find all: at an
index of 0.8 two fingerprints differ in about ten bits, and no split into
fields is selective at such a radius. What lies beyond its radius comes from a
prefix filter, which loses none: whatever the order of shingles, two sets that are alike enough share k of the first
n - ceil(0.8 n) + k of each, for any k. Here k grows with the set (`common`),
so that a text is a candidate only if a good part of its prefix is found
elsewhere. Every candidate is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograph.llm import simhash, store
from tempograph.llm.components import components
from tempograph.llm.words import GRAM, GRAM2, SPACED, U64, WORD, mix, runs, split_words

WIDTH = 5
#: Least Jaccard index, as a fraction of whole numbers so that bounds are exact.
ALIKE, OF = 4, 5
#: Texts in which frequent shingles are looked for; their order decides the cost and nothing else.
SAMPLE, FREQUENT, MOST_FREQUENT = 20_000, 4, 200_000
#: Rounds, one at least, in which one member of each key is compared with the others, before all pairs that are left;
#: pairs of places that are so few to a place are looked at without another round.
ROUNDS, FEW = 2, 4
#: Words of 64 bits of a set's bitmap, in which each shingle turns over one bit.
BITMAP = 4
#: Keys of more members are compared in tiles of two chunks of so many members.
CROWDED, TILE = 16, 1024


def shingle_sets(column) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text; fewer than WIDTH words make one shingle, none make none."""
    for words in split_words(column, SPACED, lower=True):
        h = words.hashes(WORD)
        n = words.counts
        sizes = np.where(n == 0, 0, np.maximum(n - WIDTH + 1, 1))
        at = runs(words.first[:-1], sizes)
        row = np.repeat(np.arange(len(n)), sizes)
        grams = GRAM.spans(h, at, np.minimum(at + WIDTH, words.first[row + 1]))
        ends = np.cumsum(sizes)
        for i, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist())):
            yield words.lo + i, np.unique(grams[a:b])


def set_hash(grams: np.ndarray) -> int:
    """One signed long for a set."""
    total = (mix(grams ^ GRAM2.base).sum(dtype=np.uint64) + U64(len(grams))) if len(grams) else U64(0)
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def common(n: int) -> int:
    """Shingles that the prefixes of two sets of at least n shingles share if the sets are alike."""
    return 1 + n // 10


def least(n: int) -> int:
    """Shingles that a set alike to one of n has at least, and has in common with it."""
    return -(-n * ALIKE // OF)


def prefix(grams: np.ndarray, frequent: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first shingles of a set, seldom ones first, so many that a set alike has `common` of them among its own."""
    n = len(grams)
    size = n - least(n) + common(n) if n else 0
    rank = np.zeros(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
        rank = np.where(frequent[at] == grams, often[at], 0)
    return grams[np.lexsort((grams, rank))[:size]]


def bitmap(grams: np.ndarray) -> np.ndarray:
    """BITMAP signed longs. Two sets' bitmaps differ in at most as many bits as one of the sets only has shingles."""
    odd = np.bincount((mix(grams) & U64(64 * BITMAP - 1)).astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def fingerprint(grams: np.ndarray) -> int:
    """SimHash of a set: the bits that over half of its shingles' hashes have, as a signed long."""
    return int(simhash.majority(mix(grams), np.array([len(grams)])).view(np.int64)[0])


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)))


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of the sampled texts have, sorted, and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.concatenate([np.zeros(0, np.uint64), *(g for _, g in shingle_sets(batch.column("text")))])
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64))], names=["gram"])

    share = min(1.0, SAMPLE / max(docs.count(), 1))
    grams = docs.select("text").sample(share, seed=1).mapInArrow(run, "gram long")
    rows = grams.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n")).limit(MOST_FREQUENT).toArrow()
    gram = rows["gram"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(gram)
    return gram[order], rows["n"].to_numpy().astype(np.int64)[order]


def _prints(docs: DataFrame) -> DataFrame:
    """doc_id, th, h (the set's hash), n (its size), keys (its prefix), need (keys that a set alike shares, at least), bits and fp (the SimHash) of every row."""
    frequent, often = _frequent(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n, need, keys, bits, fp = [], [], [], [], [], []
            for _, grams in shingle_sets(batch.column("text")):
                h.append(set_hash(grams))
                n.append(len(grams))
                need.append(common(least(len(grams))))
                keys.append(prefix(grams, frequent, often))
                bits.append(bitmap(grams).view(np.uint64))
                fp.append(fingerprint(grams))
            new = [pa.array(h, pa.int64()), pa.array(n, pa.int64()), pa.array(need, pa.int64()), _lists(keys), _lists(bits), pa.array(fp, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), *new], names=["doc_id", "th", "h", "n", "need", "keys", "bits", "fp"])

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, h long, n long, need long, keys array<long>, bits array<long>, fp long")


def _sets(docs: DataFrame) -> DataFrame:
    """h and grams of docs with h and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [g for _, g in shingle_sets(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("h"), _lists(sets)], names=["h", "grams"])

    return docs.select("h", "text").mapInArrow(run, "h long, grams array<long>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("x", "y"):
                column = batch.column(name)
                ends = column.offsets.to_numpy()
                sides.append((ends, column.values.to_numpy().view(np.uint64)))
            (p, x), (q, y) = sides
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                n, m = int(p[i + 1] - p[i]), int(q[i + 1] - q[i])
                both = len(np.intersect1d(x[p[i] : p[i + 1]], y[q[i] : q[i + 1]], assume_unique=True))
                ok[i] = both * OF >= (n + m - both) * ALIKE
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in ("a", "b")], names=["a", "b"])

    whole = pairs.join(sets.select(F.col("h").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("h").alias("b"), F.col("grams").alias("y")), "b")
    return whole.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (h, fp) that join all nodes whose fingerprints simhash.links joins, equal ones included."""
    lows = store.table(nodes.groupBy("fp").agg(F.min("h").alias("low")), "near-simhash")
    equal = nodes.join(lows, "fp").where("h <> low").select(F.col("low").alias("x"), F.col("h").alias("y"))
    side = lambda c, low: lows.select(F.col("fp").alias(c), F.col("low").alias(low))
    near = simhash.links(lows.select("fp")).join(side("a", "x"), "a").join(side("b", "y"), "b").select("x", "y")
    return equal.unionByName(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _met(left: DataFrame, right: DataFrame, once: bool = False) -> DataFrame:
    """a, b and n (the smaller size) of rows of one key that are not joined yet and whose sizes allow them to be alike; each pair `once`."""
    a, b = left.select("key", F.col("h").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra")), right.select("key", F.col("h").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))
    fits = (F.least("na", "nb") * OF >= F.greatest("na", "nb") * ALIKE) & (F.col("ra") != F.col("rb"))
    return a.join(b, "key").where(fits & (F.col("a") < F.col("b")) if once else fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("na", "nb").alias("n"))


def close(bits: np.ndarray, n: np.ndarray, root: np.ndarray, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of one tile that may be alike: not joined, sizes near, bitmaps near; of both sides where there are two.

    Sets alike differ in at most a ninth of their shingles together, and their
    bitmaps in no more bits.
    """
    found = [(np.zeros(0, np.int64),) * 2]
    for lo in range(0, len(n), 256):
        hi = min(lo + 256, len(n))
        far = np.zeros((hi - lo, len(n) - lo), np.uint16)
        for k in range(bits.shape[1]):
            far += np.bitwise_count(bits[lo:hi, k, None] ^ bits[None, lo:, k])
        both = n[lo:hi, None] + n[None, lo:]
        ok = (far.astype(np.int64) * (OF + ALIKE) <= both * (OF - ALIKE)) & (np.minimum(n[lo:hi, None], n[None, lo:]) * OF >= np.maximum(n[lo:hi, None], n[None, lo:]) * ALIKE)
        ok &= (root[lo:hi, None] != root[None, lo:]) & (np.arange(lo, hi)[:, None] < np.arange(lo, len(n))[None, :])
        if side is not None:
            ok &= side[lo:hi, None] != side[None, lo:]
        i, j = np.nonzero(ok)
        found.append((i + lo, j + lo))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _tiled(rooted: DataFrame, sizes: DataFrame) -> DataFrame:
    """What `_met` gives for keys with many members (sizes: key, k), of the pairs whose bitmaps are near.

    Members of a key are dealt to chunks, and every two chunks meet in a tile
    of bounded size, so no task holds a whole key and only near pairs leave it.
    """
    chunks = F.ceil(F.col("k") / TILE).cast("int")
    dealt = rooted.join(sizes.select("key", chunks.alias("chunks")), "key").withColumn("c", F.pmod(F.xxhash64("h"), F.col("chunks")).cast("int"))
    dealt = dealt.select("key", "h", "n", "root", "bits", "c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o"))
    tiles = dealt.select(F.xxhash64("key", F.least("c", "o"), F.greatest("c", "o")).alias("tile"), (F.col("c") != F.col("o")).alias("two"), "c", "h", "n", "root", "bits")

    def solved(part: pa.Table) -> pa.RecordBatch:
        h, n, root, c = (part[x].to_numpy() for x in ("h", "n", "root", "c"))
        bits = part["bits"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(h), -1)
        i, j = close(bits, n, root, c if part["two"][0].as_py() else None)
        columns = [np.minimum(h[i], h[j]), np.maximum(h[i], h[j]), np.minimum(n[i], n[j])]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            tile = table["tile"].to_numpy()
            cuts = np.flatnonzero(tile[1:] != tile[:-1]) + 1
            for lo, hi in zip(np.append(0, cuts), cuts):
                yield solved(table.slice(lo, hi - lo))
            held = table.slice(cuts[-1] if len(cuts) else 0).to_batches()
        if held:
            yield solved(pa.Table.from_batches(held))

    parts = store.shuffle_partitions(rooted.sparkSession)
    return tiles.repartition(parts, "tile").sortWithinPartitions("tile", "h").mapInArrow(run, "a long, b long, n long")


def _every(rooted: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pairs (a, b) of all open keys (sizes: key, k) that share as many of them as sets alike do."""
    few = rooted.join(sizes.where(F.col("k") <= CROWDED).select("key"), "key")
    found = _met(few, few, True).unionByName(_tiled(rooted, sizes.where(F.col("k") > CROWDED)))
    shared = found.groupBy("a", "b").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    return shared.where(F.col("c") >= 1 + F.floor(F.col("n") / 10)).select("a", "b")


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, th and root of every row of docs (doc_id, text, th, a hash of text); rows of one component have one root.

    Rows are linked if their sets are equal or alike, those without words among
    themselves. Equal sets are one node, SimHash links those of near fingerprints,
    the prefix filter finds what is left, and pairs that a chain of verified
    pairs already joins are left out, so a large group of copies costs about
    as many comparisons as it has members.
    """
    prints = store.table(_prints(docs), "near-prints")
    nodes = store.table(prints.groupBy("h").agg(F.min("th").alias("t"), F.first("n").alias("n"), F.first("need").alias("need"), F.first("keys").alias("keys"), F.first("bits").alias("bits"), F.first("fp").alias("fp")), "near-nodes")
    rows = store.table(prints.select("doc_id", "th", "h"), "near-rows")
    keys = nodes.select("h", "n", "need", F.explode("keys").alias("key"))
    crowded = store.table(keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "near-keys")
    shared = store.table(keys.join(crowded, "key"), "near-shared")
    able = store.table(shared.groupBy("h").agg(F.count("*").alias("c"), F.first("need").alias("need")).where("c >= need").select("h").join(nodes.select("h", "bits", "fp"), "h"), "near-able")
    members = store.table(shared.join(able.drop("fp"), "h").select("key", "h", "n", "bits"), "near-members")
    # one text of each set that may be alike another
    chosen = store.table(nodes.select("h", "t").join(able.select("h"), "h"), "near-chosen")
    for gone in (prints, nodes, crowded, shared):
        store.drop(gone)
    texts = docs.select("th", "text").join(chosen, F.col("th") == F.col("t")).dropDuplicates(["th"]).select("h", "text")
    sets = store.table(_sets(texts), "near-sets")
    total = members.count()
    # sets that cannot be alike any other by their prefixes need no SimHash link either
    pairs = store.table(simhash_pairs(able.select("h", "fp")), "near-simhash-pairs")
    edges, last = store.table(_verified(pairs, sets), "near-edges"), None
    for gone in (pairs, able):
        store.drop(gone)
    roots = store.table(components(edges), "near-roots")
    for turn in range(ROUNDS + 1):
        rooted = members.join(roots, members.h == roots.node, "left").select("key", "h", "n", "bits", F.coalesce("root", "h").alias("root"))
        # keys whose members are joined are done
        sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("k"), F.sum(F.col("c") * F.col("c")).alias("s"), F.count("*").alias("m"))
        open_keys = store.table(sizes.where("m > 1"), "near-open")
        left = open_keys.agg(F.sum((F.col("k") * F.col("k") - F.col("s")) / 2)).first()[0] or 0
        if not left:
            break
        rooted = store.table(rooted.join(open_keys.select("key"), "key").select("key", "h", "n", "bits", "root"), "near-rooted")
        final = turn == ROUNDS or (turn > 0 and (left <= FEW * total or left == last))
        if final:
            pairs = _every(rooted, open_keys.select("key", "k"))
        else:
            pivots = rooted.groupBy("key").agg(F.min_by(F.struct("h", "n", "root"), F.xxhash64("h", F.lit(turn))).alias("p")).select("key", "p.*")
            pairs = _met(pivots, rooted).select("a", "b").distinct()
        pairs = store.table(pairs, "near-pairs")
        new = store.table(_verified(pairs, sets), "near-edges")
        for gone in (open_keys, rooted, pairs):
            store.drop(gone)
        edges = edges.unionByName(new)
        roots = store.table(components(edges), "near-roots")
        if final:
            break
        last = left
    for gone in (members, sets, chosen):
        store.drop(gone)
    return rows.join(roots, rows.h == roots.node, "left").select("doc_id", "th", F.coalesce("root", "h").alias("root"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Docs without near copies: of each component the row with the smallest doc_id stays.

    Null ids come after all others, so a row with one stays only where the
    whole component has none; of rows with the same id the one with the
    smallest text stays (a null text before all others), then the one whose
    other columns are smallest. Rows of different components never replace
    each other, whatever their ids. An empty table gives an empty table.
    """
    others = [c for c in docs.columns if c != "text"]
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    roots = store.table(linked(hashed), "near-rooted-rows")
    lows = roots.groupBy("root").agg(F.min("doc_id").alias("low"))
    kept = roots.join(lows, "root").where("doc_id <=> low").select(F.col("doc_id").alias("__id"), F.col("th").alias("__t"), F.col("root").alias("__root")).distinct()
    rows = docs.select("*", F.xxhash64("text").alias("__th")).join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__t")))
    return rows.groupBy("__root").agg(F.min(F.struct("text", *others)).alias("r")).select(*(F.col(f"r.{c}").alias(c) for c in docs.columns))

import random
import re

import numpy as np
import xxhash

from tempograph.llm.simhash import close_pairs, dedup_documents, near_duplicates
from tempograph.llm.xxh64 import xxh64


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def plain_fingerprint(text):
    w = words(text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in fps}


def test_xxh64_equals_the_library_at_every_length():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = rng.integers(0, 3000, 900)
    ends = starts + np.concatenate([np.arange(600), rng.integers(0, 40, 300)])
    assert [int(x) for x in xxh64(data, starts, ends)] == [xxhash.xxh64_intdigest(data[a:b].tobytes(), 42) for a, b in zip(starts, ends)]


def test_close_pairs_equal_brute_force():
    rng = random.Random(3)
    for radius in (0, 1, 2):
        values, group = [], []
        for g in range(9):
            centre = rng.getrandbits(64)
            for _ in range(rng.choice([1, 2, 70, 150])):
                v = centre
                for _ in range(rng.randint(0, 3)):
                    v ^= 1 << rng.randrange(64)
                values.append(v)
                group.append(g)
        i, j = close_pairs(np.array(values, np.uint64), np.array(group), radius)
        want = {(a, b) for a in range(len(values)) for b in range(a + 1, len(values)) if group[a] == group[b] and bin(values[a] ^ values[b]).count("1") <= radius}
        assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


def edited(text, rng):
    w = text.split(" ")
    w[rng.randrange(len(w))] = f"x{rng.random()}"
    return " ".join(w)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("alpha beta gamma delta Eps zeta".split()) + str(rng.randrange(400)) for _ in range(500)) for _ in range(4)]
    texts = [None, "", " \t\n", "one", "One two", "one  two", "one two three", "é ü x ﬁ", *base, *base, "a " * 900]
    texts += [edited(rng.choice(base), rng) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    found = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    fps = {i: plain_fingerprint(t) for i, t in rows}
    assert {i: r.fp % (1 << 64) for i, r in found.items()} == fps
    assert {i: r.component_id for i, r in found.items()} == plain_components(fps)


def test_crowded_keys_are_tiled_without_losing_links(spark, monkeypatch):
    from tempograph.llm import simhash

    monkeypatch.setattr(simhash, "TILE", 8)
    rng = random.Random(7)
    base = " ".join(f"w{rng.randrange(900)}" for _ in range(400))
    rows = [(i, edited(base, rng)) for i in range(80)]
    fps = {i: plain_fingerprint(t) for i, t in rows}
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == plain_components(fps)


def test_nulls_repeats_and_extra_columns(spark):
    docs = spark.createDataFrame([(None, "p q r", "x"), (4, "p q r", "y"), (4, "p q r", "y"), (2, None, "z"), (1, "", "z")], "doc_id long, text string, fp string")
    found = sorted((str(r.doc_id), r.component_id) for r in near_duplicates(docs).collect())
    assert found == [("1", 1), ("2", 1), ("4", 4), ("4", 4), ("None", 4)]
    kept = dedup_documents(docs.withColumnRenamed("fp", "component_id")).collect()
    assert sorted(r.doc_id for r in kept) == [1, 4]
    empty = docs.where("false")
    assert near_duplicates(empty).count() == 0 and dedup_documents(empty).count() == 0

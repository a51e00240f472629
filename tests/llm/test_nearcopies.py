import random

import numpy as np

from tempograph.llm import nearcopies
from tempograph.llm.simhash import dedup_documents
from tests.llm.test_simhash import words


def plain_sets(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_kept(rows):
    sets = [plain_sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    order = lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")
    return sorted((min(g, key=order) for g in groups.values()), key=str)


def kept(spark, rows):
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string").repartition(5)
    found = dedup_documents(frame)
    assert found.columns == frame.columns
    return sorted(((r.doc_id, r.text) for r in found.collect()), key=str)


def test_kept_rows_equal_brute_force(spark):
    rng = random.Random(31)
    say = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    common, rows = say(30), [(900, None), (901, ""), (902, " \t"), (903, "one two"), (904, "One  two")]
    for g in range(25):
        base = say(rng.choice([3, 5, 6, 12, 60, 200, 400])) + (common if g % 3 == 0 else [])
        for c in range(rng.randrange(1, 8)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = f"x{rng.random()}"
            rows.append((rng.randrange(10**6), " ".join(w)))
    want = plain_kept(rows)
    assert kept(spark, rows) == want and 25 < len(want) < len(rows)


def test_near_copies_beyond_two_bits_go(spark):
    rng = random.Random(32)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(i, " ".join(w if j not in (20 + 40 * i, 35 + 40 * i, 27 + 40 * i) else f"y{i}" for j, w in enumerate(base))) for i in range(4)]
    assert kept(spark, rows) == rows[:1]


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(33)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"z{rng.random()}"
        rows.append((i, " ".join(w)))
    assert kept(spark, rows) == plain_kept(rows)


def test_tiles_lose_no_pair(spark, monkeypatch):
    """Every key in tiles of few members gives what brute force does."""
    monkeypatch.setattr(nearcopies, "CROWDED", 1)
    monkeypatch.setattr(nearcopies, "TILE", 3)
    rng = random.Random(34)
    base = [f"w{rng.randrange(10**6)}" for _ in range(90)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"z{rng.random()}"
        rows.append((i, " ".join(w[: rng.choice([20, 60, 90])])))
    assert kept(spark, rows) == plain_kept(rows)


def test_bitmaps_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 1 << 9, rng.integers(0, 300)).astype(np.uint64)) for _ in range(2))
        bits = np.stack([nearcopies.bitmap(x).view(np.uint64) for x in (a, b)])
        far = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
        assert far <= len(np.setxor1d(a, b))
        i, _ = nearcopies.close(bits, np.array([len(a), len(b)]), np.array([0, 1]), None)
        both = len(np.intersect1d(a, b))
        assert len(i) or 5 * both < 4 * (len(a) + len(b) - both)


def test_null_and_repeated_ids_do_not_join_components(spark):
    say = lambda k: " ".join(f"{k}{i}" for i in range(20))
    rows = [(None, say("a")), (None, say("b")), (None, say("b")), (None, say("c")), (7, say("d")), (7, say("e")), (3, say("e")), (None, say("d"))]
    assert kept(spark, rows) == sorted([(None, say("a")), (None, say("b")), (None, say("c")), (7, say("d")), (3, say("e"))], key=str)


def test_simhash_links_first(spark, monkeypatch):
    """Copies within two bits are joined by SimHash alone; the links are those of brute force."""
    rng = random.Random(35)
    base = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    sets = [np.unique(np.array([hash(" ".join(w[i : i + 5])) % (1 << 62) for i in range(596)], np.uint64)) for w in ([*base[:k], "y", *base[k + 1 :]] for k in range(0, 600, 15))]
    fps = [nearcopies.fingerprint(g) for g in sets]
    pairs = nearcopies.simhash_pairs(spark.createDataFrame(list(enumerate(fps)), "h long, fp long")).collect()
    near = {(i, j) for i in range(len(fps)) for j in range(i) if bin((fps[i] ^ fps[j]) % (1 << 64)).count("1") <= 2}

    def roots(edges):
        root = list(range(len(fps)))
        for _ in fps:
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert roots([(p.a, p.b) for p in pairs]) == roots(near) and near

    monkeypatch.setattr(nearcopies, "_every", lambda rooted, sizes: rooted.where("false").selectExpr("h a", "h b"))
    monkeypatch.setattr(nearcopies, "_met", lambda left, right, once=False: right.where("false").selectExpr("h a", "h b", "n"))
    same = " ".join(base)
    assert kept(spark, [(1, same), (2, same + " " + base[0] + " " + " ".join(base[:5])), (3, "other words stay here as they are")])[0] == (1, same)
    copies = [(i, " ".join([*base, *base[: 5 + i]])) for i in range(12)]
    assert len(kept(spark, copies)) < 12


def test_pipeline_bounds_batches(spark):
    from tempograph.llm import store

    before = spark.conf.get(store.MOST)
    store.small_batches(spark)
    assert int(spark.conf.get(store.MOST).removesuffix("b")) == store.BATCH_BYTES
    spark.conf.set(store.MOST, before)

import hashlib
import random
import re

import xxhash

from tempograph.llm import winnow
from tempograph.llm.winnow import K, PIECE, W, edits, fingerprints


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_choices(text):
    words = [xxhash.xxh64_intdigest(p.encode(), 42) for p in re.findall(r"[^ \t\n\x0b\f\r]{1,%d}" % PIECE, text)]

    def fold(values):
        h = 42
        for v in values:
            h = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), h)
        return h

    three = lambda a, b, c: fold([fold([a, b]), c])
    grams = [three(*words[i : i + K]) for i in range(len(words) - K + 1)] if len(words) >= K else [fold(words)] * bool(words)
    out = []
    for s in range(max(1, len(grams) - W + 1)) if grams else []:
        # lowest hash, rightmost on ties
        h, p = min((signed(g) >> 24, -i) for i, g in enumerate(grams) if s <= i < s + W)
        if (h, -p) not in out:
            out.append((h, -p))
    return out


def plain(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        prints = [plain_choices(t) for t in (text, edited, after)]
        say = lambda c: "".join(f"{(h << 24 | p) % (1 << 64):016x}" for h, p in c)
        sets = [{h for h, _ in c} for c in prints]
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), say(prints[0]), say(prints[1]), like(sets[0], sets[1]), like(sets[0], sets[2])))
    return sorted(out, key=str)


def case(n):
    rng = random.Random(n)
    say = lambda k: " ".join(rng.choice("the of and é 🙂x to in it".split()) + rng.choice(["", "", "n\n", "ly"]) for _ in range(k))
    rows = [(rng.choice([1, -1]) * i * 7, say(rng.choice([0, 1, 4, 5, 19, 20, 21, 60, 200]))) for i in range(n)]
    return rows + [(None, "null id"), (10**15, None), (10**15, ""), (3, "a a a " * 40), (3, "a a a " * 40), (3, "zz b"), (5, "x" * 500), (6, "  \n\t ")]


def test_edits_equal_brute_force(spark, monkeypatch):
    for ranges in (1, 7, 50):
        monkeypatch.setattr(winnow, "RANGE_ROWS", ranges)
        rows = case(60)
        frame = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, n_chars string, near_next double").repartition(5)
        assert sorted(map(tuple, edits(frame).collect()), key=str) == plain(rows)


def test_small_tables(spark):
    one = spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")
    assert sorted(map(tuple, edits(one).collect())) == plain([(1, "one two three four five six")])
    assert edits(one.where("false")).count() == 0 and fingerprints(one.where("false")).count() == 0
    none = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted(map(tuple, edits(none).collect()), key=str) == plain([(None, "a b"), (None, None)])


def test_a_shared_passage_is_always_found(spark):
    rng = random.Random(9)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = []
    for i in range(30):
        passage = say(W + K - 1)
        rows += [(2 * i, f"{say(rng.randrange(50))} {passage} {say(rng.randrange(50))}"), (2 * i + 1, f"{say(rng.randrange(50))} {passage} {say(rng.randrange(50))}")]
    found = {r.doc_id: {c >> 24 for c in r.choices} for r in fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[2 * i] & found[2 * i + 1] for i in range(30))


def test_short_texts_stay_near_their_edited_texts(spark):
    rng = random.Random(10)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(12, 30)))) for i in range(60)]
    found = edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.near_edited > 0.1 for r in found) and all(r.near_next == 0 for r in found)


def test_a_very_long_text(spark):
    text = "word " * 50_000 + " ".join(f"w{i}" for i in range(100_000))
    rows = [(1, text), (2, "x " + text)]
    found = {r.doc_id: r for r in edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].n_chars == len(text) and found[2].near_next > 0.99

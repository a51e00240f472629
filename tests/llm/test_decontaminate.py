import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from tempograph.llm import decontaminate
from tempograph.llm.decontaminate import contamination, remove_contaminated
from tempograph.llm.fmindex import FMIndex, suffix_array


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def plain(docs, items):
    out = []
    for i, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, t in items:
            q = words(t)
            k = min(13, len(q))
            for s in range(len(q) - k + 1) if q else []:
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == q[s : s + k]:
                        hit.update(range(p, p + k))
                        ids.add(str(item))
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(ids), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_suffix_array_and_search_equal_brute_force():
    rng = np.random.default_rng(1)
    for top, n in ((1, 40), (2, 200), (5, 500), (40, 300)):
        s = rng.integers(0, top + 1, n)
        s[-1] = 0
        distinct = [(-(10**6) + i if v == 0 else v) for i, v in enumerate(s.tolist())]
        assert suffix_array(s).tolist() == sorted(range(n), key=lambda i: distinct[i:])
        index = FMIndex(s, top)
        for k in (1, 2, 3, 7):
            phrases = [rng.integers(1, top + 1, k) for _ in range(30)]
            phrases += [s[i : i + k] for i in range(n - k) if (s[i : i + k] > 0).all()][:40]
            matrix = np.zeros((len(phrases), 9), np.int64)
            for r, p in enumerate(phrases):
                matrix[r, 9 - k :] = p
            lo, hi = index.search(matrix, np.full(len(phrases), k))
            for p, a, b in zip(phrases, lo, hi):
                assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(n - k + 1) if (s[i : i + k] == p).all()]


def case():
    rng = random.Random(4)
    vocabulary = "the of and Run réd 42 x".split()
    say = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", "-z"]) for _ in range(n))
    items = [(i, say(rng.choice([5, 13, 14, 20, 60]))) for i in range(12)] + [(90, None), (91, ""), (92, "..."), (10, "two words"), (10, "two words"), (93, "solo")]
    docs = [(i, say(rng.randrange(300))) for i in range(40)]
    docs += [(100 + i, say(40) + " " + items[i][1] + " " + say(i * 60)) for i in range(12)]
    docs += [(200, None), (201, ""), (202, "two  WORDS"), (202, "two  WORDS"), (203, "a solo b"), (204, "solo"), (None, "two words")]
    return docs, items


def test_contamination_equals_brute_force(spark, monkeypatch):
    docs, items = case()
    frame = spark.createDataFrame([(*d, "x", True) for d in docs], "doc_id long, text string, n_hit string, spans boolean").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = plain(docs, items)
    assert sorted(map(tuple, contamination(frame, bench).select(*columns).collect()), key=str) == want
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 100)
    assert sorted(map(tuple, contamination(frame, bench).select(*columns).collect()), key=str) == want
    kept = remove_contaminated(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(w[0]) for w in want if not w[5])


def test_empty_tables(spark):
    docs, items = case()
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert contamination(frame.where("false"), bench).count() == 0
    assert contamination(frame, bench.where("false")).where("n_hit > 0 or n_items > 0 or contaminated").count() == 0


def test_a_long_text_is_searched_whole():
    item = " ".join(f"w{i}" for i in range(13))
    text = "w1 w2 " * 200_000 + item + " w3" * 100_000
    phrases = decontaminate.Phrases([1], [item])
    (words_,) = decontaminate.split_words(pa.array([text]), decontaminate.ALNUM, lower=True)
    hit, found = decontaminate.find(words_, phrases)
    assert np.flatnonzero(hit).tolist() == list(range(400_000, 400_013)) and found == [{0}]


def test_regular_words_are_not_confused():
    bits = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    text, other = bits, bits.translate(str.maketrans("ab", "ba"))
    phrases = decontaminate.Phrases([1, 2], [text, "solo " * 14])
    (words_,) = decontaminate.split_words(pa.array([f"x {other} y"]), decontaminate.ALNUM, lower=True)
    hit, found = decontaminate.find(words_, phrases)
    assert not hit.any() and found == [set()] and sorted(phrases.items(range(len(phrases.matrix)))) == ["1", "2"]

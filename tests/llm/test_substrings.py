import random
import re
from collections import Counter

from tempograph.llm import substrings
from tempograph.llm.substrings import WindowIndex, remove_repeats


def plain(rows):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    out = []
    for (i, _), w in zip(rows, split):
        gone = {j for s in range(len(w) - 34) if seen[tuple(w[s : s + 35])] > 1 for j in range(s, s + 35)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def case():
    rng = random.Random(6)
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage = say(70)
    rows = [(None, "null id here"), (1, None), (2, ""), (3, " \n\t "), (4, "short text"), (4, "short text")]
    for i in range(10, 40):
        a = rng.randrange(0, 30)
        part = passage[a : a + rng.choice([30, 34, 35, 36, 60])]
        rows.append((i, "  ".join(say(rng.randrange(80)) + part + say(rng.randrange(80)))))
    copy = " ".join(say(300))
    rows += [(50, copy), (51, copy), (51, copy), (None, copy), (52, copy.replace(" ", "\n")), (53, " ".join(["a"] * 90)), (54, " ".join(["b", "é"] * 60)), (55, " ".join(say(40) * 2)), (56, " ".join(["c"] * 35))]
    return rows


def test_removed_words_equal_brute_force(spark):
    rows = case()
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string").repartition(4)
    found = sorted(map(tuple, remove_repeats(frame).select("doc_id", "n_words", "n_removed", "kept_text").collect()), key=str)
    assert found == plain(rows)


def test_chunks_and_batches_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BATCHES", 5)
    rows = case()
    found = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found), key=str) == plain(rows)


def test_index_finds_merges_and_goes_on(spark, tmp_path):
    folder = f"{tmp_path}/index"
    index, rng, total = WindowIndex(spark, folder), random.Random(1), Counter()
    for k in range(5):
        batch = [rng.randrange(40) for _ in range(12)]
        before, now = dict(total), Counter(batch)
        total.update(batch)
        found = index.add(spark.createDataFrame([(b,) for b in batch], "print long"))
        assert {r.print for r in found.collect()} == {p for p in now if now[p] > 1 or p in before}
        if k == 2:  # another session goes on from what was saved
            index.save()
            index = WindowIndex.open(spark, folder)
    assert [level for level, _ in index.runs] == [2, 0]
    assert {r.print: r.n for r in index.compact().collect()} == dict(total)


def test_very_long_texts(spark):
    words = [f"w{i * 7919 % 100_003}" for i in range(120_000)]
    rows = [(1, " ".join(words)), (2, "x " + " ".join(words[50_000:50_060]) + " y"), (3, "z " * 50_000)]
    found = {r.doc_id: (r.n_words, r.n_removed) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    again = 120_000 - 100_003
    assert found[2] == (62, 60) and found[3] == (50_000, 50_000) and found[1] == (120_000, 2 * again + 60)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0

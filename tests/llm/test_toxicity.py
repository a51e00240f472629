import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tempograph.llm import toxicity
from tempograph.llm.toxicity import Model, fit, held_out, passages, scored, subwords, train
from tempograph.llm.words import SPACED, split_words


def corpus(n, seed):
    rng = random.Random(seed)
    letters = "bcdfghklmnprstvz"
    plain = ["".join(rng.choice(letters) + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(400)]
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 300))]
        bad = i % 4 == 0
        if bad:
            for _ in range(1 + len(words) // 40):
                words.insert(rng.randrange(len(words)), rng.choice(["xqual", "wyrj"]) + rng.choice(plain))
        texts.append(" ".join(words))
        labels.append(int(bad))
    return texts, np.array(labels)


def test_subwords_are_all_grams_of_the_bracketed_word():
    (words,) = split_words(pa.array(["ab é abc"]), SPACED)
    buckets, counts = subwords(words, np.arange(3))
    of = lambda w: sum(max(0, len(w.encode()) + 2 - n + 1) for n in toxicity.GRAMS) + 1
    assert counts.tolist() == [of("ab"), of("é"), of("abc")] and len(buckets) == counts.sum()
    (again,) = split_words(pa.array(["x ab"]), SPACED)
    other, _ = subwords(again, np.array([1]))
    assert sorted(other) == sorted(buckets[: counts[0]])


def test_passages_cover_every_word():
    for n in (0, 1, 127, 128, 129, 192, 193, 1000):
        (words,) = split_words(pa.array([" ".join("w" * n) or " "]), SPACED)
        start, row = passages(words, toxicity.PASSAGE // 2)
        covered = {j for s in start for j in range(s, min(s + toxicity.PASSAGE, n))}
        assert covered == set(range(n)) and (row == 0).all() and bool(len(start)) == bool(n)


def test_unseen_spellings_score_by_their_subwords():
    texts, y = corpus(600, 1)
    model = fit(pa.array(texts), y, float(y.mean()))
    texts, y = corpus(400, 2)
    got = model.score(pa.array(texts)) >= 0.3
    assert (got == (y == 1)).mean() > 0.95
    long = " ".join(["bala"] * 4000 + ["xqualtezo", "wyrjbibo"] + ["bala"] * 4000)
    assert model.score(pa.array([long]))[0] > model.score(pa.array(["bala " * 8000]))[0]


def test_scores_equal_brute_force():
    texts, y = corpus(300, 5)
    model = fit(pa.array(texts), y, 0.2)
    texts = [t.upper() if i % 5 == 0 else t for i, t in enumerate(corpus(60, 6)[0])] + ["", " \n", None, "é 東京 " * 90, "one"]

    def weight(word):
        (words,) = split_words(pa.array([word]), SPACED)
        return float(np.mean(model.weights[subwords(words, np.arange(1))[0]].astype(float)))

    for text, got in zip(texts, model.score(pa.array(texts, pa.string()))):
        w = [weight(x) for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()]
        starts = range(0, max(1, len(w) - toxicity.PASSAGE + toxicity.PASSAGE // 2), toxicity.PASSAGE // 2)
        best = max(np.mean(w[s : s + toxicity.PASSAGE]) for s in starts) if w else 0.0
        assert abs(got - 1 / (1 + np.exp(-(model.bias + best)))) < 1e-9


def test_scores_of_odd_rows(spark):
    texts, y = corpus(120, 3)
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "null id", "x"), (500, None, "x"), (501, "", "x"), (501, "", "x"), (502, " \n", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = train(docs, labels, ~held_out(4, 2))
    found = scored(docs, model).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    blank = {r.score for r in found if not (r.text or "").strip()}
    assert len(blank) == 1
    assert scored(docs.where("false"), model).count() == 0
    none = train(docs, labels.where("false"), F.lit(True))
    assert len({r.score for r in scored(docs, none).collect()}) == 1


def test_learning_is_restricted_to_the_fold(spark):
    texts, y = corpus(80, 4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = [(i, int(v)) for i, v in enumerate(y)]
    fold = {r.doc_id for r in docs.where(held_out(4, 2)).collect()}
    flipped = [(i, 1 - v if i in fold else v) for i, v in labels]
    a, b = (train(docs, spark.createDataFrame(x, "doc_id long, toxic int"), ~held_out(4, 2)) for x in (labels, flipped))
    assert isinstance(a, Model) and fold and (a.weights == b.weights).all() and a.bias == b.bias

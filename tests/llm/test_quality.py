import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tempograph.llm import quality
from tempograph.llm.quality import fit, keep_good, terms, train
from tempograph.llm.toxicity import held_out, scored
from tempograph.llm.words import split_words


def corpus(n, seed):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("aeioubcdfgl") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(3, 200))]
        if i % 5 == 0:
            words = [w.upper() + "!!" for w in words] if i % 2 else [w for w in words for _ in range(12)]
        texts.append(" ".join(words))
        labels.append(int(i % 5 != 0))
    return texts, np.array(labels)


def test_terms_are_shapes_words_and_repeats():
    (words,) = split_words(pa.array(["Ab abc ABC abc abc 12-x é", "abc abc"]))
    at, term = terms(words)
    shape = {i: t for i, t in zip(at, term) if 0 < t < quality.SHAPES}
    assert shape[1] == shape[3] == shape[4] == shape[6] and shape[0] != shape[2] != shape[1] != shape[5]
    assert sorted(at[term == 0]) == [2, 3, 4, 8]


def test_scores_equal_brute_force_votes():
    texts, y = corpus(200, 1)
    model = fit(pa.array(texts), y, 0.8)
    other = pa.array(corpus(50, 2)[0] + ["", None, " \n"])
    got, vectors = model.score(other), model.embed(other)
    for i in range(len(other)):
        cosine = [float(vectors[i] @ v) for v in model.vectors]
        near = sorted(range(len(cosine)), key=lambda j: -cosine[j])[: quality.NEIGHBOURS]
        weight = [max(cosine[j], 0) ** 4 * model.votes[j] for j in near]
        want = sum(w * model.labels[j] for w, j in zip(weight, near)) / sum(weight) if sum(weight) else 0.8
        assert abs(got[i] - want) < 1e-3


def test_held_out_accuracy_and_odd_rows(spark):
    texts, y = corpus(400, 3)
    rows = [(i, t, 1.5) for i, t in enumerate(texts)] + [(None, "null id", 1.5), (900, None, 1.5), (901, "", 1.5), (901, "", 1.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)] + [(None, 0), (5, None)], "doc_id long, quality int")
    model = train(docs, labels, ~held_out(5, 0))
    found = scored(docs, model).withColumn("held", held_out(5, 0)).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held and r.doc_id < 400]
    assert held and np.mean([(r.score >= 0.3) == (y[r.doc_id] == 1) for r in held]) > 0.95
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in found if r.score >= 0.3)
    assert keep_good(docs.where("false"), labels).count() == 0
    assert {r.score for r in scored(docs, train(docs, labels.where("false"), F.lit(True))).collect()} == {0.5}

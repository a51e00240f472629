import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tempograph.llm.bpe import public_ranks, round_trip, tokenize, vocabulary

TEXTS = [
    None, "", " ", "\n\n  \t x", "Hello, world's 123  tests!", "naïve façade Ünïcode — “quotes” 東京タワー 🙂👩‍👩‍👧   z",
    "a" * 700, "ab" * 900 + "c", "=" * 1000 + " " * 999, "x\x1cy\x1d \x85z", "it'll we've I'M 'tis", "é" * 30, "ÄÖß" * 200, "\r\n" * 50 + "end ",
]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n):
    rng = random.Random(2)
    alphabet = "etaoin shrdlu\n.,'12 éßñ東🙂‍̀" + "abcdefgh" * 2
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(400))) for _ in range(n)]


def test_same_ids_as_the_library(spark, library):
    texts = TEXTS + random_texts(200) + ["x" * 10]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    found = {r.doc_id: list(r.ids) for r in tokenize(docs, *public_ranks(), ["doc_id"]).collect()}
    assert found == {i: library.encode_ordinary(t or "") for i, t, _ in rows}


def test_very_long_pre_tokens(library):
    voc = vocabulary(*public_ranks())
    rng = random.Random(5)
    letters = "".join(rng.choice("etaoinshrdlu") for _ in range(200_000))
    for text in (letters, "東京都" * 20_000, "ab" * 50_000 + "b" * 50_001, "".join(rng.choice("ñéßü") for _ in range(30_000)), "=" * 100_000):
        ids = voc.merge_long(voc.byte_id[np.frombuffer(text.encode(), np.uint8)])
        assert ids.tolist() == library.encode_ordinary(text)
    short = [letters[i : i + n] for n in range(2, 256, 7) for i in range(0, 3000, 300)]
    assert all(voc.merge([t])[t] == voc.merge_long(voc.byte_id[np.frombuffer(t.encode(), np.uint8)]).astype("<u4").tobytes() for t in short if t.encode() not in voc.ranks)
    began = time.time()
    voc.merge_long(voc.byte_id[np.frombuffer((letters * 5).encode(), np.uint8)])
    assert time.time() - began < 30


def test_every_code_point_is_split_as_the_library_does(library):
    voc = vocabulary(*public_ranks())
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}1 {chr(c)} " for c in points[i : i + 4000]) for i in range(0, len(points), 4000)]
    different = [i for i, (t, ids) in enumerate(zip(texts, voc.encode(texts))) if np.frombuffer(ids, "<u4").tolist() != library.encode_ordinary(t)]
    assert not different


def test_round_trip_digests(spark, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (3, "repeated"), (3, "repeated")]
    found = sorted(map(tuple, round_trip(spark.createDataFrame(rows, "doc_id long, text string"), *public_ranks(), ["doc_id"]).collect()), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    assert found == sorted(want, key=str)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert round_trip(empty, *public_ranks(), ["doc_id"]).count() == 0

import hashlib
import random

import base64

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from tempograph.llm import quality
from tests.llm import test_decontaminate, test_lines, test_nearcopies


def fixture():
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(20)) for i in range(5)]
    common = [say(9) for _ in range(4)]
    docs = []
    for i in range(120):
        parts = [say(rng.randrange(1, 25)) for _ in range(rng.randrange(1, 6))]
        if i % 6 == 0:
            parts = [" ".join(w.upper() + "$$$" for w in p.split()) for p in parts]
        if i % 5 == 1:
            parts.insert(rng.randrange(len(parts)), rng.choice(common))
        if i % 11 == 3:
            parts.append(rng.choice(items)[1])
        docs.append((i, "\n".join(parts), "en", f"s{i % 3}", 0))
    docs += [(200 + i, docs[i * 7 + 1][1], "en", "copy", 0) for i in range(8)]
    docs += [(220 + i, f"{docs[i * 7 + 2][1]} {say(1)}", "en", "near copy", 0) for i in range(8)] + [(300, "", "en", "s", 0), (301, None, None, None, None)]
    labels = [(i, 0 if i % 6 == 0 else 1, 0) for i in range(0, 120)]
    return docs, labels, items


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    docs, labels, items = fixture()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = sorted((r.doc_id, r.source or "", r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = {r.doc_id for r in quality.keep_good(frame, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    assert not {i for i in good if i < 120 and i % 6 == 0} and good >= {i for i in range(120) if i % 6}
    rows = [(i, t) for i, t, *_ in docs if i in good]
    rows = [(i, t) for i, t, *_ in test_lines.plain(rows)]
    before, rows = len(rows), test_nearcopies.plain_kept(rows)
    assert len(rows) < before
    clean = {r[0] for r in test_decontaminate.plain(rows, items) if not r[5]}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    source = {i: s or "" for i, _, _, s, _ in docs}
    want = []
    for i, t in rows:
        if i in clean:
            ids = library.encode_ordinary(t or "")
            want.append((i, source[i], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert found == sorted(want) and len(want) < len(rows) < len(docs)


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    docs, labels, items = fixture()
    empty = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").where("false")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.dtypes == empty.dtypes and out.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

"""Duplicate queries: a document's words stand in for spectral frames.

A word is a frame (its place the time, a digest of it the bin, its length the
magnitude); words longer than mean + 0.8 deviations are the peaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograph.operators import fingerprint as fp
from tempograph.session import spread, table

THRESHOLD = 0.35
#: Values of a frame, and the distance at which an advisory finding is made, of the stand-in for harmony.
WIDTH, ADVISORY = 4, 0.6


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sha, class_id, n): documents with their content class, the smallest doc_id that has the content."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    sizes = docs.groupBy("sha").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n"))
    return docs.join(sizes, "sha")


def prints(docs: DataFrame, packed: bool = False) -> DataFrame:
    """(id, fp), or packed, of (doc_id, text)."""
    digest = lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 3), 16, 10).cast("int"), F.lit(fp.BINS))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    frames = spread(docs).select(F.col("doc_id").alias("id"), words.alias("w")).select("id", F.transform("w", digest).alias("f"), F.transform("w", lambda w: F.length(w)).alias("mag"))
    return fp.prints(frames, packed)


def _representatives(spark: SparkSession, sf_dir: str, sides: int = 1) -> tuple[DataFrame, DataFrame]:
    """Smallest doc_id of each content (and each side), and its packed fingerprint."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.pmod("doc_id", F.lit(sides)).alias("side"))
    reps = docs.withColumn("sha", F.sha2("text", 256)).groupBy("side", "sha").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    return reps, prints(docs.join(reps.select("doc_id"), "doc_id", "left_semi"), True)


def sha_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark, sf_dir).where("n > 1").select("doc_id", "class_id", "n")


def fp_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fp.rows(prints(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def fp_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions' scores of each pair of different contents that may reach the threshold and shares a hash."""
    _, found = _representatives(spark, sf_dir)
    both = F.array(F.struct("a", "b", F.col("ab").alias("score")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("ba").alias("score")))
    return fp.near_duplicates(found, THRESHOLD).select(F.explode(both).alias("p")).select("p.a", "p.b", F.round("p.score", 4).alias("score"))


def near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate pairs of content classes; class members are in sha_dedupe."""
    _, found = _representatives(spark, sf_dir)
    return fp.near_duplicates(found, THRESHOLD).select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), "similarity", "containment")


def ledger_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd documents are new, even ones are in the ledger; contents of a side stand for their copies.

    A document's vector, where it has one, stands for its harmony.
    """
    reps, found = _representatives(spark, sf_dir, 2)
    entries = reps.select(F.col("doc_id").alias("id"), "sha", (F.col("side") == 1).alias("is_new"))
    return fp.ledger_probe(entries, found, _harmony(spark, sf_dir, 16), advisory_at=ADVISORY, width=WIDTH)


def _harmony(spark: SparkSession, sf_dir: str, frames: int) -> DataFrame:
    """(id, seq, span): the first frames of WIDTH values of each vector, scaled to length 1, at one of two tempos."""
    norm = lambda k: F.sqrt(F.aggregate(F.slice("v", WIDTH * k + 1, WIDTH), F.lit(0.0), lambda s, x: s + x * x))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, WIDTH * frames), lambda x: x.cast("double")).alias("v"))
    scaled = vectors.select("id", "v", F.array(*(norm(k) for k in range(frames))).alias("n")).select("id", F.transform("v", lambda x, i: F.try_divide(x, F.get(F.col("n"), F.floor(i / WIDTH).cast("int")))).alias("seq"))
    return scaled.withColumn("span", F.when(F.pmod(F.floor(F.col("id") / 2), F.lit(2)) == 0, F.lit(80.0)).otherwise(88.0))


def rotation_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve frames of every hundredth vector against all vectors: 16 frames of four values."""
    queries = _harmony(spark, sf_dir, 12).where("id % 100 = 0")
    return fp.sequence_distances(queries, _harmony(spark, sf_dir, 16), WIDTH)


_PEAKS = """w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM {docs}),
x AS (SELECT doc_id, unnest(w) AS tok, unnest(range(len(w))) AS t FROM w),
pk AS (SELECT doc_id, t, ('0x' || substr(md5(tok), 1, 3))::INT % 512 AS f FROM (SELECT *, avg(length(tok)) OVER v + 0.8 * stddev_pop(length(tok)) OVER v AS floor FROM x WINDOW v AS (PARTITION BY doc_id)) WHERE length(tok) > floor),
fp AS (SELECT DISTINCT doc_id, ((f1 & 511) << 16) | (((f2 - f1 + 63) & 127) << 8) | ((u - t) & 63) AS h, t
       FROM (SELECT a.doc_id, a.t, b.t AS u, a.f AS f1, b.f AS f2, row_number() OVER (PARTITION BY a.doc_id, a.t ORDER BY b.t) AS rn
             FROM pk a JOIN pk b ON a.doc_id = b.doc_id AND b.t - a.t BETWEEN 1 AND 63 AND abs(b.f - a.f) <= 63) WHERE rn <= 3)"""
_SCORES = """m AS (SELECT DISTINCT p.doc_id AS a, q.doc_id AS b, q.t - p.t AS off, p.t AS anchor FROM fp p JOIN fp q ON p.h = q.h AND p.doc_id <> q.doc_id),
o AS (SELECT DISTINCT a, b, off FROM m),
c AS (SELECT e.a, e.b, e.off, count(DISTINCT e.anchor) AS n FROM (SELECT a, b, anchor, off + unnest([-1, 0, 1]) AS off FROM m) e JOIN o USING (a, b, off) GROUP BY ALL),
an AS (SELECT doc_id AS a, count(DISTINCT t) AS anchors, count(*) AS rows FROM fp GROUP BY 1),
s AS (SELECT a, b, greatest(0.0, least(1.0, (max(n) - CASE WHEN count(*) > 1 THEN (sum(n) - max(n)) / (count(*) - 1)::DOUBLE ELSE 0 END) / any_value(anchors))) AS score FROM c JOIN an USING (a) GROUP BY a, b),
z AS (SELECT x.a, x.b, round_even(greatest(x.score, y.score), 4) AS similarity, round_even(CASE WHEN l.rows <= r.rows THEN x.score ELSE y.score END, 4) AS containment
      FROM s x JOIN s y ON x.a = y.b AND x.b = y.a JOIN an l ON l.a = x.a JOIN an r ON r.a = x.b WHERE x.a < x.b)"""
_REPS = "(SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY coalesce(text, '')))"

_FRAMES = """e AS (SELECT vec_id AS id, CASE WHEN vec_id // 2 % 2 = 0 THEN 80 ELSE 88 END AS span, unnest(range(64)) // 4 AS j, unnest(range(64)) % 4 AS k, unnest(embedding)::DOUBLE AS x FROM embeddings),
f AS (SELECT id, span, j, k, x / sqrt(sum(x * x) OVER (PARTITION BY id, j)) AS x FROM e),
g AS (SELECT id, s AS against, m, unnest(range(m)) AS j FROM (SELECT DISTINCT id, s, CASE WHEN s = span THEN 16 ELSE round_even(16.0 * span / s, 0)::INT END AS m FROM f CROSS JOIN (VALUES (80), (88)) v(s))),
h AS (SELECT id, against, m, j, j * 15.0 / (m - 1) AS place, least(floor(j * 15.0 / (m - 1)), 15)::INT AS low FROM g),
i AS (SELECT h.id, against, m, h.j, a.k, CASE WHEN against = a.span THEN a.x ELSE a.x * (1 - (place - low)) + b.x * (place - low) END AS x
      FROM h JOIN f a ON a.id = h.id AND a.j = CASE WHEN against = a.span THEN h.j ELSE low END JOIN f b ON b.id = h.id AND b.k = a.k AND b.j = least(low + 1, 15)),
y AS (SELECT id, against, m, j, k, CASE WHEN m = 16 THEN x ELSE x / sqrt(sum(x * x) OVER (PARTITION BY id, against, j)) END AS x FROM i),
u AS (SELECT a.id AS q, y.id, turn, a.j - y.j AS lag, sum(a.x * y.x) AS s, any_value(least({n}, m)) AS short, count(*) AS c
      FROM f a CROSS JOIN (SELECT unnest(range(4)) AS turn) JOIN y ON y.against = a.span AND y.k = (a.k - turn + 4) % 4 WHERE a.j < {n} AND {pairs} GROUP BY ALL),
dist AS (SELECT q, id, round(greatest(least(1 - greatest(max(s / short), 0), 1.0), 0.0), 4) AS distance FROM u WHERE c = 4 * short GROUP BY q, id)"""

SQL = {
    "sha_dedupe": "SELECT doc_id, min(doc_id) OVER w AS class_id, count(*) OVER w AS n FROM documents WINDOW w AS (PARTITION BY sha256(coalesce(text, ''))) QUALIFY n > 1",
    "fp_pairs": f"WITH {_PEAKS.format(docs='documents')} SELECT doc_id, h, t FROM fp",
    "fp_align": f"WITH {_PEAKS.format(docs=_REPS)}, {_SCORES} SELECT s.a, s.b, round(s.score, 4) AS score FROM s JOIN z ON z.a = least(s.a, s.b) AND z.b = greatest(s.a, s.b) WHERE z.similarity >= 0.35",
    "near_dup": f"WITH {_PEAKS.format(docs=_REPS)}, {_SCORES} SELECT a AS doc_a, b AS doc_b, similarity, containment FROM z WHERE similarity >= 0.35",
    "ledger_probe": f"""WITH r AS (SELECT doc_id % 2 AS side, sha256(coalesce(text, '')) AS sha, min(doc_id) AS doc_id FROM documents GROUP BY ALL),
{_PEAKS.format(docs="(SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM r))")}, {_SCORES},
{_FRAMES.format(n=16, pairs="a.id % 2 = 1 AND y.id % 2 = 0 AND a.id IN (SELECT doc_id FROM r) AND y.id IN (SELECT doc_id FROM r)")},
same AS (SELECT n.doc_id AS id, e.doc_id AS entry FROM r n JOIN r e ON n.sha = e.sha AND n.side = 1 AND e.side = 0),
near AS (SELECT CASE WHEN a % 2 = 1 THEN a ELSE b END AS id, CASE WHEN a % 2 = 1 THEN b ELSE a END AS entry, similarity, containment FROM z WHERE a % 2 <> b % 2 AND (similarity >= 0.35 OR containment >= 0.35)),
found AS (SELECT id, entry, 'identical file' AS kind, 1.0::DOUBLE AS score FROM same
  UNION ALL SELECT id, entry, CASE WHEN similarity >= 0.35 THEN 'near-duplicate' ELSE 'one is inside the other' END, round_even(greatest(similarity, containment), 3) FROM near ANTI JOIN same USING (id, entry)),
every AS (SELECT * FROM found UNION ALL SELECT q, dist.id, 'similar harmony - worth a listen', round_even(1 - distance, 3) FROM dist WHERE distance <= {ADVISORY} AND (q, dist.id) NOT IN (SELECT (id, entry) FROM found))
SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, entry)::INT AS place FROM every""",
    "rotation_distance": f"WITH {_FRAMES.format(n=12, pairs='a.id % 100 = 0 AND a.id <> y.id')} SELECT * FROM dist",
}
QUERIES = {name: globals()[name] for name in SQL}

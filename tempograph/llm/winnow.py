"""Document fingerprints by winnowing, in built-in functions only.

Words (runs of non-space characters, longer ones in pieces) are hashed, K
consecutive word hashes make a gram, and of every W consecutive grams the
lowest hash is chosen, the rightmost on ties. A choice keeps its position, so
any passage of W + K - 1 words that two texts share gives a common choice, and
says where it stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One setting for all sizes: small enough that a text of ten words has several choices.
K, W = 3, 4
PIECE = 24
#: A choice is 40 bits of hash above 24 bits of position; positions go on modulo 2**24.
POSITION = (1 << 24) - 1
#: Ranges of doc_id in which neighbours are found; about so many rows each, and no more ranges than that.
RANGE_ROWS, MOST_RANGES = 128, 1 << 14


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once; inside a lambda a plain column expression would be computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def joined(a: Column, b: Column, ahead: int, op) -> Column:
    """op(a[i], b[i + ahead]) for each i; where b has ended, op of a[i] alone."""
    return F.zip_with(a, F.slice(b, ahead + 1, F.size(a)), lambda x, y: op(x, y))


def grams(text: Column) -> Column:
    """Hash of each K = 3 consecutive words: pairs, and the third word."""

    def of(words):
        threes = F.slice(bound(joined(words, words, 1, F.xxhash64), lambda twos: joined(twos, words, 2, F.xxhash64)), 1, F.size(words) - K + 1)
        return F.when(F.size(words) >= K, threes).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<long>"))

    return bound(F.transform(F.regexp_extract_all(text, F.lit(r"\S{1,%d}" % PIECE), F.lit(0)), lambda w: F.xxhash64(w)), of)


def marked(grams: Column) -> Column:
    """Hash above, and below it a position that falls, so that the lowest value of a tie is the rightmost."""
    return F.transform(grams, lambda g, i: F.shiftleft(F.shiftrightunsigned(g, 24), 24).bitwiseOR(F.lit(POSITION) - i.cast("long").bitwiseAND(F.lit(POSITION))))


def chosen(marked: Column) -> Column:
    """Distinct lowest values of each W = 4 consecutive ones, by minima over 2 and 4."""

    def of(values):
        least = bound(joined(values, values, 1, F.least), lambda v: joined(v, v, 2, F.least))
        full = F.slice(least, 1, F.size(values) - W + 1)
        return F.when(F.size(values) > W, F.array_distinct(full)).when(F.size(values) > 0, F.array(F.array_min(values))).otherwise(F.array().cast("array<long>"))

    return bound(marked, of)


def with_choices(df: DataFrame, text: str, to: str) -> DataFrame:
    """Adds an array of choices for the text column."""
    return df.withColumn(to, chosen(marked(grams(F.col(text)))))


def as_string(choices: str) -> Column:
    """Sixteen hex digits for each choice: ten of hash, six of position."""
    return F.array_join(F.transform(choices, lambda c: F.lpad(F.lower(F.hex(c.bitwiseXOR(F.lit(POSITION)))), 16, "0")), "")


def hashes(choices: str) -> Column:
    return F.array_distinct(F.transform(choices, lambda c: F.shiftrightunsigned(c, 24)))


def likeness(a: str, b: str) -> Column:
    """Jaccard index of two sets of hashes; 1 if both are empty."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def next_text(docs: DataFrame) -> DataFrame:
    """doc_id, text, __choices and those of the next document by descending doc_id: __next, __next_choices.

    After the last comes the first; nulls are last, and rows with one doc_id
    follow each other by descending text. Rows are dealt to ranges of doc_id
    whose bounds are quantiles, and each range gets a copy of the first row of
    the range after it: one shuffle, and no task sees all rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranges = max(1, min(MOST_RANGES, docs.count() // RANGE_ROWS))
    cuts = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", cuts, 20 * ranges).alias("b")).first().b or ())) if cuts else []
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)] if bounds else []
    if steps:
        table, number = F.lit(bounds), F.lit(len(bounds))
        within = lambda at, s: F.when((at + s <= number) & (F.get(table, at + s - 1) < F.col("doc_id")), at + s).otherwise(at)
        bucket = F.aggregate(F.lit(steps), F.lit(0), within)
    else:
        bucket = F.lit(0)
    ranged = docs.withColumn("__bucket", bucket)
    tops = [(r["__bucket"], r.top) for r in ranged.groupBy("__bucket").agg(F.max("doc_id").alias("top")).collect()]
    tops.sort()
    before = [(b, top, tops[(i + 1) % len(tops)][0]) for i, (b, top) in enumerate(tops)]
    copies = F.broadcast(spark.createDataFrame(before, "b int, top long, to int"))
    both = F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.array(F.struct(F.col("__bucket").alias("at"), F.lit(False).alias("copy")), F.struct(F.col("to").alias("at"), F.lit(True).alias("copy"))))
    dealt = ranged.join(copies, F.col("__bucket") == F.col("b")).select("doc_id", "text", F.explode(F.coalesce(both, F.array(F.struct(F.col("__bucket").alias("at"), F.lit(False).alias("copy"))))).alias("e"))
    dealt = dealt.select("doc_id", "text", F.col("e.at").alias("__bucket"), F.col("e.copy").alias("__copy"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    local = with_choices(dealt.repartition(parts, "__bucket"), "text", "__choices")
    order = "PARTITION BY __bucket ORDER BY __copy, doc_id DESC NULLS LAST, text DESC"
    return local.select("*", F.expr(f"lead(text) OVER ({order})").alias("__next"), F.expr(f"lead(__choices) OVER ({order})").alias("__next_choices")).where("not __copy").drop("__bucket", "__copy")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, choices (hash above position) and fingerprint of each text, for any other use of the fingerprints.

    Null and empty texts have no choices and an empty fingerprint. Equal texts
    have equal fingerprints.
    """
    local = with_choices(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "__choices")
    return local.select("doc_id", F.col("__choices").alias("choices"), as_string("__choices").alias("fingerprint"))


def edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of the text whose last third is the start of the next document.

    Null texts count as empty; in a table of one row it is its own next
    document; an empty table stays empty. Repeated rows stay repeated. Other
    columns are ignored.
    """
    n = F.length("text").cast("long")
    third = (F.col("n_chars") / 3).cast("long").cast("int")
    cut = next_text(docs).withColumn("n_chars", n)
    cut = cut.withColumn("__edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("__next", F.lit(1), third)))
    cut = with_choices(cut, "__edited", "__edited_choices")
    cut = cut.select("*", *(hashes(c).alias(h) for c, h in (("__choices", "__a"), ("__edited_choices", "__b"), ("__next_choices", "__c"))))
    return cut.select(
        "doc_id", "n_chars", F.sha2("__edited", 256).alias("edited_sha256"), as_string("__choices").alias("fingerprint"), as_string("__edited_choices").alias("edited_fingerprint"),
        likeness("__a", "__b").alias("near_edited"), likeness("__a", "__c").alias("near_next"),
    )


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Line dedup by a fixed-depth tree of line templates.

A line's path in the tree is its token count and its LEAD leading tokens; a
leaf holds templates. Tokens with a digit are variable and become wildcards,
if that leaves MIN_FIXED others; else, and where no token has one, the line's
template is the line. So that other variable fields generalise too, each third
of the tokens behind the leading ones of a line of LONG tokens is made a
wildcard in turn. A line thus has one plain template and up to three general
ones. That is a fixed number of keys for each line, each a hash of its path
and template, so no leaf has to be gathered or compared in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempograph.llm import store
from tempograph.llm.words import U64, WORD, Words, mix, split_words

LEAD = 2
#: Tokens that are not wildcards of a template with some, at least.
MIN_FIXED = 3
#: Lines of so many tokens have general templates.
LONG = 6
THIRDS = 3
WILD, PLACE = U64(0x5851F42D4C957F2D), U64(0xD1342543DE82EF95)
DIGIT = (np.arange(256) >= 0x30) & (np.arange(256) <= 0x39)


def templates(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, line within the row, template hash) of each template of a chunk; a line has up to four."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    breaks = np.concatenate([[0], np.cumsum(words.data == 0x0A)])
    row = words.rows()
    line = breaks[words.starts] - breaks[words.offsets[row]]
    digits = np.concatenate([[0], np.cumsum(DIGIT[words.data])])
    variable = digits[words.ends] > digits[words.starts]
    fixed = np.concatenate([[0], np.cumsum(~variable)])
    first = np.flatnonzero(np.concatenate([[True], (np.diff(line) != 0) | (np.diff(row) != 0)]))
    size = np.diff(np.append(first, n))
    place = (np.arange(n) - np.repeat(first, size)).astype(np.uint64)
    # a template's hash is the sum of its tokens' values at their places
    literal = words.hashes(WORD)
    whole, general = (np.concatenate([[U64(0)], np.cumsum(mix(t + place * PLACE))]) for t in (literal, np.where(variable, WILD, literal)))
    key = lambda total, size, kind: mix(total + mix(size.astype(np.uint64) * U64(4) + U64(kind)))
    last = first + size
    masked = fixed[last] - fixed[first] >= MIN_FIXED
    out = [(first, key(np.where(masked, general[last] - general[first], whole[last] - whole[first]), size, 0))]
    s, e = first[size >= LONG], last[size >= LONG]
    tail = e - s - LEAD
    for j in range(THIRDS):
        a, b = s + LEAD + tail * j // THIRDS, s + LEAD + tail * (j + 1) // THIRDS
        enough = fixed[e] - fixed[b] + fixed[a] - fixed[s] >= MIN_FIXED
        h = key(general[e] - general[b] + general[a] - general[s], e - s, j + 1)
        out.append((s[enough], h[enough]))
    at = np.concatenate([x for x, _ in out])
    return row[at], line[at], np.concatenate([h for _, h in out])


def _signed(docs: DataFrame) -> DataFrame:
    """__doc, __th and the distinct template hashes of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, counts = [np.zeros(0, np.uint64)], np.zeros(batch.num_rows, np.int64)
            for words in split_words(batch.column("text")):
                row, _, h = templates(words)
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
                flat.append(h[new])
                counts[words.lo : words.hi] = np.bincount(row[new], minlength=words.hi - words.lo)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            keys = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(flat).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("__doc"), batch.column("__th"), keys], names=["__doc", "__th", "keys"])

    return docs.select("__doc", "__th", "text").mapInArrow(run, "__doc long, __th long, keys array<long>")


def drop_recurring(docs: DataFrame) -> DataFrame:
    """Docs with recurring lines taken out of `text`, and n_lines and n_dropped.

    A template recurs if lines of two documents (by doc_id) have it. The
    document with the smallest doc_id keeps its lines; a line goes if any of
    its templates occurs in a document with a smaller id. Lines are separated
    by a line feed; blank ones stay. What is left keeps its order and bytes. A text whose lines all go becomes empty; a null
    text stays null and has no lines. A null doc_id counts as one document
    before all others. Repeated rows with one id are one document. n_lines and
    n_dropped replace columns of these names; an empty table stays empty.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    kept = docs.select(*names, F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").alias("__doc"), F.xxhash64("text").alias("__th"))
    signed = store.table(_signed(kept), "templates")
    each = signed.select("__doc", "__th", F.explode("keys").alias("key"))
    recurring = each.groupBy("key").agg(F.min("__doc").alias("low"), F.max("__doc").alias("high")).where("low < high").select("key", "low")
    gone = each.join(recurring, "key").where("low < __doc").groupBy("__doc", "__th").agg(F.collect_set("key").alias("__gone"))
    gone = store.table(gone.withColumnsRenamed({"__doc": "__d", "__th": "__t"}), "recurring")
    store.drop(signed)
    joined = kept.join(gone, (F.col("__doc") == F.col("__d")) & (F.col("__th") == F.col("__t")), "left").select(*names, "__gone")
    where = names.index("text")
    schema = T.StructType([*docs.select(*names).schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch.column("__gone")
            sizes = gone.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, flat = np.cumsum(sizes), gone.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            texts = batch.column("text")
            n_lines, n_dropped, new = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), {}
            for words in split_words(texts):
                breaks = np.concatenate([[0], np.cumsum(words.data == 0x0A)])[words.offsets]
                n_lines[words.lo : words.hi] = np.diff(breaks) + 1
                local = sizes[words.lo : words.hi]
                if not local.any():
                    continue
                row, line, h = templates(words)
                some = local[row] > 0
                row, line, h = row[some], line[some], h[some]
                a, b = (ends - sizes)[words.lo], ends[words.hi - 1]
                owner = np.repeat(np.arange(len(local)), local).astype(np.uint64)
                # a template counts for its own document only
                salt = lambda r, k: mix(k + r * U64(0x9E3779B97F4A7C15))
                hit = np.isin(salt(row.astype(np.uint64), h), salt(owner, flat[a:b]))
                lost: dict[int, set[int]] = {}
                for r, i in zip(row[hit].tolist(), line[hit].tolist()):
                    lost.setdefault(r, set()).add(i)
                for r, drop in lost.items():
                    raw = words.data[words.offsets[r] : words.offsets[r + 1]].tobytes().decode()
                    new[words.lo + r] = "\n".join(x for i, x in enumerate(raw.split("\n")) if i not in drop)
                    n_dropped[words.lo + r] = len(drop)
            n_lines[texts.is_null().to_numpy(zero_copy_only=False)] = 0
            if new:
                changed = pa.array(np.isin(np.arange(len(texts)), list(new)))
                texts = pc.replace_with_mask(texts, changed, pa.array([new[i] for i in sorted(new)], texts.type))
            columns = [texts if i == where else batch.column(c) for i, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines), pa.array(n_dropped)], names=[*names, "n_lines", "n_dropped"])

    return joined.mapInArrow(run, schema)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, dropped lines and the SHA-256 of the text left."""
    found = drop_recurring(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents),
m AS (SELECT doc_id, i, line, list_transform(list_filter(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: x <> ''),
             lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN chr(1) ELSE x END) AS w FROM l),
t AS (SELECT doc_id, i, len(w) AS n, w, 2 + (len(w) - 2) * (j - 1) // 3 AS a, 2 + (len(w) - 2) * j // 3 AS b, j AS k FROM m, (SELECT unnest([1, 2, 3]) AS j) WHERE len(w) >= 6),
g AS (SELECT doc_id, i, n, k, list_concat(w[1:a], w[b + 1:]) AS fixed FROM t),
p AS (SELECT doc_id, i, len(w) AS n, 0 AS k, CASE WHEN len(list_filter(w, lambda x: x <> chr(1))) >= 3 THEN w ELSE list_filter(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: x <> '') END AS fixed FROM m WHERE len(w) > 0),
s AS (SELECT doc_id, i, md5(n || '/' || k || '/' || list_aggregate(fixed, 'string_agg', ' ')) AS h FROM (SELECT * FROM p UNION ALL SELECT * FROM g WHERE len(list_filter(fixed, lambda x: x <> chr(1))) >= 3)),
r AS (SELECT h, min(doc_id) AS low FROM s GROUP BY h HAVING min(doc_id) < max(doc_id)),
x AS (SELECT DISTINCT doc_id, i FROM s JOIN r USING (h) WHERE low < doc_id),
o AS (SELECT l.doc_id, count(*) AS n_lines, count(x.i) AS n_dropped, string_agg(CASE WHEN x.i IS NULL THEN line END, chr(10) ORDER BY l.i) AS kept
      FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.i = x.i GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM o
"""

"""Bounded samples of labelled documents to fit a classifier on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longer texts are not trained on (they are scored like any other), so the sample's bytes are bounded too.
LONGEST = 1 << 18


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn, per_class: int) -> tuple[pa.Array, np.ndarray, float]:
    """Texts and labels of at most `per_class` documents of either class, and the share of label 1.

    `learn` is a condition on doc_id that labels may be learnt from. The rows
    taken are those with the lowest hash of doc_id, so they do not depend on
    partitions; the ids, and so the broadcast, are bounded by the parameter.
    The share counts all labels that may be learnt from.
    """
    usable = labels.where(learn & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    counts = {r.y: r.n for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    chosen = [usable.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    ids = chosen[0].unionByName(chosen[1])
    rows = docs.select("doc_id", "text").where(F.length("text") <= LONGEST).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).toArrow()
    order_ = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    share = counts.get(1, 0) / max(1, counts.get(0, 0) + counts.get(1, 0))
    return rows["text"].combine_chunks().take(pa.array(order_)), rows["y"].to_numpy()[order_].astype(np.int64), share

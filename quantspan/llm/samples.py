"""Bounded samples of labelled documents, for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspan.llm.batches import pick


def remainder(doc_id, modulus: int):
    """The fold of a document: crc32 of its id as text, modulo `modulus`."""
    return F.crc32(doc_id.cast("string")) % modulus


def labelled(
    docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, per_class: int
) -> tuple[DataFrame, dict[int, int]]:
    """At most `per_class` documents of each class outside the held-out fold, by hashed id.

    -> (doc_id, text, label), and the number of labelled rows of each class outside the fold.
    Ids labelled both ways, and null labels or ids, are left out.
    """
    known = (
        pick(labels, doc_id="doc_id", label=label)
        .where(F.col("label").isin(0, 1) & (remainder(F.col("doc_id"), modulus) != held_out))
        .groupBy("doc_id")
        .agg(F.min("label").cast("int").alias("label"), F.max("label").alias("other"))
        .where("label = other")
        .select("doc_id", "label")
    )
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = None
    for k in (0, 1):
        part = known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * per_class rows of an id and a label.
    rows = pick(docs, doc_id="doc_id", text="text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")), counts

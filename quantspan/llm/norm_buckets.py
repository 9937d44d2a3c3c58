"""Ranked lexical search by norm buckets (after LEMP).

A document's impact vector has, for each term some item asks for, its saturated frequency; an
item's vector has the terms' weights. Both sides are scaled by the square root of the weights,
so that the best documents of an item point where the item points. Documents are laid out by
the length of their vectors, and every task goes through its stretch from the longest to the
shortest in buckets. An item leaves a bucket alone if its length times the longest vector there
stays below the item's threshold (Cauchy-Schwarz). Inside a bucket the item's heaviest
coordinates are added up; what the rest can still give is bounded by the lengths that are left,
and only documents whose bound reaches the threshold are scored, in integers, on all terms.

Thresholds start from the `seeds` longest vectors and rise with what a task finds. They never
drop a document: its bound is never below its score, and ties at the threshold are kept. Items
go in blocks of about `terms` terms, each a pass over the documents with the block's vocabulary.

Defined results: null texts have no terms. Rows that repeat a doc_id are documents of their own,
rows that repeat an item_id one item with the terms of all of them. A null doc_id ranks behind
equal scores of others. Items and documents without common terms give no row; empty tables give
none. Long texts are read whole. Extra columns are left out. Terms are told apart by 64-bit
hashes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantspan.llm.batches import Words, bounded, pick, pieces
from quantspan.session import materialize

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Settings:
    best: int = 50
    bucket: int = 2048  # documents
    focus: int = 8  # coordinates of an item that the bound looks at
    seeds: int = 4096  # vectors that the first thresholds come from
    terms: int = 1 << 20  # of a block of items, about
    length_weight: int = 50  # per cent of the frequency's saturation that follows the length


def terms_of(texts: list[str]) -> tuple[Words, np.ndarray]:
    """The terms of texts and their hashes, in lower case."""
    words = Words(texts, lambda c: (c > 127) | ((c > 47) & (c < 58)) | ((c > 64) & (c < 91)) | ((c > 96) & (c < 123)))
    words.codes = np.where((words.codes > 64) & (words.codes < 91), words.codes + np.uint32(32), words.codes)
    return words, words.hashes()


@dataclass
class Items:
    """A block of items: their terms as numbers of a sorted vocabulary of hashes."""

    ids: list
    vocabulary: np.ndarray
    terms: list[np.ndarray]

    @classmethod
    def of(cls, rows: list) -> Items:
        ids = sorted({r["item_id"] for r in rows}, key=lambda i: (i is None, i))
        number = {i: k for k, i in enumerate(ids)}
        words, hashes = terms_of([r["term"] for r in rows])
        vocabulary, at = np.unique(hashes, return_inverse=True)
        item = np.array([number[r["item_id"]] for r in rows], np.int64)[words.doc]
        return cls(ids, vocabulary, [np.unique(at[item == k]) for k in range(len(ids))])


def frequencies(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """-> (doc_id, n, terms, tfs) of the documents with any term; `terms` of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by Settings.terms

    def run(batches):
        known = shared.value
        for batch, texts in pieces(batches):
            words, hashes = terms_of(texts)
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            inside = known[at] == hashes
            key, tf = np.unique(words.doc[inside] * len(known) + at[inside], return_counts=True)
            ends = np.searchsorted(key, np.arange(1, len(texts) + 1) * len(known)).astype(np.int32)
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            columns = [
                batch.column(0),
                pa.array(words.counts(), pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(key % len(known), pa.int32())),
                pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64())),
            ]
            out = pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(words.counts() > 0))

    bounded(docs.sparkSession)
    return docs.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


@dataclass
class Weights:
    """What the corpus says about the terms, and the saturation of frequencies."""

    weight: np.ndarray
    documents: int
    length: int

    @classmethod
    def of(cls, counted: DataFrame, size: int) -> Weights:
        total = counted.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        weight = np.zeros(size, np.int64)
        # At most one row for each term of the vocabulary.
        for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
            weight[r["t"]] = math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * r["count"] + 1)))
        return cls(weight, total["docs"], total["terms"])

    def impacts(self, n: np.ndarray, tf: np.ndarray, share: int) -> np.ndarray:
        """For frequencies `tf` in documents of n terms (both arrays of the same size)."""
        sizes, at = np.unique(n, return_inverse=True)
        spread = np.array([100 - share + share * int(k) * self.documents // self.length for k in sizes], np.int64)
        return 1_000_000_000 * tf // (1000 * tf + 20 * spread[at])


def impact_vectors(counted: DataFrame, weights: Weights, s: Settings) -> DataFrame:
    """-> (doc_id, length, terms, impacts) of the documents with a term that weighs anything"""
    shared = counted.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = shared.value
        for batch in batches:
            terms, tfs = batch.column(2), batch.column(3)
            sizes = np.asarray(terms.value_lengths(), np.int64)
            t, tf = np.asarray(terms.flatten(), np.int64), np.asarray(tfs.flatten(), np.int64)
            impact = w.impacts(np.repeat(np.asarray(batch.column(1)), sizes), tf, s.length_weight)
            row = np.repeat(np.arange(len(sizes)), sizes)
            length = np.sqrt(np.bincount(row, weights=w.weight[t] * impact.astype(float) ** 2, minlength=len(sizes)))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            columns = [batch.column(0), pa.array(length), pa.ListArray.from_arrays(offsets, pa.array(t, pa.int32()))]
            columns.append(pa.ListArray.from_arrays(offsets, pa.array(impact, pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "length", "terms", "impacts"]).filter(pa.array(length > 0))

    return counted.mapInArrow(run, "doc_id bigint, length double, terms array<int>, impacts array<int>")


class Search:
    """The best documents of every item among the buckets seen so far."""

    def __init__(self, items: Items, weights: Weights, thresholds: np.ndarray, s: Settings):
        self.s, self.weight, self.root = s, weights.weight, np.sqrt(weights.weight.astype(float))
        self.threshold = thresholds.copy()
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items.ids]
        self.scored = 0  # documents that were scored in full, over all items
        # Terms by falling weight, and the lengths that whole items and their tails have.
        self.terms = [t[np.argsort(-weights.weight[t], kind="stable")] for t in items.terms]
        self.terms = [t[weights.weight[t] > 0] for t in self.terms]
        self.length = np.array([math.sqrt(weights.weight[t].sum()) for t in self.terms])
        self.tail = np.array([math.sqrt(weights.weight[t[s.focus :]].sum()) for t in self.terms])

    def bucket(self, ids: np.ndarray, length: np.ndarray, row: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
        """Documents by falling length; (row, term, impact) are their coordinates."""
        order = np.argsort(term, kind="stable")
        row, term, impact = row[order], term[order], impact[order].astype(np.int64)
        there = np.unique(term)
        begin = np.searchsorted(term, np.concatenate([there, there[-1:] + 1]))
        for q in np.flatnonzero(self.length * length[0] * (1 + 1e-9) >= self.threshold):
            at = np.searchsorted(there, self.terms[q])
            at = np.minimum(at, len(there) - 1)
            found = there[at] == self.terms[q]
            if not found.any():
                continue
            spans = [(t, slice(begin[k], begin[k + 1])) for t, k, f in zip(self.terms[q], at, found) if f]
            heavy = set(self.terms[q][: self.s.focus].tolist())
            dot, square = np.zeros(len(ids)), np.zeros(len(ids))
            for t, rows in spans:
                if t in heavy:
                    part = self.root[t] * impact[rows]
                    dot[row[rows]] += self.root[t] * part
                    square[row[rows]] += part * part
            left = np.sqrt(np.maximum(length * length - square, 0))
            passed = (dot + self.tail[q] * left) * (1 + 1e-9) >= self.threshold[q]
            if not passed.any():
                continue
            score = np.zeros(len(ids), np.int64)
            for t, rows in spans:
                score[row[rows]] += self.weight[t] * impact[rows]
            self.scored += int(passed.sum())
            self.keep(q, ids[passed], score[passed])

    def keep(self, q: int, ids: np.ndarray, score: np.ndarray) -> None:
        good = (score >= self.threshold[q]) & (score > 0)
        if not good.any():
            return
        ids, score = np.concatenate([self.best[q][0], ids[good]]), np.concatenate([self.best[q][1], score[good]])
        order = np.lexsort((ids, -score))[: self.s.best]
        self.best[q] = ids[order], score[order]
        if len(order) == self.s.best:
            self.threshold[q] = max(self.threshold[q], score[order[-1]])

    def rows(self) -> pa.RecordBatch:
        sizes = [len(b[0]) for b in self.best]
        ids = np.concatenate([b[0] for b in self.best]) if sizes else np.zeros(0, np.int64)
        score = np.concatenate([b[1] for b in self.best]) if sizes else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int32()), pa.array(ids), pa.array(score)], ["q", "id", "score"])


def searched(vectors: DataFrame, items: Items, weights: Weights, thresholds: np.ndarray, s: Settings) -> DataFrame:
    """-> (q, id, score): the best of every task, whose rows come by falling length"""
    shared = vectors.sparkSession.sparkContext.broadcast((items, weights, thresholds))

    def run(batches):
        search = Search(*shared.value, s)
        for batch in batches:
            for start in range(0, batch.num_rows, s.bucket):
                part = batch.slice(start, s.bucket)
                sizes = np.asarray(part.column(2).value_lengths(), np.int64)
                ids = np.asarray(part.column(0).fill_null(NO_ID), np.int64)
                row = np.repeat(np.arange(len(ids)), sizes)
                search.bucket(ids, np.asarray(part.column(1)), row, np.asarray(part.column(2).flatten()), np.asarray(part.column(3).flatten()))
        yield search.rows()

    bounded(vectors.sparkSession)
    return vectors.mapInArrow(run, "q int, id bigint, score bigint")


def ranked(found: DataFrame, s: Settings) -> DataFrame:
    order = W.partitionBy("q").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.best)


def _block(docs: DataFrame, items: Items, s: Settings) -> DataFrame:
    spark = docs.sparkSession
    counted = materialize(frequencies(docs, items.vocabulary), "frequencies")
    weights = Weights.of(counted, len(items.vocabulary))
    vectors = materialize(impact_vectors(counted, weights, s), "impacts")
    longest = vectors.orderBy(F.desc("length"), "doc_id").limit(s.seeds)
    first = ranked(searched(longest, items, weights, np.zeros(len(items.ids), np.int64), s), s)
    thresholds = np.zeros(len(items.ids), np.int64)
    for r in first.where(F.col("rank") == s.best).collect():  # one row for an item
        thresholds[r["q"]] = r["score"]
    # Hashed ids part the vectors of one length, which copies may share.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = vectors.repartitionByRange(tasks, F.desc("length"), F.xxhash64("doc_id")).sortWithinPartitions(F.desc("length"))
    names = spark.createDataFrame(list(enumerate(items.ids)), "q int, item_id bigint")
    best = ranked(searched(laid, items, weights, thresholds, s), s)
    doc_id = F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id")
    return best.join(F.broadcast(names), "q").select("item_id", "rank", doc_id, "score")


def search(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", s: Settings = Settings()
) -> DataFrame:
    """-> (item_id, rank, doc_id, score): the best documents of every item, ranked from 1"""
    found = F.array_distinct(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0)))
    asked = pick(items, item_id=item_id, text=item_text).select(F.col("item_id").cast("long"), F.explode(found).alias("term")).distinct()
    asked = materialize(asked, "item-terms")
    blocks = -(-asked.count() // s.terms)
    rows = pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), "text")
    result = None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # about s.terms rows
        if own:
            part = _block(rows, Items.of(own), s)
            result = part if result is None else result.unionByName(part)
    if result is None:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return result

"""Hard negatives by exact inner products from subset-sum tables (the Four-Russians trick).

Components become integers, floor(scale * x). For every anchor and every group of eight
dimensions a table holds the sums of all 256 subsets of its components. Candidates are stored
as bit planes: one byte for each group and binary digit, in two's complement. A byte looks up
the sum of the components whose digit is set; the planes are added from the highest to the
lowest, the sum doubled in between and the sign plane counted negative. The result is the whole
inner product, exact in 64 bits (what does not fit there wraps around).

Rows are packed into blocks where they lie. Slices of anchor blocks meet slices of candidate
blocks in groups of bounded size, and each group returns no more than `positives` or
`positives * negatives` rows for an anchor and a block; the best of all blocks are ranked after
that. Positives are scored against rows of their own label only, negatives in a second pass
that knows the positives' scores.

Defined results: rows with a null id, label or vector, or with a null, NaN or infinite
component, take no part. Vectors of different lengths count as filled up with zeros. Equal
scores come in the order of ids. Rows that repeat an id are rows of their own, but no row with
the anchor's id is its positive or negative; an anchor that is repeated counts once (the
smallest label and vector). An anchor without positives, or a positive without a negative
in range, gives no row. Empty tables give none. Extra columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantspan.llm.batches import bounded, pick
from quantspan.session import materialize

LOWEST = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Settings:
    scale: float = 256.0
    positives: int = 5
    negatives: int = 5
    low: int = 80  # a negative has at least low / 100 of its positive's score
    rows: int = 2048  # of a candidate block
    anchors: int = 256  # of an anchor block
    blocks: int = 16  # of a slice, at most


def integers(vectors: list, scale: float) -> np.ndarray:
    """floor(scale * x) as (rows, dimensions), short vectors filled up with zeros."""
    lengths = np.fromiter(map(len, vectors), np.int64, len(vectors))
    wide = max(int(lengths.max(initial=0)), 1)
    flat = np.fromiter((x for v in vectors for x in v), np.float64, int(lengths.sum()))
    out = np.zeros((len(vectors), -(-wide // 8) * 8), np.int64)
    inside = np.arange(out.shape[1]) < lengths[:, None]
    with np.errstate(over="ignore"):
        out[inside] = np.clip(np.floor(scale * flat), -(2.0**62), 2.0**62).astype(np.int64)
    return out


def planes(values: np.ndarray) -> np.ndarray:
    """(digits, groups of eight dimensions, rows): packed bits, the lowest digit first."""
    digits = max(int(v).bit_length() for v in (values.max(initial=0), ~values.min(initial=0), 0)) + 1
    shifted = values.T[None] >> np.arange(digits)[:, None, None]
    return np.packbits((shifted & 1).astype(np.uint8).reshape(digits, -1, 8, len(values)), axis=2, bitorder="little")[:, :, 0]


def subset_sums(values: np.ndarray, digits: int) -> np.ndarray:
    """(groups, 256, anchors): the sums of all subsets of every eight dimensions."""
    peak = int(np.abs(values).max(initial=0)) * values.shape[1] << (digits + 1)
    kind = np.int32 if peak < 2**31 else np.int64
    columns = values.astype(kind).T.reshape(-1, 8, len(values))
    table = np.zeros((len(columns), 256, len(values)), kind)
    for j in range(8):
        table[:, 1 << j : 2 << j] = table[:, : 1 << j] + columns[:, j : j + 1]
    return table


def scores(table: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """(rows, anchors): whole inner products by look-ups, shifts and additions."""
    groups = min(len(table), packed.shape[1])  # beyond them one side is all zeros
    total = None
    for digit in packed[::-1]:
        looked = table[0][digit[0]]
        for g in range(1, groups):
            looked += table[g][digit[g]]
        total = -looked if total is None else (total << 1) + looked
    return total


@dataclass
class Block:
    """Rows of one packed record, sorted by label and id."""

    ids: np.ndarray
    labels: np.ndarray
    digits: int
    data: np.ndarray  # bit planes of candidates, integers of anchors
    positive_ids: list
    positive_scores: list

    @classmethod
    def read(cls, r: dict) -> Block:
        ids = np.frombuffer(r["ids"], np.int64)
        if r["digits"]:
            data = np.frombuffer(r["data"], np.uint8).reshape(r["digits"], -1, len(ids))
        else:
            data = np.frombuffer(r["data"], np.int64).reshape(len(ids), -1)
        return cls(ids, np.frombuffer(r["labels"], np.int64), r["digits"], data, r["positive_ids"], r["positive_scores"])


PACKED = (
    "block bigint, ids binary, labels binary, digits int, data binary, "
    "positive_ids array<array<bigint>>, positive_scores array<array<bigint>>"
)


def packed(rows: DataFrame, size: int, s: Settings, anchors: bool) -> DataFrame:
    """Blocks of at most `size` consecutive rows of (id, label, vector[, positives])."""
    known = "positives" in rows.columns

    def one(number, records):
        records.sort(key=lambda r: (r[1], r[0]))
        values = integers([r[2] for r in records], s.scale)
        data = None if anchors else planes(values)
        found = [r[3] for r in records] if known else []
        return {
            "block": number,
            "ids": np.array([r[0] for r in records], np.int64).tobytes(),
            "labels": np.array([r[1] for r in records], np.int64).tobytes(),
            "digits": 0 if anchors else len(data),
            "data": (values if anchors else data).tobytes(),
            "positive_ids": [[p["id"] for p in f] for f in found],
            "positive_scores": [[p["score"] for p in f] for f in found],
        }

    schema = pa.schema(
        [("block", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("digits", pa.int32()), ("data", pa.binary())]
        + [(n, pa.list_(pa.list_(pa.int64()))) for n in ("positive_ids", "positive_scores")]
    )

    def run(batches):
        number, waiting = TaskContext.get().partitionId() << 32, []
        for batch in batches:
            waiting += zip(*[c.to_pylist() for c in batch.columns])
            while len(waiting) >= size:
                yield pa.RecordBatch.from_pylist([one(number, waiting[:size])], schema)
                number, waiting = number + 1, waiting[size:]
        if waiting:
            yield pa.RecordBatch.from_pylist([one(number, waiting)], schema)

    bounded(rows.sparkSession)
    return rows.mapInArrow(run, PACKED)


def same_label(a: Block, c: Block, s: Settings) -> list[tuple]:
    """(anchor, score, row): the best rows of each anchor's label in one block."""
    out = []
    for label in np.intersect1d(a.labels, c.labels):
        mine = slice(*np.searchsorted(a.labels, [label, label + 1]))
        theirs = slice(*np.searchsorted(c.labels, [label, label + 1]))
        got = scores(subset_sums(a.data[mine], c.digits), c.data[:, :, theirs]).astype(np.int64)
        ids, anchors = c.ids[theirs], a.ids[mine]
        other = ids[:, None] != anchors[None]
        # Rows are sorted by id, so a stable sort leaves ties in their order.
        order = np.argsort(np.where(other, -got, -LOWEST - 1), axis=0, kind="stable")[: s.positives + 8]
        for k in range(len(anchors)):
            best = order[other[order[:, k], k], k][: s.positives]
            if len(best) < s.positives:  # repeats of the anchor's own id took the places
                rest = np.flatnonzero(other[:, k])
                best = rest[np.argsort(-got[rest, k], kind="stable")][: s.positives]
            out += [(int(anchors[k]), int(got[i, k]), int(ids[i])) for i in best]
    return out


def other_labels(a: Block, c: Block, s: Settings) -> list[tuple]:
    """(anchor, positive, its score, score, row): the first rows in range for each positive."""
    got = scores(subset_sums(a.data, c.digits), c.data).astype(np.int64)
    lows = [[-(-s.low * p // 100) for p in ps] for ps in a.positive_scores]
    low = np.array([min(x) for x in lows], np.int64)
    high = np.array([max(x) for x in a.positive_scores], np.int64)
    row, anchor = np.nonzero((got >= low) & (got <= high) & (c.labels[:, None] != a.labels))
    value = got[row, anchor]
    order = np.lexsort((c.ids[row], -value, anchor))
    row, anchor, value = row[order], anchor[order], value[order]
    begin = np.searchsorted(anchor, np.arange(len(a.ids) + 1))
    out = []
    for k in np.unique(anchor):
        mine = slice(begin[k], begin[k + 1])
        falling = -value[mine]
        for p, score, least in zip(a.positive_ids[k], a.positive_scores[k], lows[k]):
            i = begin[k] + int(np.searchsorted(falling, -score))
            for j in range(i, min(i + s.negatives, begin[k + 1])):
                if value[j] < least:
                    break
                out.append((int(a.ids[k]), p, score, int(value[j]), int(c.ids[row[j]])))
    return out


def meet(anchors: DataFrame, candidates: DataFrame, fn, columns: tuple[str, ...], s: Settings) -> DataFrame:
    """fn(anchor block, candidate block, settings) for all blocks, in groups of two slices."""
    spark = anchors.sparkSession
    n_anchors, n_candidates = anchors.count(), candidates.count()
    # A slice is small where that keeps the cluster busy, and never beyond its bound.
    share = lambda n: min(s.blocks, max(1, n // spark.sparkContext.defaultParallelism))
    mine, theirs = max(1, -(-n_anchors // s.blocks)), max(1, -(-n_candidates // share(n_candidates)))
    part = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tasks = min(mine * theirs, max(int(spark.conf.get("spark.sql.shuffle.partitions")), mine * theirs // 8))
    left = anchors.withColumn("a", part(mine)).withColumn("c", every(theirs)).repartition(tasks, "a", "c")
    right = candidates.withColumn("c", part(theirs)).withColumn("a", every(mine)).repartition(tasks, "a", "c")
    schema = pa.schema([(n, pa.int64()) for n in columns])

    def run(some: pa.Table, others: pa.Table) -> pa.Table:
        found = []
        blocks = [Block.read(r) for r in others.to_pylist()]
        for r in some.to_pylist():
            a = Block.read(r)
            for c in blocks:
                found += fn(a, c, s)
        return pa.table([pa.array(x, pa.int64()) for x in zip(*found)], schema=schema) if found else schema.empty_table()

    grouped = left.groupBy("a", "c").cogroup(right.groupBy("a", "c"))
    return grouped.applyInArrow(run, ", ".join(f"{n} bigint" for n in columns))


def usable(rows: DataFrame, vec_id: str, label: str, vector: str) -> DataFrame:
    """(id, label, vector) of the rows that take part."""
    known = pick(rows, id=vec_id, label=label, vector=vector).select(
        F.col("id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<double>")
    )
    wrong = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return known.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).where(~wrong)


def mine(
    rows: DataFrame, anchor: Column, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", s: Settings = Settings()
) -> DataFrame:
    """-> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score)

    `anchor` is a condition on the column id.
    """
    known = usable(rows, vec_id, label, vector)
    asked = known.where(anchor).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("x")).select("id", "x.label", "x.vector")
    asked = materialize(asked, "anchors")
    candidates = materialize(packed(known, s.rows, s, anchors=False), "bit-planes")
    near = meet(packed(asked, s.anchors, s, anchors=True), candidates, same_label, ("anchor_id", "score", "id"), s)
    best = W.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    first = near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= s.positives)
    chosen = first.groupBy("anchor_id").agg(F.collect_list(F.struct("id", "score")).alias("positives"))
    chosen = asked.join(chosen.withColumnRenamed("anchor_id", "id"), "id").select("id", "label", "vector", "positives")
    again = materialize(packed(chosen, s.anchors, s, anchors=True), "positives")
    found = meet(again, candidates, other_labels, ("anchor_id", "positive_id", "positive_score", "score", "id"), s)
    # A positive's score goes with its id; rows that repeat an id differ in it.
    hardest = W.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(hardest)).where(F.col("rank") <= s.negatives)
    return ranked.select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )

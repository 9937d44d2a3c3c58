"""Merkle fixity audit of WARC archives.

A record is hashed with the offset and length at which it stands. The file is cut into ranges
of `range_bytes` by offset; the ordered hashes of the records that begin in a range make the
leaf of that range, and `fan_out` ordered nodes make a node of the next level, up to one root
per file. Nodes are small groups whatever the size of a file, so no file has to fit a task.

The audit compares the roots of two replicas and descends level by level, keeping only the
children of nodes that differ; at the leaves it compares the records of the ranges that are
left. Each level joins only what is still open.

Defined results: a file that one replica lacks differs in its root and all its records are
listed; equal records at other offsets are missing in one place and extra in the other;
records repeated at the same offset are compared as a list; an empty replica lacks every
record. Null bytes are an empty record.
"""

from __future__ import annotations

import gzip
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantspan.llm.batches import bounded, pick
from quantspan.session import materialize

HEADER = "WARC/1.1"
END = b"\r\n\r\n"


@dataclass(frozen=True)
class Settings:
    range_bytes: int = 64 * 1024
    fan_out: int = 16
    levels: int = 5  # 64 KiB * 16 ** 5 = 64 GiB; a larger file has several roots


# Writing and reading records


def record_bytes(uri: Column, body: Column) -> Column:
    """A resource record of a page, as bytes."""
    payload = F.encode(F.coalesce(body, F.lit("")), "UTF-8")
    head = F.concat(
        F.lit(f"{HEADER}\r\nWARC-Type: resource\r\nWARC-Target-URI: "),
        F.coalesce(uri, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(payload).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "UTF-8"), payload, F.lit(END))


def split_records(data: bytes) -> list[tuple[int, int]]:
    """(offset, length) of the records of an uncompressed file; what cannot be read is one more."""
    out, at = [], 0
    while at < len(data):
        head = data.find(END, at)
        size = re.search(rb"\r\nContent-Length:[ \t]*(\d+)", data[at : head + 2], re.I) if head >= 0 else None
        if not data.startswith(b"WARC/", at) or not size:
            out.append((at, len(data) - at))
            break
        stop = head + len(END) + int(size[1])
        stop = min(stop + (len(END) if data.startswith(END, stop) else 0), len(data))
        out.append((at, stop - at))
        at = stop
    return out


def read_archives(spark: SparkSession, path: str, glob: str = "*.warc*") -> DataFrame:
    """-> (file, offset, record): every record of the .warc and .warc.gz files below `path`.

    A file is read by one task; archives are written in files of bounded size.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                places = split_records(data)
                for i in range(0, len(places), 256):
                    part = places[i : i + 256]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name.rpartition("/")[2]] * len(part)),
                            pa.array([a for a, _ in part], pa.int64()),
                            pa.array([data[a : a + n] for a, n in part], pa.binary()),
                        ],
                        ["file", "offset", "record"],
                    )

    bounded(spark)
    return files.select("path", "content").mapInArrow(run, "file string, offset bigint, record binary")


# Trees


def measures(record: Column) -> tuple[Column, Column]:
    """Size and digest of a record; a null one is empty."""
    body = F.coalesce(record, F.lit(b""))
    return F.octet_length(body).cast("long"), F.sha2(body, 256)


def digests(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(file, offset, record) -> (file, offset, size, digest) and the columns named in `keep`."""
    size, digest = measures(F.col("record"))
    return pick(records, file="file", offset="offset", record="record", **{c: c for c in keep}).select(
        *keep, "file", "offset", size.alias("size"), digest.alias("digest")
    )


def offsets(records: DataFrame, order: str) -> DataFrame:
    """Adds `offset` to rows of (file, size): what the records before it in their file take.

    For rows that hold digests instead of records, so that what moves is small.
    """
    before = W.partitionBy("file").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0).cast("long")))


def tree(listed: DataFrame, s: Settings = Settings()) -> list[DataFrame]:
    """Levels of (file, node, digest), leaves first, one node per file in the last."""
    entry = F.concat_ws(":", F.lpad(F.col("offset").cast("string"), 20, "0"), "size", "digest")
    node = F.floor(F.col("offset") / s.range_bytes).cast("long")
    joined = F.sha2(F.array_join(F.array_sort(F.collect_list("entry")), "\n"), 256)
    level = listed.select("file", node.alias("node"), entry.alias("entry")).groupBy("file", "node").agg(joined.alias("digest"))
    levels = [level]
    for _ in range(s.levels):
        entry = F.concat_ws(":", F.lpad(F.col("node").cast("string"), 20, "0"), "digest")
        parent = F.floor(F.col("node") / s.fan_out).cast("long")
        level = level.select("file", parent.alias("node"), entry.alias("entry")).groupBy("file", "node").agg(joined.alias("digest"))
        levels.append(level)
    return levels


def roots(listed: DataFrame, s: Settings = Settings()) -> DataFrame:
    """-> (file, root)"""
    return tree(listed, s)[-1].select("file", F.col("digest").alias("root"))


def audit(left: DataFrame, right: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Compare two replicas given as (file, offset, size, digest).

    -> (file, offset, status, left_digest, right_digest): status is changed, missing (the
    right replica lacks it) or extra.
    """
    sides = [[materialize(x, "level") for x in tree(d, s)] for d in (left, right)]
    open_ = None
    for a, b in reversed(list(zip(*sides))):
        if open_ is not None:
            parent = F.floor(F.col("node") / s.fan_out).cast("long")
            a, b = (x.join(open_, (x["file"] == open_["file"]) & (parent == open_["up"]), "left_semi") for x in (a, b))
        both = a.select("file", "node", F.col("digest").alias("l")).join(b.select("file", "node", F.col("digest").alias("r")), ["file", "node"], "full")
        open_ = materialize(both.where(~F.col("l").eqNullSafe(F.col("r"))).select("file", F.col("node").alias("up")), "open")
    place = F.floor(F.col("offset") / s.range_bytes).cast("long")

    def leaves(d: DataFrame, name: str) -> DataFrame:
        inside = d.join(open_, (d["file"] == open_["file"]) & (place == open_["up"]), "left_semi")
        entries = F.array_sort(F.collect_list(F.struct("size", "digest")))
        return inside.groupBy("file", "offset").agg(F.array_join(F.transform(entries, lambda e: e["digest"]), ",").alias(name))

    both = leaves(left, "left_digest").join(leaves(right, "right_digest"), ["file", "offset"], "full")
    status = (
        F.when(F.col("right_digest").isNull(), "missing").when(F.col("left_digest").isNull(), "extra").otherwise("changed")
    )
    return both.where(~F.col("left_digest").eqNullSafe(F.col("right_digest"))).select("file", "offset", status.alias("status"), "left_digest", "right_digest")

import gzip
import hashlib

from pyspark.sql import functions as F

from quantspan.llm import merkle
from quantspan.llm.merkle import Settings

SMALL = Settings(range_bytes=300, fan_out=3, levels=4)


def archive(n=60):
    out, files = [], ["a.warc", "b.warc"]
    for f in files:
        offset = 0
        for k in range(n):
            body = f"{f} page {k} " * (1 + k % 7)
            record = (
                f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: u{k}\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()
            )
            out.append((f, offset, bytearray(record)))
            offset += len(record)
    return out


def digested(spark, rows):
    return merkle.digests(spark.createDataFrame([(f, o, bytes(r)) for f, o, r in rows], "file string, offset bigint, record binary"))


def audit(spark, left, right):
    rows = merkle.audit(digested(spark, left), digested(spark, right), SMALL).collect()
    return sorted((r.file, r.offset, r.status) for r in rows)


def test_finds_every_kind_of_damage(spark):
    left, right = archive(), archive()
    right[5][2][-6] ^= 1
    right[70][2][3] ^= 1
    gone = right.pop(90)
    right.append(("b.warc", 10**6, bytearray(b"stray")))
    assert audit(spark, left, right) == sorted(
        [("a.warc", left[5][1], "changed"), ("b.warc", left[70][1], "changed"), ("b.warc", gone[1], "missing"), ("b.warc", 10**6, "extra")]
    )
    assert audit(spark, left, archive()) == []


def test_a_missing_file_and_empty_replicas(spark):
    left = archive(8)
    right = [x for x in left if x[0] == "a.warc"]
    assert audit(spark, left, right) == [("b.warc", x[1], "missing") for x in left if x[0] == "b.warc"]
    assert len(audit(spark, left, [])) == 16 and audit(spark, [], []) == []


def test_root_is_the_hash_of_ordered_children(spark):
    rows = archive(4)[:4]
    entry = [f"{o:020d}:{len(r)}:{hashlib.sha256(bytes(r)).hexdigest()}" for _, o, r in rows]
    level = {}
    for e, (_, o, _) in zip(entry, rows):
        level.setdefault(o // 300, []).append(e)
    nodes = {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in level.items()}
    for _ in range(4):
        up = {}
        for k in sorted(nodes):
            up.setdefault(k // 3, []).append(f"{k:020d}:{nodes[k]}")
        nodes = {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in up.items()}
    assert merkle.roots(digested(spark, rows[::-1]), SMALL).first().root == nodes[0]


def test_files_round_trip(spark, tmp_path):
    rows = archive(10)
    for f in ("a.warc", "b.warc"):
        data = b"".join(bytes(r) for g, _, r in rows if g == f)
        name = f if f == "a.warc" else f + ".gz"
        (tmp_path / name).write_bytes(data if f == "a.warc" else gzip.compress(data))
    got = sorted((r.file.removesuffix(".gz"), r.offset, bytes(r.record)) for r in merkle.read_archives(spark, str(tmp_path)).collect())
    assert got == sorted((f, o, bytes(r)) for f, o, r in rows)
    assert merkle.split_records(b"junk") == [(0, 4)] and merkle.split_records(b"") == []
    made = spark.createDataFrame([("u", "é<p>"), (None, None)], "u string, h string").select(merkle.record_bytes(F.col("u"), F.col("h")).alias("r"))
    for r in made.collect():
        assert merkle.split_records(bytes(r.r) * 2) == [(0, len(r.r)), (len(r.r), len(r.r))]


def test_nulls_and_repeated_rows(spark):
    rows = [("a", 0, b"x"), ("a", 0, b"x"), ("a", 9, b"y")]
    left = digested(spark, rows)
    assert merkle.audit(left, digested(spark, rows), SMALL).count() == 0
    assert [r.status for r in merkle.audit(left, digested(spark, rows[1:]), SMALL).collect()] == ["changed"]
    blank = merkle.digests(spark.createDataFrame([("a", 0, None, "e")], "file string, offset bigint, record binary, digest string"))
    assert blank.first().digest == hashlib.sha256(b"").hexdigest()

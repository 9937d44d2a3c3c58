"""N-gram Jaccard join with a MinHash LSH forest.

Texts become sets of five-word shingles; texts with the same set are one node, so copies cost
one row each. A tree orders the nodes by a sequence of MinHash values, and the nodes below a
prefix of that sequence are candidates of each other. Prefixes start at the greatest depth
that is expected to lose at most `loss` of the pairs at the threshold. A link is late if no
tree holds it one value deeper: links that are late here and links that are still missing stand
in a known ratio at the threshold. While the loss that this ratio gives for the late links
counted in the corpus is above `loss`, prefixes are shortened by one value. Candidates are
verified exactly on their shingle sets.

No pair is emitted. The members of a prefix go to tasks in blocks of bounded bytes and number; a
prefix that is larger than a block becomes several that meet two by two. A task counts each pair
in the first tree that holds it, adds up links per node and reduces them to a spanning forest. Classes are the
connected components of these edges, found by label propagation with shortcuts, every round
written to the shared folder.

Defined results: texts without words link to nothing; texts of fewer than five words are one
shingle of all their words; rows with equal texts are links of each other. Rows with a null
doc_id take part, and their class gets the smallest doc_id that is not null, if any.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspan.llm.batches import Rolling, Words, bounded, mix, pieces, quoted
from quantspan.session import materialize


@dataclass(frozen=True)
class Settings:
    words: int = 5
    similarity: float = 0.8
    trees: int = 24
    deepest: int = 12
    recall: float = 0.985  # at the threshold, which any depth has at least
    loss: float = 1e-4  # of pairs at the threshold: expected at the start, estimated at the end
    block: int = 2_048  # sets of a block, at most
    block_bytes: int = 8 << 20  # of their shingles, about; a longer set is a block of its own
    seed: int = 1

    def chance(self, similarity, depth: int):
        """That two sets of this similarity share a prefix of this depth in some tree."""
        return 1 - (1 - similarity**depth) ** self.trees

    def start(self) -> int:
        """The deepest prefix that is expected to lose no more than `loss` at the threshold."""
        least = max(self.recall, 1 - self.loss)
        return max([d for d in range(1, self.deepest) if self.chance(self.similarity, d) >= least], default=1)

    def missing(self, late: float, depth: int) -> float:
        """Links expected to be missing at this depth where so many are late."""
        here, deeper = (1 - self.chance(self.similarity, d) for d in (depth, depth + 1))
        return late * here / (deeper - here)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the different shingles of each text, by text and hash."""
    rolling = Rolling(w.hashes())
    start = np.flatnonzero(w.doc[n - 1 :] == w.doc[: len(w.doc) - n + 1]) if len(w.doc) >= n else np.zeros(0, np.int64)
    doc, h = w.doc[start], rolling(start, start + n)
    counts = w.counts()
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        first = np.searchsorted(w.doc, short)
        doc = np.concatenate([doc, short])
        h = np.concatenate([h, rolling(first, first + counts[short])])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[keep], h[keep]


def set_keys(doc: np.ndarray, h: np.ndarray, n: int) -> list[bytes | None]:
    """128 bits for each text's set, None for an empty one."""
    out = np.zeros((n, 2), np.uint64)
    there = np.unique(doc)
    if len(there):
        first = np.searchsorted(doc, there)
        out[there, 0] = np.add.reduceat(mix(h), first)
        out[there, 1] = np.add.reduceat(mix(h ^ np.uint64(0xD1B54A32D192ED03)), first)
    raw = out.tobytes()
    has = np.zeros(n, bool)
    has[there] = True
    return [raw[16 * i : 16 * i + 16] if has[i] else None for i in range(n)]


def prefixes(doc: np.ndarray, h: np.ndarray, n: int, depth: int, s: Settings, deeper: np.ndarray | None = None) -> np.ndarray:
    """For each text and tree, a hash of the first `depth` MinHash values.

    `deeper`, an array of bytes by text and tree, gets eight bits of the hash with one value more.
    """
    rng = np.random.default_rng(s.seed)
    odd = rng.integers(1, 1 << 62, (s.trees, s.deepest), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((n, s.trees), np.uint64)
    there = np.unique(doc)
    if not len(there):
        return out
    first = np.searchsorted(doc, there)
    for t in range(s.trees):
        value = np.full(len(there), t, np.uint64)
        for k in range(depth):
            value = mix(value ^ np.minimum.reduceat(h * odd[t, k], first))
        out[there, t] = value
        if deeper is not None:
            deeper[there, t] = mix(value ^ np.minimum.reduceat(h * odd[t, depth], first)) >> np.uint64(56)
    return out


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(o, doc_id, text): o is the id, or a hash of the text where the id is null."""
    i, t = F.col(quoted(doc_id)).cast("long"), F.col(quoted(text))
    hashed = F.lit(1 << 62) + F.xxhash64(t).bitwiseAND(F.lit((1 << 61) - 1))
    return docs.select(F.coalesce(i, hashed).alias("o"), i.alias("doc_id"), t.alias("text"))


def signatures(rows: DataFrame, depth: int, s: Settings) -> DataFrame:
    """-> (o, doc_id, sid, prefixes, deeper, size in shingles)"""

    def run(batches):
        for batch, texts in pieces(batches):
            doc, h = shingles(Words(texts), s.words)
            deeper = np.zeros((len(texts), s.trees), np.uint8)
            p = prefixes(doc, h, len(texts), depth, s, deeper).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(set_keys(doc, h, len(texts)), pa.binary()),
                    pa.array(list(p), pa.list_(pa.int64())),
                    pa.array([x.tobytes() for x in deeper], pa.binary()),
                    pa.array(np.bincount(doc, minlength=len(texts)), pa.int64()),
                ],
                ["o", "doc_id", "sid", "prefixes", "deeper", "size"],
            )

    bounded(rows.sparkSession)
    return rows.mapInArrow(run, "o bigint, doc_id bigint, sid binary, prefixes array<bigint>, deeper binary, size bigint")


def shingle_sets(rows: DataFrame, s: Settings) -> DataFrame:
    """-> (sid, shingles binary: sorted 64-bit hashes)"""

    def run(batches):
        for _, texts in pieces(batches):
            doc, h = shingles(Words(texts), s.words)
            raw = h.tobytes()
            cut = 8 * np.searchsorted(doc, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(set_keys(doc, h, len(texts)), pa.binary()),
                    pa.array([raw[a:b] for a, b in zip(cut, cut[1:])], pa.binary()),
                ],
                ["sid", "shingles"],
            )

    return rows.mapInArrow(run, "sid binary, shingles binary")


def candidates(nodes: DataFrame, s: Settings) -> DataFrame:
    """Members of every prefix with two nodes or more, cut into blocks.

    -> (task, tree, side, sid, copies, prefixes, deeper). A task holds one block (side 0), or two
    blocks (sides 0 and 1) that meet. Prefixes with the same members count in the first tree.
    """
    placed = nodes.select("sid", "size", F.posexplode("prefixes").alias("tree", "prefix"))
    shared = (
        placed.groupBy("tree", "prefix")
        .agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("sid").cast("decimal(38,0)")).alias("members"),
            F.sum("size").alias("shingles"),
        )
        .where("n > 1")
    )
    # Equal members: equal counts and sums of hashes.
    distinct = shared.groupBy("n", "members").agg(
        F.min("tree").alias("tree"), F.min_by("prefix", "tree").alias("prefix"), F.min("shingles").alias("shingles")
    )
    blocks = F.least("n", F.greatest(F.ceil(F.col("n") / s.block), F.ceil(F.col("shingles") * 8 / s.block_bytes))).cast("int")
    member = (
        placed.join(distinct.select("tree", "prefix", blocks.alias("blocks")), ["tree", "prefix"])
        .withColumn("own", F.expr("cast(pmod(xxhash64(sid), blocks) AS int)"))
        # Block b is side 0 of (b, c) for c >= b and side 1 of (c, b) for c < b.
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select(
            F.xxhash64("tree", "prefix", F.least("own", "other"), F.greatest("own", "other")).alias("task"),
            "tree",
            F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"),
            "sid",
        )
    )
    return member.join(nodes.select("sid", "copies", "prefixes", "deeper"), "sid")


def _verified(block: list, s: Settings):
    """Links of one task -> rows (sid, links, root, found, late)"""
    tree, side = block[0][0], np.array([m[1] for m in block])
    sets = [m[6] for m in block]
    size = np.array([len(x) for x in sets])
    copies = np.array([m[3] for m in block])
    prefix = np.stack([m[4] for m in block])
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = not len(second)
    if alone:
        second = first
    # Pairs of this tree that no tree before it has.
    here = prefix[first, tree][:, None] == prefix[second, tree]
    for t in range(tree):
        here &= prefix[first, t][:, None] != prefix[second, t]
    if alone:
        here &= np.triu(np.ones(here.shape, bool), 1)
    if not here.any():
        return []
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    often = np.bincount(column, minlength=len(values)) > 1
    number = np.cumsum(often) - 1
    row, column = row[often[column]], number[column[often[column]]]
    common = np.zeros((len(first), len(second)), np.float32)
    n_columns = int(often.sum())
    place = np.empty(len(sets), np.int64)
    wide = max(64, (8 << 20) // len(sets))  # columns whose indicators take 32 MB
    for lo in range(0, n_columns, wide):
        inside = (column >= lo) & (column < lo + wide)
        dense = np.zeros((len(sets), min(wide, n_columns - lo)), np.float32)
        dense[row[inside], column[inside] - lo] = 1
        common += dense[first] @ dense[second].T
    union = size[first][:, None] + size[second][None, :] - common
    link = here & (common >= s.similarity * union - 1e-6)
    if not link.any():
        return []
    a, b = np.nonzero(link)
    a, b = first[a], second[b]
    deeper = np.stack([m[5] for m in block])
    early = np.concatenate(
        [((prefix[a[k : k + 4096]] == prefix[b[k : k + 4096]]) & (deeper[a[k : k + 4096]] == deeper[b[k : k + 4096]])).any(axis=1) for k in range(0, len(a), 4096)]
    )
    links = np.bincount(a, weights=copies[b], minlength=len(sets)) + np.bincount(b, weights=copies[a], minlength=len(sets))
    late = np.bincount(a, weights=~early, minlength=len(sets))
    found = np.bincount(a, minlength=len(sets))
    place[:] = np.arange(len(sets))
    while True:
        low = place.copy()
        np.minimum.at(low, a, place[b])
        np.minimum.at(low, b, place[a])
        low = low[low]
        if (low == place).all():
            break
        place = low
    return [
        (block[i][2], int(links[i]), block[place[i]][2], int(found[i]), int(late[i]))
        for i in np.flatnonzero(links > 0)
    ]


def verify(member: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """-> (sid, links, root, found, late): per task, its nodes with links"""
    dealt = member.join(sets, "sid").repartition("task").sortWithinPartitions("task", "sid")

    def run(batches):
        task, block = None, []
        schema = pa.schema([("sid", pa.binary()), ("links", pa.int64()), ("root", pa.binary()), ("found", pa.int64()), ("late", pa.int64())])

        def done(out):
            if len(block) > 1:
                out += _verified(block, s)

        for batch in batches:
            out = []
            for r in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("task", "tree", "side", "sid", "copies", "prefixes", "deeper", "shingles")]):
                if r[0] != task:
                    done(out)
                    task, block = r[0], []
                block.append((*r[1:5], np.array(r[5], np.int64), np.frombuffer(r[6], np.uint8), np.frombuffer(r[7], np.uint64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
        out = []
        done(out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    return dealt.mapInArrow(run, "sid binary, links bigint, root binary, found bigint, late bigint")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) -> (sid, root): the smallest sid of each component."""
    both = materialize(
        edges.where("a != b").select("a", "b").unionByName(edges.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "edges",
    )
    label = materialize(both.groupBy("a").agg(F.min("b").alias("r")).select(F.col("a").alias("sid"), F.least("a", "r").alias("root")), "labels")
    while True:
        # The smallest label around each node, then the label of that label.
        around = both.join(label.select(F.col("sid").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        near = label.join(around, label["sid"] == around["a"]).select("sid", F.col("root").alias("before"), F.least("root", "r").alias("root"))
        jump = label.select(F.col("sid").alias("root"), F.col("root").alias("further"))
        after = materialize(
            near.join(jump, "root", "left").select("sid", "before", F.coalesce(F.least("root", "further"), "root").alias("root")), "labels"
        )
        changed = after.where("before != root").limit(1).count()
        label = after.select("sid", "root")
        if not changed:
            return label


def forest(rows: DataFrame, s: Settings) -> tuple[int, DataFrame, DataFrame, DataFrame]:
    """The depth at the end; the signatures, nodes and links there."""
    depth = s.start()
    while True:
        signed = materialize(signatures(rows, depth, s), "signatures")
        # One row per set: copies are counted, and one of them brings the prefixes.
        nodes = (
            signed.where("sid IS NOT NULL")
            .groupBy("sid")
            .agg(F.min("o").alias("o"), F.count("*").alias("copies"), F.max("prefixes").alias("prefixes"), F.max("deeper").alias("deeper"), F.max("size").alias("size"))
        )
        nodes = materialize(nodes, "nodes")
        member = materialize(candidates(nodes, s), "members")
        wanted = member.select("sid").distinct().join(nodes.select("sid", "o"), "sid").select("o").distinct()
        texts = rows.select("o", "text").join(wanted, "o").groupBy("o", F.xxhash64("text").alias("k")).agg(F.min("text").alias("text"))
        sets = shingle_sets(texts.select("text"), s).groupBy("sid").agg(F.min("shingles").alias("shingles"))
        links = materialize(verify(member, sets, s), "links")
        total = links.agg(F.sum("found").alias("found"), F.sum("late").alias("late")).first()
        if depth == 1 or not total["found"] or s.missing(total["late"], depth) <= s.loss * total["found"]:
            return depth, signed, nodes, links
        depth -= 1


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """-> (o, doc_id, sid, class_id, n_links), one row per row of `docs`.

    class_id is the smallest id of the class (o where a row has none), n_links the number of
    other rows that are similar enough.
    """
    _, signed, nodes, links = forest(_rows(docs, doc_id, text), s)
    root = components(links.select(F.col("sid").alias("a"), F.col("root").alias("b")))
    linked = links.groupBy("sid").agg(F.sum("links").alias("links"))
    first = nodes.select("sid", "copies", F.col("o").alias("first"))
    grouped = first.join(root, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    classes = grouped.groupBy("root").agg(F.min("first").alias("class_id"))
    # Only sets with copies or links differ from a row alone in its class.
    known = (
        grouped.join(linked, "sid", "left")
        .where("copies > 1 OR links IS NOT NULL")
        .join(classes, "root")
        .select("sid", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    return signed.select("o", "doc_id", "sid").join(known, "sid", "left").select(
        "o", "doc_id", "sid", F.coalesce("class_id", "o").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """The rows of `docs` with the smallest id of their class, unchanged; one row of each class.

    Texts without words have no class and stay.
    """
    found = join(docs, doc_id, text, s)
    name = "class_order"
    while name in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    go = found.where("sid IS NOT NULL AND class_id != o").select(F.col("o").alias(name)).distinct()
    i, t = F.col(quoted(doc_id)).cast("long"), F.col(quoted(text))
    keyed = docs.withColumn(name, F.coalesce(i, F.lit(1 << 62) + F.xxhash64(t).bitwiseAND(F.lit((1 << 61) - 1))))
    kept = keyed.join(go, name, "left_anti")
    # Rows that repeat the id and the words of the row that stays.
    again = found.where("sid IS NOT NULL AND class_id = o").groupBy("o").count().where("count > 1").select(F.col("o").alias(name))
    if again.limit(1).count():
        once = kept.join(again, name, "left_semi").dropDuplicates([name])
        kept = kept.join(again, name, "left_anti").unionByName(once)
    return kept.drop(name)

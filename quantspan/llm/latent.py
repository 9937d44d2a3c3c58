"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into blocks of words; three blocks in a row are a passage. Passages are TF-IDF
vectors over hashed words. A randomised SVD (products with the Gram matrix, summed over the
tasks by feature block) of all passages together with the benchmark items gives the latent
space. Items longer than a passage are cut into parts of equal size. Every
passage of every text is projected there and compared with all parts of items: a candidate has
the cosine, and enough of the part's latent content. Candidates are with the whole item
then compared word by word: the longest common subsequence of content words must cover most
of the item, and enough of its answer (its last sentence), which also finds paraphrases.

The space is fitted on every passage of every different text, and all passages are searched.
Items are searched in blocks of `item_block`, one pass over the texts each, so that what a
task holds is bounded. Defined results: null and empty texts, and items without words, match
nothing; a text is listed once for each item it holds; items with equal texts match alike.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspan.llm.batches import Rolling, Words, bounded, mix, pick, pieces
from quantspan.session import materialize

BITS = 14
SIZE = 1 << BITS
PARTS = 128  # pieces that sums of products are added up in
TOGETHER = 24  # passages whose counts are one dense table


@dataclass(frozen=True)
class Settings:
    block: int = 16  # words
    blocks: int = 3  # per passage
    rank: int = 96
    rounds: int = 2
    item_weight: float = 10.0
    balance: int = 20_000  # among more passages items weigh more, as much as among so many
    cosine: float = 0.35
    content: float = 0.5  # of the latent content of an item's part
    # With few passages both limits are lower, see `limits`.
    rare: float = 2.5  # words of a lower idf have no place in the latent space
    common: float = 3.5  # words of a lower idf do not count in the word-by-word check
    least_words: int = 4  # fewer content words than that: all words count
    covered: float = 0.6  # of the item's content words, in order
    answer: float = 0.5  # of its answer's
    item_block: int = 4_096
    seed: int = 3


    def limits(self, passages: int) -> Settings:
        most = float(np.log(passages + 2))
        return replace(self, rare=min(self.rare, 0.4 * most), common=min(self.common, 0.6 * most))


_lower: list[np.ndarray] = []  # for each code: that of the small letter, mixed; whether it is part of a word


def _words(texts: list[str]) -> tuple[Words, np.ndarray]:
    """Runs of letters and digits, and their hashes without regard to case."""
    if not _lower:
        codes = np.arange(1 << 16, dtype=np.uint64)
        for i in range(1 << 16):
            low = chr(i).lower()
            codes[i] = ord(low) if len(low) == 1 else i
        _lower.append(mix(codes + np.uint64(1)))
        _lower.append(np.array([chr(i).isalnum() for i in range(1 << 16)]))
    w = Words(texts, lambda c: np.take(_lower[1], c, mode="clip"))
    values = np.take(_lower[0], w.codes, mode="clip")
    high = np.flatnonzero(w.codes >> np.uint32(16))
    values[high] = mix(w.codes[high].astype(np.uint64) + np.uint64(1))
    return w, Rolling(values)(w.starts, w.ends)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def cut_blocks(doc: np.ndarray, n_docs: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and text of each block of `size` words."""
    counts = np.bincount(doc, minlength=n_docs)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = np.flatnonzero(within % size == 0)
    return first, doc[first]


def _sums(x: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Of every row, the sum of it and the next n - 1 rows of its text."""
    out = x.copy()
    for k in range(1, min(n, len(x))):
        same = doc[k:] == doc[:-k]
        out[:-k][same] += x[k:][same]
    return out


def passage_rows(docs: DataFrame, s: Settings) -> DataFrame:
    """-> (features binary): the buckets of the words of every passage, all with repeats.

    Of texts that are equal one counts; what moves for that are their buckets, two bytes a word.
    """
    width = s.block * s.blocks

    def buckets(batches):
        for batch, texts in pieces(batches):
            w, h = _words(texts)
            counts = w.counts()
            there = np.flatnonzero(counts)
            raw = _binary(_bucket(h).astype("<u2"), counts[there])
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(there)), raw], ["h", "features"])

    def cut(batches):
        for batch in batches:
            flat, sizes = _flat(batch.column(1), "<u2")
            first, _ = cut_blocks(np.repeat(np.arange(len(sizes)), sizes), len(sizes), width)
            yield pa.RecordBatch.from_arrays([_binary(flat.astype("<i4"), np.diff(np.append(first, len(flat))))], ["features"])

    bounded(docs.sparkSession)
    keyed = docs.where("text IS NOT NULL").select("text", F.xxhash64("text").alias("h"))
    texts = keyed.mapInArrow(buckets, "h bigint, features binary").groupBy("h").agg(F.min("features").alias("features"))
    return materialize(texts.mapInArrow(cut, "features binary"), "passages")


sample_rows = passage_rows  # the name of the time when a sample was drawn


def _binary(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values of `sizes` items each, one after the other in `flat`."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * flat.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes())]
    ).cast(pa.binary())


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The items of binary values, one after the other, and the number of each."""
    sizes = np.asarray(pc.binary_length(column), np.int64) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(column.to_pylist()), kind), sizes


def _totals(rows: DataFrame) -> DataFrame:
    """Sums of (part, sums) by part, a running sum for each."""

    def run(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums = np.frombuffer(raw, np.float32)
                totals[part] = totals[part] + sums if part in totals else sums.astype(float)
        raw = [t.astype(np.float32).tobytes() for t in totals.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(raw, pa.binary())], ["part", "sums"])

    return rows.repartition("part").mapInArrow(run, "part int, sums binary")


def _gram(rows: DataFrame, idf: np.ndarray, x: np.ndarray, items: list[np.ndarray], weight: float) -> np.ndarray:
    """A'A x for all passages and the weighted items."""
    context = rows.sparkSession.sparkContext
    shared = context.broadcast((idf.astype(np.float32), x.astype(np.float32)))  # SIZE * rank

    def run(batches):
        own, y = shared.value
        scaled = own[:, None] * y
        total = np.zeros_like(y)
        for batch in batches:
            flat, sizes = _flat(batch.column(0), "<i4")
            add_gram(total, flat, sizes, own, scaled, 1.0)
        step = SIZE // PARTS
        parts = [total[i : i + step].tobytes() for i in range(0, SIZE, step)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], ["part", "sums"])

    # Few tasks that read much each: what a task sends is as large as the space.
    few = rows.coalesce(2 * context.defaultParallelism)
    parts = sorted(_totals(few.mapInArrow(run, "part int, sums binary")).collect(), key=lambda r: r["part"])
    total = np.concatenate([np.frombuffer(r["sums"], np.float32) for r in parts]).reshape(SIZE, -1).copy() if parts else np.zeros_like(x, np.float32)
    sizes = np.array([len(f) for f in items], np.int64)
    flat = np.concatenate([np.zeros(0, np.int64), *items])
    add_gram(total, flat, sizes, idf.astype(np.float32), (idf[:, None] * x).astype(np.float32), weight**2)
    return total.astype(float)


def add_gram(total: np.ndarray, flat: np.ndarray, sizes: np.ndarray, idf: np.ndarray, scaled: np.ndarray, weight: float) -> None:
    """Add each passage's idf-weighted counts times its projection; `scaled` is idf times x."""
    passage = np.repeat(np.arange(len(sizes)), sizes)
    placed = idf[flat] > 0
    flat, passage = flat[placed], passage[placed]
    edges = np.searchsorted(passage, np.arange(0, len(sizes) + TOGETHER, TOGETHER))
    there, place = np.zeros(SIZE, bool), np.zeros(SIZE, np.int64)
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        there[flat[a:b]] = True
        feature = np.flatnonzero(there)
        there[feature] = False
        place[feature] = np.arange(len(feature))
        cells = (passage[a:b] - k * TOGETHER) * len(feature) + place[flat[a:b]]
        counts = np.bincount(cells, minlength=TOGETHER * len(feature)).reshape(TOGETHER, -1).astype(np.float32)
        total[feature] += (np.float32(weight) * idf[feature])[:, None] * (counts.T @ (counts @ scaled[feature]))


def different(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The buckets of every passage, each once a passage; passages are short."""
    sizes, first = sizes[sizes > 0], (np.cumsum(sizes) - sizes)[sizes > 0]
    if not len(sizes):
        return flat[:0]
    # As wide as the longest; the others end in repeats of their last.
    table = flat[first[:, None] + np.minimum(np.arange(sizes.max()), sizes[:, None] - 1)]
    table.sort(axis=1)
    new = np.ones(table.shape, bool)
    np.not_equal(table[:, 1:], table[:, :-1], out=new[:, 1:])
    return table[new]


@dataclass
class Space:
    idf: np.ndarray
    basis: np.ndarray  # feature x rank: right singular vectors, scaled by idf
    settings: Settings


def fit(docs: DataFrame, items: list[str], s: Settings, rows: DataFrame | None = None) -> Space:
    """The space of all passages of `docs` and the items; `rows` are the passages, if known."""
    rows = passage_rows(docs, s) if rows is None else rows
    hashed = [_bucket(_words([t])[1]) for t in items]

    def frequencies(batches):
        total = np.zeros(SIZE + 1, np.int64)
        for batch in batches:
            flat, sizes = _flat(batch.column(0), "<i4")
            total[:SIZE] += np.bincount(different(flat, sizes), minlength=SIZE)
            total[SIZE] += len(sizes)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], ["feature", "n"])

    counted = rows.mapInArrow(frequencies, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))
    df = np.zeros(SIZE + 1, np.int64)
    for r in counted.collect():  # SIZE + 1 rows at most; the last is the number of passages
        df[r["feature"]] = r["n"]
    n, df = int(df[SIZE]), df[:SIZE]
    idf = np.log((n + 2) / (df + 1))
    s = s.limits(n)
    weight = s.item_weight * max(1.0, n / s.balance) ** 0.5
    plain, idf = idf, np.where(idf >= s.rare, idf, 0.0)
    rng = np.random.default_rng(s.seed)
    x, r = np.linalg.qr(rng.standard_normal((SIZE, s.rank)))
    for _ in range(s.rounds):
        x, r = np.linalg.qr(_gram(rows, idf, x, hashed, weight))
    # The last product's own singular values tell its directions from rounding: no further product is
    # needed, since cosines and contents are the same in any basis of a space.
    turn, values, _ = np.linalg.svd(r)
    real = values > 1e-6 * max(values.max(), 1e-9)  # fewer texts than `rank` leave empty directions
    return Space(plain, (idf[:, None] * (x @ turn) * real).astype(np.float32), s)


@dataclass
class Items:
    ids: list[int]
    latent: np.ndarray  # of the parts
    part_of: np.ndarray  # for each part, the place of its item
    length: list[int]  # in words
    words: list[np.ndarray]  # content words in order
    sets: list[frozenset]
    all_words: list[bool]  # too few content words: all count
    answer: list[int]  # of the words, how many at the end are the answer's


def prepare(ids: list[int], texts: list[str], space: Space) -> Items:
    s = space.settings
    latent, part_of, length = [], [], []
    words, every, answers = [], [], []
    for i, t in enumerate(texts):
        w, h = _words([t])
        content = space.idf[_bucket(h)] >= s.common
        if content.sum() < s.least_words:
            content[:] = True
        n_parts = max(1, -(-len(h) // (s.block * s.blocks)))
        for part in np.array_split(_bucket(h), n_parts):
            latent.append(space.basis[part].sum(0))
        part_of += [i] * n_parts
        length.append(len(h))
        words.append(h[content])
        every.append(bool(content.all()))
        # The last sentence is the answer, at least a fifth of the item's words.
        body = t.rstrip()
        cut = max(body[:-1].rfind(". "), body[:-1].rfind("? "), body[:-1].rfind("\n"))
        last = content & (w.starts > cut) if cut >= 0 else content
        answers.append(max(int(last.sum()), -(-int(content.sum()) // 5)))
    latent = np.array(latent, np.float32).reshape(-1, space.basis.shape[1])
    return Items(ids, latent, np.array(part_of, np.int64), length, words, [frozenset(x.tolist()) for x in words], every, answers)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, with one bit per element of `a`."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        m = masks.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def block_sums(basis: np.ndarray, bucket: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of every block of words, the sum of its buckets' rows; blocks begin at `first`."""
    sizes = np.diff(np.append(first, len(bucket)))
    order = np.argsort(-sizes, kind="stable")  # those that still have a word come first
    out = np.empty((len(first), basis.shape[1]), basis.dtype)
    for lo in range(0, len(first), 2_048):
        mine = order[lo : lo + 2_048]
        at, size = first[mine], sizes[mine]
        sums = np.take(basis, bucket[at], axis=0)
        for k in range(1, size[0]):
            n = np.searchsorted(-size, -k)  # sizes above k
            sums[:n] += np.take(basis, bucket[at[:n] + k], axis=0)
        out[mine] = sums
    return out


def search(texts: list[str], space: Space, items: Items) -> list[tuple[int, int, float, float]]:
    """(text, item id, cosine, covered) of what passes all checks."""
    s = space.settings
    w, h = _words(texts)
    if not len(h) or not len(items.ids):
        return []
    bucket = _bucket(h)
    first, doc = cut_blocks(w.doc, w.n_docs, s.block)
    latent = block_sums(space.basis, bucket, first)
    latent = _sums(latent, doc, s.blocks)
    own = np.maximum(np.einsum("ij,ij->i", items.latent, items.latent), 1e-9)
    norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", latent, latent)), 1e-9)
    found: dict[tuple[int, int], list[tuple[int, float]]] = {}
    step = max(1, min(8_192, 8_192 * s.item_block // len(own)))
    for lo in range(0, len(first), step):
        dots = latent[lo : lo + step] @ items.latent.T
        p_at, k_at = np.nonzero(dots >= s.content * own)
        near = dots[p_at, k_at] >= s.cosine * np.sqrt(own[k_at]) * norm[lo + p_at]
        p_at, k_at = p_at[near], k_at[near]
        cosine = dots[p_at, k_at] / np.sqrt(own[k_at]) / norm[lo + p_at]
        p_at += lo
        for d, i, p, c in zip(doc[p_at].tolist(), items.part_of[k_at].tolist(), p_at.tolist(), cosine.tolist()):
            found.setdefault((d, i), []).append((p, c))
    content = space.idf[bucket] >= s.common
    word_of = np.searchsorted(w.doc, np.arange(w.n_docs + 1))
    out = []
    for (d, i), places in found.items():
        item = items.words[i]
        if not len(item):
            continue
        best = (0.0, 0.0)
        # Neighbouring passages are one stretch of the text; any part of a long item may be missed.
        margin = max(s.block * s.blocks, items.length[i])
        gap = -(-margin // s.block)
        at = 0
        while at < len(places):
            start = end = at
            while end + 1 < len(places) and places[end + 1][0] <= places[end][0] + gap:
                end += 1
            lo = max(word_of[d], first[places[at][0]] - margin)
            hi = min(word_of[d + 1], first[places[end][0]] + s.block * s.blocks + margin)
            there = h[lo:hi] if items.all_words[i] else h[lo:hi][content[lo:hi]]
            at = end + 1
            # Different words in common are counted first, which is quicker.
            if len(items.sets[i].intersection(there.tolist())) < s.covered * len(items.sets[i]):
                continue
            share = common_subsequence(item, there) / len(item)
            k = items.answer[i]
            if share >= s.covered and share > best[1] and common_subsequence(item[len(item) - k :], there) >= s.answer * k:
                best = (max(c for _, c in places[start : end + 1]), share)
        if best[1]:
            out.append((d, items.ids[i], *best))
    return out


def _benchmark(benchmark: DataFrame, s: Settings) -> list[tuple[list[int], list[str]]]:
    """The items in blocks; the stated query set, one row per item."""
    rows = pick(benchmark, item_id="item_id", text="text").where("item_id IS NOT NULL").orderBy("item_id", "text").collect()
    return [
        ([r["item_id"] for r in rows[i : i + s.item_block]], [r["text"] or "" for r in rows[i : i + s.item_block]])
        for i in range(0, len(rows), s.item_block)
    ]


def matches(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """-> (doc_id, item_id, cosine, covered): every document and the items that it holds."""
    spark = docs.sparkSession
    schema = "doc_id bigint, item_id bigint, cosine double, covered double"
    rows = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out, fitted = None, None
    for ids, texts in _benchmark(benchmark, s):
        fitted = passage_rows(rows.select("text"), s) if fitted is None else fitted
        space = fit(rows.select("text"), texts, s, fitted)
        shared = spark.sparkContext.broadcast((space, prepare(ids, texts, space)))  # bounded by item_block

        def run(batches, shared=shared):
            for batch, part in pieces(batches):
                found = search(part, *shared.value)
                ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                rest = [pa.array([f[k] for f in found], t) for k, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64()))]
                yield pa.RecordBatch.from_arrays([ids, *rest], ["doc_id", "item_id", "cosine", "covered"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def without_matches(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings(), text: str = "text") -> DataFrame:
    """The rows of `docs`, unchanged, that hold no item."""
    from quantspan.llm.batches import arrow_filter

    texts_only, fitted = pick(docs, text=text), None
    for ids, texts in _benchmark(benchmark, s):
        fitted = passage_rows(texts_only, s) if fitted is None else fitted
        space = fit(texts_only, texts, s, fitted)
        shared = docs.sparkSession.sparkContext.broadcast((space, prepare(ids, texts, space)))

        def clean(part, shared=shared):
            keep = np.ones(len(part), bool)
            keep[[f[0] for f in search(part, *shared.value)]] = False
            return keep

        docs = arrow_filter(docs, clean, text)
    return docs

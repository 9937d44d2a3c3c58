"""Language-model scores: word counts of the corpus, and a causal self-attention model.

Texts are lower-cased (A-Z) and cut into words; every text ends with one end token. Words are
read into bundles of about `bundle` characters: each different word of a bundle is kept once, with
its hash, its subword ids and its count among the texts to learn from.

The word counts of the corpus are one shuffle of these bundle dictionaries by hash; what comes
back to a bundle are the words that also stand elsewhere. Subword counts set the model's classes and
its starting frequencies. The model learns in `rounds`: every task takes Adagrad steps on its own
bundles, the changes are averaged (by tokens; embeddings by how often a task saw the token) in
sums over keys, and only the averaged parameters, whose size the vocabulary fixes, meet in the driver.
A round takes every `every`-th window of each text, each round others; with `every = rounds`, as
it is set, every window of every text to learn from is learnt from once. Scores cover every token of every
text: windows overlap, and a token is scored in the first window that has it.

Defined results: null and empty texts have the end token only. Rows with a null id are scored
and never learnt from. Repeated rows count as often as they stand there. Without texts to learn
from, counts are zero and the model gives all tokens the same probability but for its random
start. Very long texts are a bundle of their own. Empty tables give no rows. Extra columns are
left out. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantspan.llm import attention
from quantspan.llm.batches import PIECE, Words, bounded, pick, pieces, spans
from quantspan.llm.pieces_bpe import encode_flat, load
from quantspan.session import materialize

BEGIN, END = 1, 2
CHUNK = 1024  # tokens whose embeddings share a key
BATCH = 128  # windows that go through the attention at once: what they need stays in the cache
STATES = 1 << 15  # positions whose outputs are computed at once, so that classes have many each


@dataclass(frozen=True)
class Settings:
    bundle: int = 1 << 22
    rounds: int = 2
    every: int = 2  # as many as rounds: every window is learnt from once
    batch: int = 64  # windows of a step
    overlap: int = 4
    rate: float = 0.15
    shape: attention.Shape = attention.Shape()


BUNDLE = pa.schema(
    [
        ("bundle", pa.int64()),
        ("ids", pa.list_(pa.int64())),
        ("learn", pa.binary()),  # of each text
        ("sizes", pa.binary()),  # words of each text
        ("words", pa.binary()),  # number of each word in the bundle's dictionary
        ("hashes", pa.list_(pa.int64())),
        ("counts", pa.list_(pa.int32())),  # of the dictionary's words in texts to learn from
        ("word_tokens", pa.binary()),
        ("word_sizes", pa.binary()),  # tokens of each word
        ("learned", pa.int64()),  # tokens to learn from, and those that are ends
        ("learned_ends", pa.int64()),
        ("tokens", pa.list_(pa.int32())),
        ("token_counts", pa.list_(pa.int64())),
    ]
)
BUNDLE_SQL = (
    "bundle bigint, ids array<bigint>, learn binary, sizes binary, words binary, hashes array<bigint>, counts array<int>, "
    "word_tokens binary, word_sizes binary, learned bigint, learned_ends bigint, tokens array<int>, token_counts array<bigint>"
)


def gathered(batches, limit: int):
    """(ids, learn, texts) of about `limit` characters each, across batches."""
    ids, learn, texts, size = [], [], [], 0
    for batch, part in pieces(batches, limit=limit):
        n = sum(map(len, part))
        if texts and size + n > limit:
            yield ids, np.array(learn, bool), texts
            ids, learn, texts, size = [], [], [], 0
        ids += batch.column(0).to_pylist()
        learn += batch.column(1).to_pylist()
        texts, size = texts + part, size + n
    if texts:
        yield ids, np.array(learn, bool), texts


def dictionary(texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """The different words of `texts`, lower-cased: their hashes in order, and the words;
    of each word there is its number among them, and of each text how many it has.

    The texts are read in pieces: what goes along with every character is there for one of them only.
    """
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    hashes, words, at, per_text, start = [], [], [], [], 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + PIECE, "right")))
        w = Words(texts[start:stop])
        w.codes = np.where((w.codes > 64) & (w.codes < 91), w.codes + np.uint32(32), w.codes)
        own, sample, place = np.unique(w.hashes(), return_index=True, return_inverse=True)
        lower = w.codes.tobytes().decode("utf-32-le", "surrogatepass")
        at.append(place.astype(np.int32) + np.int32(len(words)))
        words += [lower[a:b] for a, b in zip(w.starts[sample].tolist(), w.ends[sample].tolist())]
        hashes.append(own)
        per_text.append(w.counts())
        start = stop
    different, sample, place = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    return different, [words[i] for i in sample.tolist()], place.astype(np.int32)[np.concatenate(at)], np.concatenate(per_text)


def bundled(rows: DataFrame, model_path: str, s: Settings) -> DataFrame:
    """(id, learn, text) -> bundles"""
    vocabulary = rows.sparkSession.sparkContext.broadcast(load(model_path))  # size bound: the model's

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        kind = token_kind(len(vocabulary.value.pieces))
        for ids, learn, texts in gathered(batches, s.bundle):
            hashes, different, at, per_text = dictionary(texts)
            tokens, sizes = encode_flat(vocabulary.value, different)
            counts = np.bincount(at[np.repeat(learn, per_text)], minlength=len(hashes))
            token_counts = np.bincount(tokens, weights=np.repeat(counts, sizes)).astype(np.int64)
            token_counts = np.pad(token_counts, (0, max(0, END + 1 - len(token_counts))))
            token_counts[END] += learn.sum()
            found = np.flatnonzero(token_counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([learn.tobytes()]),
                    pa.array([per_text.astype(np.int32).tobytes()]),
                    pa.array([at.tobytes()]),
                    pa.array([hashes.view(np.int64)], pa.list_(pa.int64())),
                    pa.array([counts.astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([tokens.astype(kind).tobytes()]),
                    pa.array([sizes.astype(np.int32).tobytes()]),
                    pa.array([int(counts.sum() + learn.sum())], pa.int64()),
                    pa.array([int(learn.sum())], pa.int64()),
                    pa.array([found], pa.list_(pa.int32())),
                    pa.array([token_counts[found]], pa.list_(pa.int64())),
                ],
                schema=BUNDLE,
            )
            number += 1

    bounded(rows.sparkSession)
    return rows.mapInArrow(run, BUNDLE_SQL)


def elsewhere(bundles: DataFrame) -> DataFrame:
    """-> (bundle, slots, totals, first): counts of words that other bundles have too

    `first`: learnt words that no bundle before this one has, for the number of different words.
    """
    words = bundles.select("bundle", F.posexplode(F.arrays_zip("hashes", "counts")).alias("slot", "x")).select(
        "bundle", "slot", F.col("x.hashes").alias("h"), F.col("x.counts").alias("own")
    )
    # A bundle has a word once, so the groups are no larger than the number of bundles.
    same = W.partitionBy("h")
    total = words.withColumn("total", F.sum("own").over(same)).withColumn("least", F.min("bundle").over(same))
    other = F.col("total") != F.col("own")
    return total.groupBy("bundle").agg(
        F.collect_list(F.when(other, F.col("slot"))).alias("slots"),
        F.collect_list(F.when(other, F.col("total"))).alias("totals"),
        F.count_if((F.col("least") == F.col("bundle")) & (F.col("total") > 0)).alias("first"),
    )


def one_by_one(batch: pa.RecordBatch):
    """The rows of a batch; bundles are large, so one at a time is copied."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def token_kind(size: int) -> type:
    """The smallest numbers that name all tokens of a vocabulary."""
    return np.uint16 if size <= 1 << 16 else np.int32


def sequences(row: dict, size: int, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the bundle's texts, each with its end token, and their numbers.

    With `only`, texts for which it is false have none at all.
    """
    sizes = np.frombuffer(row["sizes"], np.int32).astype(np.int64)
    words = np.frombuffer(row["words"], np.int32).astype(np.int64)
    word_sizes = np.frombuffer(row["word_sizes"], np.int32).astype(np.int64)
    tokens = np.frombuffer(row["word_tokens"], token_kind(size))
    text = np.repeat(np.arange(len(sizes)), sizes)
    if only is not None:
        words, text = words[only[text]], text[only[text]]
    at = np.cumsum(word_sizes) - word_sizes
    flat = tokens[spans(at[words], word_sizes[words])]
    per_text = np.bincount(text, weights=word_sizes[words], minlength=len(sizes)).astype(np.int64)
    ends = np.ones(len(sizes), np.int64) if only is None else only.astype(np.int64)
    out = np.full(len(flat) + int(ends.sum()), END, np.int32)
    out[np.arange(len(flat)) + np.repeat(np.cumsum(ends) - ends, per_text)] = flat
    return out, per_text + ends


class Cuts:
    """Windows of texts that lie one after the other, as positions of a model's classes."""

    def __init__(self, classes: attention.Classes, flat: np.ndarray, sizes: np.ndarray, stride: int, window: int):
        self.text, self.begin, self.length, self.new = attention.windows(sizes, window, stride)
        self.base = (np.cumsum(sizes) - sizes)[self.text] + self.begin
        # One place before each target; a window may reach beyond the end.
        self.padded = np.concatenate([flat[:1], flat, np.full(window, END, flat.dtype)])
        self.padded = classes.position[self.padded]
        self.start = classes.position[BEGIN]

    def __call__(self, part: np.ndarray, wide: int):
        """Inputs and targets (windows, positions) of some windows, and which are there."""
        both = self.padded[self.base[part, None] + np.arange(wide + 1)]
        before, target = both[:, :-1].copy(), both[:, 1:]
        before[self.begin[part] == 0, 0] = self.start
        return before, target, np.arange(wide) < self.length[part, None]


def learnt(bundles: DataFrame, shared, turn: int, s: Settings) -> DataFrame:
    """Steps of every task on its own bundles -> (key, at, change, weight), ready to be added up"""
    width = s.shape.window

    def run(batches):
        classes, p = shared.value
        trainer = attention.Trainer(p, classes, s.rate)
        for batch in batches:
            for row in one_by_one(batch.select(["bundle", "learn", "sizes", "words", "word_tokens", "word_sizes"])):
                learn = np.frombuffer(row["learn"], bool)
                flat, sizes = sequences(row, len(p["seen"]), learn)
                cuts = Cuts(classes, flat, sizes, width, width)
                mine = (cuts.text + cuts.begin // width) % s.every == turn
                order = np.random.default_rng(row["bundle"] & 0xFFFFFFFF).permutation(np.flatnonzero(mine))
                for k in range(0, len(order), s.batch):
                    trainer.step(*cuts(order[k : k + s.batch], width))
        if not trainer.tokens:
            return
        n = np.float32(trainer.tokens)
        for name in attention.DENSE:
            yield _row(name, 0, None, n * (trainer.p[name] - p[name]), np.array([n]))
        for name in ("seen", "next"):
            touched = trainer.touched[name]
            change = trainer.p[name] - p[name]
            if name == "next":
                change = np.concatenate([change, (trainer.p["next_offset"] - p["next_offset"])[:, None]], axis=1)
            ids = np.flatnonzero(touched)
            for chunk in np.unique(ids // CHUNK):
                own = ids[ids // CHUNK == chunk]
                yield _row(name, int(chunk), own, touched[own, None] * change[own], touched[own])

    return bundles.select("bundle", "learn", "sizes", "words", "word_tokens", "word_sizes").mapInArrow(run, CHANGE)


CHANGE = "name string, chunk int, at binary, change binary, weight binary"


def _row(name, chunk, at, change, weight) -> pa.RecordBatch:
    columns = [[name], [chunk], [None if at is None else at.astype(np.int32).tobytes()]]
    columns += [[change.astype(np.float32).tobytes()], [weight.astype(np.float64).tobytes()]]
    types = [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["name", "chunk", "at", "change", "weight"])


def added(changes: DataFrame) -> DataFrame:
    """Sums of changes and weights by (name, chunk), a running sum for each key."""

    def run(batches):
        sums: dict = {}
        for batch in batches:
            for r in batch.to_pylist():
                weight = np.frombuffer(r["weight"], np.float64)
                change = np.frombuffer(r["change"], np.float32).reshape(len(weight), -1)
                key = (r["name"], r["chunk"])
                at = np.zeros(1, np.int64) if r["at"] is None else np.frombuffer(r["at"], np.int32) % CHUNK
                if key not in sums:
                    rows = 1 if r["at"] is None else CHUNK
                    sums[key] = np.zeros((rows, change.shape[1])), np.zeros(rows)
                total, times = sums[key]
                total[at] += change
                times[at] += weight
        for (name, chunk), (total, times) in sums.items():
            ids = None if name in attention.DENSE else chunk * CHUNK + np.flatnonzero(times)
            there = times > 0
            yield _row(name, chunk, ids, total[there], times[there])

    return changes.repartition("name", "chunk").mapInArrow(run, CHANGE)


def averaged(p: dict, sums: list) -> dict:
    """The parameters after a round; `sums` has at most one row for each part of them."""
    p = {k: v.copy() for k, v in p.items()}
    for r in sums:
        weight = np.frombuffer(r["weight"], np.float64)
        change = np.frombuffer(r["change"], np.float32).reshape(len(weight), -1) / weight[:, None]
        if r["name"] in attention.DENSE:
            p[r["name"]] += change.reshape(p[r["name"]].shape)
            continue
        at = np.frombuffer(r["at"], np.int32)
        wide = p[r["name"]].shape[1]
        p[r["name"]][at] += change[:, :wide].astype(np.float32)
        if r["name"] == "next":
            p["next_offset"][at] += change[:, wide].astype(np.float32)
    return p


def train(bundles: DataFrame, size: int, s: Settings) -> tuple[attention.Classes, dict]:
    """Classes and parameters, learnt from the texts that are marked for it."""
    counted = bundles.select(F.explode(F.arrays_zip("tokens", "token_counts")).alias("x")).groupBy("x.tokens").agg(F.sum("x.token_counts").alias("n"))
    counts = np.zeros(size)
    for r in counted.collect():  # at most one row for each token of the vocabulary
        counts[r["tokens"]] = r["n"]
    classes, p = attention.start(counts, s.shape)
    for turn in range(s.rounds if counts.any() else 0):
        shared = bundles.sparkSession.sparkContext.broadcast((classes, p))
        p = averaged(p, added(learnt(bundles, shared, turn, s)).collect())
    return classes, p


def text_scores(classes: attention.Classes, p: dict, flat: np.ndarray, sizes: np.ndarray, s: Settings) -> np.ndarray:
    """log10 probability of every text, each of its tokens scored once."""
    width = s.shape.window
    cuts = Cuts(classes, flat, sizes, width - s.overlap, width)
    out = np.zeros(len(sizes))
    # Windows of a like length together: short ones need no positions of the long ones. Those that go on
    # from another one need no states where they overlap it.
    for new in np.unique(cuts.new):
        own = np.flatnonzero(cuts.new == new)
        order = own[np.argsort(cuts.length[own].astype(np.int16), kind="stable")]
        for k in range(0, len(order), STATES // width):
            states, targets, texts = [], [], []
            for j in range(k, min(k + STATES // width, len(order)), BATCH):
                part = order[j : min(j + BATCH, k + STATES // width)]
                x, target, valid = cuts(part, int(cuts.length[part].max()))
                valid = valid[:, new:]
                states.append(attention.trunk(p, x, int(new))[-1].take(np.flatnonzero(valid), axis=0))
                targets.append(target[:, new:][valid])
                texts.append(np.repeat(cuts.text[part], valid.sum(axis=1)))
            logs = attention.log_probabilities(p, classes, np.concatenate(states), np.concatenate(targets))
            out += np.bincount(np.concatenate(texts), weights=logs, minlength=len(sizes))
    return out / np.log(10)


SCORES = "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score(docs: DataFrame, learn: Column, model_path: str, doc_id: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """-> (doc_id, n_tokens, n_known, train_tokens, base_score, score), one row per row of `docs`

    `learn` is a condition on the column id; where it is null, a text is not learnt from.
    """
    rows = pick(docs, id=doc_id, text=text).select(F.col("id").cast("long"), "text")
    rows = rows.select("id", F.coalesce(learn, F.lit(False)).alias("learn"), "text")
    bundles = materialize(bundled(rows, model_path, s), "bundles")
    others = materialize(elsewhere(bundles), "word-counts")
    total = bundles.agg(F.sum("learned").alias("n"), F.sum("learned_ends").alias("ends")).first()
    n, ends = total["n"] or 0, total["ends"] or 0
    different = (others.agg(F.sum("first")).first()[0] or 0) + (ends > 0)
    vocabulary = load(model_path)
    classes, p = train(bundles, len(vocabulary.pieces), s)
    shared = bundles.sparkSession.sparkContext.broadcast((classes, p))
    below = np.log10(n + 0.1 * (different + 1))

    def model(batches):
        classes, p = shared.value
        for batch in batches:
            for row in one_by_one(batch):
                flat, per_text = sequences(row, len(p["seen"]))
                yield pa.RecordBatch.from_pydict({"bundle": [row["bundle"]], "scores": [text_scores(classes, p, flat, per_text, s)]})

    def base(batches):
        for batch in batches:
            for i, row in enumerate(one_by_one(batch.select(["bundle", "ids", "sizes", "words", "scores"]))):
                counts, slots, totals = (np.asarray(batch.column(c)[i].values, np.int64) if batch.column(c)[i].is_valid else () for c in ("counts", "slots", "totals"))
                counts = counts.copy()
                counts[slots if len(slots) else []] = totals
                words = np.frombuffer(row["words"], np.int32)
                sizes = np.frombuffer(row["sizes"], np.int32).astype(np.int64)
                text = np.repeat(np.arange(len(sizes)), sizes)
                worth = np.bincount(text, weights=(np.log10(counts + 0.1) - below)[words], minlength=len(sizes))
                known = np.bincount(text, weights=(counts > 0)[words], minlength=len(sizes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["ids"], pa.int64()),
                        pa.array(sizes + 1),
                        pa.array(known + (ends > 0)),
                        pa.array(np.full(len(sizes), n, np.int64)),
                        pa.array(worth + np.log10(ends + 0.1) - below),
                        pa.array(row["scores"], pa.float64()),
                    ],
                    ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    # The model needs no counts: its tokens stay where they are, and only words move to their counts.
    scored = bundles.select("bundle", "sizes", "words", "word_tokens", "word_sizes").mapInArrow(model, "bundle bigint, scores array<double>")
    scored = materialize(scored, "scores")
    joined = bundles.select("bundle", "ids", "sizes", "words", "counts").join(others, "bundle", "left").join(scored, "bundle")
    return joined.mapInArrow(base, SCORES)

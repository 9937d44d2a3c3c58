import math
import re
import tracemalloc
from collections import Counter

import numpy as np
import sentencepiece
from pyspark.sql import functions as F

from quantspan.llm import attention, lm_scoring
from quantspan.llm.batches import PIECE, Words
from quantspan.llm.pieces_bpe import load
from quantspan.llm.queries import piece_model
from quantspan.llm.samples import remainder

from cases import frame, none, odd_rows, prose

TINY = attention.Shape(width=6, window=5, hidden=7, classes=4, tail=8)


def model(size=30, shape=TINY, seed=3):
    """Parameters that are random everywhere."""
    rng = np.random.default_rng(seed)
    classes, p = attention.start(rng.integers(0, 50, size), shape)
    return classes, {k: v + 0.3 * rng.standard_normal(v.shape).astype(np.float32) for k, v in p.items()}


def plain_log_probability(classes, p, context, target):
    """One position by loops over its context; tokens given as positions of the classes."""
    d = p["mixed"].shape[0]
    first = [p["seen"][t] + p["place"][i] for i, t in enumerate(context)]
    q, k, v = np.split(np.array(first) @ p["qkv"], 3, axis=1)
    weight = np.exp([q[-1] @ row / math.sqrt(d) for row in k])
    second = first[-1] + (weight / weight.sum()) @ v @ p["mixed"]
    state = second + np.maximum(second @ p["up"] + p["up_offset"], 0) @ p["down"]
    by_class = np.exp(state @ p["klass"] + p["klass_offset"])
    c = classes.of[target]
    own = slice(classes.begin[c], classes.end[c])
    inner = np.exp(p["next"][own] @ state + p["next_offset"][own])
    return math.log(by_class[c] / by_class.sum()) + math.log(inner[target - classes.begin[c]] / inner.sum())


def plain_text(classes, p, tokens, s):
    """log10 probability of a text: every token once, from the first window that has it."""
    ids = classes.position[np.array([lm_scoring.BEGIN, *tokens])]
    width, stride = s.shape.window, s.shape.window - s.overlap
    total = 0.0
    for i in range(len(tokens)):
        window = 0 if i < width else -(-(i + 1 - width) // stride)
        total += plain_log_probability(classes, p, ids[window * stride : i + 1], ids[i + 1])
    return total / math.log(10)


def test_scores_equal_loops_over_positions():
    s = lm_scoring.Settings(overlap=2, shape=TINY)
    classes, p = model()
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 30, n).tolist() for n in (1, 2, 4, 5, 6, 8, 9, 23)]
    sizes = np.array([len(t) for t in texts])
    got = lm_scoring.text_scores(classes, p, np.concatenate(texts), sizes, s)
    assert np.allclose(got, [plain_text(classes, p, t, s) for t in texts], atol=1e-4)


def test_places_that_overlap_get_no_states(monkeypatch):
    """A token's state is computed once, in the window that scores it."""
    s = lm_scoring.Settings(overlap=2, shape=TINY)
    classes, p = model()
    sizes = np.array([5, 8, 14, 14, 20])  # all windows of full length
    rows, trunk = [], attention.trunk

    def spy(*args):
        out = trunk(*args)
        rows.append(out[-1].size // TINY.width)
        return out

    monkeypatch.setattr(attention, "trunk", spy)
    lm_scoring.text_scores(classes, p, np.random.default_rng(5).integers(0, 30, sizes.sum()), sizes, s)
    assert sum(rows) == sizes.sum()


def test_large_exponents_stay_finite():
    """Where powers of e would overflow or vanish, scores and gradients are those of the plain sums."""
    s = lm_scoring.Settings(overlap=2, shape=TINY)
    classes, p = model()
    p |= {"qkv": 12 * p["qkv"], "klass": 10 * p["klass"], "next": 10 * p["next"]}
    rng = np.random.default_rng(6)
    first, meeting, *_, last = attention.trunk(p, rng.integers(0, 30, (50, 5)))
    logits = meeting[:, 5:] @ first.transpose(0, 2, 1), last @ p["klass"], last @ p["next"].T
    assert all(np.abs(x).max() > 88 for x in logits)
    texts = [rng.integers(0, 30, n).tolist() for n in (1, 6, 11)]
    got = lm_scoring.text_scores(classes, p, np.concatenate(texts), np.array([len(t) for t in texts]), s)
    assert np.allclose(got, [plain_text(classes, {k: v.astype(np.float64) for k, v in p.items()}, t, s) for t in texts], rtol=1e-3)
    x = rng.integers(0, 30, (4, 5))
    target, valid = rng.integers(0, 30, x.shape), np.ones(x.shape, bool)
    small, large = (attention.Trainer({k: v.astype(kind) for k, v in p.items()}, classes, 0.1).gradients(x, target, valid, move=False)[1] for kind in (np.float32, np.float64))
    for name in set(small) - {"seen"}:
        assert np.abs(small[name] - large[name]).max() < 1e-3 * max(1, np.abs(large[name]).max()), name


def test_steps_with_moved_outputs_equal_plain_updates():
    """What a step moves in one piece is what the gradients by name give."""
    classes, p = model(60)
    p = {k: v.astype(np.float64) for k, v in p.items()}
    rng = np.random.default_rng(7)
    trainer, square = attention.Trainer(p, classes, 0.1), {k: np.full(v.shape, 1e-6) for k, v in p.items()}
    times = np.zeros(60)
    for _ in range(3):
        x, target = rng.integers(0, 60, (3, 5)), rng.integers(0, 60, (3, 5))
        valid = np.arange(5) < np.array([5, 4, 2])[:, None]
        g = attention.Trainer(p, classes, 0.1).gradients(x, target, valid, move=False)[1]
        ids, rows, _ = g["seen"]
        g["seen"] = np.zeros_like(p["seen"])
        g["seen"][ids] = rows
        for k, v in g.items():
            square[k] += v * v
            p[k] = p[k] - 0.1 * v / np.sqrt(square[k])
        trainer.step(x, target, valid)
        times += np.bincount(classes.of[target[valid]], minlength=len(classes.begin))[classes.of]
    assert trainer.tokens == 33 and trainer.touched["seen"].sum() == 45 and (trainer.touched["next"] == times).all()
    for k, v in p.items():
        assert np.allclose(trainer.p[k], v, atol=1e-5), k


def test_probabilities_sum_to_one():
    classes, p = model(60)
    state = np.random.default_rng(2).standard_normal((3, 6)).astype(np.float32)
    for row in state:
        logs = attention.log_probabilities(p, classes, np.repeat(row[None], 60, 0), np.arange(60))
        assert abs(np.exp(logs).sum() - 1) < 1e-4


def test_gradients_equal_differences():
    classes, p = model()
    p = {k: v.astype(np.float64) for k, v in p.items()}
    rng = np.random.default_rng(4)
    x, target = rng.integers(0, 30, (3, 5)), rng.integers(0, 30, (3, 5))
    valid = np.arange(5) < np.array([5, 3, 1])[:, None]
    trainer = attention.Trainer(p, classes, 0.1)
    _, g = trainer.gradients(x, target, valid, move=False)
    ids, rows, times = g.pop("seen")
    g["seen"] = np.zeros_like(p["seen"])
    g["seen"][ids] = rows
    assert times.sum() == x.size
    for name, gradient in g.items():
        at = np.unravel_index(np.argmax(np.abs(gradient)), gradient.shape)
        sides = []
        for step in (1e-4, -1e-4):
            trainer.p = {k: v.copy() for k, v in p.items()}
            trainer.p[name][at] += step
            sides.append(trainer.gradients(x, target, valid, move=False)[0])
        assert abs((sides[0] - sides[1]) / 2e-4 - gradient[at]) < 2e-3 * max(1, abs(gradient[at])), name


def test_every_target_is_new_once():
    sizes = np.array([0, 1, 31, 32, 33, 56, 57, 500])
    text, begin, length, new = attention.windows(sizes, 32, 24)
    seen = Counter((t, b + i) for t, b, n, f in zip(text, begin, length, new) for i in range(f, n))
    assert seen == Counter((t, i) for t, n in enumerate(sizes) for i in range(n))
    assert (length[begin > 0] > 8).all()


def counted(rows, learn):
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in t or "")) for k, (_, t) in enumerate(rows)}
    c = Counter(w for k, (i, _) in enumerate(rows) if learn(i) for w in [*words[k], None])
    n, v = sum(c.values()), len(c)
    return [
        (i, len(words[k]) + 1, sum(c[w] > 0 for w in [*words[k], None]), n,
         sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words[k], None]))
        for k, (i, _) in enumerate(rows)
    ]


def crc(i):
    import zlib

    return i is not None and zlib.crc32(str(i).encode()) % 10 != 0


def test_counts_and_base_over_many_bundles(spark):
    rows = odd_rows() + [(100 + i, prose(i % 25, 40)) for i in range(60)]
    learn = remainder(F.col("id"), 10) != 0
    small = lm_scoring.Settings(bundle=2_000, rounds=1, every=1, batch=8)
    for s in (small, lm_scoring.Settings()):
        got = lm_scoring.score(frame(spark, rows).repartition(3), learn, piece_model(), s=s).collect()
        key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
        got, want = sorted((tuple(r) for r in got), key=key), sorted(counted(rows, crc), key=key)
        assert [r[:4] for r in got] == [r[:4] for r in want]
        assert np.allclose([r[4] for r in got], [r[4] for r in want])
        assert all(np.isfinite(r[5]) and r[5] < 0 for r in got)


def test_tokens_are_those_of_the_library(spark):
    texts = ["The  Quick\nBROWN é fox", "", "日本 x" * 5, None]
    bundle = lm_scoring.bundled(spark.createDataFrame([(i, True, t) for i, t in enumerate(texts)], "id bigint, learn boolean, text string").coalesce(1), piece_model(), lm_scoring.Settings()).collect()
    assert len(bundle) == 1
    flat, sizes = lm_scoring.sequences(bundle[0].asDict(), 32_000)
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    for text, part in zip(texts, np.split(flat, np.cumsum(sizes)[:-1])):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lower = ["".join(c.lower() if c < "\x80" else c for c in w) for w in words]
        assert part.tolist() == [t for w in lower for t in library.encode(w)] + [lm_scoring.END]


def test_learns_what_follows_what(spark):
    rows = [(i, " ".join(prose(k % 7, 12) for k in range(i, i + 6))) for i in range(400)]
    s = lm_scoring.Settings(rounds=2, every=2, batch=32, rate=0.1)
    learn = remainder(F.col("id"), 10) != 0
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    with_model = lm_scoring.score(docs, learn, piece_model(), s=s)
    without = lm_scoring.score(docs, learn, piece_model(), s=lm_scoring.Settings(rounds=0))
    held = lambda df: df.where(remainder(F.col("doc_id"), 10) == 0).agg(F.avg("score")).first()[0]
    assert held(with_model) > 0.6 * held(without)  # logarithms below zero: less is likelier


def test_nothing_to_learn_from_and_empty_tables(spark):
    got = lm_scoring.score(frame(spark, [(1, "word"), (2, None)]), F.lit(False), piece_model()).collect()
    assert [(r["n_known"], r["train_tokens"]) for r in got] == [(0, 0), (0, 0)]
    assert np.isfinite([r["score"] for r in got]).all() and np.isfinite([r["base_score"] for r in got]).all()
    assert lm_scoring.score(none(spark), F.col("id") > 0, piece_model()).count() == 0


def test_windows_to_learn_from_hold_their_own_text(spark):
    """Texts that are not learnt from leave no token behind."""
    texts = [prose(i, 30) for i in range(6)]
    rows = spark.createDataFrame([(i, i % 2 == 0, t) for i, t in enumerate(texts)], "id bigint, learn boolean, text string").coalesce(1)
    row = lm_scoring.bundled(rows, piece_model(), lm_scoring.Settings()).first().asDict()
    learn = np.frombuffer(row["learn"], bool)
    every, sizes = lm_scoring.sequences(row, 32_000)
    some, kept = lm_scoring.sequences(row, 32_000, learn)
    want = [t for k, t in enumerate(np.split(every, np.cumsum(sizes)[:-1])) if learn[k]]
    assert some.tolist() == np.concatenate(want).tolist() and kept.tolist() == np.where(learn, sizes, 0).tolist()
    classes, _ = attention.start(np.bincount(every, minlength=32_000))
    cuts = lm_scoring.Cuts(classes, some, kept, 5, 5)
    back = {t: [] for t in range(6)}
    for i in range(len(cuts.text)):
        x, target, valid = cuts(np.array([i]), 5)
        back[int(cuts.text[i])] += classes.order[target[valid]].tolist()
        assert classes.order[x[0, 0]] == (lm_scoring.BEGIN if cuts.begin[i] == 0 else some[cuts.base[i] - 1])
    assert [back[k] for k in range(0, 6, 2)] == [t.tolist() for t in want] and not back[1]


def test_every_window_is_learnt_from(spark):
    s = lm_scoring.Settings()
    docs = frame(spark, [(i, prose(i, 60 + 40 * i)) for i in range(12)]).selectExpr("doc_id AS id", "doc_id % 3 > 0 AS learn", "text")
    bundles = lm_scoring.bundled(docs, piece_model(), s).cache()
    size = len(load(piece_model()).pieces)
    counts = np.zeros(size)
    for r in bundles.collect():
        counts[r["tokens"]] += r["token_counts"]
    shared = spark.sparkContext.broadcast(lm_scoring.attention.start(counts, s.shape))
    seen = 0
    for turn in range(s.rounds):
        rows = lm_scoring.learnt(bundles, shared, turn, s).where("name = 'place'").collect()
        seen += sum(np.frombuffer(r["weight"], np.float64)[0] for r in rows)
    assert seen == counts.sum()


def test_memory_of_a_bundle_follows_a_piece():
    """A bundle's words by pieces: equal to those read at once, with much less beside the texts."""
    part = " ".join(prose(i, 200) for i in range(40)) + " É日本 ABC\U0001f600"
    texts = ["", *[f"{i} {part}" for i in range(4 * PIECE // len(part))], "", "Ab\tAB  ab"]
    tracemalloc.start()
    hashes, different, at, per_text = lm_scoring.dictionary(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    w = Words(texts)
    w.codes = np.where((w.codes > 64) & (w.codes < 91), w.codes + np.uint32(32), w.codes)
    want, sample, place = np.unique(w.hashes(), return_index=True, return_inverse=True)
    assert hashes.tolist() == want.tolist() and at.tolist() == place.tolist() and per_text.tolist() == w.counts().tolist()
    lower = w.codes.tobytes().decode("utf-32-le")
    assert different == [lower[w.starts[i] : w.ends[i]] for i in sample]
    assert most < 160 << 20, most
    alone = lm_scoring.dictionary(["x" * (2 * PIECE)])
    assert alone[1] == ["x" * (2 * PIECE)] and alone[3].tolist() == [1]
    assert [len(x) for x in lm_scoring.dictionary(["", ""])] == [0, 0, 0, 2]

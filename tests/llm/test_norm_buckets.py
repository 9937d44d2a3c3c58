import math
import random
import re
from collections import Counter

import numpy as np

from quantspan.llm import norm_buckets

from cases import frame, none, odd_rows, prose

ITEMS = "item_id bigint, text string, score double, doc_id string, `odd.name` string"


def items(spark, rows):
    return spark.createDataFrame([(i, t, 1.0, "clash", "x") for i, t in rows], ITEMS)


def terms(text):
    lower = "".join(c.lower() if c < "\x80" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, asked, best=50):
    """Every document against every item, in Python integers."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    total, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = set()
    for item in {i for i, _ in asked}:
        own = {t for i, text in asked if i == item for t in terms(text)}
        scored = []
        for i, c, n in counted:
            m = 100 - 50 + 50 * n * total // length
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
                for t in own if t in c
            )
            if score > 0:
                scored.append((-score, i is None, i))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out |= {(item, r, i, -s) for r, (s, _, i) in enumerate(scored[:best], 1)}
    return out


def corpus(n, seed=1):
    rng = random.Random(seed)
    return [(i, prose(i, rng.choice([5, 20, 80, 300]))) for i in range(n)]


def found(spark, docs, asked, s=norm_buckets.Settings()):
    got = [tuple(r) for r in norm_buckets.search(frame(spark, docs), items(spark, asked), s=s).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_equal_to_scoring_everything(spark):
    docs = corpus(400)
    asked = [(k, " ".join(docs[7 * k][1].split()[:12])) for k in range(12)] + [(99, prose(5000, 30))]
    small = norm_buckets.Settings(best=5, bucket=32, focus=2, seeds=20, terms=60)  # several blocks of items
    assert found(spark, docs, asked) == brute(docs, asked)
    assert found(spark, docs, asked, small) == brute(docs, asked, 5)


def test_odd_rows_copies_and_ties(spark):
    copies = [(1000 + i, prose(4, 40)) for i in range(90)]
    docs = odd_rows() + corpus(30, 3) + copies
    asked = [(1, prose(4, 40)), (2, None), (3, "?! ..."), (4, "日本語 É word"), (5, prose(1)), (5, prose(2)), (None, prose(3)), (6, "THE " * 3000)]
    assert found(spark, docs, asked) == brute(docs, asked)


def test_empty_tables(spark):
    assert norm_buckets.search(none(spark), items(spark, [(1, "word")])).count() == 0
    got = norm_buckets.search(frame(spark, odd_rows()), items(spark, []))
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_buckets_and_bounds_leave_work_out():
    """Most documents are never scored in full, and none of the best is lost."""
    rng = np.random.default_rng(5)
    size, docs = 300, 20_000
    weight = rng.integers(100, 12_000, size)
    w = norm_buckets.Weights(weight, docs, docs)
    own = [rng.choice(size, 12, replace=False) for _ in range(5)]
    block = norm_buckets.Items(list(range(5)), np.arange(size, dtype=np.uint64), own)
    chosen = [rng.choice(size, rng.integers(1, 9), replace=False) for _ in range(docs)]
    for k in range(300):
        chosen[k] = rng.choice(own[k % 5], 9, replace=False)
    vectors = [(t, rng.integers(200_000, 900_000, len(t))) for t in chosen]
    length = np.array([math.sqrt((weight[t] * x.astype(float) ** 2).sum()) for t, x in vectors])
    order = np.argsort(-length)
    search = norm_buckets.Search(block, w, np.zeros(5, np.int64), norm_buckets.Settings(bucket=500))
    for start in range(0, docs, 500):
        part = order[start : start + 500]
        row = np.repeat(np.arange(500), [len(vectors[i][0]) for i in part])
        search.bucket(part, length[part], row, np.concatenate([vectors[i][0] for i in part]), np.concatenate([vectors[i][1] for i in part]))
    for q in range(5):
        full = np.array([sum(int(weight[t]) * int(x) for t, x in zip(*v) if t in set(own[q])) for v in vectors])
        want = np.lexsort((np.arange(docs), -full))[:50]
        assert search.best[q][0].tolist() == want.tolist() and search.best[q][1].tolist() == full[want].tolist()
    assert search.scored < 5 * docs / 4

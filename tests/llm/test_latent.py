import random

import numpy as np

from quantspan.llm import latent

from cases import frame, none, odd, odd_rows, prose, words


def setting(spark, n=200, noise=0.0, seed=3):
    rng = random.Random(seed)
    items = [(k, prose(5_000 + k, rng.randint(18, 55))) for k in range(25)]
    rows, planted = [], set()
    for i in range(n):
        w = prose(i, 150).split()
        if i % 4 == 0:
            k = rng.randrange(len(items))
            told = [x if rng.random() >= noise else words(rng, 1)[0] for x in items[k][1].split()]
            at = rng.randrange(len(w))
            w[at:at] = told
            planted.add((i, k))
        rows.append((i, " ".join(w)))
    return frame(spark, rows), spark.createDataFrame(items, "item_id bigint, text string"), planted


def found(docs, benchmark):
    return {(r.doc_id, r.item_id) for r in latent.matches(docs, benchmark).collect()}


def test_exact_passages_are_all_found_and_nothing_else(spark):
    docs, benchmark, planted = setting(spark)
    assert found(docs, benchmark) == planted
    kept = latent.without_matches(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(200)) - {i for i, _ in planted}


def test_paraphrases_recall(spark):
    docs, benchmark, planted = setting(spark, noise=0.15, seed=8)
    got = found(docs, benchmark)
    assert got <= planted and len(got) >= 0.9 * len(planted)


def test_items_in_blocks_and_odd_rows(spark):
    docs, benchmark, planted = setting(spark, 80)
    small = latent.Settings(item_block=10)
    assert {(r.doc_id, r.item_id) for r in latent.matches(docs, benchmark, small).collect()} == planted
    odd_items = spark.createDataFrame([(1, None), (2, ""), (None, "x y z"), (3, prose(1)), (4, prose(1))], "item_id bigint, text string")
    got = found(odd(spark), odd_items)
    assert got == {(i, k) for i in (1, 6, 8) for k in (3, 4)}  # 6 begins with the text of 1
    assert latent.matches(none(spark), benchmark).count() == 0
    assert latent.matches(docs, benchmark.limit(0)).count() == 0
    assert latent.without_matches(odd(spark), odd_items).count() == len(odd_rows()) - 3


def test_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(40):
        a, b = rng.integers(0, 4, rng.integers(1, 30)), rng.integers(0, 4, rng.integers(0, 30))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert latent.common_subsequence(a, b) == table[-1, -1]


def test_space_holds_the_items(spark):
    """Singular directions of the fit against numpy's SVD of the same matrix."""
    docs, benchmark, _ = setting(spark, 60)
    s = latent.Settings(rank=8, rounds=6, item_weight=3.0)
    texts = [r.text for r in benchmark.orderBy("item_id").collect()]
    space = latent.fit(docs.select("text"), texts, s)
    rows = [np.frombuffer(r.features, "<i4") for r in latent.sample_rows(docs.select("text"), s).collect()]
    idf = np.where(space.idf >= space.settings.rare, space.idf, 0.0)
    matrix = np.array([np.bincount(f, minlength=latent.SIZE) * idf for f in rows])
    items = np.array([np.bincount(latent._bucket(latent._words([t])[1]), minlength=latent.SIZE) * idf * 3.0 for t in texts])
    _, values, right = np.linalg.svd(np.concatenate([matrix, items]), full_matrices=False)
    basis = np.divide(space.basis, idf[:, None], where=idf[:, None] > 0, out=np.zeros(space.basis.shape))
    overlap = np.linalg.svd(basis.T @ right[:4].T, compute_uv=False)
    np.testing.assert_allclose(overlap[:3], 1.0, atol=0.03)  # the leading subspace is inside


def test_items_longer_than_a_passage(spark):
    rng = random.Random(4)
    items = [(k, prose(7_000 + k, n)) for k, n in enumerate([100, 130, 180, 250, 320, 400, 450, 500] * 2)]
    for noise, least in ((0.0, 1.0), (0.2, 0.9)):
        rows, planted = [], set()
        for i in range(64):
            w = prose(i, 300).split()
            if i % 2 == 0:
                k = i // 2 % len(items)
                at = rng.randrange(len(w))
                w[at:at] = [x if rng.random() >= noise else words(rng, 1)[0] for x in items[k][1].split()]
                planted.add((i, k))
            rows.append((i, " ".join(w)))
        got = found(frame(spark, rows), spark.createDataFrame(items, "item_id bigint, text string"))
        print(noise, len(got), len(got & planted), len(planted))
        assert got <= planted and len(got) >= least * len(planted)
    # A third of a long item is not the item.
    third = frame(spark, [(1, prose(1, 200) + " " + " ".join(items[7][1].split()[:160]))])
    assert not found(third, spark.createDataFrame(items, "item_id bigint, text string"))


def test_the_space_is_fitted_on_every_passage(spark):
    long = prose(1, 48 * 100 + 5)
    docs = frame(spark, [(1, long), (2, prose(2, 30)), (3, long), (4, None), (5, "")])
    s = latent.Settings()
    rows = [np.frombuffer(r.features, "<i4") for r in latent.passage_rows(docs.select("text"), s).collect()]
    assert sorted(map(len, rows)) == [5, 30] + [48] * 100
    space = latent.fit(docs.select("text"), [prose(3, 20)], s)
    df = sum(np.bincount(np.unique(f), minlength=latent.SIZE) for f in rows)
    np.testing.assert_allclose(space.idf, np.log((102 + 2) / (df + 1)))


def test_products_of_passages_equal_those_of_the_matrix():
    rng = np.random.default_rng(2)
    sizes = rng.integers(0, 40, 900)
    flat = rng.integers(0, 50, sizes.sum()) * 7
    idf = np.where(rng.random(latent.SIZE) < 0.3, 0.0, rng.random(latent.SIZE)).astype(np.float32)
    x = rng.standard_normal((latent.SIZE, 5)).astype(np.float32)
    matrix = np.zeros((900, latent.SIZE))
    np.add.at(matrix, (np.repeat(np.arange(900), sizes), flat), idf[flat])
    total = np.zeros_like(x)
    latent.add_gram(total, flat, sizes, idf, idf[:, None] * x, 2.0)
    np.testing.assert_allclose(total, 2.0 * matrix.T @ (matrix @ x), rtol=1e-3, atol=1e-2)


def test_as_many_products_as_rounds(spark, monkeypatch):
    """The space of the last product needs no other one; few texts leave empty directions out."""
    calls, gram = [], latent._gram
    monkeypatch.setattr(latent, "_gram", lambda *a: calls.append(1) or gram(*a))
    docs, benchmark, _ = setting(spark, 40)
    texts = [r.text for r in benchmark.collect()]
    rows = latent.passage_rows(docs.select("text"), latent.Settings())
    space = latent.fit(docs.select("text"), texts, latent.Settings(), rows)
    assert len(calls) == latent.Settings().rounds
    # In the basis that a further product would turn it to, the same cosines.
    idf = np.where(space.idf >= space.settings.rare, space.idf, 0.0)
    there = idf > 0
    x = space.basis[there] / idf[there, None]
    np.testing.assert_allclose(x.T @ x, np.eye(x.shape[1]), atol=1e-4)
    few = latent.fit(docs.limit(2).select("text"), texts[:3], latent.Settings())
    passages = latent.passage_rows(docs.limit(2).select("text"), latent.Settings()).count()
    assert 0 < (np.abs(few.basis).max(axis=0) > 0).sum() <= passages + 3


def test_different_buckets_and_block_sums():
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 49, 300)
    flat = rng.integers(0, 60, sizes.sum()).astype(np.int32)
    parts = np.split(flat, np.cumsum(sizes)[:-1])
    want = np.concatenate([np.unique(x) for x in parts])
    assert latent.different(flat, sizes).tolist() == want.tolist()
    assert len(latent.different(flat[:0], sizes[:0])) == 0
    basis = rng.standard_normal((60, 7))
    first = np.cumsum(sizes[sizes > 0]) - sizes[sizes > 0]
    got = latent.block_sums(basis, flat, first)
    np.testing.assert_allclose(got, [basis[x].sum(axis=0) for x in parts if len(x)], atol=1e-9)
    assert latent.block_sums(basis, flat[:0], first[:0]).shape == (0, 7)


def test_words_beyond_the_first_plane():
    texts = ["Ab\U00010400 \U00010400b, ÉéA\U0001f600", "ab\U00010400 ééa\uffff ÉÉA"]
    w, h = latent._words(texts)
    told = [texts[d][a:b] for d, a, b in zip(w.doc, w.starts - w.base[w.doc], w.ends - w.base[w.doc])]
    by_word = {}
    for x, v in zip(told, h.tolist()):
        by_word.setdefault(x.lower() if x.isascii() or "\u00e9" in x.lower() else x, set()).add(v)
    assert all(len(v) == 1 for v in by_word.values()) and len({v for s in by_word.values() for v in s}) == len(by_word)

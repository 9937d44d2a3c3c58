import itertools
import random

import numpy as np
import pytest

from quantspan.llm import automata, toxicity

from cases import frame, none, odd, odd_rows, prose


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_table_equals_edit_distances():
    terms, letters = ["abcde$", "bad", "decab"], "abcdez"
    limits = {"abcde$": 1, "bad": 0, "decab": 1}
    auto = automata.build(terms, lambda t: limits[t])
    some = ["".join(w) for n in (3, 4, 5) for w in itertools.product(letters, repeat=n)][::7] + ["abcd", "abcdez", "decabzzz", "dcab", "badly"]
    codes = np.array([ord(c) for c in "".join(some)], np.uint32)
    size = np.array([len(w) for w in some])
    word, term, edits = auto.match(codes, np.cumsum(size) - size, np.cumsum(size))
    got = dict(zip(word.tolist(), zip(term.tolist(), edits.tolist())))
    for i, w in enumerate(some):
        least = {}
        for t in terms:
            d = distance(w, t[:-1]) if t.endswith("$") else min(distance(w[:k], t) for k in range(len(w) + 1))
            if d <= limits[t]:
                least[t] = d
        assert (i in got) == bool(least), w
        if least:
            assert got[i][1] == min(least.values()), w


def corpus(spark, n=240):
    rows, labels = [], []
    for i in range(n):
        w = prose(i, 80).split()
        toxic = i % 6 == 0
        if toxic:
            for k, bad in enumerate(("grobian", "scoundrel", "mudheaded"), i):
                w[(7 * k) % 80] = bad
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = corpus(spark)
    return docs, labels, toxicity.fit(docs, labels, "toxic", 4, 2)


def test_learns_terms_and_separates(spark, fitted):
    docs, labels, model = fitted
    assert {t.rstrip("$")[:7] for t in model.lexicon.terms} == {"grobian", "scoundr", "mudhead"}
    rows = toxicity.score(docs, model).join(labels, "doc_id").collect()
    assert all((r.score >= 0.3) == (r.toxic == 1) for r in rows)
    kept = toxicity.clean(docs, model, 0.3)
    assert kept.columns == docs.columns and kept.count() == labels.where("toxic = 0").count()


def test_broad_vocabularies_of_rare_terms_are_learned(spark):
    """Sixty terms, two in each toxic document: none is in more than one of thirty."""
    rng = random.Random(4)
    bad = [w for w in {"zu" + "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(80)}][:59] + ["xq"]
    rows, labels = [], []
    for i in range(2_400):
        w = prose(i, 30).split()
        toxic = i % 2 == 0
        if toxic:
            for k, term in enumerate(rng.sample(bad, 2)):
                w[9 * k + 3] = term
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.fit(docs, known, "toxic", 4, 2)
    scored = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    wrong = sum((scored[i] >= 0.3) != bool(t) for i, t in labels)
    assert wrong <= 0.05 * len(labels)
    assert model.score(["xq and others", "xqa and others"])[0] > model.score(["and others"])[0]
    assert abs(model.score(["xqa and others"])[0] - model.score(["and others"])[0]) < 1e-9  # short words without edits


def test_labels_without_a_term_fall_back_to_the_seed(spark):
    rows = [(i, prose(i, 30)) for i in range(400)]
    known = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id bigint, toxic int")
    model = toxicity.fit(frame(spark, rows), known, "toxic", 4, 2)
    assert (model.score([t for _, t in rows]) < 0.3).all()


def plain_features(model, text):
    """Hits, contexts and sums of one text, word by word."""
    lexicon = model.lexicon
    words, at, inside = [], [], False
    for i, c in enumerate(text + " "):
        known = c.isalnum() or c in "*@$"
        if known and not inside:
            at.append(i)
        if inside and not known:
            words.append(text[at[-1] : i].lower())
        inside = known
    hits = []
    for k, w in enumerate(words):
        best = None
        for t, term in enumerate(lexicon.terms):
            stem, whole = term.rstrip(toxicity.END), term.endswith(toxicity.END)
            if w == stem or (not whole and w.startswith(stem)):
                best = (0, t) if best is None or best[0] > 0 else best
            elif automata.allowed_edits(term) and best is None:
                d = distance(w, stem) if whole else min(distance(w[:n], stem) for n in range(len(w) + 1))
                best = (d, t) if d <= automata.allowed_edits(term) else None
        if best is None:
            continue
        left, right = max(k - lexicon.window, 0), min(k + lexicon.window, len(words) - 1)
        before = sum(c in toxicity.QUOTES for c in text[max(at[left] - 1, 0) : at[k]])
        after = sum(c in toxicity.QUOTES for c in text[at[k] + len(words[k]) : at[right] + len(words[right]) + 1])
        enclosed = before % 2 == 1 and after > 0
        reported = any(x in toxicity.REPORTS for x in words[left:k])
        context = 1.0 - 0.6 * enclosed - 0.3 * (reported and enclosed)
        hits.append((k, context * (1.0 if best[0] == 0 else toxicity.EDITED * lexicon.trust[best[1]])))
    total = sum(x for _, x in hits)
    densest = max((sum(x for j, x in hits if k <= j <= k + lexicon.window) for k, _ in hits), default=0.0)
    return [np.log1p(total), min(1, total), np.log1p(100 * total / max(len(words), 1)), np.log1p(densest)]


def test_scores_equal_a_plain_version(fitted):
    _, _, model = fitted
    rng = random.Random(8)
    spice = ["grobian", "grobain", "scoundrels", "scoundrl", "mudheaded", '"', "said", "said", "he", '"grobian"', "“scoundrel”"]
    texts = ["", "grobian", '"grobian" said', *(" ".join(rng.choice(spice) if rng.random() < 0.3 else w for w in prose(i, 60).split()) for i in range(40))]
    want = np.array([plain_features(model, t) for t in texts])
    assert np.allclose(model.lexicon.features(texts), want)
    z = want @ model.weights[:-1] + model.weights[-1]
    assert np.allclose(model.score(texts), 1 / (1 + np.exp(-z)))


def test_misspelled_terms_count_and_quoted_ones_count_less(fitted):
    _, _, model = fitted
    plain, misspelled, quoted, none_ = model.score(
        ["you grobian and scoundrel", "you grobain1 and scoundrl", 'he said "you grobian and scoundrel" to them', "you and them"]
    )
    assert plain > misspelled > none_ and plain > quoted > none_
    assert misspelled >= 0.3 and none_ < 0.05


def test_odd_rows(spark, fitted):
    _, _, model = fitted
    got = toxicity.score(odd(spark), model)
    assert got.count() == len(odd_rows()) and got.where("score IS NULL").count() == 0
    assert toxicity.clean(odd(spark), model, 0.3).count() == len(odd_rows())
    assert toxicity.score(none(spark), model).count() == 0
    blank = toxicity.fit(none(spark), none(spark).selectExpr("doc_id", "kept AS toxic"), "toxic", 4, 2)
    assert blank.score(["you idiot", ""])[0] > 0.3


def test_words_of_copied_texts_are_no_terms(spark):
    """A toxic text in forty near copies brings no words of its own into the lexicon."""
    docs, labels = corpus(spark, 240)
    rng = random.Random(6)
    own = ["".join(rng.choice("qwxyzvjk") + rng.choice("aeiou") for _ in range(4)) for _ in range(60)]
    base = "grobian " + " ".join(own)
    copies = [(1000 + i, base.replace(base.split()[7 + i % 40], f"edit{i}", 1)) for i in range(40)]
    docs = docs.unionByName(frame(spark, copies))
    labels = labels.unionByName(spark.createDataFrame([(i, 1) for i, _ in copies], "doc_id bigint, toxic int"))
    model = toxicity.fit(docs, labels, "toxic", 4, 2)
    assert any(t.startswith("grobian") for t in model.lexicon.terms)
    assert not any(w.startswith(t.rstrip("$")) for t in model.lexicon.terms for w in own)

"""Toxicity: a lexicon learned from labels, matched with edits, weighed by its context.

Terms are stems and words that documents labelled toxic have more often than others by more than
chance: the lower confidence bound of their share among toxic documents exceeds the upper bound
of their share among the others several times over. How many documents have a term does not matter
beyond that, so a broad vocabulary of rare terms is learned too. Every word of
a text runs through the intersection of the terms' Levenshtein automata with their trie. A
hit counts less the more its window of words looks like a report of someone else's words
(quotation marks on both sides, a reporting verb before it), and more where other hits are
near. A logistic model of a few sums per text gives the score.

Fitting reads at most `per_class` labelled documents of each class; everything else runs over
all rows and whole texts. Defined results: null and empty texts have no hit and get the score
of a text without hits; without labelled documents of both classes, or where the labels mark no
term, the terms of `SEED` and fixed weights are used: a model without power would give every
text the share of toxic ones. Repeated rows are scored alike and count once in fitting; equal
edits go to the term that the table has first; texts of any length are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspan.llm.automata import END, Automaton, build
from quantspan.llm.batches import Words, arrow_filter, arrow_map, fresh, pick
from quantspan.llm.samples import labelled

SEED = ("idiot", "moron", "scumbag", "worthless" + END, "pathetic" + END, "stupid", "loser" + END)
QUOTES = "\"“”„«»‹›"
REPORTS = (
    "said says wrote writes called quote quoted quotes reported according "
    "sagte schrieb nannte zitat zitiert dit dixit écrit appelé citation cité "
    "dijo escribió llamó cita citado"
).split()
N_FEATURES = 4
EDITED = 0.7  # weight of a hit with edits, before the trust in its term


@dataclass(frozen=True)
class Settings:
    per_class: int = 3_000
    min_count: int = 4
    precision: float = 0.98  # of the labelled documents with a term
    lift: float = 3.0  # of a term's share among toxic documents over that among others, at least
    deviations: float = 2.33  # of the bounds that this is said of
    min_letters: int = 4  # of a stem; shorter terms are whole words and match without edits
    max_letters: int = 12  # of a stem
    window: int = 8  # words on each side
    ridge: float = 0.02


def token_chars(codes: np.ndarray) -> np.ndarray:
    """Letters, digits and the signs that stand in for letters."""
    if not _alnum:
        table = np.array([chr(i).isalnum() for i in range(1 << 16)])
        table[[ord(c) for c in "*@$"]] = True
        _alnum.append(table)
    return _alnum[0][np.minimum(codes, 0xFFFF)]


_alnum: list[np.ndarray] = []


def share_bound(count: Column, of: int, deviations: float, upper: bool) -> Column:
    """Wilson's bound of a share from `count` in `of`."""
    z2 = deviations * deviations
    middle, n = count + z2 / 2, F.lit(float(max(of, 1)))
    spread = deviations * F.sqrt(F.greatest(count * (n - count) / n, F.lit(0.0)) + z2 / 4)
    return (middle + spread if upper else middle - spread) / (n + z2)


def choose_terms(counts: dict[str, tuple[float, float]], s: Settings) -> list[str]:
    """Stems from the counted prefixes that mark the class (with the end mark: whole words).

    A stem starts at a prefix that marks the class while its own prefix does not, and grows
    while one longer prefix holds nearly all of it.
    """

    def marks(p: str) -> bool:
        return p in counts

    longer: dict[str, list[str]] = {}
    for p in counts:
        longer.setdefault(p[:-1], []).append(p)
    terms = set()
    for p in sorted(counts):
        if not marks(p) or marks(p[:-1]):
            continue
        while True:
            most = max((c for c in longer.get(p, []) if marks(c)), key=lambda c: counts[c][0], default=None)
            if most is None or counts[most][0] < 0.8 * counts[p][0]:
                break
            p = most
        if p.endswith(END) or len(p) >= s.min_letters:
            terms.add(p)
            continue
        # Too short to stand alone: its longer forms are taken instead.
        todo = [p]
        while todo:
            q = todo.pop()
            for c in longer.get(q, []):
                if marks(c):
                    terms.add(c) if c.endswith(END) or len(c) >= s.min_letters else todo.append(c)
    return sorted(terms)


def learn_terms(sample: DataFrame, s: Settings) -> list[str]:
    """Count the prefixes of the words of the labelled documents, once for each setting of a word.

    A setting is the two words beside it. Where copies of a text carry its label many times
    over, their words have one setting, however many copies there are; a term that is used in many
    texts has nearly as many settings as texts.
    """
    sample = sample.dropDuplicates(["label", "text"])
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    listed = sample.select("doc_id", "label", F.split(F.lower("text"), r"[^\p{L}]+").alias("w"))
    beside = "transform(w, (x, i) -> struct(x AS word, concat_ws(' ', get(w, i - 1), get(w, i + 1)) AS beside))"
    words = (
        listed.select("doc_id", "label", F.explode(F.expr(beside)).alias("x"))
        .where(F.length("x.word") >= 2)
        # One setting a document and word, then one of each setting.
        .groupBy("doc_id", "label", F.col("x.word").alias("word"))
        .agg(F.min("x.beside").alias("beside"))
        .groupBy("label", "word", "beside")
        .agg(F.lit(1))
        .groupBy("word")
        .agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    )
    marked = F.concat("word", F.lit(END))
    prefix = F.explode(
        F.expr(f"transform(sequence(2, least(length(word), {s.max_letters})), n -> left(word, n))")
    )
    prefixes = words.select(prefix.alias("p"), "toxic", "clean").unionByName(
        words.where(F.length("word") <= s.max_letters).select(marked.alias("p"), "toxic", "clean")
    )
    found = prefixes.groupBy("p").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    toxic, clean = F.col("toxic").cast("double"), F.col("clean").cast("double")
    apart = share_bound(toxic, n.get(1, 0), s.deviations, False) >= s.lift * share_bound(clean, n.get(0, 0), s.deviations, True)
    marking = (toxic >= s.min_count) & (toxic >= s.precision * (toxic + clean)) & apart
    # Bounded by the sample: each row stands for `min_count` of its words at least.
    return choose_terms({r["p"]: (r["toxic"], r["clean"]) for r in found.where(marking).collect()}, s)


@dataclass
class Lexicon:
    terms: list[str]
    automaton: Automaton
    reports: Automaton
    window: int
    trust: np.ndarray  # of each term's hits with edits, 0 to 1

    @classmethod
    def of(cls, terms: list[str], window: int) -> Lexicon:
        exact = build([r + END for r in REPORTS], lambda _: 0)
        return cls(terms, build(terms), exact, window, np.ones(len(terms)))

    def hits(self, texts: list[str]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The words, and of each hit its word, term, edits and weight by context (0 to 1)."""
        w = Words(texts, token_chars)
        word, term, edits = self.automaton.match(w.codes, w.starts, w.ends)
        if not len(word):
            return w, word, term, edits, np.zeros(0)
        first = np.searchsorted(w.doc, w.doc[word])
        last = np.searchsorted(w.doc, w.doc[word], "right") - 1
        left, right = np.maximum(word - self.window, first), np.minimum(word + self.window, last)
        quote = np.concatenate([[0], np.cumsum(np.isin(w.codes, [ord(c) for c in QUOTES]))])
        before = quote[w.starts[word]] - quote[w.starts[left] - (w.starts[left] > 0)]
        after = quote[np.minimum(w.ends[right] + 1, len(w.codes))] - quote[w.ends[word]]
        enclosed = (before % 2 == 1) & (after > 0)
        said = np.zeros(len(w.starts) + 1, np.int64)
        near = np.unique(np.concatenate([np.arange(a, b) for a, b in zip(left, word)])) if len(word) else word
        if len(near):
            r, _, _ = self.reports.match(w.codes, w.starts[near], w.ends[near])
            said[near[r] + 1] = 1
        said = np.cumsum(said)
        reported = said[word] > said[left]
        return w, word, term, edits, 1.0 - 0.6 * enclosed - 0.3 * (reported & enclosed)

    def edited_terms(self, texts: list[str]) -> list[list[int]]:
        """The terms that each text has with edits."""
        w, word, term, edits, _ = self.hits(texts)
        out = [set() for _ in texts]
        for d, t in zip(w.doc[word[edits > 0]], term[edits > 0]):
            out[d].add(int(t))
        return [sorted(x) for x in out]

    def features(self, texts: list[str]) -> np.ndarray:
        """Sum of hit weights, whether there is any, their share of the words, their densest window."""
        w, word, term, edits, context = self.hits(texts)
        out = np.zeros((len(texts), N_FEATURES))
        if not len(word):
            return out
        weight = context * np.where(edits == 0, 1.0, EDITED * self.trust[term])
        doc = w.doc[word]
        total = np.bincount(doc, weights=weight, minlength=len(texts))
        stop = np.minimum(np.searchsorted(word, word + self.window, "right"), np.searchsorted(doc, doc, "right"))
        so_far = np.concatenate([[0.0], np.cumsum(weight)])
        densest = np.zeros(len(texts))
        np.maximum.at(densest, doc, so_far[stop] - so_far[:-1])
        out[:, 0] = np.log1p(total)
        out[:, 1] = np.minimum(1, total)
        out[:, 2] = np.log1p(100 * total / np.maximum(w.counts(), 1))
        out[:, 3] = np.log1p(densest)
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Weights and, last, the offset; Newton steps on the penalised likelihood."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.append(np.full(x.shape[1] - 1, ridge), ridge / 100) * len(x)
    penalty = penalty / 10
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, x.T @ (weight * (p - y)) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        z = self.lexicon.features(texts) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


DEFAULT_WEIGHTS = np.array([1.5, 2.0, 0.5, 0.5, -4.0])


def fit(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, s: Settings = Settings()) -> Model:
    sample, counts = labelled(docs, labels, label, modulus, held_out, s.per_class)
    there = {r["label"] for r in sample.select("label").distinct().collect()}
    if there != {0, 1}:
        return Model(Lexicon.of(list(SEED), s.window), DEFAULT_WEIGHTS)
    context = docs.sparkSession.sparkContext
    terms = learn_terms(sample, s)
    if not terms:
        return Model(Lexicon.of(list(SEED), s.window), DEFAULT_WEIGHTS)
    lexicon = Lexicon.of(terms, s.window)
    plain = context.broadcast(lexicon)  # a few hundred terms
    edited = arrow_map(sample, lambda texts: {"terms": pa.array(plain.value.edited_terms(texts), pa.list_(pa.int32()))}, "terms array<int>")
    n = {k: edited.where(F.col("label") == k).count() for k in counts}
    seen = np.ones((len(lexicon.terms), 2)) * [0.0, 1.0]
    for r in edited.select("label", F.explode("terms").alias("t")).groupBy("label", "t").count().collect():
        seen[r["t"], r["label"]] += r["count"] / max(n[r["label"]], 1) * max(n.values())
    lexicon.trust = (seen[:, 1] / seen.sum(1)) ** 2
    trusted = context.broadcast(lexicon)
    names = [f"f{i}" for i in range(N_FEATURES)]

    def run(texts):
        x = trusted.value.features(texts)
        return {n: pa.array(x[:, i]) for i, n in enumerate(names)}

    got = arrow_map(sample, run, ", ".join(f"{n} double" for n in names)).drop("doc_id").toPandas()
    y = got["label"].to_numpy(float)
    share = np.array([counts[int(k)] / max((y == k).sum(), 1) for k in y])
    return Model(lexicon, fit_logistic(got[names].to_numpy(), y, share * len(y) / share.sum(), s.ridge))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """-> the other columns of `docs`, score double; a column named score is dropped."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    column = fresh(docs, "text_to_score")
    kept = {c: c for c in docs.columns if c != text and c.lower() != "score"}
    run = lambda texts: {"score": pa.array(shared.value.score(texts), pa.float64())}
    return arrow_map(pick(docs, **kept, **{column: text}), run, "score double", column)


def clean(docs: DataFrame, model: Model, limit: float, text: str = "text") -> DataFrame:
    """The rows of `docs` whose score is below `limit`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return arrow_filter(docs, lambda texts: shared.value.score(texts) < limit, text)

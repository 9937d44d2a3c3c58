"""Quality rules from repetition: how much of a text lies inside repeated n-grams and lines.

Every n-gram of words is a range of the word hashes, so one prefix sum gives the rolling
hashes of all lengths. An n-gram found twice or more in its text covers its words, the first
place included; covered characters are counted once however many n-grams cover them. Lines
are ranges of the character hashes.

Defined results: null, empty and blank texts have no words, all counts 0, all shares 0.0, fail
the base rule and are not kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quantspan.llm.batches import Rolling, Words, arrow_map, fresh, mix, pick

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """The largest shares of a text's word characters that a kept text may have."""

    ngrams: tuple[tuple[int, float], ...] = (
        (2, 0.60),
        (3, 0.50),
        (5, 0.45),
        (10, 0.43),
    )
    lines: float = 0.25
    symbols: float = 0.10  # symbols per word
    repeats: float = 0.20  # words equal to the one before them
    base_words: int = 50
    base_window: int = 3


def repeated(doc: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of items with a hash in a text: whether it occurs twice or more there; whether it is not the first."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    salted = keys ^ mix(doc.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
    order = np.argsort(salted, kind="stable")
    same = salted[order][1:] == salted[order][:-1]
    later = np.concatenate([[False], same])
    twice = later.copy()
    twice[:-1] |= same
    out = np.empty((2, len(keys)), bool)
    out[0, order], out[1, order] = twice, later
    return out[0], out[1]


def covered(words: Words, rolling: Rolling, n: int) -> np.ndarray:
    """Words inside an n-gram that its text has twice or more."""
    count = len(words.doc) - n + 1
    if count <= 0:
        return np.zeros(len(words.doc), bool)
    start = np.flatnonzero(words.doc[n - 1 :] == words.doc[:count])
    twice, _ = repeated(words.doc[start], rolling(start, start + n))
    step = np.zeros(len(words.doc) + 1, np.int32)
    step[start[twice]] += 1
    np.subtract.at(step, start[twice] + n, 1)
    return np.cumsum(step[:-1]) > 0


def measure(texts: list[str], limits: Limits) -> dict[str, np.ndarray]:
    w = Words(texts)
    total = lambda x: np.bincount(w.doc, weights=x, minlength=w.n_docs).astype(np.int64)
    sizes = w.ends - w.starts
    n_words, word_chars = w.counts(), total(sizes)
    hashes = w.hashes()
    rolling = Rolling(hashes)
    symbol = np.isin(w.codes, [ord(c) for c in SYMBOLS])
    n_symbols = np.add.reduceat(np.append(symbol, 0), w.base) if w.n_docs else np.zeros(0)

    edge = np.flatnonzero(w.codes == 10)
    line_start = np.concatenate([[0], edge[:-1] + 1])
    filled = np.searchsorted(w.starts, edge) > np.searchsorted(w.starts, line_start)
    line_start, edge = line_start[filled], edge[filled]
    line_doc = np.searchsorted(w.base, line_start, "right") - 1
    twice, later = repeated(line_doc, w.chars(line_start, edge))
    n_dup_lines = np.bincount(line_doc, weights=later, minlength=w.n_docs).astype(np.int64)
    chars = np.concatenate([[0], np.cumsum(sizes)])
    line_chars = chars[np.searchsorted(w.starts, edge)] - chars[np.searchsorted(w.starts, line_start)]
    dup_line_chars = np.bincount(line_doc, weights=np.where(later, line_chars, 0), minlength=w.n_docs)

    n_repeat_words = total(covered(w, rolling, limits.base_window))
    base_failed = (n_words < limits.base_words) | (100 * n_repeat_words > 50 * n_words)
    most = np.maximum(word_chars, 1)
    out = {
        "n_words": n_words.astype(np.int64),
        "word_chars": word_chars,
        "n_symbols": n_symbols.astype(np.int64),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat_words,
        "base_failed": base_failed,
    }
    kept = ~base_failed & (dup_line_chars <= limits.lines * most)
    shares = [dup_line_chars / most]
    for n, limit in limits.ngrams:
        inside = total(np.where(covered(w, rolling, n), sizes, 0))
        shares.append(inside / most)
        kept &= inside <= limit * most
    stutter = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (w.doc[1:] == w.doc[:-1])])
    kept &= total(stutter) <= limits.repeats * np.maximum(n_words, 1)
    kept &= out["n_symbols"] <= limits.symbols * np.maximum(n_words, 1)
    return out | {"kept": kept, "shares": np.stack(shares, 1) if len(texts) else np.zeros((0, 1 + len(limits.ngrams)))}


def rules(docs: DataFrame, limits: Limits = Limits(), text: str = "text") -> DataFrame:
    """Measures and verdict for every text.

    -> the other columns of `docs`, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, dup_line_share and dup_<n>gram_share per length. A
    column of `docs` with one of these names is dropped in favour of the new one.
    """
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shares = ["dup_line_share", *[f"dup_{n}gram_share" for n, _ in limits.ngrams]]
    schema = [f"{c} bigint" for c in longs] + ["base_failed boolean", "kept boolean"] + [f"{c} double" for c in shares]

    def run(texts: list[str]) -> dict[str, pa.Array]:
        m = measure(texts, limits)
        share = m.pop("shares")
        return {k: pa.array(v) for k, v in m.items()} | {c: pa.array(share[:, i]) for i, c in enumerate(shares)}

    new = {*longs, "base_failed", "kept", *shares}
    column = fresh(docs, "text_to_measure")
    kept = {c: c for c in docs.columns if c != text and c.lower() not in new}
    return arrow_map(pick(docs, **kept, **{column: text}), run, ", ".join(schema), column)

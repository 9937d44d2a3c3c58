import re
from collections import Counter

from quantspan.llm import repetition

from cases import none, odd, odd_rows, prose


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    inside = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), failed


def test_measures_equal_a_plain_count(spark):
    got = repetition.rules(odd(spark))
    rows = got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    want = sorted([(i, *brute(t)) for i, t in odd_rows()], key=repr)
    assert sorted((tuple(r) for r in rows), key=repr) == want
    assert dict(got.dtypes)["kept"] == "boolean" and "score" in got.columns
    assert repetition.rules(none(spark)).count() == 0


def test_overlapping_windows_cover_a_character_once():
    text = "a b a b a b c d e f"
    m = repetition.measure([text], repetition.Limits(ngrams=((2, 0.5),)))
    # "a b" and "b a" repeat: six words of one character out of ten.
    assert m["shares"][0].tolist() == [0.0, 0.6]


def test_verdicts():
    clean, doubled = prose(1, 200), "\n".join([prose(2, 60)] * 3)
    stutter = " ".join(w for w in prose(3, 60).split() for _ in range(2))
    signs = " ".join(w + "$" for w in prose(4, 100).split())
    kept = repetition.measure([clean, doubled, stutter, signs, "short"], repetition.Limits())["kept"]
    assert kept.tolist() == [True, False, False, False, False]

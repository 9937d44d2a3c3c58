import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quantspan.llm import pieces_bpe, queries

from cases import none, odd, odd_rows, prose

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def encoded(texts):
    flat, sizes = pieces_bpe.encode_flat(pieces_bpe.load(PATH), texts)
    ends = np.cumsum(sizes)
    return [flat[a:b].tolist() for a, b in zip(ends - sizes, ends)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_any_text_encodes_and_decodes_as_the_library_does(library, texts):
    ids = encoded(texts)
    assert ids == [library.encode(t) for t in texts]
    v = pieces_bpe.load(PATH)
    decoded = pieces_bpe.decode_flat(v, np.array(sum(ids, []), np.int32), np.array([len(x) for x in ids], np.int64))
    assert [d.decode("utf-8", "replace") for d in decoded] == [library.decode(x) for x in ids]


def test_long_words_take_the_queue_with_the_same_result(library, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("inerthaou") for _ in range(3_000)), "a" * 9_000, " " * 40, "in" * 5_000 + "the"]
    want = [library.encode(t) for t in texts]
    assert encoded(texts) == want
    monkeypatch.setattr(pieces_bpe, "LONG", 5)
    assert encoded([*texts, prose(5, 300)]) == [*want, library.encode(prose(5, 300))]


def test_rows_digests_and_odd_columns(spark, library):
    got = queries.token_digests(pieces_bpe.encode(odd(spark).select("doc_id", "text", "n_tokens", "`odd.name`"), PATH))
    want = []
    for i, t in odd_rows():
        ids = [1, *library.encode(t or ""), 2]
        raw = np.array(ids, "<u4").tobytes()
        want.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    key = lambda r: repr(r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    assert pieces_bpe.encode(none(spark), PATH).count() == 0

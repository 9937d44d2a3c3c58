"""Documents that operators must survive, and a generator of plain prose."""

import random

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "score double, n_tokens string, kept int, sid string, `odd.name` string"
)
SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo zu".split()


def words(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def prose(seed, n=80):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        sentence = words(rng, rng.randint(4, 9))
        sentence[-1] += "."
        out += sentence
    return " ".join(out[:n])


def frame(spark, rows):
    """(doc_id, text) rows with every other column filled, also with clashing names."""
    full = [(i, t, "en", "s", None if t is None else len(t), 9.5, "clash", 7, "clash", "x") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows():
    long = " ".join(prose(k, 400) for k in range(40))
    return [
        (1, prose(1)),
        (2, None),
        (3, ""),
        (4, " \n\t \n"),
        (5, "word"),
        (6, long),
        (7, "x" * 30_000),
        (8, prose(1)),
        (9, "▁ é 日本語 \U0001f600 \x01\x02 \x00 end"),
        (None, prose(2)),
        (None, None),
        (10, prose(303)),
        (10, prose(303)),
        (11, "\n".join(prose(k, 30) for k in range(5))),
    ]


def odd(spark):
    return frame(spark, odd_rows())


def none(spark):
    return frame(spark, [])

"""Texts of a task as flat numpy arrays, in pieces of bounded size.

A piece holds about `PIECE` characters, or one text where that alone is longer, so memory
follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 20
RECORDS = 1_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def bounded(spark) -> None:
    """Small Arrow batches: few rows at once, so that long texts do not pile up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(RECORDS))


def fresh(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under new names; a name may hold dots."""
    return df.select(*[F.col(quoted(old)).alias(new) for new, old in columns.items()])


def pieces(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE
) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts; a null text is an empty one."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        lengths = np.asarray(pc.fill_null(pc.utf8_length(texts), 0), np.int64)
        start = 0
        while start < len(lengths):
            stop = start + max(1, int(np.searchsorted(np.cumsum(lengths[start:]), limit, "right")))
            part = texts.slice(start, stop - start).to_pylist()
            yield batch.slice(start, stop - start), [t or "" for t in part]
            start = stop


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + length), one run after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, PIECE + 4096)
        for i, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table, dtype=np.uint64)
    return _powers[0], _powers[1]


class Rolling:
    """Hashes of any ranges of a sequence of 64-bit values, from one prefix sum."""

    def __init__(self, values: np.ndarray):
        power, self.inverse = _grown(len(values) + 1)
        self.prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * power[: len(values)], out=self.prefix[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.prefix[ends] - self.prefix[starts]) * self.inverse[starts])


class Words:
    """Words and lines of several texts, in one array of code points.

    `starts`, `ends` and `doc` describe the words (runs without ASCII white space, or runs of
    what `inside` accepts, which must leave out the line feed); each text is followed by one line feed that belongs to no text. `base` is where each text starts.
    """

    def __init__(self, texts: list[str], inside: Callable[[np.ndarray], np.ndarray] | None = None):
        self.n_docs = len(texts)
        self.codes = codes_of("\n".join(texts) + "\n")
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.base = np.cumsum(lengths) - lengths
        self.sizes = lengths - 1
        c = self.codes
        within = inside(c) if inside else (c != 32) & ((c < 9) | (c > 13))
        edge = np.diff(np.concatenate([[False], within]).astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.doc = np.searchsorted(self.base, self.starts, "right") - 1
        self._chars = None

    @property
    def chars(self) -> Rolling:
        if self._chars is None:
            self._chars = Rolling(mix(self.codes.astype(np.uint64) + np.uint64(1)))
        return self._chars

    def hashes(self) -> np.ndarray:
        """One 64-bit hash per word."""
        return self.chars(self.starts, self.ends)

    def counts(self) -> np.ndarray:
        """Words per text."""
        return np.bincount(self.doc, minlength=self.n_docs)


def plain_names(df: DataFrame) -> DataFrame:
    """The same columns by position: mapInArrow cannot resolve names that hold dots."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def arrow_map(
    df: DataFrame, fn: Callable[[list[str]], dict[str, pa.Array]], schema: str, text: str = "text"
) -> DataFrame:
    """All columns of `df` but the text's, and what `fn` returns for the texts.

    The name of a new column must be free in `df`.
    """
    at = df.columns.index(text)
    kept = [f for f in df.schema if f.name != text]
    fields = [f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(kept)]
    names = [f"k{i}" for i in range(len(kept))]

    def run(batches):
        for batch, texts in pieces(batches, f"c{at}"):
            new = fn(texts)
            columns = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, *new.values()], [*names, *new])

    bounded(df.sparkSession)
    out = plain_names(df).mapInArrow(run, ", ".join([*fields, schema]))
    return out.toDF(*[f.name for f in kept], *out.columns[len(kept) :])


def arrow_filter(df: DataFrame, fn: Callable[[list[str]], np.ndarray], text: str = "text") -> DataFrame:
    """The rows of `df`, unchanged, for whose texts `fn` is true."""
    at = df.columns.index(text)

    def run(batches):
        for batch, texts in pieces(batches, f"c{at}"):
            yield batch.filter(pa.array(fn(texts), pa.bool_()))

    bounded(df.sparkSession)
    plain = plain_names(df)
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)

"""SentencePiece BPE encoding and decoding with flat numpy arrays.

All words of a batch are merged together. A round finds the best pair of each word (lowest
rank, leftmost on ties) with one segmented minimum, merges these pairs in all words at once,
closes the gaps, and drops the words that have no pair left. Words are cut wherever no piece
of the vocabulary holds the two neighbouring characters: no merge can cross such a place, so
the result is that of the library's queue. Every different word is merged once per batch.

A word beyond `LONG` symbols takes a queue of pairs instead, because rounds would be
quadratic in its length; the result is the same.

Defined results: null and empty texts give the begin and end ids alone and decode to "".
U+2581 is read as a space, as the library does. Characters without a piece become bytes.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quantspan.llm.batches import Rolling, arrow_map, codes_of, fresh, mix, pick, spans

SPACE = 0x2581
LONG = 4_000
NONE = np.iinfo(np.int32).max


@dataclass
class Vocabulary:
    """A BPE model as arrays: characters, merges packed by left piece, bytes of each piece."""

    pieces: list[str]
    kinds: np.ndarray  # 0 text, 1 control, 2 byte, 3 unknown
    scores: np.ndarray
    prefix: bool = True
    low: np.ndarray = field(init=False)

    def __post_init__(self):
        text = [i for i in range(len(self.pieces)) if self.kinds[i] == 0]
        index = {self.pieces[i]: i for i in text}
        _, rank = np.unique(-self.scores, return_inverse=True)
        self.rank = rank.astype(np.int32)
        self.bytes_at = np.full(256, -1, np.int32)
        for i in np.flatnonzero(self.kinds == 2):
            self.bytes_at[int(self.pieces[i][3:-1], 16)] = i
        single = sorted((ord(p), i) for p, i in index.items() if len(p) == 1)
        self.char_codes = np.array([c for c, _ in single], np.uint32)
        self.char_ids = np.array([i for _, i in single], np.int32)
        self.low = np.full(1 << 16, -1, np.int32)
        small = self.char_codes < (1 << 16)
        self.low[self.char_codes[small]] = self.char_ids[small]
        # Characters that stand beside each other in some piece.
        inner = sorted({c for p in index if len(p) > 1 for c in p})
        number = {c: i + 1 for i, c in enumerate(inner)}
        self.joined = np.zeros((len(inner) + 1, len(inner) + 1), bool)
        self.number = np.zeros(len(self.pieces) + 1, np.int32)  # by id; -1 is the last, number 0
        for c in inner:
            if c in index:
                self.number[index[c]] = number[c]
        for p in index:
            for a, b in zip(p, p[1:]):
                self.joined[number[a], number[b]] = True
        rows: dict[int, list[tuple[int, int]]] = {}
        for p, i in index.items():
            for k in range(1, len(p)):
                a, b = index.get(p[:k]), index.get(p[k:])
                if a is not None and b is not None:
                    rows.setdefault(a, []).append((b, i))
        self._pack(rows)
        blobs = [
            self._surface(p, k) for p, k in zip(self.pieces, self.kinds)
        ]
        self.blob = np.frombuffer(b"".join(blobs), np.uint8)
        self.blob_size = np.array([len(b) for b in blobs], np.int64)
        self.blob_at = np.cumsum(self.blob_size) - self.blob_size

    @staticmethod
    def _surface(piece: str, kind: int) -> bytes:
        if kind == 1:
            return b""
        if kind == 2:
            return bytes([int(piece[3:-1], 16)])
        return (" \u2047 " if kind == 3 else piece.replace(chr(SPACE), " ")).encode()

    def _pack(self, rows: dict[int, list[tuple[int, int]]]) -> None:
        """merged[shift[a] + b] is the piece of a and b where owner has a there."""
        n = len(self.pieces)
        size = n + 4 * sum(map(len, rows.values())) + 1024
        taken = np.zeros(size, bool)
        self.shift, self.owner, self.merged = np.zeros(n, np.int32), np.full(size, -1, np.int32), np.zeros(size, np.int32)
        rng = np.random.default_rng(7)
        for a, pairs in sorted(rows.items(), key=lambda x: -len(x[1])):
            right = np.array([b for b, _ in pairs])
            while True:
                at = int(rng.integers(0, size - n))
                if not taken[at + right].any():
                    break
            taken[at + right] = True
            self.shift[a] = at
            self.owner[at + right] = a
            self.merged[at + right] = [i for _, i in pairs]

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merged piece of each pair and its rank, NONE where there is none."""
        known = (left >= 0) & (right >= 0)
        at = self.shift[np.where(known, left, 0)] + np.where(known, right, 0)
        known &= self.owner[at] == left
        merged = np.where(known, self.merged[at], 0)
        return merged, np.where(known, self.rank[merged], NONE)


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    """Read a BPE model with the identity normaliser, byte fallback and no user symbols."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    kinds = np.array(
        [3 if model.is_unknown(i) else 1 if model.is_control(i) else 2 if model.is_byte(i) else 0 for i in ids]
    )
    mark = chr(SPACE)
    if (kinds == 2).sum() != 256 or model.normalize("ﬁ  x ") != f"{mark}ﬁ{mark}{mark}x{mark}":
        raise ValueError(f"{path}: only byte fallback without normalisation is known here")
    return Vocabulary([model.id_to_piece(i) for i in ids], kinds, np.array([model.get_score(i) for i in ids]))


def _queued(v: Vocabulary, symbols: np.ndarray) -> np.ndarray:
    """One long word, with a queue of pairs and linked neighbours."""
    sym = symbols.tolist()
    n = len(sym)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    merged, rank = v.pair(symbols[:-1], symbols[1:])
    queue = [(r, i, sym[i], sym[i + 1], m) for i, (r, m) in enumerate(zip(rank.tolist(), merged.tolist())) if r != NONE]
    heapq.heapify(queue)

    def offer(i):
        j = after[i]
        a, b = sym[i], sym[j]
        if a >= 0 and b >= 0:
            at = v.shift[a] + b
            if v.owner[at] == a:
                m = int(v.merged[at])
                heapq.heappush(queue, (int(v.rank[m]), i, a, b, m))

    gone = [False] * n
    while queue:
        _, i, a, b, m = heapq.heappop(queue)
        j = after[i]
        if gone[i] or j < 0 or sym[i] != a or sym[j] != b:
            continue
        sym[i], gone[j] = m, True
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
            offer(i)
        if before[i] >= 0:
            offer(before[i])
    return np.array([s for s, g in zip(sym, gone) if not g], np.int32)


def _merged(v: Vocabulary, sym: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge words given as runs of `sizes` symbols -> (symbols, sizes)"""
    out: dict[int, np.ndarray] = {}
    word = np.repeat(np.arange(len(sizes)), sizes)
    done_sym, done_word = [], []
    if len(sizes) and sizes.max() > LONG:
        at = np.cumsum(sizes) - sizes
        long = np.flatnonzero(sizes > LONG)
        for w in long:
            out[w] = _queued(v, sym[at[w] : at[w] + sizes[w]])
            done_sym.append(out[w])
            done_word.append(np.full(len(out[w]), w))
        keep = np.repeat(sizes <= LONG, sizes)
        sym, word = sym[keep], word[keep]
    rank = np.full(len(sym), NONE, np.int32)
    if len(sym) > 1:
        _, rank[:-1] = v.pair(sym[:-1], sym[1:])
        rank[:-1][word[1:] != word[:-1]] = NONE
    while len(sym):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        key = (rank.astype(np.int64) << 32) | np.arange(len(sym))
        best = np.minimum.reduceat(key, first)
        more = (best >> 32) != NONE
        if not more.all():
            keep = np.repeat(more, np.diff(np.append(first, len(sym))))
            done_sym.append(sym[~keep])
            done_word.append(word[~keep])
            shift = np.cumsum(keep) - 1
            sym, word, rank = sym[keep], word[keep], rank[keep]
            best = best[more]
            at = shift[best & 0xFFFFFFFF]
        else:
            at = best & 0xFFFFFFFF
        if not len(sym):
            break
        sym[at], _ = v.pair(sym[at], sym[at + 1])
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        shift = np.cumsum(keep) - 1
        sym, word, rank = sym[keep], word[keep], rank[keep]
        at = shift[at]
        for i in (at, at[at > 0] - 1):
            i = i[i + 1 < len(sym)] if len(i) else i
            same = word[i] == word[i + 1]
            _, r = v.pair(sym[i], sym[i + 1])
            rank[i] = np.where(same, r, NONE)
        if word.size:
            rank[-1] = NONE
    sym = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int32)
    word = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
    order = np.argsort(word, kind="stable")
    return sym[order], np.bincount(word, minlength=len(sizes))


def encode_flat(v: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts without begin and end, and how many each text has."""
    mark = chr(SPACE)
    texts = [(mark if v.prefix else "") + t.replace(" ", mark) if t else "" for t in texts]
    codes = codes_of("".join(texts))
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    if not len(codes):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    sym = v.low[np.minimum(codes, 0xFFFF)]
    high = codes > 0xFFFF
    if high.any():
        at = np.minimum(np.searchsorted(v.char_codes, codes[high]), len(v.char_codes) - 1)
        sym[high] = np.where(v.char_codes[at] == codes[high], v.char_ids[at], -1)
    sym = np.where(sym < 0, -1 - codes.astype(np.int64), sym).astype(np.int32)
    number = v.number[np.maximum(sym, -1)]
    cut = np.ones(len(codes), bool)
    cut[1:] = ~v.joined[number[:-1], number[1:]]
    starts_of_texts = (np.cumsum(lengths) - lengths)[lengths > 0]
    cut[starts_of_texts] = True
    start = np.flatnonzero(cut)
    size = np.diff(np.append(start, len(codes)))
    rolling = Rolling(mix(codes.astype(np.uint64) + np.uint64(1)))
    _, sample, inverse = np.unique(rolling(start, start + size) + size.astype(np.uint64), return_index=True, return_inverse=True)
    # Words that share a hash must be the same characters; a stray one is merged by itself.
    twin = spans(start[sample][inverse], np.minimum(size[sample][inverse], size))
    differs = codes[twin] != codes if len(twin) == len(codes) else None
    if differs is None or differs.any():
        sample, inverse = np.arange(len(start)), np.arange(len(start))
    ids, n_ids = _merged(v, sym[spans(start[sample], size[sample])], size[sample])
    unknown = ids < 0
    if unknown.any():
        as_bytes = [[int(v.bytes_at[b]) for b in chr(-1 - c).encode("utf-8", "surrogatepass")] for c in ids[unknown]]
        repeat = np.ones(len(ids), np.int64)
        repeat[unknown] = [len(b) for b in as_bytes]
        owner = np.repeat(np.repeat(np.arange(len(n_ids)), n_ids), repeat)
        spread = np.repeat(ids, repeat)
        spread[np.repeat(unknown, repeat)] = np.concatenate(as_bytes)
        ids, n_ids = spread, np.bincount(owner, minlength=len(n_ids))
    at = np.cumsum(n_ids) - n_ids
    flat = ids[spans(at[inverse], n_ids[inverse])]
    text_of_word = np.searchsorted(np.cumsum(lengths), start, "right")
    per_text = np.bincount(text_of_word, weights=n_ids[inverse], minlength=len(texts)).astype(np.int64)
    return flat, per_text


def decode_flat(v: Vocabulary, ids: np.ndarray, per_text: np.ndarray) -> list[bytes]:
    """Texts of runs of ids: control ids vanish, the leading space is dropped once."""
    ends = np.cumsum(per_text)
    shown = np.flatnonzero(v.kinds[ids] != 1)
    size = v.blob_size[ids]
    blob = v.blob[spans(v.blob_at[ids], size)].tobytes()
    stop = np.concatenate([[0], np.cumsum(size)])
    first = shown[np.minimum(np.searchsorted(shown, ends - per_text), max(len(shown) - 1, 0))] if len(shown) else None
    out = []
    for i, (a, b) in enumerate(zip((ends - per_text).tolist(), ends.tolist())):
        part = blob[stop[a] : stop[b]]
        if part and first is not None and v.prefix and v.kinds[ids[first[i]]] == 0 and part[:1] == b" ":
            part = part[1:]
        out.append(part)
    return out


def encode(docs: DataFrame, path: str, text: str = "text", bos: int = 1, eos: int = 2) -> DataFrame:
    """Encode every text and decode its ids again.

    -> the other columns of `docs`, n_tokens long, ids binary (little-endian unsigned 32-bit,
    begin and end included), decoded string. A column of `docs` with one of these names is
    dropped in favour of the new one.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(path))  # size bound: the model's

    def run(texts: list[str]) -> dict[str, pa.Array]:
        v = vocabulary.value
        ids, per_text = encode_flat(v, texts)
        n = per_text + 2
        ends = np.cumsum(n)
        full = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        full[ends - n], full[ends - 1] = bos, eos
        full[spans(ends - n + 1, per_text)] = ids
        raw = full.astype("<u4").tobytes()
        decoded = decode_flat(v, full, n)
        return {
            "n_tokens": pa.array(n, pa.int64()),
            "ids": pa.array([raw[4 * a : 4 * b] for a, b in zip(ends - n, ends)], pa.binary()),
            "decoded": pa.array([d.decode("utf-8", "replace") for d in decoded], pa.string()),
        }

    new = {"n_tokens", "ids", "decoded"}
    column = fresh(docs, "text_to_encode")
    kept = {c: c for c in docs.columns if c != text and c.lower() not in new}
    return arrow_map(pick(docs, **kept, **{column: text}), run, "n_tokens bigint, ids binary, decoded string", column)

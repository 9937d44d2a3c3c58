"""Line dedup by overlapping windows of three lines.

A line is a physical line; where one holds several sentences each of them counts as a line,
and a sentence beyond `LONG` characters is cut after every `PIECE_WORDS` words, so that a
passage on one physical line is covered too. Every three consecutive lines are
hashed (64 bits); a window found again anywhere, in another document or further on in the same one, is
a repeat. Its first place (the smallest doc_id, then the smallest position) stays. In all
later places the covered lines go; overlapping windows merge into one removed range.

Windows are counted with partial aggregates, so a window that a third of all documents share
costs one row per task. The join with the repeated windows can be split by AQE. What a
document gathers is bounded by its own number of windows.

Defined results: null texts stay null; texts of fewer than three lines, and windows below
`min_bytes` bytes of UTF-8 if a caller asks for that, stay as they are. Rows with equal doc_id and text are one document:
all of them lose the same lines. Rows with a null doc_id come after all others, in the order
of their hashed text; rows that share a doc_id but not the text count as one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspan.llm.batches import fresh, quoted
from quantspan.session import materialize

WINDOW = 3
MIN_BYTES = 0
BREAK = r"(?<=\n)(?=[^\n])|(?<=[.!?] )(?=\S)"
LONG, PIECE_WORDS = 120, 8
PIECE = rf"[ \t\n\r\f]*(?:[^ \t\n\r\f]+[ \t\n\r\f]*){{1,{PIECE_WORDS}}}"
LAST = 1 << 62


def _lines(text: Column) -> Column:
    """The lines of a text; joined they give the text again."""
    cut = lambda x: F.when(F.octet_length(x) > LONG, F.regexp_extract_all(x, F.lit(PIECE), F.lit(0))).otherwise(F.array(x))
    return F.flatten(F.transform(F.split(text, BREAK), cut))


def _order(doc_id: Column, text: Column) -> Column:
    """A place in the order of documents; null ids after the others."""
    return F.coalesce(doc_id.cast("long"), F.lit(LAST) + F.xxhash64(text).bitwiseAND(F.lit(LAST // 2 - 1)))


def windows(docs: DataFrame, doc_id: str, text: str, min_bytes: int) -> DataFrame:
    """-> (o, k, windows): of each document the hashes of its windows, null for short ones.

    Written once, because it is read by the count and by the join.
    """
    source = F.col(quoted(text))
    lines = docs.select(
        _order(F.col(quoted(doc_id)), source).alias("o"),
        F.xxhash64(source).alias("k"),
        _lines(source).alias("lines"),
    ).where(F.size("lines") >= WINDOW)
    hashed = lines.select(
        "o",
        "k",
        F.expr(r"transform(lines, x -> xxhash64(rtrim(substring_index(x, '\n', 1))))").alias("h"),
        F.expr("transform(lines, x -> octet_length(x))").alias("n"),
    )
    found = F.expr(
        f"""transform(sequence(0, size(h) - {WINDOW}),
            i -> CASE WHEN n[i] + n[i + 1] + n[i + 2] >= {min_bytes} THEN xxhash64(h[i], h[i + 1], h[i + 2]) END)"""
    )
    return materialize(hashed.select("o", "k", found.alias("windows")), "windows")


def later_places(found: DataFrame) -> DataFrame:
    """-> (o, k, starts): the sorted window positions to remove from each document."""
    repeated = (
        found.select("o", F.explode("windows").alias("h"))
        .where("h IS NOT NULL")
        .groupBy("h")
        .agg(F.count("*").alias("n"), F.min("o").alias("first"))
        .where("n > 1")
        .drop("n")
    )
    places = (
        found.select("o", "k", F.posexplode("windows").alias("pos", "h"))
        .where("h IS NOT NULL")
        .join(repeated, "h")
        .groupBy("o", "k")
        .agg(
            F.collect_set(F.when(F.col("o") > F.col("first"), F.col("pos"))).alias("later"),
            F.collect_set(F.when(F.col("o") == F.col("first"), F.struct("h", "pos"))).alias("own"),
        )
    )
    # In the first document of a window all positions but the smallest go.
    return (
        places.withColumn("own", F.array_sort("own"))
        .select("o", "k", F.array_sort(F.array_distinct(F.concat("later", _again()))).alias("starts"))
        .where(F.size("starts") > 0)
    )


def _again() -> Column:
    """Positions of `own` (sorted by hash and position) whose window equals the one before."""
    pairs = F.arrays_zip(F.slice("own", 2, F.size("own")).alias("x"), F.col("own").alias("y"))
    return F.when(
        F.size("own") > 1,
        F.transform(
            F.filter(
                pairs,
                lambda p: p["x"]["h"] == p["y"]["h"],
            ),
            lambda p: p["x"]["pos"],
        ),
    ).otherwise(F.array().cast("array<int>"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_bytes: int = MIN_BYTES, counts: bool = False) -> DataFrame:
    """`docs` with the repeated lines of its texts removed; with `counts` also n_lines, n_removed.

    With `counts`, columns of `docs` with these two names are replaced.
    """
    later = later_places(windows(docs, doc_id, text, min_bytes))
    names = {n: fresh(docs, n) for n in ("place_order", "place_key", "place_starts")}
    o, k, starts = names.values()
    source = F.col(quoted(text))
    keyed = docs.withColumns({o: _order(F.col(quoted(doc_id)), source), k: F.xxhash64(source)})
    joined = keyed.join(later.select(F.col("o").alias(o), F.col("k").alias(k), F.col("starts").alias(starts)), [o, k], "left")
    # A column of its own: within the lambda below it would be made anew for every stretch.
    own = fresh(docs, "own_lines")
    cut_texts = F.col(starts).isNotNull()
    joined = joined.withColumn(own, _lines(source) if counts else F.when(cut_texts, _lines(source)))
    lines = F.col(own)
    # The stretches between removed ranges; where ranges touch or overlap, a stretch is empty.
    begin = F.concat(F.array(F.lit(0)), F.transform(starts, lambda s: s + WINDOW))
    stop = F.concat(F.col(starts), F.array(F.size(lines)))
    stretches = F.arrays_zip(begin.alias("a"), stop.alias("b"))
    size = lambda p: F.greatest(p["b"] - p["a"], F.lit(0))
    kept = F.flatten(F.transform(stretches, lambda p: F.slice(lines, p["a"] + 1, size(p))))
    cut = F.when(cut_texts, F.array_join(kept, "")).otherwise(source)
    new = {text: cut}
    if counts:
        n_lines = F.coalesce(F.size(lines), F.lit(0)).cast("long")
        n_left = F.aggregate(stretches, F.lit(0), lambda n, p: n + size(p))
        n_kept = F.when(cut_texts, n_left).otherwise(n_lines).cast("long")
        new |= {"n_lines": n_lines, "n_removed": n_lines - n_kept}
    return joined.withColumns(new).drop(o, k, starts, own)


def oracle(min_bytes: int = MIN_BYTES) -> str:
    """The same over `documents` with unique ids, in SQL."""
    return rf"""
WITH sentences AS (
  SELECT doc_id, unnest(string_split(marked, chr(1))) AS unit, generate_subscripts(string_split(marked, chr(1)), 1) AS s
  FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '(\n)([^\n])', '\1' || chr(1) || '\2', 'g'),
          '([.!?] )([^ \t\n\r\f\v])', '\1' || chr(1) || '\2', 'g') AS marked
        FROM documents WHERE text IS NOT NULL)),
cut AS (
  SELECT doc_id, s, CASE WHEN strlen(unit) > {LONG}
    THEN regexp_extract_all(unit, '{PIECE}') ELSE [unit] END AS parts FROM sentences),
parted AS (SELECT doc_id, s, unnest(parts) AS unit, generate_subscripts(parts, 1) AS p FROM cut),
units AS (SELECT doc_id, unit, row_number() OVER (PARTITION BY doc_id ORDER BY s, p) AS i FROM parted),
keyed AS (SELECT doc_id, i, unit, rtrim(split_part(unit, chr(10), 1), ' ') AS line FROM units),
w AS (
  SELECT doc_id, i, line AS a, lead(line) OVER p AS b, lead(line, 2) OVER p AS c,
         strlen(unit) + lead(strlen(unit)) OVER p + lead(strlen(unit), 2) OVER p AS n
  FROM keyed WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
later AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS r
    FROM w WHERE c IS NOT NULL AND n >= {min_bytes}) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + d.d AS i FROM later, (VALUES (0), (1), (2)) d(d)),
kept AS (
  SELECT k.doc_id, string_agg(CASE WHEN g.i IS NULL THEN unit ELSE '' END, '' ORDER BY k.i) AS text,
         count(*) AS n_lines, count(g.i) AS n_removed
  FROM keyed k LEFT JOIN gone g USING (doc_id, i) GROUP BY k.doc_id)
SELECT d.doc_id, k.text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)"""

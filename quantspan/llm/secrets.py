"""Secret scans: fixed patterns, and a battery of randomness tests on long tokens.

Every run of 16 or more token characters gets an encoding (hex, base32, base36, base64) from
the characters it has. Three tests ask whether it looks random there: chi-squared uniformity
over the alphabet (Wilson-Hilferty), runs about the middle of the alphabet, and lag-one
serial correlation. Their smallest p-value times three is the token's randomness.

The null hypothesis is "ordinary writing". Its distribution comes from the corpus: every text
is stripped to its letters, all of them are cut into runs of the bands' lengths by turns, and
every run goes through the same tests. Short runs of letters pass for random often, long ones hardly
ever, so a token is compared with those of its own band. The resulting p-values go through
Benjamini-Hochberg over all tokens of the corpus. Both distributions are counts over a fixed
grid of bands and randomness, so their size does not depend on the corpus.

Only DataFrame and SQL functions are used. Defined results: null and empty texts have no
spans; positions are code points, ends exclusive; a token that overlaps a pattern's span is
not added again. U+0001 and U+0002 are read as U+0003, which no pattern holds. Rows that repeat
an id or a text are rows of their own. A text may hold any number of matches: the work for n of them
grows with n ** 1.5 at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantspan.llm.batches import quoted

MARK, INNER = "\u0001", "\u0002"
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]{16,})"
HEX = r"([0-9a-f]{24,})"
MIN_VALUE = 6
TOKEN = r"[A-Za-z0-9+/_-]{16,}"
WORD = "^[A-Za-z]?([a-z]+|[A-Z]+)$"
RANK = {"assign": 0, "access": 1, "hex": 2, "random": 3}
BANDS = (16, 20, 24, 32, 48)
STEPS, FINEST = 20, 200  # grid cells per power of ten of randomness, and the last cell

# Of a token: chi-squared, runs about the middle, the three tests together, its cell.
CHI = "(pow(greatest({x}sq * {x}a / {x}n - {x}n, 0.0D) / ({x}a - 1), 1.0D / 3) - (1 - 2 / (9 * ({x}a - 1)))) / sqrt(2 / (9 * ({x}a - 1)))"
RUNS = """CASE WHEN {x}hi = 0 OR {x}hi = {x}n THEN sqrt({x}n) ELSE
                ({x}runs - 1 - 2 * {x}hi * ({x}n - {x}hi) / {x}n)
                / sqrt(greatest(2 * {x}hi * ({x}n - {x}hi) * (2 * {x}hi * ({x}n - {x}hi) - {x}n) / ({x}n * {x}n * ({x}n - 1)), 1e-9D)) END"""
P = "least(1.0D, 3 * least({upper}, {runs}, {serial}))"
CELL = f"cast(least({FINEST}, floor(-log10(greatest({{p}}, 1e-12D)) * {STEPS})) AS int)"


@dataclass(frozen=True)
class Settings:
    rate: float = 0.05  # of false discoveries


def _pieces(text: Column, pattern: str, replacement: str) -> Column:
    """Text outside and inside the matches by turns; one piece where nothing matches."""
    marked = F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}{replacement}{MARK}"))
    return F.when(text.rlike(pattern), F.split(marked, MARK)).otherwise(F.array(text))


def _found(df: DataFrame, name: str, pattern: str, replacement: str, size: str, keep: str, text: str) -> DataFrame:
    """Add column `name`: array of (s, r, e, t) for the matches for which `keep` holds.

    `size` is the length of a match and `keep` a condition, both in terms of the piece x.
    """
    pieces, sizes, starts = (f"{name}_{x}" for x in ("pieces", "sizes", "starts"))
    df = df.withColumn(pieces, _pieces(F.col(text), pattern, replacement))
    lengths = f"transform({pieces}, (x, i) -> CASE WHEN i % 2 = 1 THEN {size} ELSE length(x) END)"
    df = _sums_before(df.withColumn(sizes, F.expr(lengths)), sizes, starts)
    found = f"""filter(
        transform({pieces}, (x, i) -> CASE WHEN i % 2 = 1 AND {keep}
            THEN named_struct('s', {starts}[i], 'r', {RANK[name]}, 'e', {starts}[i] + {sizes}[i], 't', x) END),
        y -> y IS NOT NULL)"""
    return df.withColumn(name, F.expr(found)).drop(pieces, sizes, starts)


def _blocks(array: str) -> str:
    """An array cut into blocks of about the root of its size: n items in n ** 1.5 steps at most."""
    size = f"cast(ceil(sqrt(size({array}))) AS int)"
    return f"transform(sequence(0, cast(ceil(size({array}) / {size}) AS int) - 1), b -> slice({array}, b * {size} + 1, {size}))"


def _sums_before(df: DataFrame, sizes: str, name: str) -> DataFrame:
    """Add column `name`: for each item of the array `sizes` the sum of those before it.

    In two levels, because a list grows by copies of itself: the sums of blocks, then inside blocks.
    """
    blocks, before = f"{name}_blocks", f"{name}_before"
    grow = "named_struct('p', {start}, 'out', cast(array() AS array<int>)), (acc, x) -> named_struct('p', acc.p + x, 'out', array_append(acc.out, acc.p)), acc -> acc.out"
    df = df.withColumn(blocks, F.expr(_blocks(sizes)))
    df = df.withColumn(before, F.expr(f"aggregate(transform({blocks}, k -> aggregate(k, 0, (a, x) -> a + x)), {grow.format(start=0)})"))
    return df.withColumn(name, F.expr(f"flatten(zip_with({blocks}, {before}, (k, p) -> aggregate(k, {grow.format(start='p')})))")).drop(blocks, before)


def _alphabet(core: str) -> str:
    """The alphabet of a token without padding, null where it is no known encoding."""
    return f"""CASE
        WHEN {core} RLIKE '^[0-9]+$' THEN NULL
        WHEN {core} RLIKE '^[0-9a-f]+$' THEN '0123456789abcdef'
        WHEN {core} RLIKE '^[0-9A-F]+$' THEN '0123456789ABCDEF'
        WHEN {core} RLIKE '^[A-Z2-7]+$' THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'
        WHEN {core} RLIKE '^[0-9a-z]+$' THEN '0123456789abcdefghijklmnopqrstuvwxyz'
        WHEN {core} RLIKE '^[0-9A-Z]+$' THEN '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'
        ELSE 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/' END"""


def _tail(z: str) -> str:
    """P(|Z| > |z|) of a normal variable (rational approximation, error below 2e-7)."""
    x = f"(abs({z}) / sqrt(2.0D))"
    t = f"(1.0D / (1.0D + 0.3275911D * {x}))"
    poly = f"({t} * (0.254829592D + {t} * (-0.284496736D + {t} * (1.421413741D + {t} * (-1.453152027D + {t} * 1.061405429D)))))"
    return f"({poly} * exp(-{x} * {x}))"


def _upper(z: str) -> str:
    """P(Z > z) of a normal variable."""
    return f"(CASE WHEN {z} > 0 THEN {_tail(z)} / 2 ELSE 1 - {_tail(z)} / 2 END)"


def battery(df: DataFrame, tokens: str) -> DataFrame:
    """Replace the array `tokens` of (s, e, t) by one of (s, e, word, band, cell).

    `word`: letters of one case (a capital may lead), the null. `band`: of the length.
    `cell`: of the randomness, 0 for a token that all tests call random.
    """
    step = lambda expression: df.withColumn(tokens, F.expr(expression))
    df = step(f"transform({tokens}, x -> named_struct('s', x.s, 'e', x.e, 'word', x.t RLIKE '{WORD}', 't', translate(x.t, '-_', '+/')))")
    df = step(f"filter(transform({tokens}, x -> named_struct('s', x.s, 'e', x.e, 'word', x.word, 't', x.t, 'abc', {_alphabet('x.t')})), x -> x.abc IS NOT NULL)")
    df = step(
        f"""transform({tokens}, x -> named_struct('s', x.s, 'e', x.e, 'word', x.word, 'a', cast(length(x.abc) AS double),
            'v', transform(filter(split(x.t, ''), c -> c != ''), c -> cast(instr(x.abc, c) - 1 AS double))))"""
    )
    df = step(
        f"""transform({tokens}, x -> named_struct('s', x.s, 'e', x.e, 'word', x.word, 'a', x.a, 'v', x.v,
            'n', cast(size(x.v) AS double),
            'm', aggregate(x.v, 0.0D, (y, z) -> y + z) / size(x.v),
            'sq', aggregate(array_distinct(x.v), 0.0D, (y, d) -> y + pow(size(filter(x.v, w -> w = d)), 2)),
            'hi', cast(size(filter(x.v, w -> w >= x.a / 2)) AS double),
            'runs', 1.0D + aggregate(zip_with(slice(x.v, 1, size(x.v) - 1), slice(x.v, 2, size(x.v)), (y, z) ->
                CASE WHEN (y >= x.a / 2) != (z >= x.a / 2) THEN 1.0D ELSE 0.0D END), 0.0D, (y, z) -> y + z)))"""
    )
    df = step(
        f"""transform({tokens}, x -> named_struct('s', x.s, 'e', x.e, 'word', x.word, 'n', x.n,
            'chi', {CHI.format(x='x.')},
            'rz', {RUNS.format(x='x.')},
            'cz', CASE WHEN aggregate(x.v, 0.0D, (y, z) -> y + pow(z - x.m, 2)) = 0 THEN sqrt(x.n) ELSE
                sqrt(x.n) * (1 / x.n + aggregate(zip_with(slice(x.v, 1, size(x.v) - 1), slice(x.v, 2, size(x.v)), (y, z) -> (y - x.m) * (z - x.m)), 0.0D, (y, z) -> y + z)
                / aggregate(x.v, 0.0D, (y, z) -> y + pow(z - x.m, 2))) END))"""
    )
    df = step(
        f"""transform({tokens}, x -> named_struct('s', x.s, 'e', x.e, 'word', x.word, 'n', x.n,
            'p', {P.format(upper=_upper('x.chi'), runs=_tail('x.rz'), serial=_tail('x.cz'))}))"""
    )
    band = " + ".join(f"CASE WHEN x.n >= {b} THEN 1 ELSE 0 END" for b in BANDS[1:])
    return step(
        f"""transform({tokens}, x -> named_struct('s', x.s, 'e', x.e, 'word', x.word, 'band', {band},
            'cell', {CELL.format(p='x.p')}))"""
    )


def word_runs(df: DataFrame, text: str) -> DataFrame:
    """-> (band, run): the letters of every text, all of them, in runs of the bands' lengths by turns.

    What is left at the end of a text is as many whole runs as it has room for.
    """
    letters = F.lower(F.regexp_replace(F.col(text), "[^A-Za-z]+", ""))
    stretches = F.regexp_extract_all(letters, F.lit(f".{{1,{sum(BANDS)}}}"), F.lit(0))
    starts = [1 + sum(BANDS[:i]) for i in range(len(BANDS))]
    cut = F.array(*[F.substr(F.col("x"), F.lit(a), F.lit(n)) for a, n in zip(starts, BANDS)])
    runs = df.select(F.explode(stretches).alias("x")).select(F.posexplode(cut).alias("band", "run"))
    return runs.where(F.length("run") == F.element_at(F.array(*map(F.lit, BANDS)), F.col("band") + 1))


def word_cells(runs: DataFrame) -> DataFrame:
    """(band, run) of lower-case letters -> (band, cell), as `battery` has them, from sums of the run.

    The letters a to z are 10 to 35 in both alphabets that such runs can have, hexadecimal and base36.
    """
    abc = "abcdefghijklmnopqrstuvwxyz"
    letters = "array(" + ", ".join(f"'{c}'" for c in abc) + ")"
    add = "0.0D, (y, z) -> y + z"
    df = runs.selectExpr(
        "band",
        "cast(length(run) AS double) AS n",
        "CASE WHEN run RLIKE '^[a-f]+$' THEN 16.0D ELSE 36.0D END AS a",
        f"aggregate({letters}, 0.0D, (y, c) -> y + pow(length(run) - length(replace(run, c, '')), 2)) AS sq",
        f"translate(run, '{abc}', '{''.join('01'[c >= 'i'] for c in abc)}') AS upper",
        "transform(slice(split(run, ''), 1, length(run)), c -> cast(ascii(c) - 87 AS double)) AS v",
    )
    df = df.selectExpr(
        "band", "n", "a", "sq",
        "CASE WHEN a = 16 THEN n ELSE cast(length(replace(upper, '0', '')) AS double) END AS hi",
        "1 + (2 * n - length(replace(upper, '01', '')) - length(replace(upper, '10', ''))) / 2 AS runs",
        "v[0] + element_at(v, -1) AS ends",
        f"aggregate(v, {add}) AS total",
        "aggregate(v, 0.0D, (y, z) -> y + z * z) AS squares",
        f"aggregate(zip_with(slice(v, 1, size(v) - 1), slice(v, 2, size(v)), (y, z) -> y * z), {add}) AS pairs",
    )
    # Whole numbers up to here; n * n times the sums of products about the mean are, too.
    df = df.selectExpr(
        "band", "n", f"{CHI.format(x='')} AS chi", f"{RUNS.format(x='')} AS rz",
        """CASE WHEN sq = n * n THEN sqrt(n) ELSE
            sqrt(n) * (1 / n + (n * n * pairs - n * total * (2 * total - ends) + (n - 1) * total * total) / (n * (n * squares - total * total))) END AS cz""",
    )
    return df.selectExpr("band", f"{P.format(upper=_upper('chi'), runs=_tail('rz'), serial=_tail('cz'))} AS p").selectExpr("band", f"{CELL.format(p='p')} AS cell")


def accepted_cells(df: DataFrame, text: str, s: Settings) -> list[int]:
    """Cells (band * (FINEST + 1) + randomness) whose tokens are discoveries.

    A bounded table: at most len(BANDS) * (FINEST + 1) cells, whatever the corpus.
    """
    token = lambda t: F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"), t.alias("t"))
    runs = F.filter(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: ~t.rlike(WORD))
    found = df.select(F.when(F.col(text).rlike(TOKEN), F.transform(runs, token)).otherwise(F.array()).alias("tokens"))
    # The outer form infers no filter, which would run the battery twice.
    tested = battery(found, "tokens").select(F.explode_outer("tokens").alias("x")).groupBy("x.band", "x.cell")
    tested = tested.agg(F.lit(0).cast("long").alias("words"), F.count_if(F.col("x.word") == F.lit(False)).alias("tokens"))
    ordinary = word_cells(word_runs(df, text)).groupBy("band", "cell").agg(F.count("*").alias("words"), F.lit(0).cast("long").alias("tokens"))
    cells = tested.unionByName(ordinary).groupBy("band", "cell").agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens"))
    # Of the band's ordinary runs, those that look at least as random.
    up_to = W.partitionBy("band").orderBy("cell").rowsBetween(W.unboundedPreceding, 0)
    p = (F.sum("words").over(up_to) + 1) / (F.sum("words").over(W.partitionBy("band")) + 1)
    ranked = cells.withColumn("p", p).where("band IS NOT NULL AND tokens > 0")
    by_p = W.orderBy("p").rangeBetween(W.unboundedPreceding, 0)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    tested_cells = ranked.select(
        (F.col("band") * (FINEST + 1) + F.col("cell")).cast("int").alias("id"),
        "p",
        F.sum("tokens").over(by_p).alias("k"),
        F.sum("tokens").over(everything).alias("m"),
    )
    good = F.when(F.col("p") * F.col("m") <= s.rate * F.col("k"), F.col("p"))
    rows = tested_cells.withColumn("limit", F.max(good).over(everything)).where("p <= limit").select("id").collect()
    return sorted(r["id"] for r in rows)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """-> doc_id and base, random: arrays of (s, r, e) by start, kind; r indexes `RANK`."""
    safe = F.translate(F.coalesce(F.col(quoted(text)), F.lit("")), MARK + INNER, "\u0003\u0003")
    df = docs.select(F.col(quoted(doc_id)).alias("doc_id"), safe.alias("body"))
    plain = docs.select(F.coalesce(F.col(quoted(text)), F.lit("")).alias("body"))
    cells = accepted_cells(plain, "body", s)
    df = _found(df, "assign", ASSIGN, f"$1{INNER}$2", "length(x) - 1", f"length(substring_index(x, '{INNER}', -1)) >= {MIN_VALUE}", "body")
    df = _found(df, "access", ACCESS, "$1", "length(x)", "true", "body")
    df = _found(df, "hex", HEX, "$1", "length(x)", "true", "body")
    df = _found(df, "random", f"({TOKEN})", "$1", "length(x)", f"NOT x RLIKE '{WORD}'", "body").drop("body")
    base = "transform(array_sort(concat(assign, access, hex)), x -> named_struct('s', x.s, 'r', x.r, 'e', x.e))"
    df = df.select("doc_id", F.expr(base).alias("base"), "random")
    if not cells:
        return df.withColumn("random", F.expr("cast(array() AS array<struct<s:int,r:int,e:int>>)"))
    df = battery(df, "random")
    known = ", ".join(map(str, cells))
    # Pattern spans in blocks of their order: a token looks into the blocks around its place only.
    parts = f"CASE WHEN size(base) = 0 THEN array() ELSE {_blocks('base')} END"
    bounds = "transform(parts, k -> named_struct('s', k[0].s, 'e', array_max(transform(k, b -> b.e)), 'k', k))"
    df = df.withColumn("parts", F.expr(parts)).withColumn("parts", F.expr(bounds))
    add = f"""transform(filter(random, x -> NOT x.word AND array_contains(array({known}), x.band * {FINEST + 1} + x.cell)
            AND NOT exists(parts, q -> q.s < x.e AND x.s < q.e AND exists(q.k, b -> b.s < x.e AND x.s < b.e))),
        x -> named_struct('s', x.s, 'r', {RANK["random"]}, 'e', x.e))"""
    return df.withColumn("random", F.expr(add)).drop("parts")


def listed(spans: str) -> str:
    """SQL for kind:start:end of an array of spans, comma-joined in order."""
    kinds = "array('assign', 'access', 'hex', 'random')"
    return f"array_join(transform(array_sort({spans}), x -> concat({kinds}[x.r], ':', x.s, ':', x.e)), ',')"

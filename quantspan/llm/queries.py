"""The queries of these operators over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspan.llm import bit_planes, html_blocks, latent, line_windows, lm_scoring, lsh_forest, merkle, nbsvm, norm_buckets, pieces_bpe, repetition, secrets, toxicity
from quantspan.llm.samples import remainder
from quantspan.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
TOXIC = 0.3


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return latent.matches(docs, table(spark, sf_dir, "benchmark"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", modulus=4, held_out=2)
    return toxicity.score(docs, model).select(
        "doc_id",
        (remainder(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"),
    )


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    count = lambda rank: F.expr(f"size(filter(base, x -> x.r = {rank}))").cast("long")
    return secrets.scan(docs).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(F.expr(secrets.listed("base")), 256).alias("base_sha256"),
        F.expr(secrets.listed("concat(base, random)")).alias("spans"),
    )


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_windows.dedup(docs, counts=True)


ORACLE["op4_line_dedup"] = line_windows.oracle()


@query
def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lsh_forest.join(docs).select("doc_id", "class_id", "n_links")


@query
def op6_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repetition.rules(docs)


FILE_PAGES = 500


@query
def op7_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as WARC records in files of at most 500, and a replica with decayed records.

    Every 97th page has changed there, every 211th is gone. Records are measured where they are
    read; only sizes and digests go on.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    record = merkle.record_bytes(F.col("url"), F.col("html"))
    # A byte is turned in every 97th record; offsets stay, as in a file that decays in place.
    turned = F.concat(F.expr("substring(record, 1, octet_length(record) - 5)"), F.lit(b"?"), F.expr("substring(record, -4, 4)"))
    decayed = F.when(F.col("page_id") % 97 == 11, turned).otherwise(F.col("record"))
    size, digest = merkle.measures(F.col("record"))
    measured = pages.withColumn("record", record).select(
        "page_id",
        "url",
        F.format_string("pages-%06d.warc", F.floor(F.col("page_id") / FILE_PAGES)).alias("file"),
        size.alias("size"),
        digest.alias("digest"),
        merkle.measures(decayed)[1].alias("decayed"),
    )
    placed = materialize(merkle.offsets(measured, "page_id"), "digests")
    left = placed.select("file", "offset", "size", "digest")
    right = placed.where("page_id % 211 != 7").select("file", "offset", "size", F.col("decayed").alias("digest"))
    names = placed.select("page_id", "url", "file", "offset")
    return merkle.audit(left, right).join(names, ["file", "offset"]).select("page_id", "url", "file", "offset", "status")


ORACLE["op7_merkle_audit"] = r"""
WITH sized AS (
  SELECT page_id, url, printf('pages-%06d.warc', CAST(page_id // 500 AS BIGINT)) AS file,
    strlen('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ')
    + strlen(coalesce(url, '')) + strlen('Content-Type: text/html') + strlen('Content-Length: ') + 6
    + strlen(CAST(strlen(coalesce(html, '')) AS VARCHAR)) + strlen(coalesce(html, '')) + 6 AS size
  FROM pages),
placed AS (
  SELECT page_id, url, file, CAST(coalesce(sum(size) OVER (PARTITION BY file ORDER BY page_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM sized)
SELECT page_id, url, file, "offset", CASE WHEN page_id % 211 = 7 THEN 'missing' ELSE 'changed' END AS status
FROM placed WHERE page_id % 211 = 7 OR page_id % 97 = 11"""


@query
def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_blocks.extract(pages).select("page_id", "url", "text", "n_chars")


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = nbsvm.fit(docs, table(spark, sf_dir, "labels"), "quality", modulus=3, held_out=1)
    return nbsvm.score(docs, model).select(
        "doc_id",
        (remainder(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_digests(pieces_bpe.encode(docs, piece_model()))


@query
def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm_scoring.score(docs, remainder(F.col("id"), 10) != 0, piece_model())
    held_out = (remainder(F.col("doc_id"), 10) == 0).alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector as an anchor; the labels of every seventh are shifted by one first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return bit_planes.mine(rows, F.col("id") % 100 == 0)


ORACLE["op12_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id AS id,
    CAST(list_dot_product(a.q, c.q) AS BIGINT) AS score
  FROM v a, v c WHERE a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 5"""


@query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return norm_buckets.search(docs, table(spark, sf_dir, "benchmark"))


ORACLE["op13_lexical_search"] = rf"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{norm_buckets.UPPER}', '{norm_buckets.LOWER}'),
    '{norm_buckets.TERM}')) AS term FROM documents WHERE text IS NOT NULL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
sized AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sized),
weighted AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{norm_buckets.UPPER}', '{norm_buckets.LOWER}'),
    '{norm_buckets.TERM}')) AS term FROM benchmark WHERE text IS NOT NULL),
scored AS (
  SELECT item_id, doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN weighted USING (term) JOIN tf USING (term) JOIN sized USING (doc_id), total GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50"""

"""Documents to tokens: the stages of the corpus pipeline, each a DataFrame of documents.

Null texts and texts without words go through every stage and end as begin and end ids. Rows with a
null id are judged like others. Of rows that repeat an id and its words one stays; of a class of near
duplicates the row with the smallest id, null ids after all others. Very long texts are read whole,
an empty table gives an empty one, and columns of other names stay until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantspan.llm import latent, line_windows, lsh_forest, pieces_bpe, toxicity
from quantspan.llm.queries import TOXIC, piece_model, table, token_digests
from quantspan.session import materialize


def less_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity limit, by a model fitted on their labels."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", modulus=4, held_out=2)
    return toxicity.clean(docs, model, TOXIC)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; lines that an earlier place has in a window of three, however short, are cut."""
    return line_windows.dedup(docs, min_bytes=0)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of every class of near duplicates."""
    return lsh_forest.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return latent.without_matches(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of what is left, as digests."""
    return token_digests(pieces_bpe.encode(docs.select("doc_id", "text"), piece_model()))


STAGES = [
    ("toxicity", less_toxic),
    ("line_dedup", without_repeated_lines),
    ("ngram_jaccard", one_of_each_group),
    ("decontamination", decontaminated),
    ("sentencepiece", tokens),
]
# The learned stages have no SQL; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

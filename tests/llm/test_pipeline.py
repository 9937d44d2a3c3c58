import corpus_pipeline
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from quantspan.llm import queries

from cases import frame, odd_rows, prose
from test_line_windows import brute as without_lines
from test_lsh_forest import brute as classes

SF = "/root/testdata/sf0.001"


def test_run_against_a_plain_version(spark, tmp_path):
    """Every stage's decisions spelled out; the learned one is taken as it is."""
    rows = {i: prose(i, 90) for i in range(60)}
    for i in range(0, 60, 5):
        w = rows[i].split()
        w[7], w[30], w[55] = "grobian", "grobian", "scoundrel"
        rows[i] = " ".join(w)
    rows[61], rows[62] = rows[1], rows[2].replace(".", "!", 1)
    items = [(k, prose(900 + k, 30)) for k in range(5)]
    rows[63] = prose(80, 40) + "\n" + items[2][1]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    spark.createDataFrame([(i, 1, int(i % 5 == 0 and i < 60)) for i in range(60)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = [(i, t) for i, t in rows.items() if not (i % 5 == 0 and i < 60)]
    left = sorted(without_lines(left).items())
    kept = {c for _, c, _ in classes([x for x in left if x[1].strip()])} | {i for i, t in left if not t.strip()}
    left = [(i, t) for i, t in left if i in kept and i != 63]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((i, len(library.encode(t)) + 2) for i, t in left)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.n_tokens) for r in got.collect()) == want


def test_stages_keep_the_columns_and_survive_empty_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, SF)
        assert out.count() == 0
        if name != "sentencepiece":
            assert out.columns == docs.columns


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    """Nulls in every column, empty and long texts, rows and ids that repeat."""
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (2, None, None)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    items = [(1, prose(900, 30)), (2, None), (None, prose(901, 30)), (3, "")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, sizes = frame(spark, odd_rows()), []
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        sizes.append(docs.count())
        assert name == "sentencepiece" or docs.columns == columns
    # The copy of document 1 goes, and one row of document 10; texts without words all stay.
    assert sizes[:2] == [len(odd_rows())] * 2 and sizes[2] == sizes[3] == sizes[4] < len(odd_rows())
    left = [r.doc_id for r in docs.collect()]
    assert {2, 3, 4, None} <= set(left) and left.count(10) == 1


def test_clean_documents_of_the_given_tables_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = docs.join(labels.where("toxic = 0"), "doc_id", "left_semi")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert kept.join(clean, "doc_id", "left_semi").count() >= 0.97 * clean.count()


def test_every_operator_has_a_query():
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in queries.QUERIES) == 1


def test_queries_equal_their_sql(spark):
    from check_oracle import compare, database

    con = database(SF)
    for name, sql in queries.ORACLE.items():
        assert compare(queries.QUERIES[name](spark, SF), con, sql)[0] == "ok", name


def test_crc_folds(spark):
    import zlib

    from quantspan.llm.samples import remainder

    rows = spark.range(200).select("id", remainder(F.col("id"), 4).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 4 for r in rows)

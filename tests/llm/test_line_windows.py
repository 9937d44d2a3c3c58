import re

import corpus_pipeline
from pyspark.sql import functions as F

from quantspan.llm import line_windows

from cases import frame, none, odd, odd_rows, prose


def lines_of(text):
    out = []
    for x in re.split(r"(?<=\n)(?=[^\n])|(?<=[.!?] )(?=\S)", text):
        long = len(x.encode()) > line_windows.LONG
        out += re.findall(r"[ \t\n\r\f]*(?:[^ \t\n\r\f]+[ \t\n\r\f]*){1,8}", x) if long else [x]
    return out


def brute(rows):
    """Later places of every window, by position in the order of ids."""
    seen, gone = {}, {}
    for i, text in sorted(rows):
        lines = lines_of(text)
        for p in range(len(lines) - 2):
            if sum(len(x.encode()) for x in lines[p : p + 3]) < line_windows.MIN_BYTES:
                continue
            key = tuple(x.split("\n")[0].rstrip(" ") for x in lines[p : p + 3])
            if seen.setdefault(key, (i, p)) != (i, p):
                gone.setdefault(i, set()).update((p, p + 1, p + 2))
    return {i: "".join(x for k, x in enumerate(lines_of(t)) if k not in gone.get(i, ())) for i, t in rows}


def texts():
    shared, passage = "\n".join(prose(k, 12) for k in range(4)), " ".join(w.rstrip(".") for w in prose(50, 60).split())
    return [
        (1, f"{prose(10, 20)}\n{shared}\n{prose(11, 20)}"),
        (2, f"{shared}\n{prose(12, 20)}"),
        (3, f"{prose(13, 20)}\n{shared}\n{shared}"),
        (4, f"{prose(14)}\n{passage}\n{prose(15)}"),
        (5, f"{passage}\n{prose(16)}"),
        (6, "a.\nb.\nc.\na.\nb.\nc."),
        (7, shared),
        (8, "\n\n" + prose(17, 30) + "\n\n\n" + shared + "\n"),
        (9, "one line without an end"),
    ]


def test_equals_a_plain_search(spark):
    rows = texts()
    got = {r.doc_id: r for r in line_windows.dedup(frame(spark, rows), counts=True).collect()}
    want = brute(rows)
    assert {i: r.text for i, r in got.items()} == want
    assert got[7].text == "" and got[7].n_removed == got[7].n_lines
    passage = lines_of(rows[4][1])[0]
    assert passage in got[4].text and passage not in got[5].text
    assert got[6].text == "a.\nb.\nc.\n"  # however short


def test_short_menus_go_from_all_later_documents(spark):
    rows = [(i, f"Home\nAbout us\nContact\n{prose(i, 40)}") for i in range(20)]
    got = {r.doc_id: r.text for r in line_windows.dedup(frame(spark, rows)).collect()}
    assert got[0] == rows[0][1] and all(got[i] == prose(i, 40) for i in range(1, 20))


def test_each_part_of_the_text_is_kept_in_order(spark):
    for t in [prose(1, 300), " leading\n\n\nx. y! z? end\n", "w " * 500, "x" * 999]:
        assert "".join(lines_of(t)) == t
        got = spark.createDataFrame([(t,)], "t string").select(line_windows._lines(F.col("t")).alias("x")).first().x
        assert got == lines_of(t)


def test_odd_rows(spark):
    docs = odd(spark)
    got = line_windows.dedup(docs)
    assert got.columns == docs.columns and got.count() == len(odd_rows())
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r.text)
    assert by[2] == [None] and by[3] == [""] and by[4] == [" \n\t \n"]
    assert by[8][0] != prose(1) and by[1] == [prose(1)]  # 8 repeats 1
    assert by[10] == [prose(303)] * 2  # rows that are one document keep its lines
    assert line_windows.dedup(none(spark), counts=True).count() == 0


def test_a_window_that_a_third_of_all_documents_share(spark):
    hot = prose(99, 40)
    rows = [(i, f"{prose(i, 30)}\n{hot}" if i % 3 == 0 else prose(i, 30)) for i in range(300)]
    got = {r.doc_id: r.text for r in line_windows.dedup(frame(spark, rows)).collect()}
    assert hot in got[0] and not any(hot in got[i] for i in range(3, 300, 3))
    assert got == brute(rows)


def test_short_windows_go_in_the_pipeline(spark, monkeypatch):
    menu, shout = "Home\nAbout\nContact\n", "WORD!! " * 60 + "In. Out. Up. Down. " * 10
    rows = [(1, menu + prose(1)), (2, prose(2) + "\n" + menu), (3, prose(3) + ". " + shout), (4, prose(4) + ". " + shout), (5, "a.\nb.\nc.\nd.")]
    got = {r.doc_id: r.text for r in corpus_pipeline.without_repeated_lines(spark, frame(spark, rows), "").collect()}
    assert got[1] == rows[0][1] and got[2] == prose(2) + "\n" and got[5] == rows[4][1]
    monkeypatch.setattr(line_windows, "MIN_BYTES", 0)
    assert got == brute(rows)
    assert "WORD!!" not in got[4] and "In. Out. Up." not in got[4]

import datetime as dt
import lzma
import struct

import numpy as np
import pytest
from conftest import business_days, day, walk
from pyspark.sql import functions as F

from quantspan.config import INSTRUMENTS
from quantspan.operators import quality
from quantspan.operators.calendars import month_spine
from quantspan.operators.clean import clean_bars, dedup_keep_last, duplicate_dates
from quantspan.sources import candles, raw, stores


def write(folder, name, *lines):
    (folder / name).write_text("\n".join(lines) + "\n", encoding="utf-8")


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_layouts_may_differ_between_files(spark, tmp_path):
    write(tmp_path, "eurusd.csv", "Date,Open,CLOSE", "2020-01-02,1.10,1.11", "2020-01-03,1.11,1.12")
    write(tmp_path, "Spx 500.TXT", "gmt time,Adj Close,volume", "02.01.2020 00:00:00.000,3000,7")
    write(tmp_path, "notes.md", "Date,Close", "2020-01-02,5")
    got = rows_of(raw.read_raw(spark, str(tmp_path)), "instrument", "dt", "open", "close")
    assert got == [
        ("EURUSD", day("2020-01-02"), 1.10, 1.11),
        ("EURUSD", day("2020-01-03"), 1.11, 1.12),
        ("SPX 500", day("2020-01-02"), None, 3000.0),
    ]
    listed = [r.instrument for r in raw.raw_files(spark, str(tmp_path)).collect()]
    assert sorted(listed) == ["EURUSD", "SPX 500"]


@pytest.mark.parametrize("unit, scale", [("s", 1), ("ms", 1000)])
def test_numeric_dates_are_epochs(spark, tmp_path, unit, scale):
    seconds = 1_577_923_200  # 2020-01-02
    write(tmp_path, "a.csv", "timestamp,close", f"{seconds * scale},1", f"{(seconds + 90_000) * scale},2")
    got = rows_of(raw.read_raw(spark, str(tmp_path)), "dt", "close")
    assert got == [(day("2020-01-02"), 1.0), (day("2020-01-03"), 2.0)]


def test_compact_dates_are_an_epoch_unless_asked_for(spark, tmp_path):
    write(tmp_path, "a.csv", "date,close", "20200102,1")
    assert raw.read_raw(spark, str(tmp_path)).first().dt.year == 1970
    assert raw.read_raw(spark, str(tmp_path), compact_dates=True).first().dt == day("2020-01-02")


def test_unreadable_values_become_null(spark, tmp_path):
    write(tmp_path, "a.csv", "date,close", "2020-01-02,n/a", "garbage,2", "also bad,3")
    bars = raw.read_raw(spark, str(tmp_path))
    assert sorted(((r.dt, r.close) for r in bars.collect()), key=repr) == sorted(
        [(day("2020-01-02"), None), (None, 2.0), (None, 3.0)], key=repr
    )
    assert duplicate_dates(bars).first().has_duplicates


def test_nan_and_infinite_cells_are_missing(spark, tmp_path):
    write(tmp_path, "A.csv", "date,close", "1577923200,1.0", "NaN,2.0", "1578009600,NaN", "1578096000,inf", "1578182400,", ",5.0")
    got = raw.read_raw(spark, str(tmp_path)).select("dt", "close").collect()
    dated = sorted(((r.dt, r.close) for r in got if r.dt), key=str)
    assert [r[0] for r in dated] == [day(f"2020-01-{d:02d}") for d in (2, 3, 4, 5)]  # still seconds
    assert [r[1] for r in dated] == [1.0, None, None, None]
    found = quality.anomalies(None, raw.read_raw(spark, str(tmp_path)).where("dt IS NOT NULL")).groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in found}["nonpositive_price"] == 3


def test_dates_that_are_not_understood_are_counted(spark, tmp_path):
    write(tmp_path, "A.csv", "date,close", "2020-01-02,1.0", "second of May,2.0", "NaN,3.0", "sometime,4.0")
    write(tmp_path, "B.csv", "date,close", "2020-01-02,1.0")
    rows = raw.unparsed_dates(spark, str(tmp_path)).orderBy("path").collect()
    assert [(r.instrument, r.n_rows, r.n_missing, r.n_unparsed) for r in rows] == [("A", 4, 1, 2), ("B", 1, 0, 0)]


def test_equal_order_keeps_one_whole_row(spark):
    rows = [("A", day("2020-01-02"), 1, 5.0, 1.0), ("A", day("2020-01-02"), 1, 1.0, 5.0)]
    bars = spark.createDataFrame(rows * 3, "instrument string, dt date, ord bigint, open double, close double")
    got = dedup_keep_last(bars).first()
    assert (got.open, got.close) in {(5.0, 1.0), (1.0, 5.0)}


def test_first_column_is_the_date_when_none_is_named_so(spark, tmp_path):
    write(tmp_path, "a.csv", "when,text,price,other", "2020-01-02,x,5.5,1", "2020-01-03,y,6.5,2")
    assert rows_of(raw.read_raw(spark, str(tmp_path)), "dt", "close") == [
        (day("2020-01-02"), 5.5),
        (day("2020-01-03"), 6.5),
    ]


def test_close_beats_adjusted_close(spark, tmp_path):
    write(tmp_path, "a.csv", "date,Adj Close,Close", "2020-01-02,1,2")
    assert raw.read_raw(spark, str(tmp_path)).first().close == 2.0


def test_no_price_column_is_an_error(spark, tmp_path):
    write(tmp_path, "a.csv", "date,text", "2020-01-02,x")
    with pytest.raises(ValueError, match="numeric"):
        raw.read_raw(spark, str(tmp_path))
    (tmp_path / "empty").mkdir()
    with pytest.raises(Exception):
        raw.read_raw(spark, str(tmp_path / "empty"))


def test_row_order_survives_splitting_a_file(spark, tmp_path):
    lines = [f"2020-01-{2 + i % 2:02d},{i}" for i in range(4000)]
    write(tmp_path, "a.csv", "date,close", *lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        bars = raw.read_raw(spark, str(tmp_path))
        assert bars.count() == 4000
        ordered = [r.close for r in bars.orderBy("ord").collect()]
        assert ordered == [float(i) for i in range(4000)]
        assert rows_of(clean_bars(bars), "close") == [(3998.0,), (3999.0,)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_raw_to_clean_leaves_raw_alone_and_repeats(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    days = business_days("2020-01-01", 200)
    for name, seed in (("aaa.csv", 42), ("bbb.csv", 43)):
        prices = walk(200, seed)
        write(folder, name, "date,close", *[f"{d},{p!r}" for d, p in zip(days, map(float, prices))])
    (folder / "bbb.csv").open("a").write(f"{days[10]},1.0\n2020-01-04,9\n")
    before = {p.name: p.read_bytes() for p in folder.iterdir()}

    def run():
        stored = stores.process_raw(spark, str(folder), str(tmp_path / "clean"), str(tmp_path / "report"))
        return rows_of(stored, "instrument", "dt", "close")

    first, second = run(), run()
    assert first == second and len(first) == 400
    assert ("BBB", days[10], 1.0) in first
    assert before == {p.name: p.read_bytes() for p in folder.iterdir()}
    summary = {r.instrument: r for r in spark.read.parquet(str(tmp_path / "report/summary")).collect()}
    assert "duplicate_dates" in summary["BBB"].counts and "duplicate_dates" not in summary["AAA"].counts
    panel = stores.read_prices(spark, str(tmp_path / "clean"))
    assert panel.columns == ["panel", "instrument", "dt", "close"] and panel.count() == 400


def test_a_new_instrument_keeps_the_stored_ones(spark, tmp_path):
    days = business_days("2020-01-01", 3)
    for name in ("A", "B"):
        rows = [(name, d, 1.0) for d in days]
        stores.write_clean(spark.createDataFrame(rows, "instrument string, dt date, close double"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 6


def test_panel_falls_back_to_the_first_column(spark, tmp_path):
    rows = [("A", day("2020-01-01"), 5.0), ("A", day("2020-01-02"), float("nan"))]
    stores.write_clean(spark.createDataFrame(rows, "instrument string, dt date, last double"), str(tmp_path / "c"))
    got = rows_of(stores.read_prices(spark, str(tmp_path / "c")).orderBy("dt"), "dt", "close")
    assert got == [(day("2020-01-01"), 5.0), (day("2020-01-02"), None)]


# --- candles ----------------------------------------------------------------------------------


def blob(*records, extra=b""):
    data = b"".join(struct.pack(">iiiiif", *r) for r in records) + extra
    return lzma.compress(data, format=lzma.FORMAT_ALONE)


def test_candles_below_a_folder(spark, tmp_path):
    files = {
        "EURUSD/2020/00": blob(
            (0, 110000, 112000, 109000, 113000, 5.0), (86400, 112000, 111000, 110500, 112500, 6.0), extra=b"\x00\x01"
        ),
        "USA500IDXUSD/2020/11": blob((86400 * 3, 3000_000, 3010_000, 2990_000, 3020_000, 1.0)),
        "EURUSD/2020/01": b"",
    }
    for path, data in files.items():
        folder = tmp_path / path
        folder.mkdir(parents=True)
        (folder / "BID_candles_day_1.bi5").write_bytes(data)
    got = rows_of(candles.read_candles(spark, str(tmp_path)), "instrument", "dt", "open", "high", "low", "close")
    assert got == [
        ("EURUSD", dt.date(2020, 1, 1), 1.10, 1.13, 1.09, 1.12),
        ("EURUSD", dt.date(2020, 1, 2), 1.12, 1.125, 1.105, 1.11),
        ("SPX500", dt.date(2020, 12, 4), 3000.0, 3020.0, 2990.0, 3010.0),
    ]


def test_symbols_without_an_instrument_are_named(spark, tmp_path):
    target = tmp_path / "NOSUCHPAIR" / "2020" / "00"
    target.mkdir(parents=True)
    (target / "candles.bi5").write_bytes(blob((0, 1, 1, 1, 1, 1.0)))
    with pytest.raises(KeyError, match="NOSUCHPAIR"):
        candles.read_candles(spark, str(tmp_path))


def test_packing_is_undone_by_decoding(spark):
    days = business_days("2020-01-01", 60)
    rows = [("X", d, *[round(float(v), 2) for v in np.random.default_rng(i).uniform(1, 9, 4)]) for i, d in enumerate(days)]
    bars = spark.createDataFrame(rows, "instrument string, dt date, open double, high double, low double, close double")
    back = candles.decode_candles(candles.pack_candles(bars))
    got = rows_of(back, "symbol", "dt", *[F.round(F.col(c) / 100, 2) for c in candles.UNITS])
    assert got == sorted(rows)


def test_every_instrument_needs_a_symbol(spark):
    candles.check_universe(spark)
    assert len(INSTRUMENTS) == 9
    with pytest.raises(KeyError, match="NEWONE"):
        candles.check_universe(spark, (*INSTRUMENTS, "NEWONE"))


def test_months_are_inclusive(spark):
    spans = spark.createDataFrame([(day("2019-11-15"), day("2020-02-01"))], "start date, end date")
    months = sorted(str(r.month) for r in month_spine(spans).collect())
    assert months == ["2019-11-01", "2019-12-01", "2020-01-01", "2020-02-01"]

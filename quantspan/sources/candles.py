"""Monthly candle blobs: LZMA-compressed, fixed-size big-endian records.

The only place Python touches rows: Spark has no LZMA codec. A blob is one instrument's
month, at most 31 records, and is unpacked as one numpy array.
"""

from __future__ import annotations

import datetime as dt
import json
import lzma

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspan.config import INSTRUMENTS, POINT_SCALES, VENDOR_SYMBOLS

# Layout of a record, in file order.
RECORD = np.dtype(
    [
        ("offset_s", ">i4"),
        ("open", ">i4"),
        ("close", ">i4"),
        ("low", ">i4"),
        ("high", ">i4"),
        ("volume", ">f4"),
    ]
)
UNITS = ("open", "high", "low", "close")


def records_of(blob: bytes) -> np.ndarray:
    """The records of a blob; none in an empty one, an incomplete last one is ignored."""
    data = lzma.decompress(blob) if blob else b""
    return np.frombuffer(data, RECORD, count=len(data) // RECORD.itemsize)


def _unpack(batches):
    for batch in batches:
        parts = []
        for symbol, month, blob in zip(batch["symbol"], batch["month"], batch["content"]):
            records = records_of(blob)
            part = pd.DataFrame({u: records[u].astype("int64") for u in UNITS})
            part.insert(0, "offset_s", records["offset_s"].astype("int64"))
            part.insert(0, "month", month)
            part.insert(0, "symbol", symbol)
            parts.append(part)
        if parts:
            yield pd.concat(parts, ignore_index=True)


def decode_candles(blobs: DataFrame) -> DataFrame:
    """blobs(symbol, month DATE, content BINARY) -> (symbol, dt, open, high, low, close) in units.

    An empty blob has no rows and an incomplete last record is ignored.
    """
    schema = "symbol string, month date, offset_s bigint, " + ", ".join(f"{u} bigint" for u in UNITS)
    rows = blobs.select("symbol", "month", "content").mapInPandas(_unpack, schema)
    day = F.date_add("month", F.floor(F.col("offset_s") / 86_400).cast("int"))
    return rows.select("symbol", day.alias("dt"), *UNITS)


def _pack(batches):
    for batch in batches:
        blobs = []
        for records in batch["records"]:
            packed = np.zeros(len(records), RECORD)
            for name in ("offset_s", *UNITS):
                packed[name] = [r[name] for r in records]
            blobs.append(lzma.compress(packed.tobytes(), format=lzma.FORMAT_ALONE))
        yield batch[["symbol", "month"]].assign(content=blobs)


def pack_candles(bars: DataFrame, point: float = 100.0) -> DataFrame:
    """Daily bars to monthly blobs, the inverse of `decode_candles`; a month is 31 rows at most.

    bars(instrument, dt, open, high, low, close) -> (symbol, month, content)
    """
    units = [F.round(F.col(u) * point).cast("int").alias(u) for u in UNITS]
    offset = (F.datediff("dt", F.trunc("dt", "MM")) * 86_400).alias("offset_s")
    months = (
        bars.select(F.col("instrument").alias("symbol"), F.trunc("dt", "MM").alias("month"), F.struct(offset, *units).alias("record"))
        .groupBy("symbol", "month")
        .agg(F.array_sort(F.collect_list("record")).alias("records"))
    )
    return months.mapInPandas(_pack, "symbol string, month date, content binary")


def symbol_map(spark: SparkSession, symbols: dict[str, str] | None = None) -> DataFrame:
    """-> (instrument, symbol, point); point is NULL where the default scale holds"""
    symbols = VENDOR_SYMBOLS if symbols is None else symbols
    rows = [(i, s, POINT_SCALES.get(i)) for i, s in symbols.items()]
    return spark.createDataFrame(rows, "instrument string, symbol string, point double")


def unmapped_instruments(universe: DataFrame, symbols: DataFrame) -> DataFrame:
    return universe.select("instrument").distinct().join(symbols, "instrument", "left_anti")


def check_universe(spark: SparkSession, universe=INSTRUMENTS, symbols: dict[str, str] | None = None) -> None:
    """Raise, naming them, when instruments have no feed symbol."""
    wanted = spark.createDataFrame([(i,) for i in universe], "instrument string")
    missing = unmapped_instruments(wanted, symbol_map(spark, symbols)).orderBy("instrument")
    names = [r.instrument for r in missing.collect()]
    if names:
        raise KeyError(f"no feed symbol for {names}")


def read_candles(
    spark: SparkSession,
    folder: str,
    symbols: dict[str, str] | None = None,
    points: dict[str, float] | None = None,
    instruments: list[str] | None = None,
    months: tuple[dt.date, dt.date] | None = None,
) -> DataFrame:
    """Blobs below `folder` -> (instrument, symbol, month, dt, open, high, low, close)

    `instruments` and `months` (first and last) say which blobs are opened at all. Raises, naming
    them, when folders have no instrument.
    """
    from quantspan.sources import candle_source

    symbols = VENDOR_SYMBOLS if symbols is None else symbols
    points = POINT_SCALES if points is None else points
    there = {b.symbol for b in candle_source.blobs(folder)}
    names = sorted(there - set(symbols.values()))
    if names:
        raise KeyError(f"no instrument for the feed symbols {names}")
    candle_source.register(spark)
    found = spark.read.format("candles").option("symbols", json.dumps(symbols)).option("points", json.dumps(points))
    if instruments is not None:
        found = found.option("instruments", json.dumps(list(instruments)))
    if months is not None:
        found = found.option("months", json.dumps([m.replace(day=1).isoformat() for m in months]))
    return found.load(folder)


def write_candles(blobs: DataFrame, folder: str) -> None:
    """blobs(symbol, month, content) as files below `folder`, one for each symbol and month."""
    from quantspan.sources import candle_source

    candle_source.register(blobs.sparkSession)
    blobs.select("symbol", "month", "content").write.format("candles").mode("append").save(folder)

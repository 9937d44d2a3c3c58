"""`spark.read.format("candles")`: a folder of monthly candle blobs as a table.

Blobs lie at symbol/year/month/file, months counted from 00. Reading lists the folder, keeps the
blobs of the instruments and months asked for, and deals them to tasks; a task opens and decodes only its own.
What to open is said by options and not by pushed filters: this version of Spark keeps the
filters pushed by one query for the next query on the same table, which then misses rows.
Writing takes (symbol, month, content) and puts every blob in its place. Any file system pyarrow
knows will do; the folder has to be shared by all executors.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

from quantspan.config import DEFAULT_POINT, POINT_SCALES, VENDOR_SYMBOLS
from quantspan.sources.candles import records_of

SUFFIX = ".bi5"
PLACE = re.compile(r"([^/]+)/(\d{4})/(\d{2})/[^/]*$")
TABLE = pa.schema(
    [("instrument", pa.string()), ("symbol", pa.string()), ("month", pa.date32()), ("dt", pa.date32())]
    + [(u, pa.float64()) for u in ("open", "high", "low", "close")]
)
BLOBS_PER_TASK = 32


@dataclass(frozen=True)
class Blob:
    path: str
    symbol: str
    month: dt.date


def located(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and its path there."""
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://", 1))


def blobs(folder: str) -> list[Blob]:
    """All blobs below a folder, by symbol and month."""
    system, root = located(folder)
    found = []
    for entry in system.get_file_info(fs.FileSelector(root, recursive=True)):
        place = PLACE.search(entry.path)
        if entry.type == fs.FileType.File and entry.path.endswith(SUFFIX) and place:
            found.append(Blob(entry.path, place[1], dt.date(int(place[2]), int(place[3]) + 1, 1)))
    return sorted(found, key=lambda b: (b.symbol, b.month, b.path))


def instruments(symbols: dict[str, str]) -> dict[str, str]:
    """Feed symbol -> instrument."""
    return {s: i for i, s in symbols.items()}


class CandleSource(ds.DataSource):
    """Options: path; `symbols` and `points`, JSON objects by instrument; `instruments`, a JSON list
    of those to read; `months`, the first and the last to read as a JSON list of dates.
    """

    @classmethod
    def name(cls) -> str:
        return "candles"

    def schema(self) -> str:
        return "instrument string, symbol string, month date, dt date, open double, high double, low double, close double"

    def reader(self, schema) -> CandleReader:
        return CandleReader(self.options)

    def writer(self, schema, overwrite: bool) -> CandleWriter:
        return CandleWriter(self.options["path"])


class CandleReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.names = instruments(json.loads(options.get("symbols") or json.dumps(VENDOR_SYMBOLS)))
        self.points = json.loads(options.get("points") or json.dumps(POINT_SCALES))
        self.wanted = set(json.loads(options.get("instruments") or json.dumps(list(self.names.values()))))
        first, last = json.loads(options.get("months") or '["0001-01-01", "9999-12-31"]')
        self.first, self.last = dt.date.fromisoformat(first), dt.date.fromisoformat(last)

    def partitions(self) -> list[ds.InputPartition]:
        chosen = []
        for b in blobs(self.folder):
            if b.symbol not in self.names:
                raise KeyError(f"no instrument for the feed symbol {b.symbol}")
            if self.names[b.symbol] in self.wanted and self.first <= b.month <= self.last:
                chosen.append(b)
        return [ds.InputPartition(chosen[i : i + BLOBS_PER_TASK]) for i in range(0, len(chosen), BLOBS_PER_TASK)] or [ds.InputPartition([])]

    def read(self, partition: ds.InputPartition) -> Iterator[pa.RecordBatch]:
        system, _ = located(self.folder)
        for b in partition.value:
            with system.open_input_stream(b.path) as stream:
                records = records_of(stream.read())
            name = self.names[b.symbol]
            days = np.datetime64(b.month, "D") + records["offset_s"].astype(np.int64) // 86_400
            point = float(self.points.get(name) or DEFAULT_POINT)
            columns = [[name] * len(records), [b.symbol] * len(records), [b.month] * len(records), days]
            columns += [records[u].astype(np.float64) / point for u in ("open", "high", "low", "close")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, TABLE)], schema=TABLE)


class CandleWriter(ds.DataSourceWriter):
    """Rows (symbol, month, content) to files; a blob that is there already is replaced."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator) -> ds.WriterCommitMessage:
        system, root = located(self.folder)
        for row in iterator:
            place = f"{root}/{row.symbol}/{row.month.year}/{row.month.month - 1:02d}"
            system.create_dir(place, recursive=True)
            # Whole under another name first: a lost task leaves no half blob under the final one.
            with system.open_output_stream(f"{place}/.candles.part") as out:
                out.write(bytes(row.content))
            system.move(f"{place}/.candles.part", f"{place}/candles{SUFFIX}")
        return ds.WriterCommitMessage()

    def commit(self, messages) -> None:
        pass


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CandleSource)


"""Raw price dumps: one delimited file per instrument, header names vary by vendor.

The dumps are read once, as numbered lines; what follows reads those. A file's first line is its
header, and files that share one share a layout. Only the distinct layouts reach the driver,
where they decide which column is the date and which the close; a file learns its layout by a
join, and its lines are taken apart by that layout's `from_csv`, all layouts in one pass.
"""

from __future__ import annotations

import csv
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspan.config import CLOSE_HEADERS, DATE_HEADERS, PRICE_HEADERS
from quantspan.functions.scalars import finite
from quantspan.session import materialize

RAW_GLOB = "*.{[cC][sS][vV],[tT][xX][tT]}"
# Cells without a value, in any case.
MISSING = ("", "nan", "nat", "na", "n/a", "#n/a", "<na>", "null", "none")
EPOCH_MILLIS_ABOVE = 1e11
# Tried in this order after the ISO forms a plain cast understands.
DATE_PATTERNS = (
    "dd.MM.yyyy HH:mm:ss.SSS", "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy HH:mm", "d.M.yyyy", "M/d/yyyy", "yyyyMMdd HHmmss",
    "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy h:mm:ss a", "M/d/yyyy h:mm a", "d/M/yyyy", "d/M/yyyy H:mm:ss", "d/M/yyyy H:mm",
    "yyyy/M/d", "yyyy/M/d H:mm:ss", "yyyy/M/d H:mm", "yyyy.M.d", "yyyy.M.d H:mm:ss", "yyyy.M.d H:mm", "d-M-yyyy",
    "d-MMM-yyyy", "d-MMM-yy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMMM d yyyy",
)


def instrument_of(path: Column) -> Column:
    """File stem in upper case."""
    name = F.element_at(F.split(plain_path(path), "/"), -1)
    return F.upper(F.regexp_replace(name, r"\.[^.]*$", ""))


def plain_path(path: Column) -> Column:
    """File metadata carries paths as URIs; undo the escapes."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def raw_files(spark: SparkSession, folder: str) -> DataFrame:
    """The .csv and .txt files of a folder, sorted -> (path, instrument)"""
    listing = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", RAW_GLOB)
        .load(folder)
        .select("path")
    )
    return listing.select("path", instrument_of(F.col("path")).alias("instrument")).orderBy("path")


def numbered_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of every dump, read once and stored -> (path, ord, value), empty lines left out

    `ord` is where a line's block starts plus its place in the task. A task never holds as many
    lines as a block has bytes, so later blocks always sort later.
    """
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lines = (
        spark.read.option("pathGlobFilter", RAW_GLOB)
        .option("recursiveFileLookup", "true")
        .text(folder)
        .select(
            F.col("_metadata.file_path").alias("path"),
            (F.col("_metadata.file_block_start") + in_task).alias("ord"),
            "value",
        )
        .where(F.trim("value") != "")
    )
    return materialize(lines, "lines")


@dataclass(frozen=True)
class Layout:
    """A header, as positions of what is read from a line."""

    header: str
    number: int
    width: int
    date: int
    prices: dict[str, int]  # open, high, low or close -> position
    others: tuple[int, ...]  # candidates for a close that no header names, else empty

    @classmethod
    def of(cls, header: str, number: int) -> Layout:
        columns = next(csv.reader([header]))
        date = columns.index(date_header(columns))
        rest = [c for i, c in enumerate(columns) if i != date]
        names = price_names(rest)
        prices = {name: columns.index(c) for c, name in names.items()}
        others = () if "close" in prices else tuple(i for i in range(len(columns)) if i != date)
        return cls(header, number, len(columns), date, prices, others)

    def cells(self) -> Column:
        """The line's cells as an array of strings."""
        names = [f"c{i}" for i in range(self.width)]
        parsed = F.from_csv("value", F.lit(", ".join(f"{n} string" for n in names)))
        return F.array(*[parsed[n] for n in names])


def headers(lines: DataFrame) -> DataFrame:
    """-> (path, header, first), `first` being the header's place"""
    return lines.groupBy("path").agg(F.min_by("value", "ord").alias("header"), F.min("ord").alias("first"))


def date_header(columns: Iterable[str]) -> str:
    columns = list(columns)
    return next((c for c in columns if c.lower() in DATE_HEADERS), columns[0])


def price_names(columns: Iterable[str]) -> dict[str, str]:
    """Source column -> open, high, low or close.

    A column that is already called close, in any case, wins over an adjusted close.
    """
    columns = list(columns)
    names = {}
    for c in columns:
        if c.lower() in PRICE_HEADERS and c.lower() not in names.values():
            names[c] = c.lower()
    if "close" not in names.values():
        adjusted = next((c for c in columns if c in CLOSE_HEADERS), None)
        if adjusted:
            names[adjusted] = "close"
    return names


def date_number() -> Column:
    """The date column as a finite number, NULL where it is none."""
    return finite(F.expr("try_cast(raw_date as double)"))


def parse_date(text: Column, is_epoch: Column, is_millis: Column, compact_dates: bool = False) -> Column:
    """Text to a date: an epoch in a numeric column, a date or timestamp otherwise."""
    number = date_number()
    days = F.floor(F.when(is_millis, number / 86_400_000.0).otherwise(number / 86_400.0))
    # A number too far out for a date is as unreadable as text.
    days = F.when(F.abs(days) < 1e8, days).cast("int")
    epoch = F.date_add(F.lit("1970-01-01").cast("date"), days)
    if compact_dates:
        compact = F.when(text.rlike(r"^(19|20|21)\d{6}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")))
        epoch = F.coalesce(F.to_date(compact), epoch)
    written = F.coalesce(
        F.expr("try_cast(raw_date as timestamp_ntz)").cast("date"),
        *[F.to_date(F.try_to_timestamp(text, F.lit(p))) for p in DATE_PATTERNS],
    )
    return F.when(is_epoch, epoch).otherwise(written)


def _number(cell: Column) -> Column:
    return finite(cell.try_cast("double"))


def _scans(spark: SparkSession, folder: str, compact_dates: bool, name_of) -> DataFrame:
    """Every dump, with (path, raw_date) beside the columns of `read_raw`."""
    lines = numbered_lines(spark, folder)
    first = materialize(headers(lines), "headers")
    known = sorted(r.header for r in first.select("header").distinct().collect())  # a row for each layout
    if not known:
        raise ValueError(f"no .csv or .txt files in {folder}")
    found = [Layout.of(h, i) for i, h in enumerate(known)]
    numbers = spark.createDataFrame([(x.header, x.number) for x in found], "header string, layout int")
    placed = first.join(F.broadcast(numbers), "header").select("path", "first", "layout")
    own = lambda fn, kind: F.coalesce(*[F.when(F.col("layout") == x.number, fn(x)) for x in found], F.lit(None).cast(kind))
    rows = (
        lines.join(placed, "path")
        .where(F.col("ord") != F.col("first"))
        .withColumn("cells", own(Layout.cells, "array<string>"))
        .withColumn("date", own(lambda x: F.col("cells")[x.date], "string"))
        .withColumn("raw_date", F.when(~F.lower(F.trim("date")).isin(*MISSING), F.col("date")))
    )
    # What kind of number the dates of a file are, and which columns of a layout hold numbers only.
    number = date_number()
    widest = max((len(x.others) for x in found), default=0)
    other = [own(lambda x, i=i: F.col("cells")[x.others[i]] if i < len(x.others) else F.lit(None).cast("string"), "string") for i in range(widest)]
    kinds = materialize(
        rows.groupBy("path", "layout").agg(
            (F.count("raw_date") == F.count(number)).alias("is_epoch"),
            (F.max(F.abs(number)) > EPOCH_MILLIS_ABOVE).alias("is_millis"),
            F.array(*[F.count(c) == F.count(c.try_cast("double")) for c in other]).cast("array<boolean>").alias("numeric"),
        ),
        "kinds",
    )
    closes = first_numeric(kinds, found)
    prices = {n: {x.number: x.prices[n] for x in found if n in x.prices} for n in PRICE_HEADERS}
    prices["close"] |= closes
    cells = {
        n: F.coalesce(*[F.when(F.col("layout") == k, _number(F.col("cells")[i])) for k, i in at.items()])
        for n, at in prices.items()
        if at
    }
    day = parse_date(F.col("raw_date"), F.col("is_epoch"), F.col("is_millis"), compact_dates)
    return rows.join(kinds.drop("layout", "numeric"), "path").select(
        name_of(F.col("path")).alias("instrument"),
        day.alias("dt"),
        "ord",
        *[value.alias(n) for n, value in cells.items()],
        "path",
        "raw_date",
    )


def first_numeric(kinds: DataFrame, found: list[Layout]) -> dict[int, int]:
    """Layout without a close -> its first column whose values are all numbers.

    An error where a layout has none.
    """
    open_ = {x.number: x for x in found if x.others}
    if not open_:
        return {}
    every = [F.bool_and(F.get("numeric", F.lit(i))).alias(str(i)) for i in range(max(len(x.others) for x in open_.values()))]
    out = {k: x.others[0] for k, x in open_.items() if x.others}  # layouts without a row
    for r in kinds.where(F.col("layout").isin(*open_)).groupBy("layout").agg(*every).collect():  # a row for each layout
        columns = open_[r["layout"]].others
        numeric = [c for i, c in enumerate(columns) if r[str(i)]]
        if not numeric:
            raise ValueError("no numeric price column found")
        out[r["layout"]] = numeric[0]
    return out


def unparsed_dates(
    spark: SparkSession, folder: str, compact_dates: bool = False, name_of=instrument_of
) -> DataFrame:
    """Rows of each file, how many lack a date, and how many have one that is not understood.

    -> (path, instrument, n_rows, n_missing, n_unparsed)
    """
    bars = _scans(spark, folder, compact_dates, name_of)
    return bars.groupBy(plain_path(F.col("path")).alias("path"), "instrument").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("raw_date").isNull()).alias("n_missing"),
        F.count_if(F.col("raw_date").isNotNull() & F.col("dt").isNull()).alias("n_unparsed"),
    )


def read_raw(
    spark: SparkSession, folder: str, compact_dates: bool = False, name_of=instrument_of
) -> DataFrame:
    """Every dump below a folder -> (instrument, dt, ord, open, high, low, close).

    Price columns no file has are left out, those some files lack are NULL there. `ord`
    grows with the position in the file. `compact_dates` reads eight-digit numbers as
    yyyyMMdd instead of as an epoch. NaN, infinite and empty cells are missing;
    `unparsed_dates` counts dates that are not understood. `name_of` turns a path into the instrument.
    """
    return _scans(spark, folder, compact_dates, name_of).drop("path", "raw_date")

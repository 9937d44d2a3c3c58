"""Running values over long series, in two levels.

A window over a whole series puts it into one task. Here a series is cut into chunks that follow
each other in its order. A window runs inside each chunk; a chunk's total is the running value
at its last row; a second window over the totals, one row a chunk, carries what came before a
chunk into it; and the carry is combined with every row. That works for each operation that is
associative: sums, counts, products, extremes, the last known value.

Chunks come from a column that grows with the order (`quarter_of` for dates), or from
`ranged`, which cuts by the order itself and so needs no unit: any run of rows, also one that
shares a key and an hour, is spread over as many tasks as it has rows for. Rows whose key or chunk is
null belong to no series and are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantspan.session import materialize

CHUNK = "chunk"


@dataclass(frozen=True)
class Running:
    """An associative operation over the rows so far; rows without a value add nothing."""

    kind: str
    value: Column | str

    def inside(self) -> Column:
        """Aggregate over the rows of a window."""
        return _AGGREGATES[self.kind](self.value)

    def over_totals(self, total: str) -> Column:
        """Aggregate over the chunks' totals."""
        return _AGGREGATES["sum" if self.kind == "count" else self.kind](total)

    def combined(self, carry: Column, local: Column) -> Column:
        """What came before the chunk, then what the chunk has."""
        if self.kind == "last":
            return F.coalesce(local, carry)
        both = {
            "sum": carry + local,
            "count": carry + local,
            "product": carry * local,
            "max": F.greatest(carry, local),
            "min": F.least(carry, local),
        }[self.kind]
        return F.coalesce(both, local, carry)


_AGGREGATES = {
    "sum": F.sum,
    "count": F.count,
    "product": F.product,
    "max": F.max,
    "min": F.min,
    "last": lambda value: F.last(value, ignorenulls=True),
}


def quarter_of(day: Column) -> Column:
    """A chunk of a daily series: at most 92 rows, four chunks a year."""
    return F.year(day) * 4 + F.quarter(day)


def chunk_of(df: DataFrame, order: str) -> Column:
    """Quarters of a date or time, stretches of 64 of a row number."""
    kind = df.schema[order].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return quarter_of(F.col(order))
    if isinstance(kind, T.IntegralType):
        return F.floor(F.col(order) / 64)
    raise TypeError(f"{order}: no chunks are known for {kind.simpleString()}; see `ranged`")


def ranged(df: DataFrame, by: list[str], order: list[str], name: str = "ranges") -> DataFrame:
    """`df` with a chunk number that grows along (by, order), written to the shared folder.

    The rows are range-partitioned by key and order together, so a key with most of the rows
    gets most of the chunks. Written, because bounds found by sampling differ when they are
    found again.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(tasks, *by, *order)
    return materialize(laid.withColumn(CHUNK, F.spark_partition_id()), name)


def carried(df: DataFrame, by: list[str], order: list[str], local: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """`df` with window values `local` of its chunks, and `carry` from the chunks before.

    `local` are columns over the window of a chunk's rows so far and may build on each other in
    order; `carry` are aggregates over the values that `local` has at the last row of each
    earlier chunk, null in a series' first chunk.
    """
    inside = W.partitionBy(*by, CHUNK).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = df
    for column, value in local.items():
        rows = rows.withColumn(column, value.over(inside))
    last = F.max_by(F.struct(*local), F.struct(*order))
    totals = rows.groupBy(*by, CHUNK).agg(last.alias("total")).select(*by, CHUNK, "total.*")
    before = W.partitionBy(*by).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    earlier = totals.select(*by, CHUNK, *[value.over(before).alias(column) for column, value in carry.items()])
    # Laid out like the rows, so that not the rows move to where their whole series is.
    return rows.join(earlier.repartition(*by, CHUNK), [*by, CHUNK])


def running(df: DataFrame, by: list[str], order: list[str], chunk: Column | None = None, **columns: Running) -> DataFrame:
    """Adds each of `columns` over the rows of a series so far; `chunk` is dropped.

    Without `chunk`, `df` has one already, from `ranged`. The order must not leave ties within a
    series, or their rows may be counted either way.
    """
    cut = df if chunk is None else df.withColumn(CHUNK, chunk)
    here, earlier = {c: f"here_{c}" for c in columns}, {c: f"before_{c}" for c in columns}
    found = carried(
        cut,
        by,
        order,
        {here[c]: r.inside() for c, r in columns.items()},
        {earlier[c]: r.over_totals(here[c]) for c, r in columns.items()},
    )
    values = {c: r.combined(F.col(earlier[c]), F.col(here[c])) for c, r in columns.items()}
    return found.withColumns(values).drop(CHUNK, *here.values(), *earlier.values())


def compounded(df: DataFrame, by: list[str], order: list[str], growth: Column, chunk: Column | None = None) -> DataFrame:
    """Running product of `growth` and its highest value so far -> adds (equity, peak)

    One pass for both: what came before a chunk multiplies all its products by one number, so the
    chunk's peak is that number times its highest product, or its lowest if the number is negative.
    """
    cut = (df if chunk is None else df.withColumn(CHUNK, chunk)).withColumn("growth", growth)
    peak_here = F.greatest(F.col("base") * F.col("highest"), F.col("base") * F.col("lowest"))
    inside = W.partitionBy(*by, CHUNK).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = cut.withColumn("part", F.product("growth").over(inside)).withColumns(
        {"highest": F.max("part").over(inside), "lowest": F.min("part").over(inside)}
    )
    last = F.max_by(F.struct("part", "highest", "lowest"), F.struct(*order))
    before = W.partitionBy(*by).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    earlier = (
        rows.groupBy(*by, CHUNK)
        .agg(last.alias("total"))
        .select(*by, CHUNK, "total.*")
        .withColumn("base", F.coalesce(F.product("part").over(before), F.lit(1.0)))
        .withColumn("peak_before", F.max(peak_here).over(before))
        .select(*by, CHUNK, "base", "peak_before")
    )
    return (
        rows.join(earlier.repartition(*by, CHUNK), [*by, CHUNK])
        .withColumns({"equity": F.col("base") * F.col("part"), "peak": F.greatest("peak_before", peak_here)})
        .drop(CHUNK, "growth", "part", "highest", "lowest", "base", "peak_before")
    )


def lagged(df: DataFrame, by: list[str], order: list[str], value: str, name: str, chunk: Column | None = None) -> DataFrame:
    """Adds the value of the row before, also across chunks; null on a series' first row."""
    cut = df if chunk is None else df.withColumn(CHUNK, chunk)
    inside = W.partitionBy(*by, CHUNK).orderBy(*order)
    # Wrapped, so that a missing value before is not mistaken for no row before.
    rows = cut.withColumn("row", F.struct(F.col(value).alias("x"))).withColumn("previous", F.lag("row").over(inside))
    ends = rows.groupBy(*by, CHUNK).agg(F.max_by("row", F.struct(*order)).alias("end"))
    earlier = ends.select(*by, CHUNK, F.lag("end").over(W.partitionBy(*by).orderBy(CHUNK)).alias("end"))
    joined = rows.join(earlier.repartition(*by, CHUNK), [*by, CHUNK])
    return joined.withColumn(name, F.coalesce("previous", "end")["x"]).drop(CHUNK, "row", "previous", "end")


def asof_join(
    left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: dict[str, str], chunk=quarter_of
) -> DataFrame:
    """Adds to each row of `left` the last `values` of `right` at or before its time.

    Both sides become one series of known values and questions, cut into slices of time; the last
    value of earlier slices is carried into a slice, so a key of any length is spread over tasks,
    and a question may look back any number of slices. `values` names new column -> column of
    `right`; of rows of `right` that share key and time the greatest values win. Nulls are values
    too. A null time finds nothing.
    """
    found = F.struct(*[F.col(old).alias(new) for new, old in values.items()])
    known = right.where(F.col(right_time).isNotNull()).select(
        *by, F.col(right_time).alias("asof_time"), F.lit(0).alias("asof_side"), found.alias("asof_found")
    )
    asked = left.select(
        *by, F.col(left_time).alias("asof_time"), F.lit(1).alias("asof_side"), F.struct(*left.columns).alias("asof_row")
    )
    both = known.unionByName(asked.where(F.col("asof_time").isNotNull()), allowMissingColumns=True)
    order = ["asof_time", "asof_side", "asof_found"]
    series = running(both, by, order, chunk(F.col("asof_time")), asof_found=Running("last", "asof_found"))
    answered = series.where("asof_side = 1").select("asof_row.*", *[F.col(f"asof_found.{c}").alias(c) for c in values])
    timeless = left.where(F.col(left_time).isNull())
    return answered.unionByName(timeless, allowMissingColumns=True)


def rolling_deviation(df: DataFrame, by: list[str], order: list[str], value: str, window: int, name: str, chunk: Column | None = None, block: int = 512) -> DataFrame:
    """Adds the sample deviation of the last `window` values, null until there are so many.

    Rows are numbered and cut into blocks of `block` numbers; each block also gets the `window`
    rows before it. Inside a block the moments are differences of running sums about the
    block's own mean, so a row costs the same whatever the window. The variance is exact to about 1e-15 times the square of the
    block's spread, so the deviation of a window of equal values is 0 to about 1e-7 of that spread. A
    window with a missing value gives null.
    """
    block = max(block, window)  # a window reaches into one block before its own
    numbered = running(df, by, order, chunk, row_number=Running("count", F.lit(1)))
    n = F.col("row_number") - 1
    own = F.floor(n / block)
    # The last rows of a block are looked back on by the next one.
    blocks = F.when(n % block >= block - window, F.array(own, own + 1)).otherwise(F.array(own))
    spread = numbered.withColumn("block", F.explode(blocks)).withColumn("halo", F.floor((F.col("row_number") - 1) / block) < F.col("block"))
    whole = W.partitionBy(*by, "block")
    upto = whole.orderBy("row_number").rowsBetween(W.unboundedPreceding, 0)
    before = whole.orderBy("row_number")
    centred = spread.withColumn("x", F.col(value) - F.avg(value).over(whole))
    sums = centred.withColumns({"s0": F.count("x").over(upto), "s1": F.sum("x").over(upto), "s2": F.sum(F.col("x") * F.col("x")).over(upto)})
    past = {s: F.coalesce(F.col(s), F.lit(0)) - F.coalesce(F.lag(s, window).over(before), F.lit(0)) for s in ("s0", "s1", "s2")}
    variance = (past["s2"] - past["s1"] * past["s1"] / window) / (window - 1)
    full = (past["s0"] == window) & (F.col("row_number") >= window)
    result = F.when(full, F.sqrt(F.greatest(variance, F.lit(0.0))))
    return sums.withColumn(name, result).where(~F.col("halo")).drop("row_number", "block", "halo", "x", "s0", "s1", "s2")

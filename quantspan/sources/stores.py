"""Clean store, quality report and strategy report: partitioned parquet tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspan.functions.scalars import finite
from quantspan.operators.clean import clean_bars, dedup_keep_last, merge_batches
from quantspan.operators.metrics import metrics, return_histogram, sampled_equity
from quantspan.operators.quality import anomalies, ranked_anomalies, quality_summary
from quantspan.operators.quality_state import month_of, states
from quantspan.sources.raw import read_raw

from quantspan.session import materialize

def write_clean(bars: DataFrame, path: str) -> None:
    """Clean bars, partitioned by instrument, each file sorted by date.

    Only the partitions present in `bars` are replaced, so a re-run leaves the same table.
    """
    (
        bars.repartition("instrument")
        .sortWithinPartitions("instrument", "dt")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("instrument")
        .parquet(path)
    )

def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A parquet table, None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None

def write_months(table: DataFrame, path: str) -> None:
    """Replace the months that `table` has, by its column `month`; others stay as they are."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)

def merge_months(batch: DataFrame, path: str, order: str = "ord") -> list[str]:
    """Merge a batch of bars into a table by month; where a date comes twice the batch wins.

    Only the months of the batch are read and written. The merged rows are stored before any
    month is replaced, so a run that breaks off can be repeated, and a repeated run leaves the
    same table. Bars without a date are left out. -> the months, at most twelve a year
    """
    spark = batch.sparkSession
    new = materialize(dedup_keep_last(batch.where(F.col("dt").isNotNull()), order), "batch")
    months = sorted(r.month for r in new.select(month_of(F.col("dt")).alias("month")).distinct().collect())
    old = stored(spark, path)
    if old is not None:
        old = old.withColumn("month", F.col("month").cast("string")).where(F.col("month").isin(months)).drop("month")
        new = merge_batches(old, new.select(old.columns), order=order)
    laid = materialize(new.withColumn("month", month_of(F.col("dt"))), "merged")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = laid.repartitionByRange(tasks, "month", "instrument", "dt").sortWithinPartitions("month", "instrument", "dt")
    write_months(laid, path)
    return months

def merge_quality(batch: DataFrame, store: str, path: str) -> None:
    """Merge bars into the store, and renew the quality states of the months they touch.

    Whether a date came twice is said of the bars that a month was last merged from.
    """
    months = merge_months(batch, store)
    spark = batch.sparkSession
    bars = spark.read.parquet(store).withColumn("month", F.col("month").cast("string")).where(F.col("month").isin(months)).drop("month")
    raw = batch.where(month_of(F.col("dt")).isin(months))
    write_months(materialize(states(clean_bars(bars), raw), "states"), path)

def read_prices(spark: SparkSession, path: str, panel: str = "all") -> DataFrame:
    """Closes of the clean store as one panel; only the needed columns are read.

    Falls back to the first column where there is no close.
    """
    store = spark.read.parquet(path)
    values = [c for c in store.columns if c not in ("dt", "instrument")]
    close = "close" if "close" in values else values[0]
    return store.select(
        F.lit(panel).alias("panel"),
        F.col("instrument").cast("string").alias("instrument"),
        "dt",
        finite(F.col(close).cast("double")).alias("close"),
    )

def write_quality(raw: DataFrame, bars: DataFrame, path: str) -> None:
    """Summary per instrument and every dated anomaly, numbered; readers limit by `rank`."""
    quality_summary(raw, bars).write.mode("overwrite").parquet(f"{path}/summary")
    ranked_anomalies(anomalies(raw, bars)).write.mode("overwrite").parquet(f"{path}/detail")

def process_raw(spark: SparkSession, raw_folder: str, clean_path: str, report_path: str) -> DataFrame:
    """Raw dumps to clean store and quality report in one run over all instruments."""
    raw = read_raw(spark, raw_folder)
    write_clean(clean_bars(raw), clean_path)
    stored = spark.read.parquet(clean_path).withColumn("instrument", F.col("instrument").cast("string"))
    write_quality(raw, stored, report_path)
    return stored

def write_report(returns: DataFrame, path: str, curve: DataFrame | None = None) -> None:
    """Metrics, sampled equity, histogram and, if given, a curve of each strategy."""
    returns = materialize(returns, "returns")  # three tables read it
    tables = {
        "metrics": metrics(returns),
        "equity": sampled_equity(returns),
        "histogram": return_histogram(returns),
    }
    if curve is not None:
        tables["leverage_curve"] = curve
    for name, table in tables.items():
        table.write.mode("overwrite").partitionBy("panel").parquet(f"{path}/{name}")

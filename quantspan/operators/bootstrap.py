"""Moving-block bootstrap of return series, with draws that are pure hashes.

A block is known by its start, and a series has only as many starts as days. So the
values of every block, and whatever a consumer needs to know about a block as a whole,
are tabulated once per start; a resampled path is then a short list of starts. A path of
756 days in blocks of 20 is 38 rows instead of 756.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantspan.functions.scalars import finite, hashed_draw
from quantspan.session import join_side, materialize


def indexed_series(series: DataFrame, by: list[str], order: str = "dt") -> DataFrame:
    """Adds idx (0-based) and n (length) per series."""
    whole = W.partitionBy(*by)
    return series.withColumns(
        {
            "idx": F.row_number().over(whole.orderBy(order)) - 1,
            "n": F.count("*").over(whole),
        }
    )


def finite_returns(returns: DataFrame) -> DataFrame:
    return returns.withColumn("ret", finite(F.col("ret"))).where(F.col("ret").isNotNull())


def wrapped_blocks(indexed: DataFrame, by: list[str], item: Column, size: int) -> DataFrame:
    """The `size` consecutive items from every start, wrapping past the end of the series.

    -> (*by, n, start, items ARRAY)
    """
    copies = F.sequence(F.lit(0), F.ceil((F.lit(size) - 1) / F.col("n")).cast("int"))
    ahead = W.partitionBy(*by).orderBy("pos").rowsBetween(0, size - 1)
    return (
        indexed.select(*by, "n", "idx", item.alias("item"))
        .withColumn("copy", F.explode(copies))
        .withColumn("pos", F.col("idx") + F.col("copy") * F.col("n"))
        .where(F.col("pos") < F.col("n") + (size - 1))
        .withColumn("items", F.collect_list("item").over(ahead))
        .where(F.col("copy") == 0)
        .select(*by, "n", F.col("idx").alias("start"), "items")
    )


def task_count(df: DataFrame) -> int:
    """Partitions for rows that are few now and will be many: enough for every core."""
    spark = df.sparkSession
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(configured, spark.sparkContext.defaultParallelism)


def path_ids(sizes: DataFrame, series: list[str], within: list[str], n_paths: int) -> DataFrame:
    """One row per path, laid out over the cluster before it grows into blocks.

    A path is identified by its `series` and the columns `within` it, `path` among them, and
    is laid out by all of them, so that no series stays in one task. The partition count is
    explicit, which keeps adaptive execution from folding the rows into few tasks while they
    are tiny; windows over a path need no other layout.
    """
    paths = sizes.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(n_paths - 1))))
    return paths.repartition(task_count(sizes), *series, *within)


def block_draws(paths: DataFrame, size: int, *seed: Column) -> DataFrame:
    """Random starts that cover `horizon` days, from rows holding (n, horizon, path).

    The last block is cut to the days still missing. -> adds (block, start, len)
    """
    last = (F.ceil(F.col("horizon") / size) - 1).cast("int")
    return (
        paths.withColumn("block", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("start", hashed_draw(F.col("n"), *seed, F.col("path"), F.col("block")))
        .withColumn(
            "len", F.least(F.lit(size), F.col("horizon") - F.col("block") * size).cast("int")
        )
    )


def block_bootstrap(
    returns: DataFrame, n_paths: int, horizon: int, block_size: int, seed: int, phase: int = 1
) -> DataFrame:
    """Resampled paths, a row per day -> (panel, phase, path, day, r), day from 1."""
    if block_size < 1:
        raise ValueError("block_size must be >= 1")
    usable = finite_returns(returns)
    if usable.limit(1).count() == 0:
        raise ValueError("no finite returns to resample")
    indexed = indexed_series(usable, ["panel"])
    blocks = materialize(wrapped_blocks(indexed, ["panel"], F.col("ret"), block_size), "blocks")
    sizes = blocks.where(F.col("start") == 0).select("panel", "n")
    paths = path_ids(sizes, ["panel"], ["path"], n_paths).withColumns(
        {"horizon": F.lit(horizon), "phase": F.lit(phase)}
    )
    draws = block_draws(paths, block_size, F.lit(seed), F.col("phase"))
    return (
        draws.drop("n")
        .join(join_side(blocks.drop("n")), ["panel", "start"])
        .select("panel", "phase", "path", "block", F.posexplode(F.slice("items", 1, F.col("len"))))
        .select(
            "panel",
            "phase",
            "path",
            (F.col("block") * block_size + F.col("pos") + 1).alias("day"),
            F.col("col").alias("r"),
        )
    )

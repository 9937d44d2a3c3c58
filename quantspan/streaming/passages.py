"""First passage of profit and loss over batches of steps, with state for each path.

The batch form (`barrier.first_passage`) reads whole histories. Here the files of a day or a
month arrive one after the other: a path's state is its number of steps, its running total and
the steps on which it first hit a barrier, and each run takes what has arrived since the last
(`Trigger.AvailableNow`), goes on from the checkpoint, and stops. The results are those of the
batch form over all files, however they are cut and whenever a run was broken off.

Steps of a path have to arrive in order from file to file; within a batch they are sorted, so a
task holds one path's steps of one batch. Steps without a path are left out; a step without a
value counts as a step of 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quantspan.config import BarrierRules
from quantspan.operators.barrier import outcome_of

STATE = "day bigint, pnl double, gain_day bigint, loss_day bigint"
OUTPUT = f"path string, {STATE}"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Passage(StatefulProcessor):
    """Rows (path, at, id, r) of one path in a batch -> its state after them."""

    def __init__(self, target: float, daily_loss_limit: float, max_drawdown: float):
        self.target, self.daily, self.drawdown = target, daily_loss_limit, max_drawdown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("passage", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        steps = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        day, pnl, gain, loss = self.state.get() if self.state.exists() else (0, 0.0, None, None)
        r = steps["r"].fillna(0.0).to_numpy(float)
        # From the total on, not added to it later: a level on a barrier falls on the side it has in one pass.
        level = np.cumsum(np.append(pnl, r))[1:]
        at = day + 1 + np.arange(len(r))
        gained, lost = level >= self.target, (r <= -self.daily) | (level <= -self.drawdown)
        gain = int(at[gained.argmax()]) if gain is None and gained.any() else gain
        loss = int(at[lost.argmax()]) if loss is None and lost.any() else loss
        after = (int(day + len(r)), float(level[-1]), gain, loss)
        self.state.update(after)
        yield pd.DataFrame([(key[0], *after)], columns=["path", "day", "pnl", "gain_day", "loss_day"]).astype(
            {"gain_day": "Int64", "loss_day": "Int64"}
        )

    def close(self) -> None:
        pass


def advance(
    spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, rules: BarrierRules = BarrierRules(), files: int | None = None
) -> None:
    """Take in the parquet files of (path, at, id, r) that have arrived in `folder`, and stop.

    `out` gets each path's state after every batch that had steps of it. `files` bounds a batch.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    steps = spark.readStream.schema(schema)
    if files is not None:
        steps = steps.option("maxFilesPerTrigger", files)
    processor = Passage(rules.phase1_target, rules.daily_loss_limit, rules.max_drawdown)
    states = (
        steps.parquet(folder)
        .where(F.col("path").isNotNull())
        .groupBy("path")
        .transformWithStateInPandas(processor, OUTPUT, "Append", "None")
    )
    run = states.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    run.trigger(availableNow=True).start(out).awaitTermination()


def outcomes(spark: SparkSession, out: str) -> DataFrame:
    """The latest state of every path as an outcome -> (path, outcome, day)"""
    states = spark.read.schema(OUTPUT).parquet(out)
    last = states.groupBy("path").agg(F.max(F.struct("day", "gain_day", "loss_day")).alias("x")).select("path", "x.*")
    return last.select(
        "path",
        outcome_of(F.col("gain_day"), F.col("loss_day")).alias("outcome"),
        F.coalesce(F.least("gain_day", "loss_day"), F.col("day")).alias("day"),
    )

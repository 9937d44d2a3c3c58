import shutil

import numpy as np
from pyspark.sql import functions as F

from quantspan.config import BarrierRules
from quantspan.operators import barrier
from quantspan.streaming import passages

SCHEMA = "path string, at timestamp_ntz, id bigint, r double"


def steps(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(f"p{k}", i // 3, i, float(r)) for i, (k, r) in enumerate(zip(rng.choice([0, 0, 0, 1, 2, 3], n), rng.normal(0.001, 0.02, n)))]
    rows += [("late", 100, 5_000, 0.2), ("gap", 10, 6_000, None), ("gap", 120, 6_001, -0.2)]
    df = spark.createDataFrame(rows, "path string, hour int, id bigint, r double")
    return df.select("path", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, hour)").alias("at"), "id", "r")


def whole(spark, df, rules):
    rows = spark.sql(
        "select *, row_number() over w as day, sum(coalesce(r, 0)) over w as pnl from {d} window w as (partition by path order by at, id)", d=df
    ).withColumn("r", F.coalesce("r", F.lit(0.0)))
    found = barrier.first_passage(rows, ["path"], rules.phase1_target, rules.daily_loss_limit, rules.max_drawdown)
    return sorted(tuple(r) for r in found.select("path", "outcome", "day").collect())


def test_batches_and_restarts_give_the_result_of_the_whole(spark, tmp_path):
    rules = BarrierRules()
    df = steps(spark)
    want = whole(spark, df, rules)
    assert {o for _, o, _ in want} == {"PASSED", "FAILED"} or len({o for _, o, _ in want}) == 3
    folder, out, progress = (str(tmp_path / n) for n in ("steps", "out", "progress"))
    days = [F.col("at") < F.lit("2024-01-03"), (F.col("at") >= F.lit("2024-01-03")) & (F.col("at") < F.lit("2024-01-05")), F.col("at") >= F.lit("2024-01-05")]
    for i, day in enumerate(days):
        df.where(day).coalesce(1).write.mode("append").parquet(folder)
        if i == 1:
            shutil.copytree(progress, str(tmp_path / "copy"))  # as a new cluster would find it
            progress = str(tmp_path / "copy")
        passages.advance(spark, folder, SCHEMA, out, progress, rules)
        passages.advance(spark, folder, SCHEMA, out, progress, rules)  # nothing new: nothing changes
    assert sorted(tuple(r) for r in passages.outcomes(spark, out).collect()) == want


def test_a_level_on_the_barrier_falls_as_in_one_pass(spark, tmp_path):
    rules = BarrierRules()
    # They add up to 199.9 = 0.1 * 1999: in order to 0.1, by the sums of two batches to a little less.
    values = [34.0, 50.98, 0.99, 0.11, 27.52, 81.5, 33.68, 371.12]
    rows = [("p", i, i, (v - 50.0) / 1999.0) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "path string, hour int, id bigint, r double")
    df = df.select("path", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, hour)").alias("at"), "id", "r")
    folder, out, progress = (str(tmp_path / n) for n in ("steps", "out", "progress"))
    for batch in (F.col("id") < 3, F.col("id") >= 3):
        df.where(batch).coalesce(1).write.mode("append").parquet(folder)
        passages.advance(spark, folder, SCHEMA, out, progress, rules)
    assert [tuple(r) for r in passages.outcomes(spark, out).collect()] == [("p", "PASSED", 8)]

"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.
Each query runs to completion into a no-op sink; the first, untimed one only starts the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from quantspan.plans.catalog import QUERIES  # noqa: E402
from quantspan.session import build_session  # noqa: E402

HEADLINE = (
    "dedup_keep_last",
    "quality_summary",
    "gap_safe_returns",
    "asof_lookback",
    "rolling_vol",
    "rebalance_hold",
    "backtest",
    "metrics",
    "return_histogram",
    "tsmom",
    "tsmom_backtest",
    "swap_sensitivity",
    "deflated_sharpe",
    "first_passage",
    "leverage_grid",
    "funded_survival",
    "block_bootstrap",
    "tom_signal",
    "mean_contrast",
    "null_benchmark",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["metrics"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": cpus,
                "bootstrap_days": 10_000 * 756 if "block_bootstrap" in times else 0,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

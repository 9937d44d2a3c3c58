import datetime as dt
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from quantspan.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(text):
    return dt.date.fromisoformat(text)


def business_days(start, n):
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def walk(n, seed, drift=0.0, deviation=0.01, start=100.0):
    rng = np.random.default_rng(seed)
    return start * np.cumprod(1 + rng.normal(drift, deviation, n))


def to_bars(spark, days, **columns):
    """Bars of one instrument, in the given order."""
    names = list(columns)
    rows = [
        ("X", d, i, *[None if v is None else float(v) for v in values])
        for i, (d, *values) in enumerate(zip(days, *columns.values()))
    ]
    schema = "instrument string, dt date, ord bigint, " + ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(rows, schema)


def to_prices(spark, frame, panel="p"):
    """A wide pandas frame (dates x instruments) as a long panel; NaN cells become no row."""
    rows = [
        (panel, str(c), d.date() if hasattr(d, "date") else d, float(v))
        for c in frame.columns
        for d, v in frame[c].items()
        if v == v
    ]
    return spark.createDataFrame(rows, "panel string, instrument string, dt date, close double")


def to_weights(spark, frame, panel="p"):
    return to_prices(spark, frame, panel).withColumnRenamed("close", "w")


def to_returns(spark, values, start="2015-01-01", panel="p"):
    days = business_days(start, len(values))
    rows = [(panel, d, None if v is None else float(v)) for d, v in zip(days, values)]
    return spark.createDataFrame(rows, "panel string, dt date, ret double")


def wide(df, value):
    pdf = df.toPandas()
    return pdf.pivot(index="dt", columns="instrument", values=value).sort_index()


def series(df, value):
    pdf = df.toPandas().sort_values("dt")
    return pdf.set_index("dt")[value]

"""The t tail at many degrees of freedom, against numeric integration."""

import math

import numpy as np
from pyspark.sql import functions as F

from sigstab.functions.columns import two_sided_t


def integrated(t: float, df: int) -> float:
    """Simpson's rule over the density, whose constant comes from lgamma."""
    x = np.linspace(0, abs(t), 20001)
    y = np.exp(-(df + 1) / 2 * np.log1p(x * x / df))
    area = (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) * (x[1] - x[0]) / 3
    half = np.linspace(0, 40, 80001)
    z = np.exp(-(df + 1) / 2 * np.log1p(half * half / df))
    whole = (z[0] + z[-1] + 4 * z[1:-1:2].sum() + 2 * z[2:-1:2].sum()) * (half[1] - half[0]) / 3
    return 1 - area / whole


def test_tail_of_many_degrees_is_exact(spark):
    cases = [(t, df) for t in (0.0, 0.01, 0.3, 1.0, 1.96, 3.3, 4.2, 4.3, 5.5) for df in (2001, 2500, 4000, 10_254, 100_000)]
    rows = spark.createDataFrame(cases, "t double, df long").withColumn("p", two_sided_t(F.col("t"), F.col("df"))).collect()
    for r in rows:
        assert abs(r["p"] - integrated(r["t"], r["df"])) < 1e-11, r
    far = spark.createDataFrame([(30.0, 3000), (1e3, 3000), (None, 3000)], "t double, df long").withColumn("p", two_sided_t(F.col("t"), F.col("df"))).collect()
    assert 0 < far[0]["p"] < 1e-160 and far[1]["p"] == 0 and far[2]["p"] is None
    assert math.isclose(rows[0]["p"], 1)

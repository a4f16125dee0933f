"""Holt's linear trend of series of any length, none of which a task needs whole.

Smoothing forgets: each step multiplies what is left of an earlier state by a matrix whose
larger eigenvalue is 0.885, so after ``HEAD`` rows two starts differ by 1e-54 of what they
differed by.  Ranges of a series are therefore run side by side, each from its own first
value; their first ``HEAD`` values are run again, one range after the other, from the state
that the range before has left.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .offsets import _parted, durable

HEAD = 1024


def _smoothed(values, level: float, trend: float) -> tuple[list[float], float, float]:
    """Errors of the guesses one step ahead, and the state after the values."""
    errors = []
    for x in values:
        guess = level + trend
        errors.append(x - guess)
        new = 0.5 * x + 0.5 * guess
        trend, level = 0.1 * (new - level) + 0.9 * trend, new
    return errors, level, trend


def _merged(a: tuple, errors) -> tuple:
    """Moments (n, mean, sum of squared distances) with more errors, or with other moments."""
    if not isinstance(errors, tuple):
        if not len(errors):
            return a
        e = np.asarray(errors, float)
        errors = (len(e), float(e.mean()), float(((e - e.mean()) ** 2).sum()))
    (n, mean, m2), (k, other, more) = a, errors
    if not n or not k:
        return a if not k else errors
    apart = other - mean
    return n + k, mean + apart * k / (n + k), m2 + more + apart * apart * n * k / (n + k)


SCANNED = "g string, part int, d bigint, n bigint, first_t bigint, last_t bigint, level double, trend double, tail_n bigint, tail_mean double, tail_m2 double, head array<double>"
FITTED = "g string, last_t bigint, level double, trend double, spread double"


def holt(df: DataFrame, timestamp: str, value: str, ids: list[str], horizon: int, z: float) -> DataFrame:
    """(ids, forecast_timestamp, forecast_value, bounds) for each series; of equal times the smaller value is first."""
    head = HEAD
    key = F.to_json(F.struct(*(F.col(c).alias(f"i{k}") for k, c in enumerate(ids)))) if ids else F.lit("")
    y = F.col(value).cast("double")
    data = df.select(key.alias("g"), F.unix_micros(F.col(timestamp).cast("timestamp")).alias("t"), y.alias("y"), *(F.col(c).alias(f"i{k}") for k, c in enumerate(ids))).where(F.col("t").isNotNull() & F.col("y").isNotNull() & ~F.isnan("y"))

    def scan(batches):
        """One row for each series of a range, and rows (g, d, n) that count its steps in time."""
        part, series = TaskContext.get().partitionId(), None

        def ended():
            g, n, first, last, level, trend, tail, start = series
            return pd.DataFrame([(g, part, None, None, first, last, level, trend, *tail, start)], columns=columns).astype({"d": "Int64", "n": "Int64"})

        columns = [c.split(" ")[0] for c in SCANNED.split(", ")]
        for batch in batches:
            for g, rows in batch.groupby("g", sort=False):
                t, x = rows["t"].to_numpy(), rows["y"].to_numpy(float)
                if series is None or series[0] != g:
                    if series is not None:
                        yield ended()
                    series = [g, 0, int(t[0]), int(t[0]), float(x[0]), 0.0, (0, 0.0, 0.0), []]
                    steps = np.diff(t)
                else:
                    steps = np.diff(t, prepend=series[3])
                errors, level, trend = _smoothed(x.tolist(), series[4], series[5])
                fresh = max(0, head - series[1])
                series[7].extend(x[:fresh].tolist())
                series[1], series[3], series[4], series[5] = series[1] + len(x), int(t[-1]), level, trend
                series[6] = _merged(series[6], errors[fresh:])
                if len(steps):
                    d, n = np.unique(steps, return_counts=True)
                    yield pd.DataFrame({c: {"g": g, "part": part, "d": d, "n": n}.get(c) for c in columns}).astype({c: "Int64" for c in ("first_t", "last_t", "tail_n")} | {c: "float64" for c in ("level", "trend", "tail_mean", "tail_m2")})
        if series is not None:
            yield ended()

    def fit(parts: pd.DataFrame) -> pd.DataFrame:
        state, moments = None, (0, 0.0, 0.0)
        parts = parts.sort_values("part")
        for p in parts.itertuples():
            values = list(p.head)
            if state is None:
                state, values = (values[0], 0.0), values[1:]
            errors, level, trend = _smoothed(values, *state)
            moments = _merged(moments, errors)
            if p.tail_n:
                moments, level, trend = _merged(moments, (int(p.tail_n), p.tail_mean, p.tail_m2)), p.level, p.trend
            state = level, trend
        n, _, m2 = moments
        return pd.DataFrame([(p.g, p.last_t, *state, float(np.sqrt(m2 / n)) if n else 0.0)], columns=[c.split(" ")[0] for c in FITTED.split(", ")])

    order = ["g", "t", "y"]
    scanned = durable(data.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(scan, SCANNED))
    ranges = scanned.where("d IS NULL").drop("d", "n")
    gaps = ranges.select("g", (F.col("first_t") - F.lag("last_t").over(Window.partitionBy("g").orderBy("part"))).alias("d"), F.lit(1).cast("bigint").alias("n"))
    steps = _middle(scanned.select("g", "d", "n").unionAll(gaps).where("d IS NOT NULL").groupBy("g", "d").agg(F.sum("n").alias("n")))
    made = ranges.groupBy("g").applyInPandas(fit, FITTED).join(steps, "g", "left").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    if ids:
        made = made.join(data.groupBy("g").agg(*(F.first(f"i{k}").alias(f"i{k}") for k in range(len(ids)))), "g")
    k, day = F.col("k"), F.lit(86_400_000_000)
    guess, wide = F.col("level") + F.col("trend") * k, F.lit(z) * F.col("spread") * F.sqrt(k)
    at = F.timestamp_micros(F.col("last_t") + F.coalesce(F.shiftright(F.col("twice") * k, 1), day * k))
    return made.select(*(F.col(f"i{j}").alias(c) for j, c in enumerate(ids)), at.alias("forecast_timestamp"), guess.alias("forecast_value"), (guess - wide).alias("prediction_interval_lower_bound"), (guess + wide).alias("prediction_interval_upper_bound"))


def _middle(counts: DataFrame) -> DataFrame:
    """(g, twice the median of d) from counts (g, d, n), each d once: ranges of values, of which only totals meet."""
    parted = _parted(counts, [F.col("g"), F.col("d")])
    whole = Window.partitionBy("g")
    per = parted.groupBy("g", "__part").agg(F.sum("n").alias("m"))
    per = per.select("g", "__part", F.sum("m").over(whole).alias("total"), (F.sum("m").over(whole.orderBy("__part")) - F.col("m")).alias("before"))
    end = F.col("before") + F.sum("n").over(Window.partitionBy("g", "__part").orderBy("d"))
    at = parted.join(per, ["g", "__part"]).withColumn("end", end)
    holds = [(F.col("end") - F.col("n") <= m) & (m < F.col("end")) for m in (F.expr("(total - 1) div 2"), F.expr("total div 2"))]
    return at.where(reduce(lambda a, b: a | b, holds)).groupBy("g").agg((F.min("d") + F.max("d")).alias("twice"))

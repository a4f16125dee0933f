"""Positions and running totals over a global order, without a single-task window."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def durable(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again, so that partitions stay what they are."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    path = f"{root}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _parted(df: DataFrame, order: list[Column]) -> DataFrame:
    """Range-partitioned by the order, with the partition's number as ``__part``."""
    return durable(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))


def _shifted(sizes) -> Column:
    """Per partition: the value before it, as one bounded literal map (an entry a partition)."""
    return F.create_map(*(F.lit(x) for pair in sizes for x in pair)) if sizes else F.create_map(F.lit(0), F.lit(0))


def _literal(value, kind: DataType) -> Column:
    """A driver's value of a type; structs by their fields."""
    if isinstance(value, Row):
        return F.struct(*(_literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind.fields)))
    return F.lit(value).cast(kind)


def with_offset(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its 0-based position in the order as ``name``."""
    parted = _parted(df, order)
    sizes, total = [], 0
    for row in parted.groupBy("__part").count().orderBy("__part").collect():
        sizes.append((row["__part"], total))
        total += row["count"]
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return parted.withColumn(name, inside.cast("bigint") + F.coalesce(_shifted(sizes)[F.col("__part")], F.lit(0)).cast("bigint")).drop("__part")


def running(df: DataFrame, order: list[Column], expr: Column, how: str, name: str, back: list[Column] | None = None) -> DataFrame:
    """``df`` with a running sum, product, min or max of ``expr``, null where ``expr`` is null; or its last value so far.

    Totals of whole partitions come first (one row each), then windows inside
    partitions.  For last values ``back`` is the order reversed.
    """
    parted = _parted(df.withColumn("__x", expr), order)
    agg = {"sum": F.sum, "prod": F.product, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[how]
    join = {"sum": lambda a, b: a + b, "prod": lambda a, b: a * b, "min": min, "max": max, "last": lambda a, b: b}[how]
    if how == "last":
        ends = parted.where(F.col("__x").isNotNull()).withColumn("__r", F.row_number().over(Window.partitionBy("__part").orderBy(*back))).where("__r = 1")
        totals = parted.select("__part").distinct().join(ends.select("__part", F.col("__x").alias("t")), "__part", "left")
    else:
        totals = parted.groupBy("__part").agg(agg("__x").alias("t"))
    before, total = [], None
    for row in totals.orderBy("__part").collect():
        if total is not None:
            before.append((row["__part"], _literal(total, parted.schema["__x"].dataType) if how == "last" else total))
        total = row["t"] if total is None else total if row["t"] is None else join(total, row["t"])
    here = agg("__x").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = here
    if before:
        earlier = _shifted(before)[F.col("__part")]
        both = {
            "sum": lambda: here + F.coalesce(earlier, F.lit(0)), "prod": lambda: here * F.coalesce(earlier, F.lit(1)),
            "min": lambda: F.least(here, earlier), "max": lambda: F.greatest(here, earlier), "last": lambda: F.coalesce(here, earlier),
        }[how]()
    return parted.withColumn(name, both if how == "last" else F.when(F.col("__x").isNotNull(), both)).drop("__part", "__x")


def tallied(counts: DataFrame, order: list[Column], n: str, below: str, dense: str) -> tuple[DataFrame, int, int]:
    """``counts`` with the sum of ``n`` over the rows before each and their number, the sum over all, and the number of rows."""
    parted = _parted(counts, order)
    sums, sizes, total, kinds = [], [], 0, 0
    for row in parted.groupBy("__part").agg(F.sum(n).alias("t"), F.count(F.lit(1)).alias("k")).orderBy("__part").collect():
        sums.append((row["__part"], total))
        sizes.append((row["__part"], kinds))
        total, kinds = total + row["t"], kinds + row["k"]
    w = Window.partitionBy("__part").orderBy(*order)
    sofar = F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(n) + F.coalesce(_shifted(sums)[F.col("__part")], F.lit(0))
    at = F.row_number().over(w) - 1 + F.coalesce(_shifted(sizes)[F.col("__part")], F.lit(0))
    return parted.withColumns({below: sofar.cast("bigint"), dense: at.cast("bigint")}).drop("__part"), total, kinds


def running_moments(df: DataFrame, order: list[Column], expr: Column, name: str) -> DataFrame:
    """``df`` with (n, mean, m2) of the values of ``expr`` so far; m2 is the sum of squared distances from the mean.

    Moments of whole partitions are merged pairwise on the driver, one row each, and once
    more with those inside a partition, so that nothing cancels.
    """
    x = F.col("__x")

    def moments(over=lambda c: c) -> Column:
        n = over(F.count(x))
        return F.struct(n.alias("n"), F.coalesce(over(F.avg(x)), F.lit(0.0)).alias("mean"), F.coalesce(over(F.var_pop(x)) * n, F.lit(0.0)).alias("m2"))

    parted = _parted(df.withColumn("__x", expr.cast("double")), order)
    whole = parted.groupBy("__part").agg(moments().alias("t"))
    kind, before, total = whole.schema["t"].dataType, [], None
    for part, t in whole.orderBy("__part").collect():
        if total is not None:
            before.append((part, _literal(Row(*total), kind)))
            n, apart = total[0] + t[0], t[1] - total[1]
            share = t[0] / n if n else 0.0
            t = (n, total[1] + apart * share, total[2] + t[2] + apart * apart * total[0] * share)
        total = tuple(t)
    w = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    made = parted.withColumn("__here", moments(lambda c: c.over(w)))
    here, was = F.col("__here"), F.coalesce(_shifted(before)[F.col("__part")], _literal(Row(0, 0.0, 0.0), kind)) if before else _literal(Row(0, 0.0, 0.0), kind)
    made = made.withColumn("__was", was)
    was, n = F.col("__was"), here["n"] + F.col("__was")["n"]
    apart, share = here["mean"] - was["mean"], F.coalesce(here["n"] / F.nullif(n, F.lit(0)), F.lit(0.0))
    both = F.struct(n.alias("n"), (was["mean"] + apart * share).alias("mean"), (was["m2"] + here["m2"] + apart * apart * was["n"] * share).alias("m2"))
    return made.withColumn(name, both).drop("__part", "__x", "__here", "__was")

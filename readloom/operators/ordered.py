"""Windows over a whole table's order, in ranges of about equal size.

A window without partitions would put all rows in one task. Here sampled splitters cut the order into ranges, a window
runs inside each range, and what passes from one range to the next is carried by a table of one row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.tables import materialise, partitions

#: The table of ranges has at most so many rows: it is broadcast, and a window over it runs in one task.
MAX_RANGES, SAMPLES = 4096, 32
#: Letters of a text key that the driver sees: splitters need not be keys, so those of long sequences are cut off.
PREFIX = 256


def ranges(df: DataFrame, *keys: str, n: int | None = None, written: bool = False) -> DataFrame:
    """df, written once (if it is not ``written``), with ``range``: numbers that ascend with the keys (not null), each for about as many rows.

    Rows whose first keys are texts with equal ``PREFIX`` letters are told apart by the other keys only.
    """
    df = df if written else materialise(df, "ordered")
    n = min(n or 3 * partitions(df.sparkSession), MAX_RANGES)
    step = max(1, df.count() // (SAMPLES * n))
    key = F.struct(*keys)
    seen = [F.left(k, F.lit(PREFIX)).alias(k) if df.schema[k].dataType.typeName() == "string" else F.col(k) for k in keys]
    sample = df.select(*keys).filter(F.pmod(F.xxhash64(*keys), F.lit(step)) == 0).select(*seen).distinct().orderBy(*keys).collect()
    found = sample[:: max(1, -(-len(sample) // n))][1:]
    if not found:
        return df.withColumn("range", F.lit(0))
    splits = F.array(*[F.struct(*[F.lit(x).cast(df.schema[k].dataType).alias(k) for k, x in zip(keys, row, strict=True)]) for row in found])
    bits = F.array(*[F.lit(1 << b) for b in reversed(range(len(found).bit_length()))])
    # how many splitters are not above the key, the high bit of the number first
    up_to = lambda at, b: F.when((at + b <= len(found)) & (F.get(splits, at + b - 1) <= key), at + b).otherwise(at)
    # never null, else a join on it puts a filter before the shuffle that finds the range once more, and a plan without that join has another shuffle
    return df.withColumn("range", F.coalesce(F.aggregate(bits, F.lit(0), up_to), F.lit(0)))


def of_ranges(rows: DataFrame, value: Column, over: Column, name: str) -> DataFrame:
    """Adds to each row what ``over``, a window function of ``name`` (the aggregate of its range), is for its range."""
    table = rows.groupBy("range").agg(value.alias(name)).select("range", over.alias(name))
    return rows.join(F.broadcast(table), "range")


def by_range() -> Window:
    return Window.orderBy("range")


def earlier() -> Window:
    """All ranges before."""
    return by_range().rowsBetween(Window.unboundedPreceding, -1)


def later() -> Window:
    """All ranges behind, the nearest last."""
    return Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)


def running_sum(df: DataFrame, value: Column, name: str, *keys: str, n: int | None = None) -> DataFrame:
    """df with the sum of value over all rows before each in order of the keys."""
    rows = of_ranges(ranges(df.withColumn("_v", value), *keys, n=n), F.sum("_v"), F.coalesce(F.sum("_before").over(earlier()), F.lit(0)), "_before")
    inner = Window.partitionBy("range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, (F.col("_before") + F.coalesce(F.sum("_v").over(inner), F.lit(0))).cast("long")).drop("range", "_v", "_before")


def number(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """df with its rows' numbers, from 0, in order of the keys."""
    return running_sum(df, F.lit(1), name, *keys)

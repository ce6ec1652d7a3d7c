"""Previous and last known values within a key, and running sums, without gathering a key in one task.

A plain window sorts each key in one task. Here a key's rows are split by blocks of the order column; each block is a window of its own,
and what crosses a block's border is carried by a table with one row for each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cindral.session import cut


def carried(df: DataFrame, keys: list[str], order: str, value: Column, name: str, width: int = 4096) -> DataFrame:
    """Adds `name`: the last non-null `value` of an earlier row of the same keys, by `order` (a whole number, unique within keys).

    width: numbers of `order` in a block. Null if there is no earlier value.
    """
    block = F.floor(F.col(order) / width)
    df = df.withColumn("_block", block).withColumn("_value", value)
    inside = W.partitionBy(*keys, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    blocks = df.groupBy(*keys, "_block").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_last"))
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carry = blocks.select(*keys, "_block", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    out = df.withColumn("_in", F.last("_value", ignorenulls=True).over(inside)).join(carry, [*keys, "_block"], "left")
    return out.withColumn(name, F.coalesce("_in", "_carry")).drop("_in", "_carry", "_value", "_block")


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """df with the running totals `sums` (name -> value) over each group of `by` in the given order (unique within groups).

    Rows are spread by ranges of the whole order, so a group, or one value of the order, of any size is cut; each range is summed by itself,
    and what comes before it is added from the ranges' totals, one row each.
    """
    by = by or []
    d = df.withColumns({f"_v{i}": v for i, v in enumerate(sums.values())})
    d = cut(d.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    totals = d.groupBy(*by, "_range").agg(*(F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(sums))))
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(*by, "_range", *(F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_c{i}") for i in range(len(sums))))
    inside = W.partitionBy(*by, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = d.withColumns({f"_r{i}": F.sum(f"_v{i}").over(inside) for i in range(len(sums))}).join(carry, [*by, "_range"])
    return out.select(*df.columns, *((F.col(f"_r{i}") + F.col(f"_c{i}")).alias(n) for i, n in enumerate(sums)))

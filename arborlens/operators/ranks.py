"""Numbers in a total order without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import stored


def numbered(rows: DataFrame, order: list[Column], name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """rows with the column `name`: 1, 2, ... in the order, for each group of keys.

    Rows are dealt by ranges of the order, sorted and stored; a row's number is its place in its partition after as many as the group has in the partitions before.
    """
    own = [F.col(k) for k in keys]
    dealt = rows.repartitionByRange(*own, *order).sortWithinPartitions(*own, *order)
    dealt = stored(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id()), "sorted")
    sizes = dealt.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition and group
    before = sizes.select(*keys, "__part", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy("__place"))
    out = dealt.withColumn("__row", place).join(before, [*keys, "__part"])
    return out.select(*rows.columns, (F.col("__before") + F.col("__row")).cast("bigint").alias(name))

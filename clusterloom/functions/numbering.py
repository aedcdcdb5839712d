"""Row numbers without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clusterloom.functions.scratch import cut


def numbered(df: DataFrame, *order: Column | str, into: str = "number") -> DataFrame:
    """``df`` with numbers 0, 1, ... in the given order, in the column ``into``; ``order`` must tell all rows apart.

    Rows are dealt by ranges and sorted side by side; only the ranges' sizes (a row a range) meet in one task.
    """
    dealt = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_m", 33)  # the id holds the range's number, and below it the row's place there
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    place = F.col("_m").bitwiseAND((1 << 33) - 1)
    return dealt.join(F.broadcast(starts), part == F.col("_part")).withColumn(into, (F.col("_start") + place).cast("long")).drop("_m", "_part", "_start")

"""Numbers over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Values of the ordering column that are numbered by one task.
SPAN = 1 << 20


def numbered(rows: DataFrame, order: Column, into: str) -> DataFrame:
    """Adds 1, 2, ... in the order of a whole-number column without ties or nulls.

    Rows are numbered within blocks of SPAN values; only the blocks' sizes, a row for each, are summed over the whole table.
    """
    own = rows.withColumn("_b", F.floor(order / F.lit(SPAN)))
    sizes = own.groupBy("_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("_b").alias("_k"), before.alias("_before"))
    place = F.row_number().over(W.partitionBy("_b").orderBy(order))
    return own.withColumn("_r", place).join(starts, F.col("_b") == F.col("_k")).withColumn(into, (F.col("_before") + F.col("_r")).cast("int")).drop("_b", "_r", "_k", "_before")

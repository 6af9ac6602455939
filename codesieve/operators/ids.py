"""Dense surrogate ids without a single-task window.

Rows are range-partitioned and sorted by the order columns and written
once (so positions are stable when an executor is lost); rows per partition
(one row per partition) become offsets, and each row adds its position
inside its partition.  The same path serves any number of rows.

Ids of a run start at the run's own base (:func:`first_id`), so no scan of
the ids handed out before is needed and two runs never meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codesieve.session import materialize

# bits of an id that number the rows of one run
ROW_BITS = 36


def first_id(run: int) -> int:
    """Ids of run number ``run`` lie above this and at or below ``first_id(run + 1)``."""
    return run << ROW_BITS


def run_of(row_id: int) -> int:
    """The run number of an id given by a run."""
    return (row_id - 1) >> ROW_BITS


def dense_ids(df: DataFrame, order_cols: list[str], start: int, id_col: str = "id",
              partitions: int | None = None) -> DataFrame:
    """Add ``id_col`` = start + 1, start + 2, ... in ``order_cols`` order (ties broken arbitrarily)."""
    ranged = df.repartitionByRange(partitions, *order_cols) if partitions else df.repartitionByRange(*order_cols)
    s = materialize(ranged.sortWithinPartitions(*order_cols)
                    .withColumn("_pid", F.spark_partition_id())
                    .withColumn("_mid", F.monotonically_increasing_id()), "numbered")
    # one row per partition, so this window and the join side are bounded by the partition count
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (s.groupBy(F.col("_pid").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
               .select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))
    pos = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return (s.join(F.broadcast(offsets), F.col("_pid") == F.col("_p"))
            .withColumn(id_col, (F.lit(start) + F.col("_off") + pos + F.lit(1)).cast("bigint"))
            .select(*df.columns, id_col))

"""Rank rows inside groups without putting a whole group into one task.

``row_number()`` over a window partitioned by the group keys sends each
group to one task; a group holding a third of the rows then holds up the
job.  Here the rows are range-partitioned on (group keys, order keys), so
a large group spans many partitions; each partition numbers its rows; a
small table with one row per (partition, group) turns those numbers into
ranks within the group.

The numbered rows are written once and read back: both readers see the
same partition numbers, whatever columns each of them needs and however
often a task is run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codesieve.session import materialize


def rank_within(df: DataFrame, group_cols: list[str], order_cols: list[str], rank_col: str = "rank",
                partitions: int | None = None) -> DataFrame:
    """Add ``rank_col`` = 1, 2, ... per group in ``order_cols`` order (the order must be unique per group)."""
    keys = group_cols + order_cols
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    s = materialize(ranged.sortWithinPartitions(*keys)
                    .withColumn("_pid", F.spark_partition_id())
                    .withColumn("_mid", F.monotonically_increasing_id()), "ranked")
    # one row per (partition, group): a group spans at most as many rows here as there are partitions
    per = s.groupBy("_pid", *group_cols).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    same = [F.col(f"_g{i}").eqNullSafe(F.col(c)) for i, c in enumerate(group_cols)]
    per = per.select(F.col("_pid").alias("_p"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group_cols)], "_off", "_first")
    on = F.col("_pid") == F.col("_p")
    for c in same:
        on = on & c
    return (s.join(per, on)
            .withColumn(rank_col, (F.col("_off") + F.col("_mid") - F.col("_first") + F.lit(1)).cast("bigint"))
            .select(*df.columns, rank_col))

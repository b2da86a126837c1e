"""Order statistics that never put a whole key (or the whole table) in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.session import cut_lineage


def row_number_within(df: DataFrame, keys: list[str], order: list[Column], out: str = "row_no",
                      n_parts: int | None = None, kind: str = "int") -> DataFrame:
    """``row_number() over (partition by keys order by order)`` for keys of any size.

    Range-partition by (keys, order); number rows inside each (partition, key)
    slice; add the count of the same key in earlier partitions.  The totals table
    has one row per (partition, key) slice, so a key spanning many partitions adds
    only that many rows, and no task holds more than one range partition."""
    spark = df.sparkSession
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = [F.col(k) for k in keys] + order
    # materialised once: two plans of the same range exchange would each sample their own boundaries
    parted = cut_lineage(df.repartitionByRange(n, *ordered).withColumn("_pid", F.spark_partition_id()))
    tot = parted.groupBy("_pid", *keys).agg(F.count("*").alias("_cnt"))
    before = W.partitionBy(*keys).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    off = tot.select("_pid", *keys, F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    local = W.partitionBy("_pid", *keys).orderBy(*order)
    return parted.withColumn("_local", F.row_number().over(local)).join(off, ["_pid", *keys]) \
        .withColumn(out, (F.col("_local") + F.col("_off")).cast(kind)).drop("_pid", "_local", "_off")

"""How many pairs a pivot leaves to compare, without forming them.

With the distances of all vectors to one pivot, two vectors can be within r only if these
distances differ by at most r.  The pairs in that band are counted by a sorted sweep: for every
left value x the band holds ``#{y <= x + r} - #{y < x - r}`` right values, so each left row
becomes two marks, each right row one point, and all are range-partitioned by value (marks
before or after equal points as the comparison wants).  Inside a partition the sum over the
marks of the points before them is one pass; across partitions only four numbers each are
combined.  No pair is formed, and however dense the band is, no value's rows meet in one task:
equal values are spread by a second sort column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.session import cut_lineage

_LOWER, _POINT, _UPPER = 0, 1, 2


def band_pairs(left: DataFrame, right: DataFrame, radius: float, value: str = "value") -> DataFrame:
    """``n``: pairs of a left and a right value with ``left - radius <= right <= left + radius``.

    Null and NaN values are in no band."""
    x, y = (d.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")) for d in (left, right))
    marks = x.select(F.explode(F.array(F.struct((F.col("v") - radius).alias("v"), F.lit(_LOWER).alias("kind")),
                                       F.struct((F.col("v") + radius).alias("v"), F.lit(_UPPER).alias("kind")))).alias("m")).select("m.*")
    events = marks.unionByName(y.select("v", F.lit(_POINT).alias("kind"))).withColumn("_t", F.monotonically_increasing_id())
    # materialised once: the sweep and the totals must see the same partitions
    order = [F.col("v"), F.col("kind"), F.col("_t")]
    parted = cut_lineage(events.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()).select("_pid", "v", "kind", "_t"))
    point = F.when(F.col("kind") == _POINT, 1).otherwise(0)
    upto = F.sum(point).over(W.partitionBy("_pid").orderBy("v", "kind", "_t").rowsBetween(W.unboundedPreceding, 0))
    sign = F.when(F.col("kind") == _UPPER, 1).when(F.col("kind") == _LOWER, -1).otherwise(0)
    part = parted.withColumns({"_before": upto, "_sign": sign}).groupBy("_pid").agg(
        F.sum(point).alias("points"), F.sum(F.col("_sign") * F.col("_before")).alias("inside"), F.sum("_sign").alias("signs"))
    # one row a partition: points in earlier partitions
    earlier = F.coalesce(F.sum("points").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return part.withColumn("_e", earlier).agg(
        F.coalesce(F.sum(F.col("inside") + F.col("signs") * F.col("_e")), F.lit(0)).cast("long").alias("n"))


def prune_counts(questions: DataFrame, demos: DataFrame, k0: float, k1: float, vec_col: str = "vec") -> DataFrame:
    """The four counts of distances without and with one pivot (the question of the lowest id):

    ``n_self_full``      question pairs, n (n - 1) / 2
    ``n_self_compared``  n - 1 pivot distances and the pairs of other questions in the band of ``k0``
    ``n_cross_full``     question-demo pairs
    ``n_cross_compared`` pivot distances of the demos and the pairs of other questions and demos in the
                         band of ``k1``"""
    from quire.functions.vectors import euclid

    q = questions.where(F.col(vec_col).isNotNull()).select("ques_id", F.col(vec_col).cast("array<double>").alias("_v"))
    demos = demos.where(F.col(vec_col).isNotNull())
    first = q.agg(F.min_by("_v", "ques_id").alias("p"), F.min("ques_id").alias("id"), F.count("*").alias("n")).first()
    n, m = int(first["n"]), demos.count()
    spark = questions.sparkSession
    if n == 0:
        return spark.createDataFrame([(0, 0, 0, 0)], "n_self_full long, n_self_compared long, n_cross_full long, n_cross_compared long")
    pivot = F.array(*[F.lit(float(x)) for x in first["p"]])
    others = cut_lineage(q.where(F.col("ques_id") != first["id"]).select(euclid(F.col("_v"), pivot).alias("value")))
    far = demos.select(euclid(F.col(vec_col).cast("array<double>"), pivot).alias("value"))
    own, cross = band_pairs(others, others, k0), band_pairs(others, far, k1)
    both = own.select(F.col("n").alias("_own"), F.lit(0).cast("long").alias("_cross")).unionByName(
        cross.select(F.lit(0).cast("long").alias("_own"), F.col("n").alias("_cross")))
    return both.agg(F.sum("_own").alias("_own"), F.sum("_cross").alias("_cross")).select(
        F.lit(n * (n - 1) // 2).cast("long").alias("n_self_full"),
        (F.lit(n - 1) + F.expr(f"(_own - {n - 1}) div 2")).cast("long").alias("n_self_compared"),
        F.lit(n * m).cast("long").alias("n_cross_full"), (F.lit(m) + F.col("_cross")).cast("long").alias("n_cross_compared"))

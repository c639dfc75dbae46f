"""Running sums along an order, without one task that holds all rows or all rows of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from defectflow.shared import materialize


def prefix_sum(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], keys: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """``df`` with the running sums (the row itself included) of ``sums`` along ``order``, within each group of ``keys``.

    Rows are dealt by range of (keys, order) over ``buckets`` partitions and summed within each. Of the groups in a partition only the first can have begun in an earlier one: its sums there are
    added, one row at most for each partition. So a large group is spread over partitions like the rest. ``df`` is read twice, so it should be a written table or cheap to compute.
    ``tables`` of the result are what was written down for it, to be released when the result isn't read any more; ``n_rows`` is the number of rows."""
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = [f"__key{i}" for i in range(len(keys))]
    values = {f"__add_{k}": v for k, v in sums.items()}
    # The range's number must not change between the two uses below, so it is written down with the rows.
    dealt = df.withColumns(values | dict(zip(group, map(F.col, keys), strict=True))).repartitionByRange(n, *group, *order).withColumn("__bucket", F.spark_partition_id())
    dealt = materialize(dealt, "ranges", free=False, n=F.count(F.lit(1)))
    w = W.partitionBy("__bucket", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    inside = dealt.withColumns({k: F.sum(f"__add_{k}").over(w) for k in sums})
    totals = dealt.groupBy("__bucket", *group).agg(*(F.sum(v).alias(v) for v in values))
    earlier = W.partitionBy(*group).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(F.col("__bucket").alias("__at"), *(F.col(g).alias(f"{g}_") for g in group), F.count(F.lit(1)).over(earlier).alias("__n"), *(F.sum(v).over(earlier).alias(f"{v}_") for v in values))
    same = F.col("__bucket") == F.col("__at")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}_"))
    joined = inside.join(F.broadcast(before.where("__n > 0")), same, "left")  # at most one row for each partition
    out = joined.withColumns({k: F.col(k) + F.coalesce(F.col(f"__add_{k}_"), F.lit(0)) for k in sums}).select(*df.columns, *(k for k in sums if k not in df.columns))
    out.tables, out.n_rows = [dealt], dealt.totals["n"]
    return out

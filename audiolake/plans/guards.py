"""Small expressions that steer the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def above(condition: Column) -> Column:
    """``condition``, kept above the projections below it.

    A filter on a long computed expression is otherwise pushed through its projections, which repeats
    the expression once per use and outgrows generated code, or through an exchange that several readers share. A
    condition with a nondeterministic part is not moved. (Comparisons with ``rand`` are folded to constants, and a
    conditional is taken apart to a conjunction whose parts are moved one by one.)
    """
    return (F.monotonically_increasing_id() >= 0) == condition


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df``, dealt to all cores by ``key`` if its scan has fewer partitions than there are cores (one large row group, say).

    Scans of a cluster's size have more and are left as they are. The rows do not change.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df

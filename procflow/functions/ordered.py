"""Running totals and ranks over a whole table without a whole-table window.

``Window.orderBy(...)`` without ``partitionBy`` moves every row into one task. Here the order is
split into a *coarse* prefix, whose distinct values are known to be few, and a *fine* rest. Each
coarse group runs its own window in parallel, and the totals of the groups before it are
added as an offset. Only the few per-group totals meet in one task and are broadcast. Where no
such prefix is known, :func:`ranged_sum` finds ranges of about equal size by sampling.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procflow.sources.staging import stage


class By:
    """A sort key: a column name and its direction."""

    def __init__(self, name: str, descending: bool = False):
        self.name, self.descending = name, descending

    @property
    def column(self) -> Column:
        c = F.col(self.name)
        return c.desc_nulls_last() if self.descending else c.asc_nulls_last()


def _same(left: DataFrame, right: DataFrame, names: Sequence[str], prefix: str) -> Column:
    return reduce(
        lambda a, b: a & b, [left[n].eqNullSafe(right[prefix + n]) for n in names]
    )


def running_sum(
    df: DataFrame, value: str, coarse: Sequence[By], fine: Sequence[By], out: str
) -> DataFrame:
    """Add ``out``: the sum of ``value`` up to and including each row, in order coarse + fine.

    The caller must know a bound on the distinct ``coarse`` values, independent of the number of
    rows; ``coarse + fine`` must order the rows uniquely. The rows are shuffled by ``coarse``
    once, for the windows and for the totals alike.
    """
    names = [b.name for b in coarse]
    df = df.repartition(*names)
    before = Window.orderBy(*[b.column for b in coarse]).rowsBetween(
        Window.unboundedPreceding, -1
    )
    totals = df.groupBy(*names).agg(F.sum(value).alias("_total"))
    offsets = totals.select(
        *[F.col(n).alias(f"_c_{n}") for n in names],
        F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"),
    )
    within = (
        Window.partitionBy(*names)
        .orderBy(*[b.column for b in fine])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = df.withColumn("_within", F.sum(value).over(within))
    return local.join(F.broadcast(offsets), _same(local, offsets, names, "_c_")).select(
        *df.columns, (F.col("_before") + F.col("_within")).alias(out)
    )


# Columns that a ranged sum adds to what it stages.
_RANGE, _WITHIN = "_range", "_within"


def ranged_sum(
    df: DataFrame,
    value: str,
    order: Sequence[By],
    out: str,
    groups: Sequence[str] = (),
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` up to and including each row, in ``order``, per group.

    Nothing needs to be known about the keys. Spark samples them and deals the rows to ranges of
    about equal size, wherever they lie close together: a group that holds most rows is spread over
    as many ranges as its rows need, and so are ties on all but the last key. Each range runs its
    window; the totals of the ranges before, one row per range and group, are added as an offset.
    ``order`` must order the rows of a group uniquely. The ranged rows are written to the shared
    folder with the number of their range, as a second sampling could cut elsewhere. ``totals`` names
    further columns to add: the sum of a column over the whole group.
    """
    totals = totals or {}
    names = list(groups)
    keys = [*[F.col(g).asc_nulls_last() for g in names], *[b.column for b in order]]
    ranged = stage(df.repartitionByRange(*keys).withColumn(_RANGE, F.spark_partition_id()), "ranged")
    place = [_RANGE, *names]
    within = (
        Window.partitionBy(*place)
        .orderBy(*[b.column for b in order])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    sums = [F.sum(column).alias(name) for name, column in totals.items()]
    held = ranged.groupBy(*place).agg(F.sum(value).alias("_total"), *sums)
    whole = Window.partitionBy(*names)
    earlier = whole.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(
        *[F.col(n).alias(f"_o_{n}") for n in place],
        F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"),
        *[F.sum(name).over(whole).alias(name) for name in totals],
    )
    local = ranged.withColumn(_WITHIN, F.sum(value).over(within))
    joined = local.join(offsets, _same(local, offsets, place, "_o_"))
    return joined.select(*df.columns, (F.col("_before") + F.col(_WITHIN)).alias(out), *totals)


def row_numbers(
    df: DataFrame, coarse: Sequence[By], fine: Sequence[By], out: str
) -> DataFrame:
    """Add ``out``: 1, 2, 3, ... in the order coarse + fine (see :func:`running_sum`)."""
    numbered = running_sum(df.withColumn("_one", F.lit(1)), "_one", coarse, fine, out)
    return numbered.withColumn(out, F.col(out).cast("int")).drop("_one")


def dense_ranks(
    df: DataFrame, coarse: Sequence[By], fine: Sequence[By], out: str
) -> DataFrame:
    """Add ``out``: the dense rank in the order coarse + fine.

    The distinct key combinations are numbered and joined back, so rows that tie (possibly most
    of the table) are combined before any sort. The join is left to Spark's own size check.
    """
    names = [b.name for b in (*coarse, *fine)]
    ranked = row_numbers(df.select(*names).distinct(), coarse, fine, out)
    keys = ranked.select(*[F.col(n).alias(f"_r_{n}") for n in names], out)
    return df.join(keys, _same(df, keys, names, "_r_")).select(*df.columns, out)

"""Exact continuous percentiles over value histograms.

Rows are first counted per (group, value). That is an ordinary hash aggregate: it combines in
the map tasks, so a group holding a third of all rows ships only its distinct values, and its
counting is spread over all reducers. The percentile then reads the counts as frequencies. Its
state is one entry per distinct value: day counts are bounded by the calendar range of the log.

Where distinct values have no such bound (unrounded shares), :func:`selected_percentiles` selects
by rank: running counts over ranges of the values find the rows at the two ranks next to the
percentile, and no task holds all values of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procflow.functions.ordered import By, ranged_sum
from procflow.functions.rows import COUNT, cases


def histogram(df: DataFrame, *cols: str) -> DataFrame:
    """Number of rows per distinct combination of ``cols``, in column ``_n``; the rows of a counted
    table count as often as they say."""
    return df.groupBy(*cols).agg(cases(df).alias(COUNT))


def percentile_of(value: Column | str, p: float) -> Column:
    """Aggregate: continuous percentile (linear interpolation) of a histogram's values.

    NULL values are ignored. Group by at least one column: an empty input must give no row.
    """
    return F.percentile(value, p, F.col(COUNT))


def percentiles(
    hist: DataFrame, keys: Sequence[str], value: Column | str, named: dict[str, float]
) -> DataFrame:
    """One row per group with the percentiles in ``named`` and the row count as ``_n``."""
    aggs = [percentile_of(value, p).alias(name) for name, p in named.items()]
    return hist.groupBy(*keys).agg(*aggs, F.sum(COUNT).alias(COUNT))


def selected_percentiles(
    hist: DataFrame, keys: Sequence[str], value: str, named: dict[str, float]
) -> DataFrame:
    """What :func:`percentiles` returns, for any number of distinct values.

    ``_n`` counts all rows of a group, those with a NULL value too, which no percentile sees; a group
    of NULLs alone has NULL percentiles. Only the rows at the ranks sought, and those of NULL, reach
    the last aggregation.
    """
    names = list(keys)
    known = F.when(F.col(value).isNotNull(), F.col(COUNT)).otherwise(F.lit(0)).alias("_known")
    counted = hist.select(*names, value, COUNT, known)
    sizes = {"_all": COUNT, "_size": "_known"}
    # Equal values are not combined first: neighbours in the order share their rank range, whichever comes first.
    order = [By(value), By("_copy")]
    rows = ranged_sum(counted.withColumn("_copy", F.monotonically_increasing_id()), "_known", order, "_upto", names, sizes)

    def here(rank: Column) -> Column:
        return (F.col("_upto") - F.col("_known") <= rank) & (rank < F.col("_upto"))

    found, out, sought = [], [], F.col(value).isNull()
    for i, (name, p) in enumerate(named.items()):
        place = (F.col("_size") - 1) * F.lit(float(p))
        for end, rank in (("low", F.floor(place)), ("high", F.ceil(place))):
            sought = sought | here(rank)
            found.append(F.max(F.when(here(rank), F.col(value).cast("double"))).alias(f"_{end}{i}"))
        found.append(F.max(place).alias(f"_place{i}"))
        place, low, high = F.col(f"_place{i}"), F.col(f"_low{i}"), F.col(f"_high{i}")
        between = (F.ceil(place) - place) * low + (place - F.floor(place)) * high
        out.append(F.when(low == high, low).otherwise(between).alias(name))
    groups = rows.where(sought).groupBy(*names).agg(*found, F.max("_all").alias(COUNT))
    return groups.select(*names, *out, COUNT)

"""A purchase-to-pay log derived from the ``lineitem`` table by integer arithmetic.

The given tables hold no purchase-to-pay log, so every order line is read as one purchase-order
item: its four keys fix when each milestone happens and which ones are missing or out of order.
Lines that repeat an order key and line number give cases with several events per step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procflow.constants import CI_ACTIVITY, GR_ACTIVITY, IR_ACTIVITY, PO_ACTIVITY
from procflow.sources.star import Star

LINE_SCHEMA = (
    "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT"
)

# The moment minute 0 stands for, the activities by key, and the keys of the
# spend-area dimension (area 12 occurs in the cases but is missing there on purpose).
EPOCH = "2018-01-01 00:00:00"
ACTIVITIES = (
    (1, PO_ACTIVITY),
    (2, GR_ACTIVITY),
    (3, IR_ACTIVITY),
    (4, CI_ACTIVITY),
    (5, "Change Price"),
)
KNOWN_SPEND_AREAS = 11


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The four key columns of ``lineitem``; nothing else is read from the files."""
    return spark.read.schema(LINE_SCHEMA).parquet(f"{folder.rstrip('/')}/lineitem.parquet")


def _day(n: Column) -> Column:
    return (n - 1) * 1440


def purchase_items(lines: DataFrame) -> DataFrame:
    """Case number, milestone minutes and the hash values that decide which events exist."""
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    keyed = lines.select(
        "*",
        (order * 10 + line).alias("case_no"),
        (
            (order * 7 + line * 31) % 395 * 1440 + (order * 37 + line * 101) % 1440 + part % 3 * 720
        ).alias("po_min"),
        ((part * 7 + order * 3 + line) % 100).alias("h1"),
        ((part * 11 + order * 5 + supp) % 100).alias("h2"),
        ((part * 13 + order * 17 + supp * 3) % 100).alias("h3"),
    )
    h1, h2, h3 = F.col("h1"), F.col("h2"), F.col("h3")
    clear_days = F.when(supp % 3 == 0, h3 * 3 % 110).otherwise(h3 % 60)
    return (
        keyed.withColumn("gr_min", F.col("po_min") + _day(part % 30) + h1 * 7)
        .withColumn("ir_min", F.col("gr_min") + _day((order + part) % 25) + h2 * 11)
        .withColumn("ci_min", F.col("ir_min") + _day(clear_days) + h1 * 5)
    )


def _case_id() -> Column:
    return F.concat(F.lit("C"), F.col("case_no").cast("string")).alias("case_id")


def _company() -> Column:
    tenth = F.col("l_orderkey") % 10
    return F.when(tenth < 8, 1).when(tenth == 8, 2).otherwise(3)


def _vendor() -> Column:
    return F.when(F.col("case_no") % 97 != 0, F.col("l_suppkey"))


def _spend_area() -> Column:
    return F.col("l_partkey") % 12 + 1


def _events(items: DataFrame, *carry: Column) -> DataFrame:
    """One row per event of each item, from a single pass over the items."""
    h1, h2, h3 = F.col("h1"), F.col("h2"), F.col("h3")
    minutes = {
        1: F.when(F.col("case_no") % 101 != 0, F.col("po_min")),
        2: F.when(h1 >= 6, F.col("gr_min")),
        3: F.when(h2 >= 10, F.col("ir_min")),
        4: F.when((h3 >= 25) & (h2 >= 10), F.col("ci_min")),
        5: F.when(h1 % 4 == 0, F.col("po_min") + 60),
    }
    ids = [_case_id(), *carry]
    wide = items.select(*ids, *[m.cast("int").alias(str(key)) for key, m in minutes.items()])
    kept = wide.columns[: len(ids)]
    long = wide.unpivot(kept, [str(key) for key in minutes], "_key", "_minute")
    moment = F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("_minute"))
    return long.filter(F.col("_minute").isNotNull()).select(
        *kept, F.col("_key").cast("int").alias("activity_key"), moment.alias("timestamp")
    )


def dim_activity(spark: SparkSession) -> DataFrame:
    # VALUES, unlike createDataFrame, tells the optimizer how small the table is.
    values = ", ".join(f"({key}, '{name}')" for key, name in ACTIVITIES)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(activity_key, activity)")


def _area_text(key: Column) -> Column:
    return F.concat(F.lit("AREA_"), key.cast("string"))


def _area_class(key: Column) -> Column:
    return F.concat(F.lit("CLASS_"), (key % 3).cast("string"))


def dim_spend_area(spark: SparkSession) -> DataFrame:
    key = F.col("id").cast("int")
    return spark.range(1, KNOWN_SPEND_AREAS + 1, numPartitions=1).select(
        key.alias("spend_area_key"),
        _area_text(key).alias("sub_spend_area_text"),
        _area_class(key).alias("spend_classification_text"),
    )


def fact_events(lines: DataFrame) -> DataFrame:
    return _events(purchase_items(lines)).select("case_id", "activity_key", "timestamp")


def fact_cases(lines: DataFrame) -> DataFrame:
    """Company, vendor and spend area of each case, the smallest where its lines differ."""
    items = lines.withColumn("case_no", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return items.groupBy(_case_id()).agg(
        F.min(_company()).cast("int").alias("company_key"),
        F.min(_vendor()).cast("int").alias("vendor_key"),
        F.min(_spend_area()).cast("int").alias("spend_area_key"),
    )


def order_line_star(spark: SparkSession, folder: str) -> Star:
    """The star tables as plans over ``lineitem``; core milestones follow from the events."""
    lines = read_lines(spark, folder)
    return Star(
        fact_events=fact_events(lines),
        fact_cases=fact_cases(lines),
        dim_activity=dim_activity(spark),
        dim_spend_area=dim_spend_area(spark),
    )


def order_line_log(spark: SparkSession, folder: str) -> DataFrame:
    """The same events as a flat log with text attributes, the input of the star builder."""
    return flat_log(read_lines(spark, folder))


def flat_log(lines: DataFrame) -> DataFrame:
    """The flat log of some order lines."""
    items = purchase_items(lines)
    area = _spend_area()
    events = _events(
        items,
        F.concat(F.lit("VENDOR_"), _vendor().cast("string")).alias("vendor"),
        F.concat(F.lit("COMPANY_"), _company().cast("string")).alias("company"),
        F.concat(F.lit("GROUP_"), (area % 2).cast("string")).alias("spend_area"),
        _area_text(area).alias("sub_spend_area"),
        _area_class(area).alias("spend_classification"),
    )
    names = F.element_at(
        F.create_map(*[F.lit(v) for pair in ACTIVITIES for v in pair]), F.col("activity_key")
    )
    return events.select(
        "case_id",
        names.alias("activity"),
        "timestamp",
        "vendor",
        "company",
        "spend_area",
        "sub_spend_area",
        "spend_classification",
    )

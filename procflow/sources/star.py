"""The star schema: loading it, saving it, and building it from a flat event log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procflow.constants import P2P_STEPS, Step
from procflow.functions.ordered import By, row_numbers
from procflow.operators.milestones import core_milestones
from procflow.sources.schema import REQUIRED_TABLES, star_schema
from procflow.sources.staging import COMPRESSION, small_tasks, stage


@dataclass(frozen=True)
class Star:
    """Facts and dimensions of one event log; dimensions that only name keys may be absent.

    ``fact_case_milestones_core`` may be absent too: the milestones are then taken from the
    events alone.
    """

    fact_events: DataFrame
    fact_cases: DataFrame
    dim_activity: DataFrame
    dim_spend_area: DataFrame | None = None
    fact_case_milestones_core: DataFrame | None = None
    dim_vendor: DataFrame | None = None
    dim_company: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        named = {f.name: getattr(self, f.name) for f in fields(self)}
        return {name: df for name, df in named.items() if df is not None}

    def dimensions(self) -> dict[str, DataFrame]:
        """The dimensions by key column, to build a later star with the same keys."""
        return {f"{n.removeprefix('dim_')}_key": df for n, df in self.tables().items() if n.startswith("dim_")}


# The list of the tables that a saved star has.
_CONTENTS = "star_tables"


def load_star(spark: SparkSession, folder: str, tables: Sequence[str] | None = None) -> Star:
    """Read ``folder/<table>`` as Parquet, every table that :func:`save_star` wrote.

    For a folder written otherwise, ``tables`` names what it has besides the required tables.
    Columns have the declared types; keys of other segments than the standard ones are read too.
    """
    base = folder.rstrip("/")
    if tables is None:
        tables = [r["name"] for r in spark.read.parquet(f"{base}/{_CONTENTS}").collect()]
    names = dict.fromkeys((*REQUIRED_TABLES, *tables))
    return Star(**{name: _read_table(spark, base, name) for name in names})


def _read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    if name == "fact_cases":
        return spark.read.parquet(f"{base}/{name}")
    return spark.read.schema(star_schema(name)).parquet(f"{base}/{name}")


def save_star(star: Star, folder: str) -> None:
    """Write every table of the star to ``folder/<table>`` as Parquet, and the list of them."""
    base, tables = folder.rstrip("/"), star.tables()
    for name, df in tables.items():
        declared = {f.name: f.dataType for f in star_schema(name)}
        extra = [c for c in df.columns if c not in declared] if name == "fact_cases" else []
        held = [c for c in declared if c in df.columns or name != "fact_cases"]
        typed = df.select(*[F.col(c).cast(declared[c]) for c in held], *extra)
        with small_tasks(df.sparkSession):
            typed.write.mode("overwrite").option("compression", COMPRESSION).parquet(f"{base}/{name}")
    values = ", ".join(f"('{name}')" for name in tables)
    spark = star.fact_events.sparkSession
    listed = spark.sql(f"SELECT * FROM VALUES {values} AS t(name)")
    listed.coalesce(1).write.mode("overwrite").parquet(f"{base}/{_CONTENTS}")


# Hex digits of the MD5 that form the coarse part of the numbering: 16^3 = 4,096 groups at most.
_PREFIX = 3


def surrogate_keys(members: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Number the distinct members 1, 2, 3, ... in the order of the MD5 of their text.

    The numbers depend only on the set of members, not on partitioning or on a re-run. MD5
    spreads any set of names evenly, so the numbering runs in parallel however alike they are.
    """
    text = F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"})
    hashed = members.withColumn("_md5", F.md5(text)).withColumn(
        "_prefix", F.substring("_md5", 1, _PREFIX)
    )
    fine = [By("_md5"), *[By(c) for c in columns]]
    return row_numbers(hashed, [By("_prefix")], fine, key).select(key, *columns)


def _some(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])


def _collated(column: Column, collation: str | None) -> Column:
    return F.collate(column, collation) if collation else column


def _member_match(left: DataFrame, right: DataFrame, pairs: Mapping[str, str], collation: str | None) -> Column:
    """Whether columns of ``left`` name the member in columns of ``right``; NULL equals NULL."""
    return reduce(
        lambda a, b: a & b,
        [_collated(left[c], collation).eqNullSafe(_collated(right[d], collation)) for c, d in pairs.items()],
    )


def build_dimension(
    log: DataFrame,
    columns: Mapping[str, str],
    key: str,
    known: DataFrame | None = None,
    collation: str | None = None,
) -> DataFrame:
    """Distinct members of some log columns with a surrogate key.

    ``columns`` maps log column to dimension column. Members with every column NULL are left out.
    The members and the finished dimension are computed here and written to the shared folder: the
    numbering reads the members twice, and the joins that attach the keys need the real size.

    ``known`` is the dimension so far: its members keep their keys, and new ones are numbered after
    its highest key, so facts that were loaded before still point to the right members. With a
    collation, spellings that it makes equal are one member, named by the known spelling or else by
    the smallest one.
    """
    names = list(columns.values())
    named = log.select(*[F.col(c).alias(d) for c, d in columns.items()]).filter(_some(names))
    members = named.distinct()
    if collation:
        alike = [F.collate(F.col(c), collation).alias(f"_c_{c}") for c in names]
        first = F.min(F.struct(*names)).alias("_member")
        members = members.groupBy(*alike).agg(first).select("_member.*")
    if known is None:
        return stage(surrogate_keys(stage(members, f"members-{key}"), names, key), f"dim-{key}")
    same = _member_match(members, known, {c: c for c in names}, collation)
    fresh = stage(members.join(known, same, "left_anti"), f"members-{key}")
    highest = known.agg(F.coalesce(F.max(key), F.lit(0)).alias("n")).scalar()
    numbered = surrogate_keys(fresh, names, key).withColumn(key, (F.col(key) + highest).cast("int"))
    return stage(known.select(key, *names).unionByName(numbered), f"dim-{key}")


def _place(key: str) -> str:
    return f"_place_{key}"


def attribute_places(held: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """The distinct texts of some columns with ``_place_<key>``: numbers that ascend in their order.

    NULL comes before all texts, as in the order of structs; a row of NULLs only comes last.
    Spark samples the order and deals the rows to ranges, in which they are numbered.
    """
    texts = stage(held.select(*columns).distinct(), f"spellings-{key}")
    order = [(~_some(columns)).asc(), *[F.col(c).asc_nulls_first() for c in columns]]
    ranged = texts.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(ranged.withColumn(_place(key), F.monotonically_increasing_id()), f"places-{key}")


def case_places(held: DataFrame, case_col: str, places: Mapping[str, DataFrame]) -> DataFrame:
    """One row per case with the ``_place_<key>`` of its attributes.

    Columns of one group describe the same thing and are chosen together: when a case has
    several, the smallest one wins. ``held`` has the distinct combinations of a log, about one row
    per case. Numbers are compared instead of texts: they aggregate by hash, texts only sorted.
    """
    for key, texts in places.items():
        held = _lookup(held, texts, {c: c for c in texts.columns if c != _place(key)}, _place(key))
    return held.groupBy(case_col).agg(*[F.min(_place(key)).alias(_place(key)) for key in places])


def case_attributes(held: DataFrame, case_col: str, groups: Sequence[Sequence[str]]) -> DataFrame:
    """One row per case with its attributes, each group of columns chosen as in :func:`case_places`."""
    places = {f"g{i}": attribute_places(held, list(g), f"g{i}") for i, g in enumerate(groups)}
    cases = case_places(held, case_col, places)
    for key, texts in places.items():
        cases = cases.join(texts, _place(key), "left")
    return cases.select(case_col, *[c for g in groups for c in g])


def _lookup(
    facts: DataFrame, dim: DataFrame, columns: Mapping[str, str], key: str, collation: str | None = None
) -> DataFrame:
    # Unhinted: the dimension is a written table, so Spark knows its size. It is broadcast when
    # that is small, else joined by shuffle with adaptive splitting of a member that holds a
    # large part of the facts.
    on = _member_match(facts, dim, columns, collation)
    return facts.join(dim, on, "left").select(facts["*"], dim[key])


def _spelled_keys(
    spellings: DataFrame,
    columns: Mapping[str, str],
    key: str,
    known: DataFrame | None,
    collation: str | None,
) -> tuple[DataFrame, DataFrame]:
    """The dimension of some log columns, and ``spellings``, their distinct texts, with its key.

    Collated texts can be neither hashed nor joined by hash: they are sorted, and all rows that name one
    member meet in one task. So only the distinct spellings are compared by collation, and the
    facts find their key by the spelling itself.
    """
    dim = build_dimension(spellings, columns, key, known, collation)
    named = _lookup(spellings, dim, columns, key, collation)
    return dim, stage(named, f"spelled-{key}") if collation else named


# Dimension key -> log columns of the attribute and their dimension columns.
ATTRIBUTES: dict[str, Mapping[str, str]] = {
    "company_key": {"company": "company"},
    "vendor_key": {"vendor": "vendor"},
    "spend_area_key": {
        "sub_spend_area": "sub_spend_area_text",
        "spend_classification": "spend_classification_text",
    },
}


def build_star(
    log: DataFrame,
    case_col: str = "case_id",
    activity_col: str = "activity",
    ts_col: str = "timestamp",
    attributes: Mapping[str, Mapping[str, str]] = ATTRIBUTES,
    steps: Sequence[Step] = P2P_STEPS,
    known: Mapping[str, DataFrame] | None = None,
    collation: str | None = None,
) -> Star:
    """Turn a flat event log into facts and dimensions.

    ``attributes`` maps the key column of each case attribute to its log columns and their
    dimension columns; any number of them is allowed, and each key can be ranked as a segment.
    The standard three have a place for their dimension in the star.

    The log is read three times: for the activities, for the events with their keys, and for the
    distinct attributes of the cases. These three are written to the shared folder; the other
    tables follow from them. Events are kept as they are, one row each. Texts are numbered in their
    order once each, so that the smallest attribute of a case is found by numbers.

    ``known`` are dimensions of an earlier star by key column (``Star.dimensions``): their members keep
    their keys. ``collation`` (e.g. ``UTF8_LCASE_RTRIM``) makes spellings one member, of activities and
    of all attributes.
    """
    known = known or {}
    activities = log.select(F.col(activity_col).alias("activity"))
    if collation:
        activities = stage(activities.distinct(), "spellings-activity_key")
        dim_activity, named = _spelled_keys(
            activities, {"activity": "activity"}, "activity_key", known.get("activity_key"), collation
        )
    else:
        dim_activity = named = build_dimension(
            activities, {"activity": "activity"}, "activity_key", known.get("activity_key")
        )

    flat = dict.fromkeys(c for m in attributes.values() for c in m)
    held = stage(log.select(case_col, *flat).distinct(), "case-attributes")
    places = {key: attribute_places(held, list(columns), key) for key, columns in attributes.items()}
    found = {
        key: _spelled_keys(places[key], columns, key, known.get(key), collation)
        for key, columns in attributes.items()
    }
    dims = {key: dim for key, (dim, _) in found.items()}

    cases = case_places(held.filter(F.col(case_col).isNotNull()), case_col, places)
    for key, (_, keys) in found.items():
        cases = cases.join(keys.select(_place(key), key), _place(key), "left")

    events = _lookup(
        log.select(
            F.col(case_col).alias("case_id"),
            F.col(activity_col).alias("_activity"),
            F.col(ts_col).cast("timestamp_ntz").alias("timestamp"),
        ),
        named,
        {"_activity": "activity"},
        "activity_key",
    )
    events = stage(events.select("case_id", "activity_key", "timestamp"), "fact-events")

    return Star(
        fact_events=events,
        fact_cases=cases.select(F.col(case_col).alias("case_id"), *dims),
        dim_activity=dim_activity,
        dim_spend_area=dims.get("spend_area_key"),
        fact_case_milestones_core=core_milestones(events, dim_activity, steps, collation),
        dim_vendor=dims.get("vendor_key"),
        dim_company=dims.get("company_key"),
    )

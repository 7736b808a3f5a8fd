"""DuckDB SQL giving the same results as the registered queries, for the correctness check.

The SQL works on the raw ``lineitem`` table, row by row and without the histogram, staging and
ranking techniques of the Spark side. Ratios are in integer arithmetic, because DuckDB divides in
DOUBLE; percentiles take DOUBLE input, because on DECIMAL input DuckDB truncates them.
"""

from __future__ import annotations

import re

_STEPS = (("PO", 1, "min"), ("GR", 2, "max"), ("IR", 3, "max"), ("CI", 4, "max"))
_STAGES = (("PO", "GR"), ("GR", "IR"), ("IR", "CI"))


def _pct(part: str, whole: str) -> str:
    """``part`` in percent of ``whole`` (both whole numbers), two decimals, half up."""
    d = f"nullif(CAST({whole} AS BIGINT), 0)"
    return f"CAST((({part}) * 20000 + {d}) // (2 * {d}) * 0.01 AS DECIMAL(10,2))"


def _median(x: str, p: float = 0.5) -> str:
    return f"quantile_cont(CAST({x} AS DOUBLE), {p})"


def _two_decimals(x: str) -> str:
    return f"CAST(CAST(round({x}, 9) AS VARCHAR) AS DECIMAL(10,2))"


def _whole(x: str) -> str:
    return f"CAST(trunc(round({x}, 9)) AS INTEGER)"


def _days(a: str, b: str) -> str:
    return f"CAST(date_diff('day', {a}, {b}) AS INTEGER)"


_MOMENT = "TIMESTAMP '2018-01-01 00:00:00' + {} * INTERVAL '1' MINUTE"
_EVENTS = (
    (1, "po_min", "case_no % 101 <> 0"),
    (2, "gr_min", "h1 >= 6"),
    (3, "ir_min", "h2 >= 10"),
    (4, "ci_min", "h3 >= 25 AND h2 >= 10"),
    (5, "po_min + 60", "h1 % 4 = 0"),
)
# Upper edges in days and the labels up to them; the last is for all above.
_BUCKETS = ((75, "75"), (90, "90"), (120, "120"), (150, "150"), (None, ">150"))
_RISKS = (
    (75, "Acceptable"),
    (90, "Watchlist"),
    (120, "At Risk"),
    (150, "Aged"),
    (None, "Critical"),
)
_TRENDS = ((75, "Acceptable"), (90, "Watchlist"), (None, "Overdue"))


def _banded(bands: tuple[tuple[int | None, str], ...]) -> str:
    cases = " ".join(f"WHEN Duration_Days <= {edge} THEN '{label}'" for edge, label in bands[:-1])
    return f"CASE {cases} ELSE '{bands[-1][1]}' END"


_VALID = "PO_GR_Days >= 0 AND GR_IR_Days >= 0 AND IR_CI_Days >= 0"

# Named parts in order of dependency; a query gets those it mentions, directly or indirectly.
_PARTS: dict[str, str] = {
    "item_hash": """
        SELECT l_orderkey * 10 + l_linenumber AS case_no, l_orderkey, l_linenumber, l_partkey,
               l_suppkey,
               (l_orderkey * 7 + l_linenumber * 31) % 395 * 1440
                 + (l_orderkey * 37 + l_linenumber * 101) % 1440 + l_partkey % 3 * 720 AS po_min,
               (l_partkey * 7 + l_orderkey * 3 + l_linenumber) % 100 AS h1,
               (l_partkey * 11 + l_orderkey * 5 + l_suppkey) % 100 AS h2,
               (l_partkey * 13 + l_orderkey * 17 + l_suppkey * 3) % 100 AS h3
        FROM lineitem""",
    "item_gr": """
        SELECT *, po_min + (l_partkey % 30 - 1) * 1440 + h1 * 7 AS gr_min FROM item_hash""",
    "item_ir": """
        SELECT *, gr_min + ((l_orderkey + l_partkey) % 25 - 1) * 1440 + h2 * 11 AS ir_min
        FROM item_gr""",
    "items": """
        SELECT *, ir_min + (CASE WHEN l_suppkey % 3 = 0 THEN h3 * 3 % 110 ELSE h3 % 60 END - 1)
                  * 1440 + h1 * 5 AS ci_min
        FROM item_ir""",
    "events_log": " UNION ALL ".join(
        f"SELECT case_no, concat('C', case_no) AS case_id, {key} AS activity_key, "
        f"{_MOMENT.format('(' + minute + ')')} AS ts, l_orderkey, l_partkey, l_suppkey "
        f"FROM items WHERE {cond}"
        for key, minute, cond in _EVENTS
    ),
    "case_keys": """
        SELECT concat('C', l_orderkey * 10 + l_linenumber) AS case_id,
               CAST(min(CASE WHEN l_orderkey % 10 < 8 THEN 1 WHEN l_orderkey % 10 = 8 THEN 2
                             ELSE 3 END) AS INTEGER) AS company_key,
               CAST(min(CASE WHEN (l_orderkey * 10 + l_linenumber) % 97 <> 0
                             THEN l_suppkey END) AS INTEGER) AS vendor_key,
               CAST(min(l_partkey % 12) + 1 AS INTEGER) AS spend_area_key
        FROM lineitem GROUP BY 1""",
    "areas": """
        SELECT CAST(k AS INTEGER) AS spend_area_key, concat('AREA_', k) AS sub_text,
               concat('CLASS_', k % 3) AS class_text
        FROM range(1, 12) AS r(k)""",
    "core": """
        SELECT case_id, CAST(activity_key AS INTEGER) AS activity_key,
               CASE WHEN activity_key = 1 THEN min(ts) ELSE max(ts) END AS milestone_ts
        FROM events_log WHERE activity_key <= 4 GROUP BY case_id, activity_key""",
    "reached": "SELECT case_id AS Case_ID, "
    + ", ".join(
        f"{pick}(ts) FILTER (WHERE activity_key = {key}) AS {name}_ts"
        for name, key, pick in _STEPS
    )
    + " FROM events_log WHERE activity_key <= 4 GROUP BY case_id",
    "bounds": """
        SELECT max(milestone_ts) AS as_of,
               CAST(date_trunc('month', max(milestone_ts) - INTERVAL '7' MONTH) AS DATE) AS start
        FROM core WHERE activity_key = 1""",
    "over": f"""
        SELECT s.case_id AS Case_ID, s.t AS Start_Time, e.milestone_ts AS End_Time,
               {_days('s.t', 'coalesce(e.milestone_ts, b.as_of)')} AS Duration_Days,
               CASE WHEN e.milestone_ts IS NULL THEN 'Age days' ELSE 'Lead Time' END
                 AS Duration_Type
        FROM (SELECT case_id, min(ts) AS t FROM events_log WHERE activity_key = 1
              GROUP BY case_id) s
        CROSS JOIN bounds b
        LEFT JOIN (SELECT * FROM core WHERE activity_key = 4) e ON e.case_id = s.case_id""",
    "class": f"""
        SELECT o.Case_ID, o.Start_Time, o.Duration_Days, o.Duration_Type,
               {_banded(_BUCKETS)} AS Distribution_Buckets,
               {_banded(_RISKS)} AS Risk_Status
        FROM over o JOIN bounds b ON o.Start_Time >= b.start""",
    "sbase": f"""
        SELECT r.*, {_days('PO_ts', 'GR_ts')} AS PO_GR_Days, {_days('GR_ts', 'IR_ts')} AS GR_IR_Days,
               {_days('IR_ts', 'CI_ts')} AS IR_CI_Days, {_days('PO_ts', 'CI_ts')} AS Lead_Time
        FROM reached r JOIN bounds b ON r.PO_ts >= b.start""",
    "sstatus": """
        SELECT *,
               CASE WHEN GR_ts IS NULL THEN 'Missing_GR' WHEN PO_GR_Days < 0 THEN 'Invalid_PO_GR'
                    ELSE 'Lack abnormality' END AS PO_GR_Status,
               CASE WHEN GR_ts IS NULL THEN 'Missing_GR' WHEN IR_ts IS NULL THEN 'Missing_IR'
                    WHEN GR_IR_Days < 0 THEN 'Invalid_GR_IR' ELSE 'Lack abnormality'
                    END AS GR_IR_Status,
               CASE WHEN IR_ts IS NULL THEN 'Missing_IR' WHEN CI_ts IS NULL THEN 'Missing_CI'
                    WHEN IR_CI_Days < 0 THEN 'Invalid_IR_CI' ELSE 'Lack abnormality'
                    END AS IR_CI_Status
        FROM sbase""",
    "sflags": """
        SELECT *, CASE WHEN PO_GR_Status <> 'Lack abnormality' THEN PO_GR_Status
                       WHEN GR_IR_Status <> 'Lack abnormality' THEN GR_IR_Status
                       ELSE IR_CI_Status END AS Primary_Issue
        FROM sstatus""",
    "shares": "SELECT Case_ID, Lead_Time, "
    + ", ".join(
        f"CAST(({a}_{b}_Days * 2000000 + nullif(Lead_Time, 0)) // (2 * nullif(Lead_Time, 0)) "
        f"* 0.0001 AS DECIMAL(18,4)) AS {a}_{b}_Share"
        for a, b in _STAGES
    )
    + f" FROM sbase WHERE Lead_Time IS NOT NULL AND {_VALID}",
    "dbase": """
        SELECT s.Case_ID, s.PO_ts, s.CI_ts, s.Lead_Time,
               CAST(CASE WHEN s.Lead_Time <= 75 THEN 0 ELSE 1 END AS INTEGER) AS Delay_Flag,
               k.company_key AS Company_key, k.vendor_key AS Vendor_key,
               k.spend_area_key AS Spend_Area_key
        FROM sbase s LEFT JOIN case_keys k ON k.case_id = s.Case_ID
        WHERE s.CI_ts IS NOT NULL""",
}

for _prefix, _key in (
    ("Vendor", "Vendor_key"),
    ("Spend_Area", "Spend_Area_key"),
    ("Company", "Company_key"),
):
    _low = _prefix.lower()
    _delay = f"CASE WHEN {_key} IS NULL THEN 0 ELSE sum(Delay_Flag) END"
    _PARTS[f"{_low}_rates"] = f"""
        SELECT {_key}, count(*) AS Total_cases, CAST({_delay} AS BIGINT) AS Delay_cases
        FROM dbase GROUP BY {_key} HAVING count(*) >= 100"""
    _PARTS[f"{_low}_pct"] = f"""
        SELECT *, {_pct('Delay_cases', 'Total_cases')} AS Delayed_Rate,
               {_pct('Delay_cases', '(SELECT sum(Delay_Flag) FROM dbase)')} AS Impact_Share
        FROM {_low}_rates"""
    _PARTS[f"{_low}_ranks"] = f"""
        SELECT *, CAST(dense_rank() OVER (ORDER BY Impact_Share DESC, Delayed_Rate DESC,
                                          Delay_cases DESC) AS INTEGER) AS {_prefix}_Rank
        FROM {_low}_pct"""

for _low, _key, _rank, _top, _extra in (
    ("vendor", "Vendor_key", "Vendor_Rank", 15, ""),
    (
        "spend_area",
        "Spend_Area_key",
        "Spend_Area_Rank",
        10,
        ", a.sub_text AS Spend_area_sub, a.class_text AS Spend_class",
    ),
):
    _areas = (
        "LEFT JOIN areas a ON a.spend_area_key = t.Spend_Area_key" if _extra else ""
    )
    _PARTS[f"{_low}_top"] = f"""
        SELECT {_key}, {_rank} FROM {_low}_ranks
        ORDER BY {_rank}, {_key} NULLS LAST LIMIT {_top}"""
    _PARTS[f"{_low}_cases"] = f"""
        SELECT s.Case_ID, t.{_key}, t.{_rank}{_extra},
               s.PO_GR_Days, s.GR_IR_Days, s.IR_CI_Days, s.Lead_Time
        FROM {_low}_top t JOIN case_keys k ON k.{_low}_key = t.{_key}
        JOIN sbase s ON s.Case_ID = k.case_id {_areas}
        WHERE s.GR_ts IS NOT NULL AND s.IR_ts IS NOT NULL AND s.CI_ts IS NOT NULL"""

# The flat log of the star builder and its dimensions.
_ACTIVITIES = (
    "CASE activity_key WHEN 1 THEN 'Create Purchase Order Item' WHEN 2 THEN "
    "'Record Goods Receipt' WHEN 3 THEN 'Record Invoice Receipt' WHEN 4 THEN 'Clear Invoice' "
    "ELSE 'Change Price' END"
)
_PARTS["flat_log"] = f"""
        SELECT case_id, {_ACTIVITIES} AS activity, ts,
               CASE WHEN case_no % 97 <> 0 THEN concat('VENDOR_', l_suppkey) END AS vendor,
               concat('COMPANY_', CASE WHEN l_orderkey % 10 < 8 THEN 1 WHEN l_orderkey % 10 = 8
                      THEN 2 ELSE 3 END) AS company,
               concat('AREA_', l_partkey % 12 + 1) AS sub_text,
               concat('CLASS_', (l_partkey % 12 + 1) % 3) AS class_text
        FROM events_log"""


def _member_key(columns: tuple[tuple[str, str], ...]) -> str:
    """Number of a dimension member: its place in the order of the MD5 of its JSON text."""
    fields = " || ',' || ".join(f"'\"{name}\":\"' || {column} || '\"'" for name, column in columns)
    return f"CAST(row_number() OVER (ORDER BY md5('{{' || {fields} || '}}')) AS INTEGER)"


_SPEND_MEMBER = (
    ("sub_spend_area_text", "sub_text"),
    ("spend_classification_text", "class_text"),
)
_PARTS["d_activity"] = f"""
        SELECT {_member_key((('activity', 'activity'),))} AS activity_key, activity
        FROM (SELECT DISTINCT activity FROM flat_log)"""
_PARTS["d_vendor"] = f"""
        SELECT {_member_key((('vendor', 'vendor'),))} AS vendor_key, vendor
        FROM (SELECT DISTINCT vendor FROM flat_log WHERE vendor IS NOT NULL)"""
_PARTS["d_vendor_first"] = f"""
        SELECT {_member_key((('vendor', 'vendor'),))} AS vendor_key, vendor
        FROM (SELECT DISTINCT concat('VENDOR_', l_suppkey) AS vendor FROM events_log
              WHERE case_no % 97 <> 0 AND l_orderkey < 40)"""
_PARTS["d_vendor_grown"] = f"""
        SELECT vendor_key, vendor FROM d_vendor_first
        UNION ALL
        SELECT CAST((SELECT coalesce(max(vendor_key), 0) FROM d_vendor_first)
                    + {_member_key((('vendor', 'vendor'),))} AS INTEGER), vendor
        FROM (SELECT DISTINCT vendor FROM flat_log
              WHERE vendor IS NOT NULL AND vendor NOT IN (SELECT vendor FROM d_vendor_first))"""
_PARTS["d_company"] = f"""
        SELECT {_member_key((('company', 'company'),))} AS company_key, company
        FROM (SELECT DISTINCT company FROM flat_log)"""
_PARTS["d_area"] = f"""
        SELECT {_member_key(_SPEND_MEMBER)} AS spend_area_key, sub_text, class_text
        FROM (SELECT DISTINCT sub_text, class_text FROM flat_log)"""
_PARTS["log_cases"] = """
        SELECT case_id, min(vendor) AS vendor, min(company) AS company,
               min((sub_text, class_text)) AS area
        FROM flat_log GROUP BY case_id"""


# As seen at the as-of date: steps after it have not happened.
_SEEN = ", ".join(f"CASE WHEN {n}_ts <= as_of THEN {n}_ts END AS {n}_ts" for n, _, _ in _STEPS)
_SNAPSHOT: dict[str, str] = {}
for _name, _text in _PARTS.items():
    if _name == "over":
        _text = _text.replace(
            "activity_key = 4)", "activity_key = 4 AND milestone_ts <= (SELECT as_of FROM bounds))"
        )
    if _name == "sbase":
        _SNAPSHOT["seen"] = f"SELECT Case_ID, {_SEEN} FROM reached, bounds"
        _text = _text.replace("FROM reached r", "FROM seen r")
    _SNAPSHOT[_name] = _text

# User journeys: three steps over the events table, users ranked by the last digit of their id.
_JOURNEY_VALID = "VIEW_CLICK_Days >= 0 AND CLICK_BUY_Days >= 0"
_JOURNEY_STAGES = ("VIEW_CLICK_Days", "CLICK_BUY_Days")
_PARTS["journey"] = """
        SELECT user_id, min(ts) FILTER (WHERE event_type = 'view') AS VIEW_ts,
               max(ts) FILTER (WHERE event_type = 'click') AS CLICK_ts,
               max(ts) FILTER (WHERE event_type = 'purchase') AS BUY_ts
        FROM events WHERE user_id IS NOT NULL GROUP BY user_id"""
_PARTS["jbase"] = f"""
        SELECT CAST(user_id % 10 AS INTEGER) AS Cohort_key, VIEW_ts, CLICK_ts, BUY_ts,
               {_days('VIEW_ts', 'CLICK_ts')} AS VIEW_CLICK_Days,
               {_days('CLICK_ts', 'BUY_ts')} AS CLICK_BUY_Days,
               {_days('VIEW_ts', 'BUY_ts')} AS Lead_Time
        FROM journey WHERE VIEW_ts >= (SELECT CAST(date_trunc('month', max(VIEW_ts)
                                              - INTERVAL '7' MONTH) AS DATE) FROM journey)"""
_PARTS["cohort_counts"] = """
        SELECT Cohort_key, count(*) AS Total_cases,
               CAST(count(*) FILTER (WHERE Lead_Time > 20) AS BIGINT) AS Delay_cases
        FROM jbase WHERE BUY_ts IS NOT NULL GROUP BY Cohort_key"""
_PARTS["cohort_rates"] = f"""
        SELECT *, {_pct('Delay_cases', 'Total_cases')} AS Delayed_Rate,
               {_pct('Delay_cases', '(SELECT sum(Delay_cases) FROM cohort_counts)')} AS Impact_Share
        FROM cohort_counts WHERE Total_cases >= 5"""
_PARTS["cohort_ranks"] = """
        SELECT *, CAST(dense_rank() OVER (ORDER BY Impact_Share DESC, Delayed_Rate DESC,
                                          Delay_cases DESC) AS INTEGER) AS Cohort_Rank
        FROM cohort_rates"""
_PARTS["cohort_top"] = """
        SELECT Cohort_key, Cohort_Rank FROM cohort_ranks ORDER BY Cohort_Rank, Cohort_key LIMIT 5"""


def _sql(body: str, known: dict[str, str] = _PARTS) -> str:
    """Put the parts ``body`` needs in front of it."""
    needed: list[str] = []
    text = body
    for name in reversed(known):
        if re.search(rf"\b{name}\b", text):
            needed.insert(0, name)
            text += known[name]
    parts = ",\n".join(f"{n} AS ({known[n]})" for n in needed)
    return f"WITH {parts}\n{body}" if needed else body


def _trend(kind: str, period: str, extra: str = "") -> str:
    status = _banded(_TRENDS)
    return _sql(
        f"""SELECT Time_Period, '{kind}' AS Cases_Status, Risk_Status, Amount,
                   {_pct('Amount', 'sum(Amount) OVER (PARTITION BY Time_Period)')} AS Ratio
            FROM (SELECT {period} AS Time_Period, {status} AS Risk_Status, count(*) AS Amount
                  FROM over CROSS JOIN bounds
                  WHERE Duration_Type = '{kind}' {extra} GROUP BY 1, 2)
            ORDER BY Time_Period DESC, Risk_Status"""
    )


_MONTH = "strftime(Start_Time, '%Y-%m')"
_WEEK = "concat(year(Start_Time), '-', lpad(CAST(week(Start_Time) AS VARCHAR), 2, '0'))"
_RECENT = "AND Start_Time > as_of - INTERVAL '3' MONTH"
_DOUBLE_PAIR = (
    f"round({_median('{0}')}, 6) AS Median, round({_median('{0}', 0.9)}, 6) AS P90"
)


def _per_stage(select: str, source: str, where: str, known: dict[str, str] = _PARTS) -> str:
    """One SELECT per stage; ``{days}``/``{share}`` stand for the stage's column."""
    return _sql(
        " UNION ALL ".join(
            select.format(stage=f"{a}_{b}_Days", share=f"{a}_{b}_Share")
            + f" FROM {source} WHERE {where.format(stage=f'{a}_{b}_Days')} HAVING count(*) > 0"
            for a, b in _STAGES
        ),
        known,
    )


def _profile(label: str, where: str, known: dict[str, str] = _PARTS) -> str:
    pair = _DOUBLE_PAIR.format("{stage}")
    return _per_stage(f"SELECT '{{stage}}' AS {label}, {pair}", "sbase", where, known)


def _journey_profile(label: str, where: str) -> str:
    return _sql(
        " UNION ALL ".join(
            f"SELECT '{s}' AS {label}, {_DOUBLE_PAIR.format(s)} FROM jbase "
            f"WHERE {s} >= 0 AND {where} HAVING count(*) > 0"
            for s in _JOURNEY_STAGES
        )
    )


def _contribution(label: str, where: str) -> str:
    median = _two_decimals(_median("{share}"))
    return _per_stage(f"SELECT '{{stage}}' AS {label}, {median} AS Median", "shares", where)


def _segment_duration(source: str, ids: str, key: str) -> str:
    flag = "CAST(CASE WHEN Lead_Time <= 75 THEN 0 ELSE 1 END AS INTEGER)"
    return _sql(
        " UNION ALL ".join(
            f"""SELECT '{a}_{b}_Days' AS Stage, {ids}, {flag} AS Delay_flag,
                       CAST(sum(count(*)) OVER (PARTITION BY {key}) AS BIGINT) AS Cases_Number,
                       {_whole(_median(f'{a}_{b}_Days'))} AS Median,
                       {_whole(_median(f'{a}_{b}_Days', 0.9))} AS P90
                FROM {source} WHERE {a}_{b}_Days >= 0 GROUP BY {ids}, {flag}"""
            for a, b in _STAGES
        )
    )


def _segment_bottleneck(source: str, ids: str) -> str:
    return _sql(
        " UNION ALL ".join(
            f"""SELECT '{a}_{b}_Days' AS Stage, {ids}, count(*) AS Cases_Number,
                       {_two_decimals(_median(f'{a}_{b}_Days * 100.0 / Lead_Time'))}
                         AS Median_Bottleneck
                FROM {source} WHERE {_VALID} AND Lead_Time > 75 GROUP BY {ids}"""
            for a, b in _STAGES
        )
    )


def _ranking(low: str, rank: str, key: str, known: dict[str, str] = _PARTS) -> str:
    return _sql(f"SELECT * FROM {low}_ranks ORDER BY {rank}, {key} NULLS LAST", known)


def _pareto(low: str, rank: str, key: str) -> str:
    running = f"CAST(sum(Delay_cases) OVER (ORDER BY {rank}, {key} NULLS LAST ROWS UNBOUNDED PRECEDING) AS BIGINT)"
    return _sql(
        f"""SELECT *, {_pct('Cumulative_Delay_cases', '(SELECT sum(Delay_Flag) FROM dbase)')}
                   AS Cumulative_Share
            FROM (SELECT *, {running} AS Cumulative_Delay_cases FROM {low}_ranks)
            ORDER BY {rank}, {key} NULLS LAST"""
    )


def _open_total() -> str:
    return "(SELECT count(*) FROM class WHERE Duration_Type = 'Age days')"


_AREA_IDS = "Spend_Area_key, Spend_Area_Rank, Spend_area_sub, Spend_class"

_DISTRIBUTION = f"""
    SELECT Duration_Type, Distribution_Buckets, Risk_Status, count(*) AS Amount,
           {_pct('count(*)', 'sum(count(*)) OVER (PARTITION BY Duration_Type)')} AS Ratio
    FROM class GROUP BY 1, 2, 3"""

_ISSUES = f"""
    SELECT Primary_Issue, count(*) AS Amount,
           {_pct('count(*)', '(SELECT count(*) FROM sbase)')} AS Ratio
    FROM sflags GROUP BY 1"""

ORACLE: dict[str, str] = {
    "sla_distribution": _sql(_DISTRIBUTION),
    "sla_monthly_closed": _trend("Lead Time", _MONTH),
    "sla_monthly_open": _trend("Age days", _MONTH),
    "sla_weekly_closed": _trend("Lead Time", _WEEK, _RECENT),
    "sla_weekly_open": _trend("Age days", _WEEK, _RECENT),
    "backlog_total": _sql(
        """SELECT count(*) AS Total_Number_Of_Open_Cases FROM class
           WHERE Duration_Type = 'Age days'"""
    ),
    "backlog_aged_share": _sql(
        f"""SELECT Duration_Type AS Backlog, count(*) AS Amount,
                   {_pct('count(*)', _open_total())} AS Ratio
            FROM class WHERE Duration_Type = 'Age days' AND Duration_Days > 90 GROUP BY 1"""
    ),
    "backlog_aged_overview": _sql(
        f"""SELECT Duration_Type, Distribution_Buckets, Risk_Status, count(*) AS Amount,
                   CAST(sum(Duration_Days) // count(*) AS INTEGER) AS Avg_Duration_Days,
                   {_pct('count(*)', _open_total())} AS Ratio
            FROM class WHERE Duration_Type = 'Age days' AND Duration_Days > 90
            GROUP BY 1, 2, 3"""
    ),
    "sla_duration_percentiles": _sql(
        f"""SELECT CASE WHEN Duration_Days <= 75 THEN 'Lead Time <= 75 days'
                        ELSE 'Lead Time > 75 days' END AS Stage,
                   {_DOUBLE_PAIR.format('Duration_Days')}
            FROM class GROUP BY 1"""
    ),
    "stage_duration_all": _profile("Stage_All_Cases", "{stage} >= 0"),
    "stage_duration_within": _profile(
        "Stage_LT_Within_75", f"Lead_Time <= 75 AND Lead_Time > 0 AND {_VALID}"
    ),
    "stage_duration_above": _profile("Stage_LT_Without_75", f"Lead_Time > 75 AND {_VALID}"),
    "primary_issue_share": _sql(_ISSUES),
    "local_missingness": _sql(
        " UNION ALL ".join(
            f"""SELECT 'Missing_{end}' AS Missing, count(*) AS Amount,
                       {_pct('count(*)', f'(SELECT count({start}_ts) FROM sbase)')} AS Ratio
                FROM sflags WHERE {start}_{end}_Status = 'Missing_{end}' HAVING count(*) > 0"""
            for start, end in _STAGES
        )
    ),
    "contribution_all": _contribution("Stage", "true"),
    "contribution_within": _contribution("Stage_Within_75", "Lead_Time <= 75"),
    "contribution_above": _contribution("Stage_Without_75", "Lead_Time > 75"),
    "vendor_ranking": _ranking("vendor", "Vendor_Rank", "Vendor_key"),
    "vendor_stage_duration": _segment_duration(
        "vendor_cases", "Vendor_key, Vendor_Rank", "Vendor_key"
    ),
    "vendor_bottleneck": _segment_bottleneck("vendor_cases", "Vendor_key, Vendor_Rank"),
    "spend_area_ranking": _sql(
        """SELECT r.Spend_Area_key, a.sub_text AS Spend_area_sub, r.Total_cases, r.Delay_cases,
                  r.Delayed_Rate, r.Impact_Share, r.Spend_Area_Rank
           FROM spend_area_ranks r LEFT JOIN areas a ON a.spend_area_key = r.Spend_Area_key"""
    ),
    "spend_area_stage_duration": _segment_duration(
        "spend_area_cases", _AREA_IDS, "Spend_Area_key"
    ),
    "spend_area_bottleneck": _segment_bottleneck("spend_area_cases", _AREA_IDS),
    "company_ranking": _ranking("company", "Company_Rank", "Company_key"),
    "vendor_pareto": _pareto("vendor", "Vendor_Rank", "Vendor_key"),
    "spend_area_pareto": _pareto("spend_area", "Spend_Area_Rank", "Spend_Area_key"),
    "company_pareto": _pareto("company", "Company_Rank", "Company_key"),
    "stage_quality_check": _sql(
        f"""SELECT Total_Cases, Negative_Cases,
                   {_pct('Negative_Cases', 'Total_Cases')} AS Negative_Share
            FROM (SELECT count(*) AS Total_Cases,
                         count(*) FILTER (WHERE PO_GR_Days < 0 OR GR_IR_Days < 0
                                             OR IR_CI_Days < 0) AS Negative_Cases
                  FROM sbase)"""
    ),
    "core_milestones": _sql("SELECT * FROM core"),
    "milestones": _sql("SELECT * FROM reached WHERE PO_ts IS NOT NULL"),
    "as_of_date": _sql("SELECT as_of AS As_of_Date FROM bounds"),
    "analysis_window": _sql(
        """SELECT start AS Start_Date, as_of AS As_of_Date,
                  as_of - INTERVAL '3' MONTH AS Trend_Cutoff FROM bounds"""
    ),
    "case_overview": _sql("SELECT * FROM over"),
    "case_classification": _sql("SELECT * FROM class"),
    "stage_base": _sql("SELECT * FROM sbase"),
    "stage_flags": _sql("SELECT * FROM sflags"),
    "stage_contribution": _sql("SELECT * FROM shares"),
    "delay_base": _sql("SELECT * FROM dbase"),
    "vendor_base": _sql("SELECT * FROM vendor_cases"),
    "spend_area_base": _sql("SELECT * FROM spend_area_cases"),
    "star_dim_activity": _sql("SELECT * FROM d_activity"),
    "star_dim_vendor": _sql("SELECT * FROM d_vendor"),
    "star_dim_company": _sql("SELECT * FROM d_company"),
    "star_dim_spend_area": _sql(
        """SELECT spend_area_key, sub_text AS sub_spend_area_text,
                  class_text AS spend_classification_text FROM d_area"""
    ),
    "star_fact_cases": _sql(
        """SELECT c.case_id, y.company_key, v.vendor_key, a.spend_area_key
           FROM log_cases c LEFT JOIN d_company y ON y.company = c.company
           LEFT JOIN d_vendor v ON v.vendor = c.vendor
           LEFT JOIN d_area a ON (a.sub_text, a.class_text) = c.area"""
    ),
    "star_fact_events": _sql(
        """SELECT l.case_id, d.activity_key, l.ts AS "timestamp"
           FROM flat_log l JOIN d_activity d ON d.activity = l.activity"""
    ),
    "star_sla_distribution": _sql(_DISTRIBUTION),
    "star_vendor_ranking": _ranking("vendor", "Vendor_Rank", "Vendor_key"),
    "report_sink": _sql(_DISTRIBUTION),
    "report_published": _sql(_DISTRIBUTION),
    "rejected_events": _sql(
        """SELECT CASE WHEN n % 89 = 0 THEN 'no activity' WHEN n % 83 = 0 THEN 'unreadable time'
                       WHEN n % 79 = 0 THEN 'no time' ELSE 'kept' END AS reason, count(*) AS rows
           FROM (SELECT CAST(substr(case_id, 2) AS BIGINT) AS n FROM flat_log) GROUP BY 1"""
    ),
    "star_keys_after_growth": _sql("SELECT * FROM d_vendor_grown"),
    "star_collated_cases": _sql("SELECT case_id, vendor, company FROM log_cases"),
    "core_milestones_collated": _sql("SELECT * FROM core"),
    "snapshot_sla_distribution": _sql(_DISTRIBUTION, _SNAPSHOT),
    "snapshot_stage_duration_all": _profile("Stage_All_Cases", "{stage} >= 0", _SNAPSHOT),
    "snapshot_primary_issue_share": _sql(_ISSUES, _SNAPSHOT),
    "snapshot_vendor_ranking": _ranking("vendor", "Vendor_Rank", "Vendor_key", _SNAPSHOT),
    "milestones_incremental": _sql("SELECT * FROM reached WHERE PO_ts IS NOT NULL"),
    "incremental_sla_distribution": _sql(_DISTRIBUTION),
    "incremental_vendor_ranking": _ranking("vendor", "Vendor_Rank", "Vendor_key"),
    "journey_stage_duration": _journey_profile("Stage_All_Cases", "true"),
    "journey_stage_duration_above": _journey_profile(
        "Stage_LT_Without_20", f"Lead_Time > 20 AND {_JOURNEY_VALID}"
    ),
    "journey_cohort_ranking": _sql("SELECT * FROM cohort_ranks"),
    "journey_cohort_bottleneck": _sql(
        " UNION ALL ".join(
            f"""SELECT '{s}' AS Stage, t.Cohort_key, t.Cohort_Rank, count(*) AS Cases_Number,
                       {_two_decimals(_median(f'{s} * 100.0 / Lead_Time'))} AS Median_Bottleneck
                FROM cohort_top t JOIN jbase j ON j.Cohort_key = t.Cohort_key
                WHERE {_JOURNEY_VALID} AND Lead_Time > 20 GROUP BY t.Cohort_key, t.Cohort_Rank"""
            for s in _JOURNEY_STAGES
        )
    ),
}

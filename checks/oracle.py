"""The same results in SQL for an independent engine.

The SQL states each result in its plainest form (interval joins, global
windows, all-pairs comparison) and shares no method with the Spark side.
"""

from __future__ import annotations

from datetime import date
from types import SimpleNamespace

from checks import fixed

# Fixed values, stated here once more so that a wrong one in the library shows.
NON_PRODUCT_CODES = ("POST", "D", "M", "BANK CHARGES", "DOT", "C2")
GRADE_NAMES = ("Lv1.이탈관리", "Lv2.관심필요", "Lv3.신규성장", "Lv4.우수충성", "Lv5.최우수VIP")
STEPS = (
    "00_raw_loaded",
    "01_drop_missing_customer_date_stockcode",
    "02_remove_cancel_orders",
    "03_remove_non_positive_quantity_price",
    "04_remove_non_product_codes",
    "05_filter_country_uk",
    "06_filter_analysis_period",
)
HALVES = {
    "Recency": ("LowRecency(최근구매)", "HighRecency(오래전구매)"),
    "Frequency": ("LowFrequency(저빈도)", "HighFrequency(고빈도)"),
    "Monetary": ("LowMonetary(저매출)", "HighMonetary(고매출)"),
}
# The run over the test tables: eleven years before the usual dates.
CFG = SimpleNamespace(
    country="United Kingdom",
    start=date(1999, 1, 1),
    end=date(2001, 1, 1),
    static_start=date(2000, 1, 1),
    static_end=date(2001, 1, 1),
    target_grade=GRADE_NAMES[2],
    panel_first=date(2000, 1, 1),
    panel_last=date(2000, 12, 1),
    rolling_months=6,
    model_first=date(2000, 1, 1),
    model_last=date(2000, 10, 1),
    train_end=date(2000, 7, 1),
    k_values=range(2, 11),
)

_LEVELS = ", ".join(f"'{g}'" for g in GRADE_NAMES)
_CODES = ", ".join(f"'{c}'" for c in NON_PRODUCT_CODES)
_TARGET = f"'{CFG.target_grade}'"


def _ts(d) -> str:
    return f"TIMESTAMP '{d:%Y-%m-%d} 00:00:00'"


def _num(v: float) -> str:
    return f"CAST('{v!r}' AS DOUBLE)"


def total(x: str) -> str:
    return f"coalesce(CAST(sum(CAST({x} AS DECIMAL(18,4))) AS DOUBLE), 0.0)"


def mean(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,4))) AS DOUBLE) / count({x})"


def r6(x: str, name: str) -> str:
    return f"round({x}, 6) AS {name}"


def share(kind: str, name: str) -> str:
    return f"round(avg(CASE WHEN MovementType = '{kind}' THEN 1.0 ELSE 0.0 END), 6) AS {name}"


# Quantile of a column, the same value when both neighbours are equal.
def quantile(x: str, p: float) -> str:
    return (
        f"(CASE WHEN quantile_cont({x}, {p}) = quantile_disc({x}, {p}) THEN quantile_disc({x}, {p}) "
        f"ELSE quantile_cont({x}, {p}) END)"
    )


def _rfm(lines: str, snapshot: str, extra: str = "") -> str:
    return f"""SELECT CustomerID, min(InvoiceDate) AS FirstPurchaseDate, max(InvoiceDate) AS LastPurchaseDate,
      round(datesub('day', max(InvoiceDate), {snapshot}) / 30.0e0, 1) AS Recency,
      count(DISTINCT InvoiceNo) AS Frequency, {total('Revenue')} AS Monetary
      FROM {lines} {extra} GROUP BY CustomerID"""


def _scaled(feature: int) -> str:
    name = ("Recency", "Frequency", "Monetary")[feature]
    return f"(({name} - {_num(fixed.MEAN[feature])}) / {_num(fixed.STD[feature])})"


_MODEL = fixed.model()


def _distance(cluster: int) -> str:
    parts = []
    for i in range(3):
        d = f"({_scaled(i)} - {_num(float(_MODEL.centers[cluster][i]))})"
        parts.append(f"{d} * {d}")
    return " + ".join(parts)


def _graded(table: str) -> str:
    distances = ", ".join(f"{_distance(j)} AS d{j}" for j in range(5))
    best = "least(d0, d1, d2, d3, d4)"
    nearest = " ".join(f"WHEN d{j} = {best} THEN {j}" for j in range(5))
    names = " ".join(f"WHEN {j} THEN '{g}'" for j, g in enumerate(fixed.GRADES))
    return f"""SELECT *, CASE Cluster {names} END AS Customer_Grade FROM (
      SELECT * EXCLUDE (d0, d1, d2, d3, d4), CAST(CASE {nearest} END AS BIGINT) AS Cluster
      FROM (SELECT *, {distances} FROM {table}))"""


def _level(column: str) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{g}' THEN {i}" for i, g in enumerate(GRADE_NAMES, 1)) + " END"


def _abc(ratio: str) -> str:
    return f"CASE WHEN {ratio} <= CAST('0.8' AS DOUBLE) THEN 'A' WHEN {ratio} <= CAST('0.95' AS DOUBLE) THEN 'B' ELSE 'C' END"


def _running(table: str, by: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"""SELECT *, {_abc('CumulativeRatio')} AS ABC_Class FROM (
      SELECT *, CumulativeRevenue / whole AS CumulativeRatio FROM (
        SELECT *, CAST(sum(CAST(Revenue AS DECIMAL(18,4))) OVER ({part}ORDER BY Revenue DESC, StockCode
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS CumulativeRevenue,
          CAST(sum(CAST(Revenue AS DECIMAL(18,4))) OVER ({part}) AS DOUBLE) AS whole FROM {table}))"""


# name -> (tables it reads, SQL)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "raw": (
        (),
        f"""SELECT (CASE WHEN o_orderkey % 50 = 0 THEN 'C' ELSE '' END) || CAST(o_orderkey AS VARCHAR) AS Invoice,
      CASE WHEN l_partkey % 100 = 0 THEN ([{_CODES}])[CAST(1 + (l_partkey // 100) % 6 AS INTEGER)]
        ELSE CAST(l_partkey AS VARCHAR) END AS StockCode,
      CASE WHEN o_orderkey % 50 = 0 THEN -l_quantity ELSE l_quantity END AS Quantity,
      o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS BIGINT)) AS InvoiceDate,
      CASE WHEN l_linenumber = 7 AND l_partkey % 5 = 0 THEN CAST(0 AS DOUBLE) ELSE l_extendedprice / l_quantity END AS Price,
      CASE WHEN o_orderkey % 10 <> 3 THEN CAST(o_custkey AS DOUBLE) END AS RawID,
      CASE WHEN c_nationkey < 20 THEN 'United Kingdom' ELSE n_name END AS Country
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey""",
    ),
    "norm": (
        ("raw",),
        """SELECT Invoice AS InvoiceNo, StockCode, Quantity, InvoiceDate, Price AS UnitPrice,
      CAST(CAST(RawID AS BIGINT) AS VARCHAR) AS CustomerID, Country, Quantity * Price AS Revenue FROM raw""",
    ),
    "s1": (("norm",), "SELECT * FROM norm WHERE CustomerID IS NOT NULL AND InvoiceDate IS NOT NULL AND StockCode IS NOT NULL"),
    "s2": (("s1",), "SELECT * FROM s1 WHERE NOT starts_with(upper(InvoiceNo), 'C')"),
    "s3": (("s2",), "SELECT * FROM s2 WHERE Quantity > 0 AND UnitPrice > 0"),
    "s4": (("s3",), f"SELECT * FROM s3 WHERE StockCode NOT IN ({_CODES})"),
    "s5": (("s4",), f"SELECT * FROM s4 WHERE Country = '{CFG.country}'"),
    "s6": (("s5",), f"SELECT * FROM s5 WHERE InvoiceDate >= {_ts(CFG.start)} AND InvoiceDate < {_ts(CFG.end)}"),
    "clean": (
        ("s6",),
        """SELECT *, year(InvoiceDate) AS Year, month(InvoiceDate) AS Month, strftime(InvoiceDate, '%Y-%m') AS YearMonth,
      CAST(date_trunc('month', InvoiceDate) AS DATE) AS MonthStart FROM s6""",
    ),
    "static": (
        ("clean",),
        f"SELECT * FROM clean WHERE InvoiceDate >= {_ts(CFG.static_start)} AND InvoiceDate < {_ts(CFG.static_end)}",
    ),
    "rfm_all": (("static",), _rfm("static", _ts(CFG.static_end))),
    "cuts": (("rfm_all",), f"SELECT {quantile('Frequency', 0.99)} AS fcut, {quantile('Monetary', 0.99)} AS mcut FROM rfm_all"),
    "rfm": (("rfm_all", "cuts"), "SELECT rfm_all.* FROM rfm_all, cuts WHERE Frequency <= fcut AND Monetary <= mcut"),
    "kept": (("static", "rfm"), "SELECT * FROM static WHERE CustomerID IN (SELECT CustomerID FROM rfm)"),
    "dyn": (("clean", "rfm"), "SELECT * FROM clean WHERE CustomerID IN (SELECT CustomerID FROM rfm)"),
    "months": (
        (),
        f"SELECT CAST(unnest(generate_series(DATE '{CFG.panel_first}', DATE '{CFG.panel_last}', INTERVAL 1 MONTH)) AS DATE) AS m",
    ),
    "panel": (
        ("rfm", "dyn", "months"),
        f"""SELECT c.CustomerID AS CustomerID, m AS AnalysisMonth, min(InvoiceDate) AS FirstPurchaseDate,
      max(InvoiceDate) AS LastPurchaseDate,
      coalesce(round(datesub('day', max(InvoiceDate), CAST(m AS TIMESTAMP)) / 30.0e0, 1), {CFG.rolling_months + 1}.0e0) AS Recency,
      count(DISTINCT InvoiceNo) AS Frequency, {total('Revenue')} AS Monetary,
      strftime(m, '%Y-%m') AS AnalysisMonthStr, CAST(m - INTERVAL {CFG.rolling_months} MONTH AS DATE) AS WindowStart, m AS WindowEnd
      FROM (SELECT CustomerID FROM rfm) c CROSS JOIN months LEFT JOIN dyn
      ON dyn.CustomerID = c.CustomerID AND InvoiceDate >= m - INTERVAL {CFG.rolling_months} MONTH AND InvoiceDate < m
      GROUP BY c.CustomerID, m""",
    ),
    "gpanel": (("panel",), _graded("panel")),
    "grfm": (("rfm",), _graded("rfm")),
    "moves": (
        ("gpanel",),
        f"""SELECT *, CAST(CASE WHEN Customer_Grade <> NextGrade THEN 1 ELSE 0 END AS BIGINT) AS Moved,
      CASE WHEN NextGrade = 'NoActivity' THEN 'NoActivity' WHEN nnum > cnum THEN 'Up' WHEN nnum < cnum THEN 'Down' ELSE 'Stay' END AS MovementType
      FROM (SELECT *, {_level('Customer_Grade')} AS cnum, {_level('NextGrade')} AS nnum FROM (
        SELECT a.*, coalesce(b.Customer_Grade, 'NoActivity') AS NextGrade FROM gpanel a LEFT JOIN gpanel b
        ON a.CustomerID = b.CustomerID AND b.AnalysisMonth = CAST(a.AnalysisMonth + INTERVAL 1 MONTH AS DATE)))""",
    ),
    "lv3": (("moves",), f"SELECT * FROM moves WHERE Customer_Grade = {_TARGET}"),
    "sales": (("kept",), f"SELECT StockCode, {total('Quantity')} AS Quantity, {total('Revenue')} AS Revenue FROM kept GROUP BY StockCode"),
    "abc": (("sales",), _running("sales", "")),
    "cp": (
        ("kept", "grfm", "abc"),
        f"""SELECT p.*, Recency, Frequency, Monetary, Customer_Grade, ABC_Class FROM (
      SELECT CustomerID, StockCode, {total('Quantity')} AS Quantity, {total('Revenue')} AS Revenue FROM kept GROUP BY ALL) p
      LEFT JOIN grfm USING (CustomerID) LEFT JOIN abc USING (StockCode)""".replace(
            "SELECT p.*, Recency", "SELECT p.CustomerID, p.StockCode, p.Quantity, p.Revenue, grfm.Recency"
        ).replace("Frequency, Monetary, Customer_Grade, ABC_Class", "grfm.Frequency, grfm.Monetary, grfm.Customer_Grade, abc.ABC_Class"),
    ),
    "tiercuts": (("rfm",), f"SELECT {quantile('Monetary', 0.5)} AS q50, {quantile('Monetary', 0.75)} AS q75 FROM rfm"),
    "tiers": (
        ("rfm", "tiercuts"),
        "SELECT CustomerID, CASE WHEN Monetary >= q75 THEN 'VIP' WHEN Monetary >= q50 THEN 'Mid' ELSE 'Low' END AS Segment FROM rfm, tiercuts",
    ),
    "edges": (
        ("rfm",),
        "SELECT "
        + ", ".join(
            f"{quantile(col, p / 5)} AS {col[0].lower()}{p}" for col in ("Recency", "Monetary") for p in range(1, 5)
        )
        + " FROM rfm",
    ),
    "scored": (
        ("rfm", "edges"),
        """SELECT *, CASE WHEN R_score >= 4 AND F_score >= 4 AND M_score >= 4 THEN 'VIP' WHEN R_score <= 2 AND F_score <= 2 THEN 'At-risk'
      WHEN F_score >= 4 THEN 'Loyal' ELSE 'General' END AS Segment2 FROM (
      SELECT *, CASE WHEN Recency <= r1 THEN 5 WHEN Recency <= r2 THEN 4 WHEN Recency <= r3 THEN 3 WHEN Recency <= r4 THEN 2 ELSE 1 END AS R_score,
      CASE WHEN (rn - 1) * 5 <= n - 1 THEN 1 WHEN (rn - 1) * 5 <= 2 * (n - 1) THEN 2 WHEN (rn - 1) * 5 <= 3 * (n - 1) THEN 3
        WHEN (rn - 1) * 5 <= 4 * (n - 1) THEN 4 ELSE 5 END AS F_score,
      CASE WHEN Monetary <= m1 THEN 1 WHEN Monetary <= m2 THEN 2 WHEN Monetary <= m3 THEN 3 WHEN Monetary <= m4 THEN 4 ELSE 5 END AS M_score
      FROM (SELECT *, row_number() OVER (ORDER BY Frequency, CustomerID) AS rn, count(*) OVER () AS n FROM rfm), edges)""",
    ),
    "snap": (
        ("dyn",),
        f"""SELECT s.*, CAST(EXISTS (SELECT 1 FROM dyn n WHERE n.CustomerID = s.CustomerID
        AND n.InvoiceDate >= CAST(BaseMonth AS TIMESTAMP) + INTERVAL 1 MONTH AND n.InvoiceDate < CAST(BaseMonth AS TIMESTAMP) + INTERVAL 2 MONTH) AS BIGINT) AS TargetBuyNextMonth
      FROM (SELECT CustomerID, m AS BaseMonth, strftime(m, '%Y-%m') AS BaseMonthStr, w AS WindowMonths,
        round(datesub('day', max(InvoiceDate), CAST(m AS TIMESTAMP)) / 30.0e0, 1) AS Recency,
        count(DISTINCT InvoiceNo) AS Frequency, {total('Revenue')} AS Monetary
        FROM (SELECT CAST(unnest(generate_series(DATE '{CFG.model_first}', DATE '{CFG.model_last}', INTERVAL 1 MONTH)) AS DATE) AS m)
        CROSS JOIN (SELECT CAST(unnest([3, 6, 12]) AS BIGINT) AS w) JOIN dyn
        ON InvoiceDate >= m - to_months(CAST(w AS INTEGER)) AND InvoiceDate < m GROUP BY CustomerID, m, w) s""",
    ),
    "rsales": (
        ("dyn", "months"),
        f"""SELECT m AS AnalysisMonth, StockCode, {total('Revenue')} AS Revenue FROM months JOIN dyn
      ON InvoiceDate >= m - INTERVAL {CFG.rolling_months} MONTH AND InvoiceDate < m GROUP BY m, StockCode""",
    ),
    "rabc": (("rsales",), _running("rsales", "AnalysisMonth")),
    "mix": (
        ("lv3", "dyn", "rabc"),
        """SELECT CustomerID, AnalysisMonth, MovementType, """
        + ", ".join(
            f"coalesce(CAST(sum(CASE WHEN ABC_Class = '{c}' THEN CAST(Revenue AS DECIMAL(18,4)) END) AS DOUBLE), 0.0) / "
            f"CAST(sum(CAST(Revenue AS DECIMAL(18,4))) AS DOUBLE) AS {c}_Share"
            for c in "ABC"
        )
        + """ FROM (SELECT v.CustomerID, v.AnalysisMonth, v.MovementType, dyn.Revenue, rabc.ABC_Class FROM lv3 v JOIN dyn
      ON dyn.CustomerID = v.CustomerID AND InvoiceDate >= v.WindowStart AND InvoiceDate < v.WindowEnd
      JOIN rabc ON rabc.AnalysisMonth = v.AnalysisMonth AND rabc.StockCode = dyn.StockCode WHERE v.MovementType IN ('Up', 'Down'))
      GROUP BY CustomerID, AnalysisMonth, MovementType HAVING sum(Revenue) > 0""",
    ),
    "halves": (
        ("lv3",),
        " UNION ALL ".join(
            f"SELECT CustomerID, MovementType, '{v}' AS Variable, CASE WHEN {v} <= cut THEN '{low}' ELSE '{high}' END AS \"Group\", "
            f"CAST({v} AS DOUBLE) AS Value, CAST(cut AS DOUBLE) AS Cut FROM lv3, (SELECT {quantile(v, 0.5)} AS cut FROM lv3)"
            for v, (low, high) in HALVES.items()
        ),
    ),
    "rich": (("lv3",), f"SELECT * FROM lv3 WHERE Monetary >= (SELECT {quantile('Monetary', 0.5)} FROM lv3)"),
    "richsplit": (
        ("rich",),
        f"""SELECT *, CASE WHEN Frequency >= (SELECT {quantile('Frequency', 0.5)} FROM rich)
      THEN 'HighF_in_HighM' ELSE 'LowF_in_HighM' END AS FreqGroup_in_HighM FROM rich""",
    ),
    "repeats": (("lv3",), "SELECT *, CASE WHEN Frequency >= 2 THEN 'Repeat' ELSE 'OneTime' END AS RepeatStatus FROM lv3"),
    "dirty": (
        ("raw",),
        """SELECT Invoice AS InvoiceNo, coalesce(CASE WHEN NOT ends_with(StockCode, '9') THEN StockCode END, 'nan') AS StockCode,
      CASE WHEN NOT ends_with(StockCode, '7') THEN Quantity END AS Quantity,
      CASE WHEN NOT ends_with(Invoice, '5') THEN InvoiceDate END AS InvoiceDate,
      CASE WHEN NOT ends_with(StockCode, '1') THEN Price END AS UnitPrice, RawID,
      coalesce(CASE WHEN NOT ends_with(Invoice, '8') THEN Country END, 'nan') AS Country FROM raw""",
    ),
    "places": (
        ("grfm",),
        f"SELECT Cluster AS c, {_scaled(0)} AS x, {_scaled(1)} AS y, {_scaled(2)} AS z, row_number() OVER () AS i FROM grfm",
    ),
}


def sql(needs: tuple[str, ...], final: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for dep in CTES[name][0]:
                visit(dep)
            ordered.append(name)

    for name in needs:
        visit(name)
    # Materialised, so that a table read in several places is computed once.
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({CTES[name][1]})" for name in ordered)
    return f"WITH {ctes}\n{final}" if ctes else final


ORACLE: dict[str, str] = {}


def add(key: str, needs: str, final: str, dates: tuple[str, ...] = ()) -> None:
    """`dates` are output columns compared as ISO text."""
    if dates:
        swaps = ", ".join(f"CAST({d} AS VARCHAR) AS {d}" for d in dates)
        final = f"SELECT * REPLACE ({swaps}) FROM ({final})"
    ORACLE[key] = sql(tuple(needs.split()), final)


_MONTH = ("AnalysisMonth",)


_TOTALS = f"SELECT count(*) AS Rows, count(DISTINCT CustomerID) AS Customers, round({total('Revenue')}, 6) AS Revenue FROM "

add(
    "src1_stack_parts",
    "raw",
    f"""SELECT CASE WHEN InvoiceDate < {_ts(CFG.static_start)} THEN Country END AS Country, count(*) AS Rows, sum(Quantity) AS Quantity
    FROM raw GROUP BY 1""",
)
add("src2_raw_snapshot", "raw", "SELECT Country, count(*) AS Rows, sum(Quantity) AS Quantity FROM raw GROUP BY 1")
_RAW_COLUMNS = (
    ("Invoice", "string"), ("StockCode", "string"), ("Quantity", "double"), ("InvoiceDate", "timestamp_ntz"),
    ("Price", "double"), ("Customer ID", "double"), ("Country", "string"),
)
add(
    "src3_overview",
    "raw",
    "SELECT (SELECT count(*) FROM raw) AS Rows, CAST(7 AS BIGINT) AS Columns, CAST(p AS BIGINT) AS Position, c AS \"Column\", t AS Dtype FROM (VALUES "
    + ", ".join(f"({i}, '{c}', '{t}')" for i, (c, t) in enumerate(_RAW_COLUMNS))
    + ") v(p, c, t)",
)
add("snk1_table_sink", "clean", f"SELECT YearMonth, round({total('Revenue')}, 6) AS Revenue FROM clean GROUP BY 1")
add(
    "snk2_report_sizes",
    "clean",
    """SELECT * FROM (VALUES ('preprocessing_stats', CAST(7 AS BIGINT))) v("Table", Rows)
    UNION ALL SELECT 'yearly_summary', count(DISTINCT Year) FROM clean UNION ALL SELECT 'monthly_sales', count(DISTINCT YearMonth) FROM clean""",
)
_LATE = f"(InvoiceDate < {_ts(CFG.static_start)} OR Quantity <= 25)"
add(
    "src1_refreshed_snapshot",
    "raw",
    f"""SELECT v.r AS Run, CAST(v.n AS BIGINT) AS PartsRead, (SELECT count(*) FROM raw WHERE {_LATE}) AS Rows, (SELECT sum(Quantity) FROM raw WHERE {_LATE}) AS Quantity
    FROM (VALUES ('first', 2), ('unchanged', 0), ('changed', 1)) v(r, n)""",
)
add("src3_first_rows", "raw", "SELECT Invoice, StockCode, Quantity FROM raw ORDER BY Invoice, StockCode, Quantity LIMIT 5")
add(
    "prj3_missing_columns",
    "raw",
    """SELECT c AS "Case", m AS Missing, (SELECT count(*) FROM raw) AS Rows
    FROM (VALUES ('whole', ''), ('no price', 'UnitPrice'), ('no ids', 'InvoiceNo,CustomerID')) v(c, m)""",
)
add(
    "prj2_trim_and_alias",
    "norm",
    "SELECT InvoiceNo, count(CustomerID) AS Lines, max(UnitPrice) AS UnitPrice FROM norm GROUP BY 1",
)
add(
    "prj4_lenient_casts",
    "dirty",
    f"""SELECT Country, count(*) AS Rows, count(InvoiceDate) AS Dates, max(InvoiceDate) AS LastDate, count(Quantity) AS Quantities,
    round({total('Quantity')}, 6) AS Units, count(UnitPrice) AS Prices, round(CAST(sum(CAST(UnitPrice AS DECIMAL(38,8))) AS DOUBLE), 6) AS PriceSum,
    count(Quantity * UnitPrice) AS Revenues, count(RawID) AS Ids, max(CAST(CAST(RawID AS BIGINT) AS VARCHAR)) AS LastId FROM dirty GROUP BY 1""",
)
add(
    "prj5_text_casts",
    "dirty",
    f"""SELECT StockCode, count(*) AS Rows, '' AS Description FROM dirty WHERE RawID IS NOT NULL AND NOT starts_with(InvoiceNo, 'C')
    AND Quantity > 0 AND UnitPrice > 0 AND StockCode NOT IN ({_CODES}) AND Country = '{CFG.country}'
    AND InvoiceDate >= {_ts(CFG.start)} AND InvoiceDate < {_ts(CFG.end)} GROUP BY 1""",
)
add(
    "prj9_clean_lines",
    "clean",
    """SELECT InvoiceNo, StockCode, Country, UnitPrice, CustomerID, InvoiceDate, Quantity, round(Revenue, 6) AS Revenue,
    '' AS Description, CAST(Year AS BIGINT) AS Year, CAST(Month AS BIGINT) AS Month, YearMonth, MonthStart FROM clean""",
    ("MonthStart",),
)
add(
    "prj10_log_columns",
    "rfm",
    "SELECT CustomerID, round(ln(1 + Frequency), 6) AS log_Frequency, round(ln(1 + Monetary), 6) AS log_Monetary FROM rfm",
)
add(
    "prj10_center_logs",
    "grfm",
    f"""SELECT Cluster, round(ln(1 + {mean('Frequency')}), 6) AS log_Frequency, round(ln(1 + {mean('Monetary')}), 6) AS log_Monetary
    FROM grfm GROUP BY 1""",
)
add(
    "prj11_replace_segment",
    "kept tiers",
    "SELECT CustomerID, StockCode, Segment FROM (SELECT DISTINCT CustomerID, StockCode FROM kept) LEFT JOIN tiers USING (CustomerID)",
)
for _i, _key in enumerate(
    ("flt1_drop_missing", "flt2_drop_cancelled", "flt3_positive_only", "flt4_products_only", "flt5_country", "flt6_period"), 1
):
    add(_key, f"s{_i}", f"{_TOTALS} s{_i}")
add("flt7_static_year", "static", f"{_TOTALS} static")
add("flt8_cohort_lines", "dyn", f"{_TOTALS} dyn")
add("flt9_target_movers", "lv3", "SELECT CustomerID, AnalysisMonth, MovementType FROM lv3 WHERE MovementType IN ('Up', 'Down')", _MONTH)
add(
    "aud1_cleaning_audit",
    "norm s1 s2 s3 s4 s5 s6",
    "SELECT Step, Rows, Customers, Orders, Revenue, coalesce(lag(Rows) OVER (ORDER BY Step) - Rows, 0) AS RemovedRowsFromPreviousStep FROM ("
    + " UNION ALL ".join(
        f"SELECT '{step}' AS Step, count(*) AS Rows, count(DISTINCT CustomerID) AS Customers, count(DISTINCT InvoiceNo) AS Orders, "
        f"round({total('Revenue')}, 6) AS Revenue FROM {table}"
        for step, table in zip(STEPS, ("norm", "s1", "s2", "s3", "s4", "s5", "s6"))
    )
    + ")",
)
add(
    "aud2_missing_ids",
    "norm s1",
    "SELECT (SELECT count(*) FROM norm WHERE CustomerID IS NULL) AS MissingBefore, (SELECT count(*) FROM s1 WHERE CustomerID IS NULL) AS MissingAfter",
)
add("aud3_cancelled_lines", "s1", "SELECT count(*) AS CancelledRows FROM s1 WHERE upper(InvoiceNo) LIKE 'C%'")
add(
    "aud4_duplicate_lines",
    "clean",
    """SELECT (SELECT count(*) FROM clean) - (SELECT count(*) FROM (SELECT DISTINCT * FROM clean)) AS DuplicateRows, 'all' AS Columns
    UNION ALL SELECT (SELECT count(*) FROM clean) - (SELECT count(*) FROM (SELECT DISTINCT StockCode, Quantity FROM clean)), 'two'""",
)

add(
    "agg1_dataset_summary",
    "raw clean",
    f"""SELECT (SELECT count(*) FROM raw) AS RawRows, count(*) AS CleanRows, (SELECT count(*) FROM raw) - count(*) AS RemovedRowsTotal,
    count(DISTINCT CustomerID) AS CleanCustomers, count(DISTINCT InvoiceNo) AS CleanOrders, count(DISTINCT StockCode) AS CleanSKUs,
    round({total('Revenue')}, 6) AS TotalRevenue, min(InvoiceDate) AS StartDate, max(InvoiceDate) AS EndDate FROM clean""",
)
add(
    "agg2_yearly_summary",
    "clean",
    f"""SELECT CAST(Year AS BIGINT) AS Year, count(*) AS Rows, count(DISTINCT CustomerID) AS Customers, count(DISTINCT InvoiceNo) AS Orders,
    count(DISTINCT StockCode) AS SKUs, round({total('Revenue')}, 6) AS Revenue FROM clean GROUP BY 1""",
)
_CLEAN_COLUMNS = (
    ("InvoiceNo", "string"), ("StockCode", "string"), ("Quantity", "double"), ("InvoiceDate", "timestamp_ntz"),
    ("UnitPrice", "double"), ("CustomerID", "string"), ("Country", "string"), ("Description", "string"),
    ("Revenue", "double"), ("Year", "int"), ("Month", "int"), ("YearMonth", "string"), ("MonthStart", "date"),
)
add(
    "agg3_variable_info",
    "clean",
    " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS Position, '{c}' AS \"Column\", '{t}' AS Dtype, count(*) - count({v}) AS MissingValues, "
        f"count(DISTINCT {v}) AS UniqueValues FROM clean"
        for i, (c, t) in enumerate(_CLEAN_COLUMNS)
        for v in ("''" if c == "Description" else c,)
    ),
)
_RFM_OUT = "CustomerID, FirstPurchaseDate, LastPurchaseDate, Recency, Frequency, round(Monetary, 6) AS Monetary"
add("agg4_rfm", "rfm_all", f"SELECT {_RFM_OUT} FROM rfm_all")
add(
    "agg4_rfm_latest",
    "clean",
    f"SELECT {_RFM_OUT} FROM ({_rfm('clean, (SELECT max(InvoiceDate) AS snap FROM clean)', 'any_value(snap)')})",
)
_Q1 = CFG.static_start.replace(month=4)
add(
    "agg5_rfm_full_base",
    "static rfm",
    f"""SELECT r.CustomerID, q.FirstPurchaseDate, q.LastPurchaseDate, coalesce(q.Recency, 4.0e0) AS Recency,
    coalesce(q.Frequency, 0) AS Frequency, round(coalesce(q.Monetary, 0.0e0), 6) AS Monetary FROM (SELECT CustomerID FROM rfm) r
    LEFT JOIN ({_rfm('static', _ts(_Q1), f'WHERE InvoiceDate < {_ts(_Q1)}')}) q USING (CustomerID)""",
)
add("agg6_outlier_cut", "rfm", f"SELECT {_RFM_OUT} FROM rfm")
add(
    "agg6_outlier_summary",
    "rfm_all rfm cuts",
    """SELECT (SELECT count(*) FROM rfm_all) AS OriginalCustomers, (SELECT count(*) FROM rfm) AS FilteredCustomers,
    (SELECT count(*) FROM rfm_all) - (SELECT count(*) FROM rfm) AS RemovedCustomers,
    round(CAST(fcut AS DOUBLE), 6) AS Frequency99Cutoff, round(mcut, 6) AS Monetary99Cutoff FROM cuts""",
)
_MEANS = ", ".join(f"round({mean(v)}, 6) AS Mean_{v}" for v in ("Recency", "Frequency", "Monetary"))
_SUMMARY = f"SELECT Customer_Grade, count(DISTINCT CustomerID) AS Customers, {_MEANS} FROM grfm GROUP BY 1"
add("agg7_cluster_summary", "grfm", _SUMMARY)
add(
    "agg8_cluster_means",
    "grfm",
    "SELECT Cluster, " + ", ".join(f"round({mean(v)}, 6) AS {v}" for v in ("Recency", "Frequency", "Monetary")) + " FROM grfm GROUP BY 1",
)
add("agg9_grade_counts", "grfm", "SELECT Customer_Grade, count(*) AS Count FROM grfm GROUP BY 1")
add("agg9_abc_counts", "abc", "SELECT ABC_Class, count(*) AS Count FROM abc GROUP BY 1")
add("agg9_segment_counts", "scored", "SELECT Segment2, count(*) AS Count FROM scored GROUP BY 1")
add("agg10_product_sales", "sales", "SELECT StockCode, round(Quantity, 6) AS Quantity, round(Revenue, 6) AS Revenue FROM sales")
add(
    "agg11_abc_share",
    "abc",
    f"""SELECT CAST(p AS BIGINT) AS Position, c AS ABC_Class, round(s / (SELECT {total('Revenue')} FROM abc), 6) AS Share
    FROM (VALUES (0, 'A'), (1, 'B'), (2, 'C')) v(p, c) LEFT JOIN (SELECT ABC_Class, {total('Revenue')} AS s FROM abc GROUP BY 1) ON c = ABC_Class""",
)
add(
    "agg12_customer_product",
    "cp",
    """SELECT StockCode, CustomerID, round(Quantity, 6) AS Quantity, round(Revenue, 6) AS Revenue, Recency, Frequency,
    round(Monetary, 6) AS Monetary, Customer_Grade, ABC_Class FROM cp""",
)
add("agg13_monthly_sales", "clean", f"SELECT YearMonth, round({total('Revenue')}, 6) AS Revenue FROM clean GROUP BY 1")
CTES["os"] = (
    ("kept", "grfm"),
    f"""SELECT o.CustomerID, o.InvoiceNo, o.OrderRevenue, o.YearMonth, grfm.Customer_Grade FROM (SELECT CustomerID, InvoiceNo,
    {total('Revenue')} AS OrderRevenue, max(YearMonth) AS YearMonth FROM kept GROUP BY 1, 2) o LEFT JOIN grfm USING (CustomerID)""",
)
add("agg14_order_summary", "os", "SELECT CustomerID, InvoiceNo, round(OrderRevenue, 6) AS OrderRevenue, YearMonth, Customer_Grade FROM os")
add(
    "agg14_order_summary_all",
    "static grfm",
    f"""SELECT o.CustomerID, o.InvoiceNo, round(o.OrderRevenue, 6) AS OrderRevenue, o.YearMonth, grfm.Customer_Grade FROM (SELECT CustomerID, InvoiceNo,
    {total('Revenue')} AS OrderRevenue, max(YearMonth) AS YearMonth FROM static GROUP BY 1, 2) o LEFT JOIN grfm USING (CustomerID)""",
)
add(
    "agg15_segment_summary",
    "os",
    f"""SELECT Customer_Grade, Customers, Orders, round(Revenue, 6) AS Revenue, round(Revenue / Orders, 6) AS AOV,
    round(Revenue / Customers, 6) AS Revenue_per_Customer, round(Customers / sum(Customers) OVER (), 6) AS Customer_Share,
    round(Revenue / sum(Revenue) OVER (), 6) AS Revenue_Share, CAST(regexp_extract(Customer_Grade, 'Lv(\\d)', 1) AS BIGINT) AS GradeOrder
    FROM (SELECT Customer_Grade, count(DISTINCT CustomerID) AS Customers, count(DISTINCT InvoiceNo) AS Orders,
    {total('OrderRevenue')} AS Revenue FROM os GROUP BY 1)""",
)
add(
    "agg16_segment_abc_mix",
    "cp tiers",
    f"""SELECT Segment, ABC_Class, round(Revenue, 6) AS Revenue, round(TotalRevenue, 6) AS TotalRevenue, round(Revenue / TotalRevenue, 6) AS Ratio
    FROM (SELECT Segment, ABC_Class, {total('cp.Revenue')} AS Revenue, sum({total('cp.Revenue')}) OVER (PARTITION BY Segment) AS TotalRevenue
    FROM cp JOIN tiers USING (CustomerID) GROUP BY 1, 2) WHERE ABC_Class IS NOT NULL""",
)
_BY_CLASS = ", ".join(
    f"coalesce(CAST(sum(CASE WHEN ABC_Class = '{c}' THEN CAST(Revenue AS DECIMAL(18,4)) END) AS DOUBLE), 0.0e0) AS r{c}" for c in "ABC"
)
add(
    "agg17_grade_abc_matrix",
    "cp",
    f"""SELECT Customer_Grade, round(rA / (rA + rB + rC), 6) AS A, round(rB / (rA + rB + rC), 6) AS B, round(rC / (rA + rB + rC), 6) AS C
    FROM (SELECT Customer_Grade, {_BY_CLASS} FROM cp GROUP BY 1)""",
)
add(
    "agg18_grade_month_revenue",
    "kept grfm",
    "SELECT YearMonth, "
    + ", ".join(
        f"round(coalesce(CAST(sum(CASE WHEN Customer_Grade = '{g}' THEN CAST(Revenue AS DECIMAL(18,4)) END) AS DOUBLE), 0.0e0), 6) AS \"{g}\""
        for g in GRADE_NAMES
    )
    + " FROM kept JOIN grfm USING (CustomerID) GROUP BY 1",
)
add(
    "agg19_monthly_grade_counts",
    "gpanel",
    "SELECT AnalysisMonthStr, "
    + ", ".join(f"count(DISTINCT CASE WHEN Customer_Grade = '{g}' THEN CustomerID END) AS \"{g}\"" for g in GRADE_NAMES)
    + " FROM gpanel GROUP BY 1",
)


def _describe(table: str, columns: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS Variable, count({c}) AS Count, round(avg({c}), 6) AS Mean, round(stddev_samp({c}), 6) AS Std, "
        f"round(CAST(min({c}) AS DOUBLE), 6) AS Min, round(CAST(quantile_cont({c}, 0.25) AS DOUBLE), 6) AS Q25, "
        f"round(CAST(quantile_cont({c}, 0.5) AS DOUBLE), 6) AS Median, round(CAST(quantile_cont({c}, 0.75) AS DOUBLE), 6) AS Q75, "
        f"round(CAST(max({c}) AS DOUBLE), 6) AS Max FROM {table}"
        for c in columns
    )


add("agg20_describe_lines", "clean", _describe("clean", ("Revenue", "Quantity", "UnitPrice")))
add("agg20_describe_rfm", "rfm", _describe("rfm", ("Recency", "Frequency", "Monetary")))
_NUMERIC = ("Quantity", "UnitPrice", "Revenue")
add(
    "agg21_correlation",
    "clean",
    " UNION ALL ".join(
        f"SELECT '{a}' AS Variable1, '{b}' AS Variable2, round(corr({a}, {b}), 6) AS Corr FROM clean" for a in _NUMERIC for b in _NUMERIC
    ),
)
add(
    "agg22_vip_summary",
    "rfm kept tiercuts",
    f"""SELECT (SELECT count(*) FROM rfm WHERE Monetary >= q75) AS VIP_Customers,
    round((SELECT count(*) FROM rfm WHERE Monetary >= q75) / (SELECT count(*) FROM rfm), 6) AS VIP_Customer_Ratio,
    round((SELECT {total('Revenue')} FROM kept WHERE CustomerID IN (SELECT CustomerID FROM rfm, tiercuts WHERE Monetary >= q75))
      / (SELECT {total('Revenue')} FROM kept), 6) AS VIP_Revenue_Ratio FROM tiercuts""",
)
add(
    "agg23_vip_class_a",
    "cp tiercuts",
    f"""SELECT round(t, 6) AS VIP_Total, round(a, 6) AS VIP_A, round(a / t, 6) AS VIP_A_Ratio FROM (SELECT {total('Revenue')} AS t,
    {total("CASE WHEN ABC_Class = 'A' THEN Revenue END")} AS a FROM cp, tiercuts WHERE Monetary >= q75)""",
)
CTES["shares"] = (
    ("gpanel",),
    f"""SELECT Customer_Grade, round_even(avg(money / whole) * 100, 2) AS Avg_Revenue_Share FROM (
    SELECT AnalysisMonthStr, Customer_Grade, {total('Monetary')} AS money,
    sum({total('Monetary')}) OVER (PARTITION BY AnalysisMonthStr) AS whole FROM gpanel GROUP BY 1, 2) GROUP BY 1""",
)
add("agg24_revenue_share_by_grade", "shares", "SELECT * FROM shares")
add("agg25_cluster_profile", "grfm shares", f"SELECT * FROM ({_SUMMARY}) LEFT JOIN shares USING (Customer_Grade)")

_ABC_OUT = """round(Revenue, 6) AS Revenue, round(CumulativeRevenue, 6) AS CumulativeRevenue, round(CumulativeRatio, 6) AS CumulativeRatio, ABC_Class"""
add("win1_running_revenue", "abc", f"SELECT StockCode, round(Quantity, 6) AS Quantity, {_ABC_OUT} FROM abc")
add(
    "win3_long_tail",
    "sales",
    "SELECT StockCode, round(Revenue, 6) AS Revenue, row_number() OVER (ORDER BY Revenue DESC, StockCode) - 1 AS ProductRank FROM sales",
)
_SCORES = ", ".join(f"CAST({v}_score AS BIGINT) AS {v}_score" for v in "RFM")
add("win7_scores", "scored", f"SELECT CustomerID, {_SCORES} FROM scored")
add(
    "win9_rfm_score",
    "scored",
    "SELECT CAST(R_score AS VARCHAR) || CAST(F_score AS VARCHAR) || CAST(M_score AS VARCHAR) AS RFM_score, count(*) AS Customers FROM scored GROUP BY 1",
)
add("win10_revenue_tier", "tiers", "SELECT CustomerID, Segment FROM tiers")
add("win11_rule_segment", "scored", "SELECT CustomerID, Segment2 FROM scored")
add(
    "lim1_top_products",
    "sales",
    "SELECT StockCode, round(Quantity, 6) AS Quantity, round(Revenue, 6) AS Revenue FROM sales ORDER BY Revenue DESC, StockCode LIMIT 10",
)

add(
    "tim1_month_range",
    "months clean",
    "SELECT m AS AnalysisMonth, count(InvoiceNo) AS Rows FROM months LEFT JOIN clean ON MonthStart = m GROUP BY 1",
    _MONTH,
)
add(
    "tim3_rolling_panel",
    "panel",
    """SELECT CustomerID, FirstPurchaseDate, LastPurchaseDate, Recency, Frequency, round(Monetary, 6) AS Monetary, AnalysisMonth,
    AnalysisMonthStr, WindowStart, WindowEnd FROM panel""",
    ("AnalysisMonth", "WindowStart", "WindowEnd"),
)
add("tim4_graded_panel", "gpanel", "SELECT CustomerID, AnalysisMonth, Cluster, Customer_Grade FROM gpanel", _MONTH)
_SNAP = "SELECT CustomerID, BaseMonth, BaseMonthStr, WindowMonths, Recency, Frequency, round(Monetary, 6) AS Monetary, TargetBuyNextMonth FROM snap"
add("tim5_snapshot_panel", "snap", f"{_SNAP} WHERE WindowMonths = 6", ("BaseMonth",))
add(
    "tim6_next_purchase_rate",
    "snap",
    "SELECT WindowMonths, BaseMonthStr, count(*) AS Rows, CAST(sum(TargetBuyNextMonth) AS BIGINT) AS Buyers FROM snap GROUP BY 1, 2",
)
add("tim7_all_widths", "snap", _SNAP, ("BaseMonth",))
add("tim8_rolling_abc", "rabc", f"SELECT AnalysisMonth, StockCode, {_ABC_OUT} FROM rabc", _MONTH)
_SHARES = ", ".join(f"round({c}_Share, 6) AS {c}_Share" for c in "ABC")
add("tim9_mover_mix", "mix", f"SELECT CustomerID, AnalysisMonth, MovementType, {_SHARES} FROM mix", _MONTH)
add(
    "tim10_mover_mix_summary",
    "mix",
    "SELECT MovementType, count(*) AS Obs, count(DISTINCT CustomerID) AS Customers, "
    + ", ".join(f"round(avg({c}_Share), 6) AS Mean_{c}_Share" for c in "ABC")
    + " FROM mix GROUP BY 1",
)

add("trn1_next_grade", "moves", "SELECT CustomerID, AnalysisMonth, Customer_Grade, NextGrade FROM moves", _MONTH)
add(
    "trn3_movement",
    "moves",
    """SELECT CustomerID, AnalysisMonth, CAST(cnum AS VARCHAR) AS CurrentGradeNum, CAST(nnum AS VARCHAR) AS NextGradeNum, MovementType, Moved FROM moves""",
    _MONTH,
)
add(
    "trn4_mobility",
    "moves",
    "SELECT Customer_Grade, count(DISTINCT CustomerID) AS Customers, count(*) AS Obs, round(avg(Moved), 6) AS Move_Rate FROM moves GROUP BY 1",
)


def _dist(table: str, group: str, of: str = "MovementType") -> str:
    return (
        f"SELECT {group}, {of}, count(*) AS Count, round(count(*) / sum(count(*)) OVER (PARTITION BY {group}), 6) AS Ratio "
        f"FROM {table} GROUP BY {group}, {of}"
    )


add("trn5_movement_distribution", "moves", _dist("moves", "Customer_Grade"))
add("trn6_transition_counts", "lv3", "SELECT Customer_Grade, NextGrade, count(*) AS Count FROM lv3 GROUP BY 1, 2")
add(
    "trn6_transition_matrix",
    "lv3",
    "SELECT Customer_Grade, " + ", ".join(f"CAST(count_if(NextGrade = '{g}') AS BIGINT) AS \"{g}\"" for g in (*GRADE_NAMES, "NoActivity")) + " FROM lv3 GROUP BY 1",
)
add(
    "trn7_transition_ratios",
    "lv3",
    "SELECT Customer_Grade, NextGrade, round(count(*) / sum(count(*)) OVER (PARTITION BY Customer_Grade), 6) AS Ratio FROM lv3 GROUP BY 1, 2",
)

add(
    "ml1_scaling",
    "panel",
    "SELECT AnalysisMonth, count(*) AS Rows, "
    + ", ".join(f"round(avg({v}), 6) AS Mean_{v}" for v in ("Recency", "Frequency", "Monetary"))
    + ", "
    + ", ".join(f"round(stddev_pop({v}), 6) AS Std_{v}" for v in ("Recency", "Frequency", "Monetary"))
    + " FROM panel GROUP BY 1",
    _MONTH,
)
add("ml3_nearest_center", "grfm", "SELECT CustomerID, Cluster FROM grfm")
_CENTER_ROWS = ", ".join(f"({j}, {c[0]}e0, {c[1]}e0, {c[2]}e0)" for j, c in enumerate(fixed.CENTERS))
CTES["centers"] = (
    (),
    f"""SELECT CAST(c AS BIGINT) AS Cluster, r AS Recency, f AS Frequency, m AS Monetary,
    ([{_LEVELS}])[row_number() OVER (ORDER BY m, f, r DESC)] AS Customer_Grade FROM (VALUES {_CENTER_ROWS}) v(c, r, f, m)""",
)
add(
    "ml4_centers",
    "grfm centers",
    """SELECT k.Cluster, Customers, round(k.Recency, 6) AS Recency, round(k.Frequency, 6) AS Frequency, round(k.Monetary, 6) AS Monetary,
    k.Customer_Grade FROM centers k JOIN (SELECT Cluster, count(*) AS Customers FROM grfm GROUP BY 1) USING (Cluster)""",
)
add(
    "ml5_grade_naming",
    "grfm centers",
    "SELECT CustomerID, Cluster, k.Customer_Grade FROM (SELECT CustomerID, Cluster FROM grfm) JOIN centers k USING (Cluster)",
)


def _silhouette(distance: str) -> str:
    return f"""SELECT CAST(5 AS BIGINT) AS K, round(avg(CASE WHEN n = 1 OR greatest(a, b) = 0 THEN 0.0e0 ELSE (b - a) / greatest(a, b) END), 6) AS Silhouette FROM (
      SELECT i, max(CASE WHEN own THEN n END) AS n, max(CASE WHEN own AND n > 1 THEN s / (n - 1) ELSE 0 END) AS a, min(CASE WHEN NOT own THEN s / n END) AS b FROM (
        SELECT p.i, q.c, p.c = q.c AS own, count(*) AS n, sum({distance}) AS s FROM places p CROSS JOIN places q GROUP BY p.i, p.c, q.c) GROUP BY i)"""


_GAP = "((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z))"
add("ml7_silhouette", "places", _silhouette(f"sqrt({_GAP})"))
add("ml7_silhouette_squared", "places", _silhouette(_GAP))
add(
    "ml8_time_split",
    "snap",
    f"""SELECT WindowMonths, count(*) AS Rows, CAST(sum(TargetBuyNextMonth) AS BIGINT) AS Buyers,
    CASE WHEN BaseMonth < DATE '{CFG.train_end}' THEN 'train' ELSE 'test' END AS Side FROM snap GROUP BY 1, 4""",
)
add(
    "ml10_auc",
    "snap",
    f"""SELECT WindowMonths, BaseMonthStr, round((sum(CASE WHEN TargetBuyNextMonth = 1 THEN rnk END) - p * (p + 1) / 2.0e0) / nullif(p * (n - p), 0), 6) AS AUC,
    n AS N, round(p / n, 6) AS PositiveRate FROM (SELECT *,
      rank() OVER (PARTITION BY WindowMonths, BaseMonthStr ORDER BY -Recency) + (count(*) OVER (PARTITION BY WindowMonths, BaseMonthStr, Recency) - 1) / 2.0e0 AS rnk,
      count(*) OVER (PARTITION BY WindowMonths, BaseMonthStr) AS n,
      CAST(sum(TargetBuyNextMonth) OVER (PARTITION BY WindowMonths, BaseMonthStr) AS BIGINT) AS p
      FROM snap WHERE BaseMonth >= DATE '{CFG.train_end}') GROUP BY WindowMonths, BaseMonthStr, n, p""",
)

_RATES3 = f"{share('Up', 'Up_Rate')}, {share('Down', 'Down_Rate')}, {share('NoActivity', 'NoActivity_Rate')}"
add("drv1_median_split", "halves", 'SELECT Variable, "Group", count(*) AS Rows, round(max(Cut), 6) AS Cut FROM halves GROUP BY 1, 2')
add(
    "drv2_impact_summary",
    "halves",
    f"""SELECT Variable, "Group", count(*) AS Obs, count(DISTINCT CustomerID) AS Customers, round({mean('Value')}, 6) AS Mean_Value,
    {_RATES3}, round(max(Cut), 6) AS Cut FROM halves GROUP BY 1, 2""",
)
add("drv3_impact_distribution", "halves", _dist("halves", '"Group"'))
add(
    "drv5_high_monetary",
    "richsplit",
    f"""SELECT FreqGroup_in_HighM, count(*) AS Obs, count(DISTINCT CustomerID) AS Customers, round({mean('Frequency')}, 6) AS Mean_Frequency,
    round({mean('Monetary')}, 6) AS Mean_Monetary, {_RATES3} FROM richsplit GROUP BY 1""",
)
add("drv5_high_monetary_distribution", "richsplit", _dist("richsplit", "FreqGroup_in_HighM"))
add(
    "drv6_repeat_summary",
    "repeats",
    f"""SELECT RepeatStatus, count(*) AS Obs, count(DISTINCT CustomerID) AS Customers, {_MEANS}, {share('Up', 'Up_Rate')},
    {share('Stay', 'Stay_Rate')}, {share('Down', 'Down_Rate')}, {share('NoActivity', 'NoActivity_Rate')} FROM repeats GROUP BY 1""",
)
add("drv6_repeat_distribution", "repeats", _dist("repeats", "RepeatStatus"))


def _steps(table: str, group: str, steps: int, starts: dict[str, list]) -> list[str]:
    """Lloyd steps from given centers, one pair of CTEs each; every group has its own scaling. `starts` holds the
    centers by a condition on the group."""
    names = ("Recency", "Frequency", "Monetary")
    stats = ", ".join(f"avg({n}) AS m{i}, CASE WHEN stddev_pop({n}) > 0 THEN stddev_pop({n}) ELSE 1 END AS s{i}" for i, n in enumerate(names))
    start = " UNION ALL ".join(
        f"SELECT g, {j} AS j, " + ", ".join(f"({_num(float(c[i]))} - m{i}) / s{i} AS a{i}" for i in range(3)) + f" FROM st WHERE {which}"
        for which, centers in starts.items()
        for j, c in enumerate(centers)
    )
    gap = " + ".join(f"(x{i} - a{i}) * (x{i} - a{i})" for i in range(3))
    parts = [
        f"src AS (SELECT *, {group} AS g FROM {table})",
        f"st AS (SELECT g, {stats} FROM src GROUP BY 1)",
        "pt AS (SELECT src.*, " + ", ".join(f"({n} - m{i}) / s{i} AS x{i}" for i, n in enumerate(names)) + " FROM src JOIN st USING (g))",
        f"c0 AS ({start})",
    ]
    near = lambda k: (
        f"n{k} AS (SELECT g, CustomerID, any_value(x0) AS x0, any_value(x1) AS x1, any_value(x2) AS x2, arg_min(j, d) AS j, min(d) AS d "
        f"FROM (SELECT pt.g, CustomerID, x0, x1, x2, j, {gap} AS d FROM pt JOIN c{k} USING (g)) GROUP BY 1, 2)"
    )
    for k in range(steps):
        moved = ", ".join(f"coalesce(avg(x{i}), any_value(a{i})) AS a{i}" for i in range(3))
        parts += [near(k), f"c{k + 1} AS (SELECT c.g, c.j, {moved} FROM c{k} c LEFT JOIN n{k} n ON c.g = n.g AND c.j = n.j GROUP BY 1, 2)"]
    return [*parts, near(steps)]


def _followed(table: str, group: str, steps: int, out: str) -> str:
    """Grades after some steps from the fixed centers."""
    parts = _steps(table, group, steps, {"true": fixed.CENTERS})
    raw = [f"a{i} * s{i} + m{i}" for i in range(3)]
    labels = " ".join(f"WHEN {i} THEN '{g}'" for i, g in enumerate(GRADE_NAMES, 1))
    parts += [
        f"named AS (SELECT g, j, CASE row_number() OVER (PARTITION BY g ORDER BY {raw[2]}, {raw[1]}, {raw[0]} DESC) {labels} END AS grade "
        f"FROM c{steps} JOIN st USING (g))",
    ]
    return "(WITH " + ", ".join(parts) + f" SELECT {out} CAST(j AS BIGINT) AS Cluster, grade AS Customer_Grade FROM n{steps} JOIN named USING (g, j))"


add("ml2_steps_from_given_centers", "rfm", "SELECT * FROM " + _followed("rfm", "0", 4, "CustomerID,"))
add("tim4_steps_from_given_centers", "panel", "SELECT * FROM " + _followed("panel", "AnalysisMonthStr", 3, "g AS AnalysisMonthStr, CustomerID,"))


def _k_sweep() -> str:
    """Inertia and silhouette in squared distance, from all pairs, after three steps for every k."""
    ks = ", ".join(map(str, CFG.k_values))
    parts = _steps("(SELECT rfm.*, unnest([" + ks + "]) AS kk FROM rfm)", "kk", 3, {f"g = {k}": fixed.starts(k) for k in CFG.k_values})
    gap = " + ".join(f"(p.x{i} - q.x{i}) * (p.x{i} - q.x{i})" for i in range(3))
    return f"""(WITH {", ".join(parts)},
    pairs AS (SELECT p.g, p.CustomerID, p.j, q.j AS other, count(*) AS n, sum({gap}) AS s FROM n3 p JOIN n3 q ON p.g = q.g GROUP BY 1, 2, 3, 4),
    rows_ AS (SELECT g, CustomerID, max(CASE WHEN j = other THEN n END) AS n, max(CASE WHEN j = other AND n > 1 THEN s / (n - 1) ELSE 0 END) AS a,
      min(CASE WHEN j <> other THEN s / n END) AS b FROM pairs GROUP BY 1, 2),
    scores AS (SELECT g, avg(CASE WHEN n = 1 OR greatest(a, b) = 0 THEN 0.0e0 ELSE (b - a) / greatest(a, b) END) AS s FROM rows_ GROUP BY 1)
    SELECT CAST(g AS BIGINT) AS K, round(i, 6) AS Inertia, round(s, 6) AS Silhouette FROM (SELECT g, sum(d) AS i FROM n3 GROUP BY 1) JOIN scores USING (g))"""


add("ml6_steps_from_given_starts", "rfm", "SELECT * FROM " + _k_sweep())

_CELL = lambda a: f"coalesce(least(floor(({a} - l{a}) / nullif((h{a} - l{a}) / 16, 0)), 15), 0)"
_GAP2 = "((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z))"
add(
    "ml7_silhouette_cells",
    "places",
    f"""SELECT * FROM (WITH ends AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM places),
    cells AS (SELECT c, count(*) AS n, avg(x) AS x, avg(y) AS y, avg(z) AS z, greatest(avg(x * x + y * y + z * z) - avg(x) ** 2 - avg(y) ** 2 - avg(z) ** 2, 0) AS s
      FROM places, ends GROUP BY c, {_CELL('x')}, {_CELL('y')}, {_CELL('z')}),
    met AS (SELECT p.i, p.c = q.c AS own, sum(q.n) AS n, sum(q.n * sqrt({_GAP2})) AS low, sum(q.n * sqrt({_GAP2} + q.s)) AS high
      FROM places p CROSS JOIN cells q GROUP BY p.i, p.c, q.c),
    ab AS (SELECT i, max(CASE WHEN own THEN n END) AS n, max(CASE WHEN own THEN low / greatest(n - 1, 1) END) AS al, max(CASE WHEN own THEN high / greatest(n - 1, 1) END) AS ah,
      min(CASE WHEN NOT own THEN low / n END) AS bl, min(CASE WHEN NOT own THEN high / n END) AS bh FROM met GROUP BY i),
    s AS (SELECT CASE WHEN n = 1 THEN 0.0e0 ELSE coalesce((bl - ah) / nullif(greatest(bl, ah), 0), 0) END AS low,
      CASE WHEN n = 1 THEN 0.0e0 ELSE coalesce((bh - al) / nullif(greatest(bh, al), 0), 0) END AS high FROM ab)
    SELECT CAST(5 AS BIGINT) AS K, round((avg(low) + avg(high)) / 2, 6) AS Silhouette, round((avg(high) - avg(low)) / 2, 6) AS Bound FROM s)""",
)


def _newton(steps: int = 14) -> list[str]:
    """Logistic models of all widths by unrolled Newton steps on scaled features; b holds the last coefficients."""
    z = [f"(x{i} - m{i}) / s{i}" for i in range(3)]
    names = ("Recency", "Frequency", "Monetary")
    stats = ", ".join(f"avg({n}) AS m{i}, stddev_pop({n}) AS s{i}" for i, n in enumerate(names))
    parts = [
        f"st AS (SELECT WindowMonths AS w, count(*) AS n, sum(TargetBuyNextMonth) AS n1, {stats} FROM snap WHERE BaseMonth < DATE '{CFG.train_end}' GROUP BY 1)",
        "tr AS (SELECT WindowMonths AS w, TargetBuyNextMonth AS y, CASE WHEN TargetBuyNextMonth = 1 THEN n / (2.0e0 * n1) ELSE n / (2.0e0 * (n - n1)) END AS wt, "
        + ", ".join(f"{e.replace(f'x{i}', names[i])} AS z{i}" for i, e in enumerate(z))
        + f" FROM snap JOIN st ON WindowMonths = st.w WHERE BaseMonth < DATE '{CFG.train_end}')",
        "b0 AS (SELECT w, 0.0e0 AS b0, 0.0e0 AS b1, 0.0e0 AS b2, 0.0e0 AS b3 FROM st)",
    ]
    axis = ["z0", "z1", "z2", "1.0e0"]
    for k in range(steps):
        sums = [f"sum(wt * (p - y) * {axis[i]}) AS q{i}" for i in range(4)]
        sums += [f"sum(wt * p * (1 - p) * {axis[i]} * {axis[j]}) AS r{j}{i}" for i in range(4) for j in range(i + 1)]
        parts.append(
            f"d{k} AS (SELECT w, {', '.join(sums)} FROM (SELECT tr.*, 1 / (1 + exp(-(z0 * b0 + z1 * b1 + z2 * b2 + b3))) AS p FROM tr JOIN b{k} USING (w)) GROUP BY w)"
        )
        ridge = lambda i: f" + 1 / (s{i} * s{i})" if i < 3 else ""
        h = {(j, i): f"(r{j}{i}{ridge(i) if i == j else ''})" for i in range(4) for j in range(i + 1)}
        g = [f"(q{i} + b{i} / (s{i} * s{i}))" if i < 3 else "q3" for i in range(4)]
        parts += [
            # Square-root-free Cholesky factors, one more pivot in each.
            f"e{k} AS (SELECT *, {h[0, 0]} AS d0, {h[0, 1]} / {h[0, 0]} AS l10, {h[0, 2]} / {h[0, 0]} AS l20, {h[0, 3]} / {h[0, 0]} AS l30 FROM d{k} JOIN st USING (w) JOIN b{k} USING (w))",
            f"f{k} AS (SELECT *, {h[1, 1]} - l10 * l10 * d0 AS d1, ({h[1, 2]} - l20 * l10 * d0) / ({h[1, 1]} - l10 * l10 * d0) AS l21, ({h[1, 3]} - l30 * l10 * d0) / ({h[1, 1]} - l10 * l10 * d0) AS l31 FROM e{k})",
            f"g{k} AS (SELECT *, {h[2, 2]} - l20 * l20 * d0 - l21 * l21 * d1 AS d2 FROM f{k})",
            f"h{k} AS (SELECT *, ({h[2, 3]} - l30 * l20 * d0 - l31 * l21 * d1) / d2 AS l32 FROM g{k})",
            f"i{k} AS (SELECT *, {h[3, 3]} - l30 * l30 * d0 - l31 * l31 * d1 - l32 * l32 * d2 AS d3, {g[1]} - l10 * {g[0]} AS y1 FROM h{k})",
            f"j{k} AS (SELECT *, {g[2]} - l20 * {g[0]} - l21 * y1 AS y2 FROM i{k})",
            f"k{k} AS (SELECT *, ({g[3]} - l30 * {g[0]} - l31 * y1 - l32 * y2) / d3 AS u3 FROM j{k})",
            f"l{k} AS (SELECT *, y2 / d2 - l32 * u3 AS u2 FROM k{k})",
            f"m{k} AS (SELECT *, y1 / d1 - l21 * u2 - l31 * u3 AS u1 FROM l{k})",
            f"b{k + 1} AS MATERIALIZED (SELECT w, b0 - ({g[0]} / d0 - l10 * u1 - l20 * u2 - l30 * u3) AS b0, b1 - u1 AS b1, b2 - u2 AS b2, b3 - u3 AS b3 FROM m{k})",
        ]
    margin = " + ".join(f"({n} - m{i}) / s{i} * b{i}" for i, n in enumerate(names))
    parts.append(f"found AS MATERIALIZED (SELECT snap.*, 1 / (1 + exp(-({margin} + b3))) AS PredProb FROM snap JOIN st ON WindowMonths = st.w JOIN b{steps} b ON b.w = st.w WHERE BaseMonth >= DATE '{CFG.train_end}')")
    return parts


_FITTED = "WITH " + ",\n".join(_newton())
_POSITIVE = "sum(TargetBuyNextMonth)"


def _area(by: str) -> str:
    part = f"PARTITION BY {by}"
    return f"""SELECT *, rank() OVER ({part} ORDER BY PredProb) + (count(*) OVER ({part}, PredProb) - 1) / 2.0e0 AS rnk FROM found"""


_AUC = f"round((sum(CASE WHEN TargetBuyNextMonth = 1 THEN rnk END) - {_POSITIVE} * ({_POSITIVE} + 1) / 2.0e0) / nullif({_POSITIVE} * (count(*) - {_POSITIVE}), 0), 6)"
_SIZES = f"""SELECT WindowMonths, count_if(BaseMonth < DATE '{CFG.train_end}') AS TrainN, count_if(BaseMonth >= DATE '{CFG.train_end}') AS TestN FROM snap GROUP BY 1"""


def add_fitted(key: str, final: str, dates: tuple[str, ...] = ()) -> None:
    add(key, "snap", f"SELECT * FROM ({_FITTED}\n{final})", dates)


add_fitted("ml9_scored_test", "SELECT CustomerID, BaseMonth, WindowMonths, TargetBuyNextMonth, round(PredProb, 6) AS PredProb FROM found", ("BaseMonth",))
add_fitted(
    "ml12_auc_summary",
    f"""SELECT WindowMonths, OverallAUC, CAST(TrainN AS BIGINT) AS TrainN, CAST(TestN AS BIGINT) AS TestN FROM ({_SIZES})
    JOIN (SELECT WindowMonths, {_AUC} AS OverallAUC FROM ({_area('WindowMonths')}) GROUP BY 1) USING (WindowMonths)""",
)
add_fitted(
    "ml12_monthly_auc",
    f"""SELECT BaseMonthStr, {_AUC} AS AUC, count(*) AS N, round({_POSITIVE} / count(*), 6) AS PositiveRate, WindowMonths
    FROM ({_area('WindowMonths, BaseMonthStr')}) GROUP BY WindowMonths, BaseMonthStr""",
)
add(
    "ml11_degenerate_splits",
    "snap",
    f"""SELECT 'no test rows' AS "Case", WindowMonths, CAST(NULL AS DOUBLE) AS OverallAUC, count(*) AS TrainN, CAST(0 AS BIGINT) AS TestN FROM snap GROUP BY 2
    UNION ALL SELECT 'one class', WindowMonths, NULL, CAST(TrainN AS BIGINT), CAST(TestN AS BIGINT) FROM ({_SIZES})""",
)

# Table of the report -> the query that makes it.
_REPORT = {
    "dataset_summary": "agg1_dataset_summary",
    "preprocessing_stats": "aud1_cleaning_audit",
    "yearly_summary": "agg2_yearly_summary",
    "variable_info": "agg3_variable_info",
    "outlier_summary": "agg6_outlier_summary",
    "cluster_summary": "agg7_cluster_summary",
    "auc_summary": "ml12_auc_summary",
    "monthly_auc": "ml12_monthly_auc",
    "mobility_summary": "trn4_mobility",
    "movement_dist": "trn5_movement_distribution",
    "lv3_next_month_ratio": "trn7_transition_ratios",
    "lv3_abc_summary": "tim10_mover_mix_summary",
    "high_m_freq_summary": "drv5_high_monetary",
    "repeat_summary": "drv6_repeat_summary",
    "repeat_dist": "drv6_repeat_distribution",
}
ORACLE["snk2_report"] = "\nUNION ALL ".join(
    f"""SELECT '{name}' AS "Table", c AS "Column", count(*) AS Cells, round(sum(try_cast(v AS DOUBLE)), 3) AS Total,
    min(CASE WHEN try_cast(v AS DOUBLE) IS NULL THEN v END) AS "First", max(CASE WHEN try_cast(v AS DOUBLE) IS NULL THEN v END) AS "Last"
    FROM (UNPIVOT (SELECT COLUMNS(*)::VARCHAR FROM ({ORACLE[key]})) ON COLUMNS(*) INTO NAME c VALUE v) GROUP BY c"""
    for name, key in _REPORT.items()
)

# The results of a whole run with a known model, and their columns by name.
RESULTS = {
    "abc_revenue_share": "ABC_Class,Position,Share",
    "auc_summary": "OverallAUC,TestN,TrainN,WindowMonths",
    "cluster_profile": "Avg_Revenue_Share,Customer_Grade,Customers,Mean_Frequency,Mean_Monetary,Mean_Recency",
    "cluster_summary": "Customer_Grade,Customers,Mean_Frequency,Mean_Monetary,Mean_Recency",
    "correlation": "Corr,Variable1,Variable2",
    "customer_product": "ABC_Class,CustomerID,Customer_Grade,Frequency,Monetary,Quantity,Recency,Revenue,Segment,StockCode",
    "dataset_summary": "CleanCustomers,CleanOrders,CleanRows,CleanSKUs,EndDate,RawRows,RemovedRowsTotal,StartDate,TotalRevenue",
    "describe_lines": "Count,Max,Mean,Median,Min,Q25,Q75,Std,Variable",
    "describe_rfm": "Count,Max,Mean,Median,Min,Q25,Q75,Std,Variable",
    "df_clean": "Country,CustomerID,Description,InvoiceDate,InvoiceNo,Month,MonthStart,Quantity,Revenue,StockCode,UnitPrice,Year,YearMonth",
    "df_dynamic": "Country,CustomerID,Description,InvoiceDate,InvoiceNo,Month,MonthStart,Quantity,Revenue,StockCode,UnitPrice,Year,YearMonth",
    "df_static_filtered": "Country,CustomerID,Description,InvoiceDate,InvoiceNo,Month,MonthStart,Quantity,Revenue,StockCode,UnitPrice,Year,YearMonth",
    "grade_month_revenue": "Lv1.이탈관리,Lv2.관심필요,Lv3.신규성장,Lv4.우수충성,Lv5.최우수VIP,YearMonth",
    "high_m_freq_dist": "Count,FreqGroup_in_HighM,MovementType,Ratio",
    "high_m_freq_summary": "Customers,Down_Rate,FreqGroup_in_HighM,Mean_Frequency,Mean_Monetary,NoActivity_Rate,Obs,Up_Rate",
    "lv3_abc_detail": "A_Share,AnalysisMonth,B_Share,C_Share,CustomerID,MovementType",
    "lv3_abc_summary": "Customers,Mean_A_Share,Mean_B_Share,Mean_C_Share,MovementType,Obs",
    "lv3_next_month_count": "Count,Customer_Grade,NextGrade",
    "lv3_next_month_ratio": "Customer_Grade,NextGrade,Ratio",
    "mobility_summary": "Customer_Grade,Customers,Move_Rate,Obs",
    "monthly_auc": "AUC,BaseMonthStr,N,PositiveRate,WindowMonths",
    "monthly_grade_counts": "AnalysisMonthStr,Lv1.이탈관리,Lv2.관심필요,Lv3.신규성장,Lv4.우수충성,Lv5.최우수VIP",
    "monthly_panel": "AnalysisMonth,AnalysisMonthStr,Cluster,CustomerID,Customer_Grade,FirstPurchaseDate,Frequency,LastPurchaseDate,Monetary,Recency,WindowEnd,WindowStart",
    "monthly_sales": "Revenue,YearMonth",
    "movement_dist": "Count,Customer_Grade,MovementType,Ratio",
    "order_summary": "CustomerID,Customer_Grade,InvoiceNo,OrderRevenue,YearMonth",
    "outlier_summary": "FilteredCustomers,Frequency99Cutoff,Monetary99Cutoff,OriginalCustomers,RemovedCustomers",
    "preprocessing_stats": "Customers,Orders,RemovedRowsFromPreviousStep,Revenue,Rows,Step",
    "product_rank": "ProductRank,Revenue,StockCode",
    "product_sales": "ABC_Class,CumulativeRatio,CumulativeRevenue,Quantity,Revenue,StockCode",
    "repeat_dist": "Count,MovementType,Ratio,RepeatStatus",
    "repeat_summary": "Customers,Down_Rate,Mean_Frequency,Mean_Monetary,Mean_Recency,NoActivity_Rate,Obs,RepeatStatus,Stay_Rate,Up_Rate",
    "rfm_impact_dist": "Count,Group,MovementType,Ratio",
    "rfm_impact_summary": "Customers,Cut,Down_Rate,Group,Mean_Value,NoActivity_Rate,Obs,Up_Rate,Variable",
    "rfm_scored": "CustomerID,F_score,FirstPurchaseDate,Frequency,LastPurchaseDate,M_score,Monetary,RFM_score,R_score,Recency,Segment2",
    "rfm_segmented": "Cluster,CustomerID,Customer_Grade,FirstPurchaseDate,Frequency,LastPurchaseDate,Monetary,Recency",
    "rfm_static": "CustomerID,FirstPurchaseDate,Frequency,LastPurchaseDate,Monetary,Recency",
    "rule_segment_counts": "Count,Segment2",
    "scored_test": "BaseMonth,BaseMonthStr,CustomerID,Frequency,Monetary,PredProb,Recency,TargetBuyNextMonth,WindowMonths",
    "segment_abc": "ABC_Class,Ratio,Revenue,Segment,TotalRevenue",
    "segment_abc_ratio": "A,B,C,Customer_Grade",
    "segment_summary": "AOV,Customer_Grade,Customer_Share,Customers,GradeOrder,Orders,Revenue,Revenue_Share,Revenue_per_Customer",
    "top_products": "ABC_Class,CumulativeRatio,CumulativeRevenue,Quantity,Revenue,StockCode",
    "transition_base": "AnalysisMonth,AnalysisMonthStr,Cluster,CurrentGradeNum,CustomerID,Customer_Grade,FirstPurchaseDate,Frequency,LastPurchaseDate,Monetary,Moved,MovementType,NextGrade,NextGradeNum,Recency,WindowEnd,WindowStart",
    "variable_info": "Column,Dtype,MissingValues,Position,UniqueValues",
    "vip_class_a": "VIP_A,VIP_A_Ratio,VIP_Total",
    "vip_summary": "VIP_Customer_Ratio,VIP_Customers,VIP_Revenue_Ratio",
    "yearly_summary": "Customers,Orders,Revenue,Rows,SKUs,Year",
}
_LISTED = ", ".join(f"('{name}', '{columns}')" for name, columns in RESULTS.items())
add("snk3_result_set", "clean", f"SELECT r AS Result, c AS Columns, (SELECT count(*) FROM clean) AS CleanRows FROM (VALUES {_LISTED}) v(r, c)")

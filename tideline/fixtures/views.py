"""Loan, rate, price and curve views derived from the TPC-H-like tables.

Each view is one SELECT in the dialect both engines share, so the SQL oracle can
inline the very text Spark runs. ``{table}`` names a base table and ``{steps33}``
a set-returning 1..33.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, tuple[list[str], str]] = {
    "f_month": ([], """
SELECT DISTINCT CAST(year(o_orderdate)*100+month(o_orderdate) AS BIGINT) AS yyyymm,
       CAST(year(o_orderdate)*12+month(o_orderdate) AS BIGINT) AS mi,
       CAST(month(o_orderdate)*10000+year(o_orderdate) AS BIGINT) AS mmyyyy
FROM {orders}"""),
    "f_market_rate": (["f_month"], """
SELECT yyyymm, mi, mmyyyy, CAST(3.0 + (mi % 37)*0.125 AS DOUBLE) AS rate_30yr FROM f_month"""),
    "f_hpi": ([], """
SELECT DISTINCT CAST(c.c_nationkey AS BIGINT) AS zip3,
       CAST(year(o.o_orderdate)*100+month(o.o_orderdate) AS BIGINT) AS yyyymm,
       CAST(100 + c.c_nationkey + (year(o.o_orderdate)*12+month(o.o_orderdate)-23940)*0.5 AS DOUBLE) AS hpi
FROM {customer} c JOIN {orders} o ON c.c_custkey = o.o_custkey"""),
    "f_loan_month": ([], """
SELECT CAST(o_custkey AS BIGINT) AS loan_id,
       CAST(year(o_orderdate)*100+month(o_orderdate) AS BIGINT) AS yyyymm,
       CAST(year(o_orderdate)*12+month(o_orderdate) AS BIGINT) AS mi,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amt
FROM {orders} GROUP BY 1, 2, 3"""),
    "f_loan_rank": (["f_loan_month"], """
SELECT m.loan_id, m.yyyymm, m.mi, m.amt,
       row_number() OVER (PARTITION BY loan_id ORDER BY yyyymm DESC) AS rd,
       min(yyyymm) OVER (PARTITION BY loan_id) AS orig_ym,
       min(mi) OVER (PARTITION BY loan_id) AS orig_mi,
       first_value(amt) OVER (PARTITION BY loan_id ORDER BY yyyymm) AS orig_upb
FROM f_loan_month m"""),
    "f_loan": (["f_loan_rank"], """
SELECT r.loan_id, r.yyyymm, r.mi,
       CAST((r.yyyymm % 100)*10000 + CAST(floor(r.yyyymm/100.0) AS BIGINT) AS BIGINT) AS mmyyyy,
       CAST(2.5 + (r.loan_id % 17)*0.25 AS DOUBLE) AS note_rate,
       CASE WHEN r.rd=1 AND r.loan_id % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE r.amt END AS upb,
       r.orig_ym, r.orig_upb,
       CASE WHEN r.rd=1 AND r.loan_id % 3 = 0 THEN NULL ELSE r.mi-r.orig_mi-1 END AS file_age,
       CAST(c.c_nationkey AS BIGINT) AS zip3,
       CASE WHEN r.loan_id % 10 = 0 THEN NULL ELSE CAST(600+(r.loan_id*7)%240 AS BIGINT) END AS fico,
       CAST(50 + r.loan_id % 46 AS DOUBLE) AS ltv,
       CAST(15+(r.loan_id*3)%36 AS BIGINT) AS dti,
       CASE r.loan_id % 4 WHEN 0 THEN 'R' WHEN 1 THEN 'C' WHEN 2 THEN 'P' ELSE 'U' END AS purpose,
       CASE r.loan_id % 5 WHEN 0 THEN 'SF' WHEN 1 THEN 'PU' WHEN 2 THEN 'CO' WHEN 3 THEN 'MH' ELSE 'XX' END AS property_type,
       CASE WHEN r.rd=1 AND r.loan_id % 3 = 0 THEN CAST(1 AS BIGINT)
            WHEN r.rd=1 AND r.loan_id % 31 = 0 THEN CAST(9 AS BIGINT) END AS zbc,
       CONCAT(CAST(CAST(floor(r.orig_ym/100.0) AS BIGINT) AS VARCHAR(4)), 'Q',
              CAST(CAST(floor(((r.orig_ym % 100)-1)/3.0)+1 AS BIGINT) AS VARCHAR(1))) AS vintage
FROM f_loan_rank r JOIN {customer} c ON c.c_custkey = r.loan_id"""),
    "f_price": ([], """
SELECT CAST(2.5 + (l_suppkey % 9)*0.5 AS DOUBLE) AS coupon,
       CAST(year(l_shipdate)*100+month(l_shipdate) AS BIGINT) AS yyyymm,
       CAST(year(l_shipdate)*12+month(l_shipdate) AS BIGINT) AS mi,
       CAST(85 + avg(l_quantity)/2 AS DOUBLE) AS price
FROM {lineitem} GROUP BY 1, 2, 3"""),
    "f_day": ([], """
SELECT DISTINCT CAST(l_shipdate AS DATE) AS d,
       CAST(year(l_shipdate)*100+month(l_shipdate) AS BIGINT) AS yyyymm,
       CAST(year(l_shipdate)*12+month(l_shipdate) AS BIGINT) AS mi,
       CAST(year(l_shipdate)*372+month(l_shipdate)*31+day(l_shipdate) AS BIGINT) AS k
FROM {lineitem}"""),
    "f_curve_daily": (["f_day"], """
SELECT d, yyyymm, mi, m1, m3, m6, y1, y2, CAST((2*y2+y5)/3 AS DOUBLE) AS y3, y5, CAST((3*y5+2*y10)/5 AS DOUBLE) AS y7, y10,
       CAST(y10 + 0.05 + (k%39)*0.004 AS DOUBLE) AS y20, CAST(y10 + 0.1 + (k%41)*0.005 AS DOUBLE) AS y30
FROM (SELECT d, yyyymm, mi, k,
       CAST(1.50+(k%13)*0.0625 AS DOUBLE) AS m1, CAST(1.60+(k%17)*0.0625 AS DOUBLE) AS m3,
       CAST(1.75+(k%19)*0.0625 AS DOUBLE) AS m6, CAST(1.90+(k%23)*0.0625 AS DOUBLE) AS y1,
       CAST(2.00+(k%29)*0.0625 AS DOUBLE) AS y2, CAST(2.50+(k%31)*0.0625 AS DOUBLE) AS y5,
       CAST(3.00+(k%37)*0.0625 AS DOUBLE) AS y10
FROM f_day) c"""),
    "f_forecast": (["f_price", "f_market_rate"], """
SELECT p.coupon, p.yyyymm, m.mi, m.rate_30yr,
       CAST(0.02 + greatest(p.coupon+0.5-m.rate_30yr,0)*0.03
            + ((m.mi*7+CAST(p.coupon*26 AS BIGINT))%11)*0.003 AS DOUBLE) AS forecast_cpr
FROM f_price p JOIN f_market_rate m ON p.yyyymm = m.yyyymm"""),
    "f_path": ([], """
SELECT path_id, t, CAST(4.0 + ((path_id*31 + t*17)%23)*0.05 AS DOUBLE) AS rate
FROM (SELECT CAST(p_partkey AS BIGINT) AS path_id, {steps33} AS t FROM {part}) s"""),
}

#: Views with a row per day, month, (coupon, month) or (region, month): as small as the calendar. They are written once to the
#: shared folder of a session, so that no plan scans a large table again for each place that reads them.
CALENDAR = ("f_month", "f_hpi", "f_price", "f_day")

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _closure(names, ready=()) -> list[str]:
    """The views and what they read, in order; ``ready`` ones need nothing else."""
    seen: list[str] = []

    def visit(name: str) -> None:
        for dep in VIEWS[name][0] if name not in ready else ():
            visit(dep)
        if name not in seen:
            seen.append(name)

    for n in names:
        visit(n)
    return seen


def _ctes(names, binding: dict[str, str]) -> str:
    return ",\n".join(f"{n} AS ({VIEWS[n][1].format_map(binding)})" for n in _closure(names))


def oracle(names: str, body: str) -> str:
    """DuckDB text: the named views as CTEs followed by ``body``."""
    binding = {t: t for t in TABLES} | {"steps33": "unnest(range(1, 34))"}
    head = _ctes(names.split(), binding)
    text = body.strip()
    if not head:
        return text
    for opening in ("WITH RECURSIVE ", "WITH "):
        if text.upper().startswith(opening):
            return opening + head + ",\n" + text[len(opening):]
    return f"WITH {head}\n{text}"


class Fixtures:
    """The same views as Spark DataFrames over one scale-factor folder.

    Base tables are registered once per session and folder, so file footers are
    read once; a view is analysed once per query, and a calendar view is read from
    the shared folder.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._views: dict[str, DataFrame] = {}

    def _registered(self, name: str) -> str:
        """Temporary view over one parquet table of this folder."""
        folder = hashlib.md5(self.sf_dir.encode()).hexdigest()[:10]
        view = f"base_{folder}_{name}"
        if not self.spark.catalog.tableExists(view):
            self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").createOrReplaceTempView(view)
        return view

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self._registered(name))

    def _dealt(self, name: str) -> str:
        """Temporary view over the rows of a table dealt over all cores, for a view that multiplies them."""
        view = self._registered(name) + "_dealt"
        if not self.spark.catalog.tableExists(view):
            key = self.table(name).columns[0]
            n = 2 * self.spark.sparkContext.defaultParallelism
            self.table(name).repartition(n, key).createOrReplaceTempView(view)
        return view

    def _sql(self, name: str, ready: dict[str, str]) -> DataFrame:
        """The view, with the ``ready`` ones read from the views of the session that they name."""
        names = [n for n in _closure([name], ready) if n not in ready]
        used = {t for n in names for t in TABLES if "{" + t + "}" in VIEWS[n][1]}
        binding = {t: self._dealt(t) if "{steps33}" in VIEWS[name][1] else self._registered(t) for t in used} | {"steps33": "explode(sequence(1L, 33L))"}
        heads = [f"{n} AS (SELECT * FROM {v})" for n, v in ready.items() if n in _closure([name], ready)]
        heads += [f"{n} AS ({VIEWS[n][1].format_map(binding)})" for n in names]
        return self.spark.sql(f"WITH {', '.join(heads)} SELECT * FROM {name}")

    def _calendar(self, name: str) -> str:
        """Temporary view over the written rows of a calendar view."""
        from tideline.catalog.memo import written

        path = written(self, name, lambda to: self._sql(name, {}).write.parquet(to))
        view = f"written_{name}_{hashlib.md5(path.encode()).hexdigest()[:10]}"
        if not self.spark.catalog.tableExists(view):
            self.spark.read.parquet(path).createOrReplaceTempView(view)
        return view

    def view(self, name: str) -> DataFrame:
        if name not in self._views:
            ready = {n: self._calendar(n) for n in _closure([name], CALENDAR) if n in CALENDAR}
            self._views[name] = self._sql(name, ready)
        return self._views[name]

    def __getattr__(self, name: str) -> DataFrame:
        if f"f_{name}" in VIEWS:
            return self.view(f"f_{name}")
        raise AttributeError(name)

"""Deterministically dirtied views of the clean driver tables, as SQL that Spark and DuckDB both read.

Where the engines spell integer division differently, {div} stands for the operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.session import table

VIEWS: dict[str, tuple[str, str]] = {
    "dirty_customer": (
        "customer",
        """select c_custkey, case when c_custkey % 11 = 0 then null when c_custkey % 7 = 0 then concat('  ', c_name, ' ')
           when c_custkey % 13 = 0 then '' when c_custkey % 17 = 0 then concat(c_name, chr(1))
           when c_custkey % 19 = 0 then concat('Café', c_name) else c_name end as name_raw from {t}""",
    ),
    "text_orders": (
        "orders",
        """select o_orderkey, case when o_orderkey % 41 = 0 then null when o_orderkey % 31 = 0 then '' when o_orderkey % 37 = 0 then '  '
           when o_orderkey % 10 = 0 then concat(' ', cast(o_orderkey as varchar(20)), ' ')
           when o_orderkey % 23 = 0 then concat(cast(o_orderkey as varchar(20)), '.0')
           when o_orderkey % 29 = 0 then concat('1_', cast(o_orderkey as varchar(20)))
           else cast(o_orderkey as varchar(20)) end as key_raw from {t}""",
    ),
    "fk_probe": (
        "orders",
        """select o_orderkey, case when o_orderkey % 17 = 0 then null when o_orderkey % 13 = 0 then concat('missing-', cast(o_custkey as varchar(20)))
           else concat('Customer#', lpad(cast(o_custkey as varchar(20)), 9, '0')) end as customer_business_key from {t}""",
    ),
    "replay_events": (
        "events",
        """select event_id, user_id, event_type, 1 as attempt from {t}
           union all select event_id, user_id, event_type, 2 as attempt from {t} where event_id % 5 = 0
           union all select event_id, user_id, concat(event_type, '-changed') as event_type, 3 as attempt from {t} where event_id % 50 = 0""",
    ),
    "decimal_text": (
        "lineitem",
        """select l_orderkey, l_linenumber, case when l_orderkey % 43 = 0 then 'abc' else concat(
             case when cents >= 100000 then concat(cast(cents {div} 100000 as varchar(20)), '.', lpad(cast(cents {div} 100 % 1000 as varchar(20)), 3, '0'))
                  else cast(cents {div} 100 as varchar(20)) end, ',', lpad(cast(cents % 100 as varchar(20)), 2, '0')) end as price_raw
           from (select l_orderkey, l_linenumber, cast(round(l_extendedprice * 100) as bigint) as cents from {t}) q""",
    ),
    "order_dates_text": (
        "orders",
        """select o_orderkey, case when o_orderkey % 47 = 0 then '03/04/2026' when o_orderkey % 53 = 0 then ''
           else cast(cast(o_orderdate as date) as varchar(20)) end as date_raw from {t}""",
    ),
    "formula_text": (
        "documents",
        """select doc_id, concat(case when doc_id % 9 = 0 then '=' when doc_id % 14 = 0 then concat(chr(9), '@') else '' end, text) as cell from {t}""",
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, sql = VIEWS[name]
    return spark.sql(sql.replace("{div}", "div"), t=table(spark, sf_dir, base))


def duck(name: str) -> str:
    """The view as a subquery for DuckDB."""
    base, sql = VIEWS[name]
    return "(" + sql.replace("{div}", "//").replace("{t}", base) + ")"

"""Rule reports."""

import json

from pyspark.sql import functions as F

from tidemark.operators import validation as V
from tidemark.operators.rules import rules_from_dict
from tidemark_queries.cleaning import TEXTS, number_texts
from tidemark_queries.hashing import DUPLICATED, NULLED, duplicated, nulled
from tidemark_queries.registry import fresh_dir, query, table

REPORT = ("column", "rule", "severity", "violations")


def _report(df, rules):
    return V.validate(df, rules_from_dict(rules)).select(
        F.coalesce("column", F.lit("-")).alias("column"), *REPORT[1:]
    )


def _sql(source, *issues):
    """Report rows from ``(column, rule, severity, count expression)``, empty ones left out."""
    rows = " union all ".join(
        f"""select '{column}' as "column", '{rule}' as rule, '{severity}' as severity,
                   cast({count} as bigint) as violations from {source}"""
        for column, rule, severity, count in issues
    )
    return f"select * from ({rows}) where violations > 0"


@query("v1_min_rows", _sql("customer", ("-", "min_rows", "error", "100000000 - count(*)")))
def min_rows(spark, sf_dir):
    return _report(table(spark, sf_dir, "customer"), {"min_rows": 100_000_000, "max_rows": None})


@query("v2_max_rows", _sql("customer", ("-", "max_rows", "warning", "count(*) - 10")))
def max_rows(spark, sf_dir):
    return _report(table(spark, sf_dir, "customer"), {"min_rows": 1, "max_rows": 10})


@query(
    "v3_required_column",
    _sql(
        "part",
        ("p_container", "required_column", "error", "least(count(*), 1)"),
        ("p_size", "max_value", "error", "count(*) filter (where p_size > 25)"),
    ),
)
def required_column(spark, sf_dir):
    rules = {
        "columns": [
            {"name": "p_container"},
            {"name": "p_comment", "required": False},
            {"name": "p_size", "max_value": 25},
        ]
    }
    return _report(table(spark, sf_dir, "part"), rules)


@query(
    "v4_extra_columns",
    _sql(
        "supplier",
        ("-", "extra_columns", "warning", "2 * least(count(*), 1)"),
        ("s_acctbal", "min_value", "error", "count(*) filter (where s_acctbal < 100)"),
    ),
)
def extra_columns(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier").withColumn("_sys_row_hash", F.lit("x"))
    rules = {
        "allow_extra_columns": False,
        "columns": [{"name": "s_suppkey"}, {"name": "s_acctbal", "min_value": 100}],
    }
    return _report(supplier, rules)


@query(
    "v5_unique_key",
    _sql(
        DUPLICATED,
        (
            "l_orderkey, l_linenumber",
            "unique_constraint",
            "error",
            "count(*) - count(distinct (l_orderkey, l_linenumber))",
        ),
    ),
)
def unique_key(spark, sf_dir):
    rules = {"require_unique": ["l_orderkey", "l_linenumber", "absent"]}
    return _report(duplicated(spark, sf_dir), rules)


@query(
    "v6_not_nullable",
    _sql(
        NULLED,
        ("event_type", "nullable", "error", "count(*) filter (where event_type is null)"),
        ("value", "nullable", "error", "count(*) filter (where value is null)"),
    ),
)
def not_nullable(spark, sf_dir):
    names = ("event_id", "event_type", "value")
    return _report(
        nulled(spark, sf_dir), {"columns": [{"name": n, "nullable": False} for n in names]}
    )


@query(
    "v7_max_null_fraction",
    _sql(
        NULLED,
        *[
            (
                name,
                "max_null_fraction",
                "error",
                f"case when avg(({name} is null)::int) > {limit} "
                f"then count(*) - count({name}) else 0 end",
            )
            for name, limit in (("value", 0.1), ("event_type", 0.3))
        ],
    ),
)
def max_null_fraction(spark, sf_dir):
    rules = {
        "columns": [
            {"name": "value", "max_null_fraction": 0.1},
            {"name": "event_type", "max_null_fraction": 0.3},
        ]
    }
    return _report(nulled(spark, sf_dir), rules)


@query(
    "v8_type",
    _sql(
        "lineitem",
        ("l_suppkey", "dtype", "warning", "least(count(*), 1)"),
        ("l_tax", "max_value", "error", "count(*) filter (where l_tax > 0.05)"),
    ),
)
def declared_type(spark, sf_dir):
    rules = {
        "columns": [
            {"name": "l_orderkey", "dtype": "int64"},
            {"name": "l_returnflag", "dtype": "object"},
            {"name": "l_suppkey", "dtype": "float64"},
            {"name": "l_tax", "dtype": "double", "max_value": 0.05},
        ]
    }
    return _report(table(spark, sf_dir, "lineitem"), rules)


_NUMBER = "try_cast(few_bad as double)"


@query(
    "v9_min_value",
    _sql(
        TEXTS,
        ("few_bad", "min_value", "error", f"count(*) filter (where {_NUMBER} < 50)"),
        ("user_id", "min_value", "error", "count(*) filter (where user_id < 20)"),
    ),
)
def min_value(spark, sf_dir):
    rules = {
        "columns": [
            {"name": "few_bad", "min_value": 50},
            {"name": "user_id", "min_value": 20},
            {"name": "event_id", "min_value": 0},
        ]
    }
    return _report(number_texts(spark, sf_dir), rules)


@query(
    "v10_max_value",
    _sql(TEXTS, ("few_bad", "max_value", "error", f"count(*) filter (where {_NUMBER} > 200)")),
)
def max_value(spark, sf_dir):
    rules = {"columns": [{"name": "few_bad", "max_value": 200}]}
    return _report(number_texts(spark, sf_dir), rules)


@query(
    "v11_allowed_values_of_a_table",
    _sql(
        "lineitem",
        (
            "l_partkey",
            "allowed_values",
            "error",
            """count(*) filter (where l_partkey not in (
                   select p_partkey from part where p_partkey % 3 > 0))""",
        ),
        (
            "l_returnflag",
            "allowed_values",
            "error",
            "count(*) filter (where l_returnflag not in (select substr(o_orderstatus, 1, 1) from orders))",
        ),
        ("l_linestatus", "allowed_values", "error", "count(*)"),
        ("l_quantity", "min_value", "error", "count(*) filter (where l_quantity < 10)"),
    ),
)
def allowed_values_of_a_table(spark, sf_dir):
    """Lists as long as a table: keys of two thirds of the parts, texts, and numbers for a text."""
    part = table(spark, sf_dir, "part").filter("p_partkey % 3 > 0").select("p_partkey")
    allowed = {
        "l_partkey": part.unionAll(part),
        "l_returnflag": table(spark, sf_dir, "orders").select(F.substring("o_orderstatus", 1, 1)),
        "l_linestatus": part,
        "l_orderkey": table(spark, sf_dir, "orders").select("o_orderkey"),
        "no_column": part,
    }
    rules = rules_from_dict({"columns": [{"name": "l_quantity", "min_value": 10}]})
    report = V.validate(table(spark, sf_dir, "lineitem"), rules, allowed)
    return report.select(F.coalesce("column", F.lit("-")).alias("column"), *REPORT[1:])


@query(
    "v18_split_rows_by_a_table",
    """select l_orderkey, l_linenumber,
              case when l_partkey in (select p_partkey from part where p_partkey % 3 > 0)
                   then '' else 'l_partkey:allowed_values' end
              || case when l_quantity < 10 then 'l_quantity:min_value' else '' end as reasons
       from lineitem""",
)
def split_rows_by_a_table(spark, sf_dir):
    allowed = {"l_partkey": table(spark, sf_dir, "part").filter("p_partkey % 3 > 0").select("p_partkey")}
    rules = rules_from_dict({"columns": [{"name": "l_quantity", "min_value": 10}]})
    good, bad = V.split_rows(table(spark, sf_dir, "lineitem"), rules, allowed)
    keys = ["l_orderkey", "l_linenumber"]
    return good.select(*keys, F.lit("").alias("reasons")).unionAll(
        bad.select(*keys, F.concat_ws("", "_sys_reasons").alias("reasons"))
    )


@query(
    "v11_allowed_values",
    _sql(
        "lineitem",
        (
            "l_returnflag",
            "allowed_values",
            "error",
            "count(*) filter (where l_returnflag not in ('A', 'N'))",
        ),
        (
            "l_linenumber",
            "allowed_values",
            "error",
            "count(*) filter (where l_linenumber not in (1, 2, 3))",
        ),
    ),
)
def allowed_values(spark, sf_dir):
    rules = {
        "columns": [
            {"name": "l_returnflag", "allowed_values": ["A", "N"]},
            {"name": "l_linenumber", "allowed_values": [1, 2, 3, "4"]},
            {"name": "l_linestatus", "allowed_values": []},
        ]
    }
    return _report(table(spark, sf_dir, "lineitem"), rules)


@query(
    "v12_regex_pattern",
    _sql(
        NULLED,
        (
            "event_type",
            "regex_pattern",
            "error",
            "count(*) filter (where not regexp_matches(event_type, '^(?:c|[p-z])'))",
        ),
    ),
)
def regex_pattern(spark, sf_dir):
    rules = {"columns": [{"name": "event_type", "regex_pattern": "c|[p-z]"}]}
    return _report(nulled(spark, sf_dir), rules)


@query(
    "v13_min_length",
    _sql(
        NULLED,
        ("event_type", "min_length", "error", "count(*) filter (where length(event_type) < 6)"),
    ),
)
def min_length(spark, sf_dir):
    return _report(
        nulled(spark, sf_dir), {"columns": [{"name": "event_type", "min_length": 6}]}
    )


@query(
    "v14_max_length",
    _sql(
        "documents",
        ("text", "max_length", "warning", "count(*) filter (where length(text) > 400)"),
    ),
)
def max_length(spark, sf_dir):
    return _report(
        table(spark, sf_dir, "documents"), {"columns": [{"name": "text", "max_length": 400}]}
    )


ALL_RULES = {
    "allow_extra_columns": False,
    "min_rows": 1,
    "max_rows": 100,
    "require_unique": ["event_id"],
    "columns": [
        {"name": "event_id", "dtype": "int64", "nullable": False},
        {"name": "user_id", "dtype": "object", "min_value": 5},
        {"name": "event_type", "nullable": False, "allowed_values": ["click", "view"]},
        {"name": "value", "max_value": 400, "max_null_fraction": 0.05},
        {"name": "props", "regex_pattern": r"\{", "min_length": 8, "max_length": 9},
    ],
}


@query(
    "v15_report_summary",
    f"""select false as passed,
               (count(*) filter (where user_id < 5) > 0)::bigint
               + (count(*) filter (where event_type is null) > 0)::bigint
               + (count(*) filter (where event_type not in ('click', 'view')) > 0)::bigint
               + (count(*) filter (where value > 400) > 0)::bigint
               + (avg((value is null)::int) > 0.05)::bigint
               + (count(*) filter (where length(props) < 8) > 0)::bigint as errors,
               (count(*) > 100)::bigint + 2
               + (count(*) filter (where length(props) > 9) > 0)::bigint as warnings,
               errors + warnings as total_issues
        from {NULLED}""",
)
def report_summary(spark, sf_dir):
    return V.report_summary(V.validate(nulled(spark, sf_dir), rules_from_dict(ALL_RULES)))


@query(
    "v18_split_rows",
    f"""select event_id, case when reasons = '' then 'good' else 'rejected' end as part, reasons
        from (select event_id, concat_ws(',',
                  case when user_id < 5 then 'user_id:min_value' end,
                  case when event_type is null then 'event_type:nullable' end,
                  case when event_type not in ('click', 'view')
                       then 'event_type:allowed_values' end,
                  case when value > 400 then 'value:max_value' end,
                  case when length(props) < 8 then 'props:min_length' end) as reasons
              from {NULLED})""",
)
def split_rows(spark, sf_dir):
    good, rejected = V.split_rows(nulled(spark, sf_dir), rules_from_dict(ALL_RULES))
    return good.select(
        "event_id", F.lit("good").alias("part"), F.lit("").alias("reasons")
    ).unionAll(
        rejected.select(
            "event_id", F.lit("rejected"), F.array_join("_sys_reasons", ",").alias("reasons")
        )
    )


@query(
    "v17_rules_from_json",
    """select 'c_acctbal' as "column", 'min_value' as rule, count(*) filter (where c_acctbal < 0) as violations
       from customer having count(*) filter (where c_acctbal < 0) > 0
       union all
       select 'c_name', 'max_length', count(*) filter (where length(c_name) > 10) from customer
       having count(*) filter (where length(c_name) > 10) > 0""",
)
def rules_from_json(spark, sf_dir):
    """Rules as JSON text on storage, one unknown key of which is an error."""
    content = {
        "columns": [
            {"name": "c_acctbal", "min_value": 0},
            {"name": "c_name", "max_length": 10},
        ]
    }
    path = fresh_dir(spark, "rules")
    spark.createDataFrame([(json.dumps(content),)], "value string").write.text(path)
    loaded = json.loads(spark.read.option("wholetext", True).text(path).first()["value"])
    try:
        rules_from_dict({**loaded, "unknown": 1})
    except (TypeError, ValueError):
        pass
    else:
        raise AssertionError("an unknown key was taken")
    found = V.validate(table(spark, sf_dir, "customer"), rules_from_dict(loaded))
    return found.select("column", "rule", "violations")

"""Checking a frame against declared rules.

Every rule on rows is one conditional aggregate, so all of them together are one pass without a
shuffle by key. Only the unique key needs one. Rules on the schema need no data at all.
"""

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import to_number
from tidemark.functions.typenames import canonical_type
from tidemark.names import data_columns, is_system, quoted

ERROR, WARNING = "error", "warning"

ISSUE_SCHEMA = T.StructType(
    [
        T.StructField("column", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("violations", T.LongType()),
        T.StructField("message", T.StringType()),
    ]
)


class ValidationFailed(ValueError):
    """A table broke a rule of severity error."""


@dataclass(frozen=True)
class Check:
    """One rule on one column: an aggregate that counts its violations."""

    column: str | None
    rule: str
    severity: str
    violations: Column
    text: str


def _allowed(column, data_type, values):
    """Membership by value and kind: a text never equals a number, as in pandas."""
    if isinstance(data_type, T.BooleanType):
        fitting = [v for v in values if isinstance(v, bool)]
    elif isinstance(data_type, T.NumericType):
        fitting = [v for v in values if isinstance(v, (int, float)) and not isinstance(v, bool)]
    elif isinstance(data_type, T.StringType):
        fitting = [v for v in values if isinstance(v, str)]
    else:
        column, fitting = column.cast("string"), [str(v) for v in values]
    return column.isin(fitting) if fitting else F.lit(False)


def row_predicates(rule, data_type):
    """``{rule name: predicate}`` true for a row that breaks a row-level rule."""
    column = F.col(quoted(rule.name))
    text = column.cast("string")
    number = to_number(column, data_type)
    found = {}
    if not rule.nullable:
        found["nullable"] = column.isNull()
    if rule.min_value is not None:
        found["min_value"] = number < F.lit(rule.min_value)
    if rule.max_value is not None:
        found["max_value"] = number > F.lit(rule.max_value)
    if rule.allowed_values:
        found["allowed_values"] = column.isNotNull() & ~_allowed(
            column, data_type, rule.allowed_values
        )
    if rule.regex_pattern:
        # Anchored at the start only.
        found["regex_pattern"] = ~text.rlike(f"^(?:{rule.regex_pattern})")
    if rule.min_length is not None:
        found["min_length"] = F.length(text) < rule.min_length
    if rule.max_length is not None:
        found["max_length"] = F.length(text) > rule.max_length
    return found


def _row_text(rule, name):
    limit = getattr(rule, name)
    return {
        "nullable": "null values in a column that allows none",
        "min_value": f"values below {limit}",
        "max_value": f"values above {limit}",
        "allowed_values": _OUTSIDE,
        "regex_pattern": f"values that do not match {limit}",
        "min_length": f"values shorter than {limit}",
        "max_length": f"values longer than {limit}",
    }[name]


def _severity(rule_name):
    return WARNING if rule_name in ("max_rows", "extra_columns", "dtype", "max_length") else ERROR


def aggregate_checks(df, rules):
    """Checks that one aggregate over the rows answers."""
    rows = F.count(F.lit(1))
    checks = []
    if rules.min_rows is not None:
        missing = F.greatest(F.lit(rules.min_rows) - rows, F.lit(0))
        checks.append(("min_rows", None, missing, f"rows missing to {rules.min_rows}"))
    if rules.max_rows is not None:
        beyond = F.greatest(rows - F.lit(rules.max_rows), F.lit(0))
        checks.append(("max_rows", None, beyond, f"rows beyond {rules.max_rows}"))
    for rule in rules.columns:
        if rule.name not in df.columns:
            continue
        nulls = F.count_if(F.col(quoted(rule.name)).isNull())
        for name, broken in row_predicates(rule, df.schema[rule.name].dataType).items():
            checks.append((name, rule.name, F.count_if(broken), _row_text(rule, name)))
        if rule.max_null_fraction is not None:
            over = F.try_divide(nulls, rows) > rule.max_null_fraction
            checks.append(
                (
                    "max_null_fraction",
                    rule.name,
                    F.when(over, nulls).otherwise(0),
                    f"null values, a fraction above {rule.max_null_fraction}",
                )
            )
    return [
        Check(column, name, _severity(name), count.cast("bigint"), text)
        for name, column, count, text in checks
    ]


def schema_issues(df, rules):
    """Issues that follow from the schema alone, as rows of the report."""
    present, issues = set(df.columns), []
    for rule in rules.columns:
        if rule.required and rule.name not in present:
            issues.append((rule.name, "required_column", 1, "required column is missing"))
    if not rules.allow_extra_columns:
        declared = {rule.name for rule in rules.columns}
        extra = sorted(name for name in data_columns(df) if name not in declared)
        if extra:
            text = "columns not declared: " + ", ".join(extra)
            issues.append((None, "extra_columns", len(extra), text))
    for rule in rules.columns:
        if rule.dtype is None or rule.name not in present:
            continue
        wanted = canonical_type(rule.dtype)
        actual = df.schema[rule.name].dataType.simpleString()
        if wanted != actual:
            issues.append((rule.name, "dtype", 1, f"type is {actual}, declared {rule.dtype}"))
    return [(c, name, _severity(name), n, text) for c, name, n, text in issues]


def unique_key_columns(df, rules):
    return [name for name in rules.require_unique or () if name in df.columns]


def unique_key_violations(df, keys):
    """One row ``violations``: rows beyond the first of every key; null keys are equal."""
    groups = df.groupBy(*[F.col(quoted(name)) for name in keys]).agg(
        F.count(F.lit(1)).alias("n")
    )
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))


def _kind(data_type):
    """Values of one kind compare; a text never equals a number."""
    kinds = ((T.BooleanType, "boolean"), (T.NumericType, "number"), (T.StringType, "text"))
    return next((k for t, k in kinds if isinstance(data_type, t)), data_type.simpleString())


def allowed_set(df, name, allowed):
    """The different values of the frame ``allowed`` (one column) as column ``_allowed``.

    None of another kind than the column's is in it, and no null.
    """
    (field,) = allowed.schema.fields
    values = allowed.select(F.col(quoted(field.name)).alias("_allowed"))
    if _kind(field.dataType) != _kind(df.schema[name].dataType):
        values = values.limit(0).select(F.lit(None).cast(df.schema[name].dataType).alias("_allowed"))
    return values.where("_allowed IS NOT NULL").distinct()


def membership_violations(df, name, allowed):
    """One row ``violations``: rows with a value that the frame ``allowed`` does not hold.

    Rows are first counted by value, which combines on the map side, and only the different values
    are joined. Spark broadcasts the allowed ones by their size alone; nothing becomes a literal list.
    """
    values = df.where(F.col(quoted(name)).isNotNull()).groupBy(F.col(quoted(name)).alias("_value"))
    counted = values.agg(F.count(F.lit(1)).alias("n"))
    known = allowed_set(df, name, allowed)
    unknown = counted.join(known, F.col("_value") == F.col("_allowed"), "left_anti")
    return unknown.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))


_OUTSIDE = "values outside the allowed set"


def _issue(column, rule, severity, violations, text):
    return F.struct(
        F.lit(column).cast("string").alias("column"),
        F.lit(rule).alias("rule"),
        F.lit(severity).alias("severity"),
        violations.cast("bigint").alias("violations"),
        F.lit(text).alias("message"),
    )


def validate(df, rules, allowed=None):
    """Report frame ``column, rule, severity, violations, message``; no row means all is well.

    ``allowed`` maps columns to frames of one column that hold their allowed values, of any number.
    """
    checks = aggregate_checks(df, rules)
    measured = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[check.violations.alias(f"_m{i}") for i, check in enumerate(checks)],
    )
    issues = [
        _issue(c.column, c.rule, c.severity, F.col(f"_m{i}"), c.text)
        for i, c in enumerate(checks)
    ] + [
        _issue(column, rule, severity, F.lit(n), text)
        for column, rule, severity, n, text in schema_issues(df, rules)
    ]
    keys = unique_key_columns(df, rules)
    report = None
    if issues:
        report = measured.select(F.inline(F.array(*issues)))
    if keys:
        text = "rows repeat the key " + ", ".join(keys)
        unique = unique_key_violations(df, keys).select(
            F.inline(
                F.array(
                    _issue(
                        ", ".join(keys), "unique_constraint", ERROR, F.col("violations"), text
                    )
                )
            )
        )
        report = unique if report is None else report.unionByName(unique)
    for name, values in (allowed or {}).items():
        if name in df.columns:
            issue = _issue(name, "allowed_values", ERROR, F.col("violations"), _OUTSIDE)
            member = membership_violations(df, name, values).select(F.inline(F.array(issue)))
            report = member if report is None else report.unionByName(member)
    if report is None:
        return df.sparkSession.createDataFrame([], ISSUE_SCHEMA)
    return report.filter("violations > 0").withColumn(
        "message",
        F.when(F.col("rule").isin("required_column", "extra_columns", "dtype"), F.col("message"))
        .otherwise(F.concat_ws(" ", F.col("violations").cast("string"), F.col("message"))),
    )


def report_summary(issues):
    """One row: passed, errors, warnings, total issues."""
    errors = F.count_if(F.col("severity") == ERROR)
    return issues.agg(
        (errors == 0).alias("passed"),
        errors.alias("errors"),
        F.count_if(F.col("severity") == WARNING).alias("warnings"),
        F.count(F.lit(1)).alias("total_issues"),
    )


def require_valid(issues):
    """Raise ``ValidationFailed`` when the report holds an error.

    The report has at most one row per rule and column, so it is collected whole.
    """
    rows = issues.collect()
    broken = [row for row in rows if row["severity"] == ERROR]
    if broken:
        raise ValidationFailed(
            "; ".join(f"{row['column'] or 'table'}: {row['message']}" for row in broken)
        )
    return rows


def split_rows(df, rules, allowed=None):
    """``(good, rejected)``: rows that break no row-level rule of severity error, and the
    others with an array column ``_sys_reasons`` of ``column:rule``.

    ``allowed`` is as in ``validate``; its frames are joined to the rows by value."""
    reasons, columns = [], df.columns
    for i, (name, values) in enumerate((allowed or {}).items()):
        if name in columns:
            known = allowed_set(df, name, values).select(F.col("_allowed").alias(f"_allowed{i}"))
            df = df.join(known, F.col(quoted(name)) == F.col(f"_allowed{i}"), "left")
            outside = F.col(quoted(name)).isNotNull() & F.col(f"_allowed{i}").isNull()
            reasons.append(F.when(outside, F.lit(f"{name}:allowed_values")))
    for rule in rules.columns:
        if rule.name not in df.columns or is_system(rule.name):
            continue
        for name, broken in row_predicates(rule, df.schema[rule.name].dataType).items():
            if _severity(name) == ERROR:
                reasons.append(F.when(broken, F.lit(f"{rule.name}:{name}")))
    if not reasons:
        return df, df.withColumn("_sys_reasons", F.array().cast("array<string>")).limit(0)
    marked = df.withColumn("_sys_reasons", F.array_compact(F.array(*reasons)))
    marked = marked.select(*[F.col(quoted(name)) for name in columns], "_sys_reasons")
    good = marked.filter(F.size("_sys_reasons") == 0).drop("_sys_reasons")
    return good, marked.filter(F.size("_sys_reasons") > 0)

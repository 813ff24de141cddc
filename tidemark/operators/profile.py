"""Column statistics of a frame."""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import to_number
from tidemark.names import data_columns, quoted

_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)
_NUMBERS = (T.NumericType, T.BooleanType)

PROFILE_SCHEMA = (
    "column string, type string, rows bigint, null_count bigint, null_fraction double, "
    "unique_count bigint, is_numeric boolean, min_value double, max_value double, "
    "mean_value double, std_value double, min_time timestamp, max_time timestamp"
)


def _measures(i, field):
    column = F.col(quoted(field.name))
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        column = F.when(~F.isnan(column), column)
    found = [F.count(column).alias(f"present{i}")]
    if isinstance(field.dataType, _TIMES):
        return found + [
            F.min(column.cast("timestamp")).alias(f"tmin{i}"),
            F.max(column.cast("timestamp")).alias(f"tmax{i}"),
        ]
    if isinstance(field.dataType, (*_NUMBERS, T.StringType)):
        number = to_number(column, field.dataType)
        found += [
            F.count(number).alias(f"numbers{i}"),
            F.min(number).alias(f"min{i}"),
            F.max(number).alias(f"max{i}"),
            F.avg(number).alias(f"avg{i}"),
            F.stddev_samp(number).alias(f"std{i}"),
        ]
    return found


def _unique_counts(df, names):
    """Exact number of different non-null values per column.

    Distinct (column, value) pairs combine on the map side, so a value that is frequent reaches
    the shuffle once per task, and no row is copied whole for each of its columns.
    """
    if not names:
        return {}
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("i"), comparable(df.schema[name]).alias("v"))
            for i, name in enumerate(names)
        ]
    )
    values = df.select(F.inline(pairs)).where("v IS NOT NULL").distinct()
    counts = {row["i"]: row["count"] for row in values.groupBy("i").count().collect()}
    return {name: counts.get(i, 0) for i, name in enumerate(names)}


def comparable(field):
    """Text that is equal for equal values: NaN is null, zero has no sign."""
    column = F.col(quoted(field.name))
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(column), column + F.lit(0.0)).cast("string")
    if isinstance(field.dataType, T.BinaryType):
        return F.hex(column)
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(column)
    return column.cast("string")


def profile(df, columns=None, unique="exact"):
    """One row per column: type, nulls, unique count, and number or time range.

    One pass and one result row answer all but the unique counts. ``unique`` says how these are
    found: ``"exact"`` by a second pass, ``"approximate"`` by sketches in the first, ``None``
    leaves them out. Columns are numeric when more than half of their non-null values convert,
    and then all figures are of the converted values.
    """
    if unique not in ("exact", "approximate", None):
        raise ValueError("unique must be 'exact', 'approximate' or None")
    names = list(columns) if columns is not None else data_columns(df)
    fields = [df.schema[name] for name in names]
    measures = [m for i, field in enumerate(fields) for m in _measures(i, field)]
    if unique == "approximate":
        measures += [
            F.approx_count_distinct(F.col(quoted(name))).alias(f"u{i}")
            for i, name in enumerate(names)
        ]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *measures).first().asDict()
    total = row["rows"]
    counts = {}
    if unique == "approximate":
        counts = {name: row[f"u{i}"] for i, name in enumerate(names)}
    elif unique == "exact":
        counts = _unique_counts(df, names)
    result = []
    for i, field in enumerate(fields):
        present = row[f"present{i}"]
        numeric = row.get(f"numbers{i}", 0) * 2 > present
        figures = [row[f"{m}{i}"] if numeric else None for m in ("min", "max", "avg", "std")]
        result.append(
            (
                field.name,
                field.dataType.simpleString(),
                total,
                total - present,
                (total - present) / total if total else 0.0,
                counts.get(field.name),
                numeric,
                *figures,
                row.get(f"tmin{i}"),
                row.get(f"tmax{i}"),
            )
        )
    return df.sparkSession.createDataFrame(result, PROFILE_SCHEMA)


def top_values(df, columns=None, n=5):
    """The ``n`` most frequent values per text column: ``column, value, count, rank``.

    Ties go to the smaller value. The count combines on the map side, and the rank filter is
    applied per task before the rows of a column meet.
    """
    if columns is None:
        columns = [
            name
            for name in data_columns(df)
            if isinstance(df.schema[name].dataType, T.StringType)
        ]
    if not columns:
        return df.sparkSession.createDataFrame(
            [], "column string, value string, count bigint, rank int"
        )
    texts = df.select(*[F.col(quoted(n_)).cast("string").alias(n_) for n_ in columns])
    counts = (
        texts.unpivot([], [F.col(quoted(n_)) for n_ in columns], "column", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .count()
    )
    order = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def top_values_of_non_numeric(df, profiled, n=5):
    """Top values of the columns that a profile found to be text and not numbers."""
    texts = [
        row["column"]
        for row in profiled.filter("type = 'string' and not is_numeric").select("column").collect()
    ]
    return top_values(df, texts, n)


def type_distribution(df):
    """Number of columns per base type, from the column names and types of ``df``."""
    schema = schema_rows(df)
    base = F.regexp_extract("type", r"^[^\[(<]*", 0).alias("base_type")
    return schema.groupBy(base).agg(F.count(F.lit(1)).alias("columns"))


def schema_rows(df):
    """``position, column, type`` of a frame's schema."""
    return df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "position int, column string, type string",
    )

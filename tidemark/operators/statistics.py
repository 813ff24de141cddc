"""Column statistics that unite: states of parts of a table give those of the whole without its rows.

A state has one row for each column: counts, range, mean and sum of squared deviations, and a sketch
of its different values. Counts add up and ranges widen; means and squared deviations unite by

    mean = sum(n * mean) / sum(n)
    squares = sum(squares) + sum(n * (mean of the part - mean)**2)

which loses no digits to large sums of squares, and sketches (HyperLogLog) unite register by register.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import to_number
from tidemark.names import data_columns, quoted
from tidemark.operators.profile import comparable

#: Sketch size: 2**12 registers, a standard error of about 1.6 %.
REGISTERS = 12

STATE_SCHEMA = T.StructType(
    [
        T.StructField("column", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("present", T.LongType()),
        T.StructField("numbers", T.LongType()),
        T.StructField("min_value", T.DoubleType()),
        T.StructField("max_value", T.DoubleType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("squares", T.DoubleType()),
        T.StructField("min_time", T.TimestampType()),
        T.StructField("max_time", T.TimestampType()),
        T.StructField("sketch", T.BinaryType()),
    ]
)
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _measures(df, name, registers):
    field = df.schema[name]
    value = F.col(quoted(name))
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        value = F.when(~F.isnan(value), value)
    number = to_number(value, field.dataType)
    time = isinstance(field.dataType, _TIMES)
    moment = value.cast("timestamp") if time else F.lit(None).cast("timestamp")
    return {
        "present": F.count(value),
        "numbers": F.count(number),
        "min_value": F.min(number),
        "max_value": F.max(number),
        "mean": F.avg(number),
        # Population variance of n values is their squared deviations over n.
        "squares": F.var_pop(number) * F.count(number),
        "min_time": F.min(moment),
        "max_time": F.max(moment),
        "sketch": F.hll_sketch_agg(comparable(field), F.lit(registers)),
    }


def column_states(df, columns=None, by=(), registers=REGISTERS):
    """The state of every column, as one aggregate: one row for each column (and each value of ``by``)."""
    names = [n for n in (columns if columns is not None else data_columns(df)) if n not in by]
    if not names:
        raise ValueError("no column to describe")
    measures = {(i, m): c for i, n in enumerate(names) for m, c in _measures(df, n, registers).items()}
    counted = df.groupBy(*[F.col(quoted(c)) for c in by]).agg(
        F.count(F.lit(1)).alias("_rows"), *[c.alias(f"_{m}{i}") for (i, m), c in measures.items()]
    )
    states = []
    for i, name in enumerate(names):
        facts = {
            "column": F.lit(name),
            "type": F.lit(df.schema[name].dataType.simpleString()),
            "rows": F.col("_rows"),
            **{m: F.col(f"_{m}{i}") for j, m in measures if j == i},
        }
        states.append(
            F.struct(*[facts[f.name].cast(f.dataType).alias(f.name) for f in STATE_SCHEMA.fields])
        )
    return counted.select(*[F.col(quoted(c)) for c in by], F.inline(F.array(*states)))


def united(states, by=()):
    """One state for each column from those of its parts."""
    keys = [*by, "column"]
    n = F.col("numbers")
    part = Window.partitionBy(*keys)
    whole = F.sum(n * F.col("mean")).over(part) / F.nullif(F.sum(n).over(part), F.lit(0))
    apart = F.col("mean") - F.col("_mean")
    return (
        states.withColumn("_mean", whole)
        .groupBy(*keys)
        .agg(
            F.max("type").alias("type"),
            *[F.sum(c).alias(c) for c in ("rows", "present", "numbers")],
            F.min("min_value").alias("min_value"),
            F.max("max_value").alias("max_value"),
            F.max("_mean").alias("mean"),
            (F.sum("squares") + F.sum(n * apart * apart)).alias("squares"),
            F.min("min_time").alias("min_time"),
            F.max("max_time").alias("max_time"),
            F.hll_union_agg("sketch", True).alias("sketch"),
        )
        .select(*by, *STATE_SCHEMA.names)
    )


def estimate(sketch):
    """Estimated number of different values, from the sketch's registers alone.

    A sketch that was built in one go knows more than its registers; united with itself it does
    not, so that equal registers give equal estimates however they came together.
    """
    return F.hll_sketch_estimate(F.hll_union(sketch, sketch))


def profile_of(states):
    """The columns of ``profile`` from states; unique counts are estimates."""
    numeric = F.col("numbers") * 2 > F.col("present")

    def figure(column):
        return F.when(numeric, column)

    deviation = F.sqrt(F.col("squares") / F.nullif(F.col("numbers") - 1, F.lit(0)))
    nulls = F.col("rows") - F.col("present")
    return states.select(
        "column",
        "type",
        "rows",
        nulls.alias("null_count"),
        F.coalesce(F.try_divide(nulls, F.col("rows")), F.lit(0.0)).alias("null_fraction"),
        estimate(F.col("sketch")).alias("unique_count"),
        numeric.alias("is_numeric"),
        figure(F.col("min_value")).alias("min_value"),
        figure(F.col("max_value")).alias("max_value"),
        figure(F.col("mean")).alias("mean_value"),
        figure(deviation).alias("std_value"),
        "min_time",
        "max_time",
    )

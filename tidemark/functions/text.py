"""Text helpers: strip, number recognition, Unicode normal forms."""

import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space as Python's str.strip sees it, and what counts as a number.
WHITE_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INTEGRAL = r"^\s*[+-]?\d+\s*$"
NORMAL_FORMS = ("NFC", "NFD", "NFKC", "NFKD")


def stripped(column):
    """Both ends without any Unicode white space; the text ``nan`` becomes null."""
    bare = F.regexp_replace(column, f"^{WHITE_SPACE}+|{WHITE_SPACE}+$", "")
    return F.nullif(bare, F.lit("nan"))


def to_number(column, data_type):
    """Value as double, or null where it is no number. Dates and nested types never are."""
    if isinstance(data_type, T.BooleanType):
        return column.cast("int").cast("double")
    if isinstance(data_type, T.NumericType):
        value = column.cast("double")
        return F.when(~F.isnan(value), value)
    if isinstance(data_type, T.StringType):
        # The pattern guards the cast: Spark alone would accept texts such as "1d".
        return F.when(column.rlike(NUMBER), column.try_cast("double"))
    return F.lit(None).cast("double")


def convertible_to_number(column, data_type):
    if isinstance(data_type, T.BooleanType):
        return column.isNotNull()
    if isinstance(data_type, T.StringType):
        return F.coalesce(column.rlike(NUMBER), F.lit(False))
    return to_number(column, data_type).isNotNull()


def to_whole_number(column):
    """Text as bigint, or null: no fraction, no exponent, nothing beyond 64 bits.

    The pattern comes first because a cast that fails costs far more than a match that does.
    """
    return F.when(column.rlike(INTEGRAL), column.try_cast("bigint"))


# Fixed value: values that are Python objects at a time.
VALUES_AT_ONCE = 500


def _normal_form_udf(form):
    # Nested so that the function travels by value and workers need no package install.
    at_once = VALUES_AT_ONCE

    @F.arrow_udf(T.StringType())
    def normalize(values: pa.Array) -> pa.Array:
        parts = [
            pa.array(
                [v if v is None else unicodedata.normalize(form, v) for v in values.slice(lo, at_once).to_pylist()],
                values.type,
            )
            for lo in range(0, len(values), at_once)
        ]
        return pa.concat_arrays(parts) if parts else values

    return normalize


def normalized_text(columns, form="NFC"):
    """Columns in a Unicode normal form.

    Spark has no such function, so this is the one Arrow UDF of the library. Pure ASCII
    values are the same in every form: they are sent over as nulls and taken from the
    original column, which leaves Python only the values that may change.
    """
    if form not in NORMAL_FORMS:
        raise ValueError(f"unknown normal form {form!r}, use one of {NORMAL_FORMS}")
    udf = _normal_form_udf(form)
    return [
        F.coalesce(udf(F.when(column.rlike(r"[^\x00-\x7F]"), column)), column)
        for column in columns
    ]

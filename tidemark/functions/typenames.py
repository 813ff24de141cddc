"""Type names: the declared names, pandas dtype names and Spark's own."""

import json

from pyspark.sql import types as T

# Type names accepted in column files and name:type pairs.
TYPE_NAMES = {
    "string": T.StringType(),
    "str": T.StringType(),
    "varchar": T.StringType(),
    "text": T.StringType(),
    "int": T.IntegerType(),
    "integer": T.IntegerType(),
    "int32": T.IntegerType(),
    "long": T.LongType(),
    "int64": T.LongType(),
    "bigint": T.LongType(),
    "float": T.FloatType(),
    "float32": T.FloatType(),
    "double": T.DoubleType(),
    "float64": T.DoubleType(),
    "boolean": T.BooleanType(),
    "bool": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
}

# Further names met in rule files written for pandas.
PANDAS_NAMES = {
    "object": "string",
    "int8": "tinyint",
    "int16": "smallint",
    "datetime64[ns]": "timestamp",
    "datetime64[us]": "timestamp",
    "datetime64[ns, utc]": "timestamp",
}


def canonical_type(name):
    """Spark ``simpleString`` of a declared type name; unknown names stay as they are."""
    plain = name.strip().lower()
    if plain in TYPE_NAMES:
        return TYPE_NAMES[plain].simpleString()
    return PANDAS_NAMES.get(plain, plain)


def parse_type(name):
    plain = name.strip().lower()
    if plain == "object":
        plain = "string"
    if plain not in TYPE_NAMES:
        raise ValueError(f"unsupported type {name!r}, use one of {sorted(TYPE_NAMES)}")
    return TYPE_NAMES[plain]


def schema_from_pairs(pairs):
    """Schema from ``{"name": "type"}`` or ``["name:type", ...]``; all nullable."""
    if not isinstance(pairs, dict):
        pairs = dict(item.split(":", 1) for item in pairs)
    return T.StructType([T.StructField(n, parse_type(t), True) for n, t in pairs.items()])


def schema_from_file(path):
    """Schema from a JSON column file: a list, or an object with a ``columns`` list."""
    with open(path, encoding="utf-8") as handle:
        content = json.load(handle)
    columns = content.get("columns") if isinstance(content, dict) else content
    if not isinstance(columns, list):
        raise ValueError(f"no list of columns in {path}")
    return T.StructType(
        [
            T.StructField(
                item["name"],
                parse_type(item.get("type") or item.get("dtype") or "string"),
                bool(item.get("nullable", True)),
            )
            for item in columns
        ]
    )


def base_type_name(type_name):
    """Type name before the first ``[``, ``(`` or ``<``."""
    for mark in "[(<":
        type_name = type_name.split(mark)[0]
    return type_name

"""Reading files into DataFrames: format from the path, defaults, many sources, samples."""

import math
import os
import re
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.files import cut_lineage
from tidemark.functions.hashing import row_text
from tidemark.functions.text import convertible_to_number, to_whole_number
from tidemark.names import data_columns, quoted
from tidemark.operators.cleaning import unique_names
from tidemark.sources.quoted import inside_splits, may_hold_line_breaks, records

# File endings and the format they stand for.
SUFFIXES = {
    ".csv": "csv",
    ".tsv": "tsv",
    ".parquet": "parquet",
    ".json": "json",
    ".jsonl": "jsonl",
    ".ndjson": "jsonl",
}
FORMATS = ("csv", "tsv", "parquet", "json", "jsonl")


def detect_format(path):
    """Format by file ending, the same for every scheme and for globs."""
    suffix = os.path.splitext(urlparse(path).path.rstrip("/"))[1].lower()
    if suffix not in SUFFIXES:
        raise ValueError(f"cannot tell the format of {path}, pass it explicitly")
    return SUFFIXES[suffix]


def spark_path(path):
    """``s3://`` is spelled ``s3a://`` for the Hadoop file system; others stay."""
    if isinstance(path, (list, tuple)):
        return [spark_path(p) for p in path]
    return "s3a://" + path[5:] if path.startswith("s3://") else path


def read_source(spark, path, source_format=None, schema=None, options=None):
    """DataFrame of one source, or of several paths alike. ``options`` go to Spark's reader and override the defaults."""
    kind = source_format or detect_format(path)
    path, options = spark_path(path), dict(options or {})
    if kind == "csv":
        return read_csv(spark, path, schema, options)
    if kind == "tsv":
        return read_csv(spark, path, schema, {"sep": "\t", **options})
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "parquet":
        return reader.options(**options).parquet(path)
    if kind == "json":
        return reader.options(**{"multiLine": "true", **options}).json(path)
    if kind == "jsonl":
        return reader.options(**options).json(path)
    raise ValueError(f"unknown format {kind!r}, use one of {FORMATS}")


# --- delimited text -------------------------------------------------------------------

# Texts that mean a missing value in delimited files, as pandas reads them.
NULL_TEXTS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)
_BAD_LINE = "_sys_bad_line"


def _csv_options(options):
    given = {key: str(value) for key, value in options.items()}
    # A quote within quotes is written twice.
    return {"header": "true", "escape": '"', **given}


def _first_line(spark, path, options):
    first = spark.read.options(**{**options, "header": "false"}).csv(path).first()
    return [] if first is None else list(first)


def csv_columns(spark, path, options):
    """Column names from the first line; names that repeat or are empty get a number."""
    options = _csv_options(options)
    first = _first_line(spark, path, options)
    if options["header"].lower() != "true":
        return [f"_c{i}" for i in range(len(first))]
    return unique_names([name or f"unnamed_{i}" for i, name in enumerate(first)])


def _values_in_line(line, options):
    """Number of values in a raw line: separators outside quotes, and one."""
    quote, escape = re.escape(options.get("quote", '"')), re.escape(options["escape"])
    escaped = "" if escape == quote else f"{escape}.|"
    # Unrolled, as Java keeps a stack frame for every turn of a choice.
    plain = f"[^{quote}{escape}]*+"
    quoted_value = f"{quote}{plain}(?:(?:{escaped}{quote}{quote}){plain})*+{quote}"
    bare = F.regexp_replace(line, F.lit(quoted_value), F.lit(""))
    separator = options.get("sep", options.get("delimiter", ","))
    without = F.replace(bare, F.lit(separator))
    return (F.length(bare) - F.length(without)) / len(separator) + 1


def _raw_rows(spark, path, schema, options, settings):
    """Rows of text by Spark's reader, or by its parser from records with line breaks in quotes."""
    inside = None
    multiline = options.get("multiLine", options.get("multiline", "false")).lower() == "true"
    if not multiline and may_hold_line_breaks(spark, path, options):
        inside = inside_splits(spark, path, options)
    if inside is None:
        return spark.read.options(**settings).schema(schema).csv(path)
    found = records(spark, path, options, inside)
    text = F.regexp_replace("text", "\r$", "")
    if options["header"].lower() == "true":
        # All files must have the header of the first, quoted or not.
        bare = F.replace(text, F.lit(options.get("quote", '"')), F.lit(""))
        head = found.where("first").select(bare.alias("text")).first()["text"]
        other = F.raise_error(F.lit("files of one path have different headers")).cast("boolean")
        found = found.where(F.when(F.col("first") & (bare != head), other).otherwise(~F.col("first")))
    names = ", ".join(f"{quoted(field.name)} STRING" for field in schema.fields)
    parsed = F.from_csv(text, names, {**settings, "header": "false", "multiLine": "true"})
    return found.where(text != "").select(parsed.alias("r")).select("r.*")


def _csv_texts(spark, path, names, options, keep_bad):
    """All values as text, missing ones null, lines with too many values left out.

    Only a line with another number of values than columns is kept whole by the reader; short
    ones among them stay and end in nulls, as pandas has it, long ones go.
    """
    options = _csv_options(options)
    # Spark compares every file's header with these names, unless they are not those of a header.
    same = options["header"].lower() == "true" and _first_line(spark, path, options) == list(names)
    fields = [T.StructField(name, T.StringType()) for name in [*names, _BAD_LINE]]
    settings = {
        **options,
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": _BAD_LINE,
        "enforceSchema": str(not same).lower(),
        # Lines are checked whole, also when few columns are selected.
        "columnPruning": "false",
    }
    raw = _raw_rows(spark, path, T.StructType(fields), options, settings)
    null_texts = ["", options["nullValue"]] if "nullValue" in options else list(NULL_TEXTS)
    line = F.col(_BAD_LINE)
    # Spark reads the raw line only together with a value, even where a count needs none.
    has_values = F.length(F.coalesce(F.col(quoted(names[-1])), F.lit(""))) >= 0
    too_long = has_values & F.coalesce(
        _values_in_line(line, options) > len(names), F.lit(False)
    )
    values = [
        F.when(~F.col(quoted(name)).isin(null_texts), F.col(quoted(name))).alias(name)
        for name in names
    ]
    if keep_bad:
        return raw.select(*values, too_long.alias(_BAD_LINE))
    return raw.filter(~too_long).select(*values)


def _inferred_types(texts):
    """Type of every text column, from one aggregate: bigint, double, boolean or string."""
    measures = []
    for i, name in enumerate(texts.columns):
        column = F.col(quoted(name))
        measures += [
            F.count(column).alias(f"present{i}"),
            F.count(to_whole_number(column)).alias(f"whole{i}"),
            F.count_if(convertible_to_number(column, T.StringType())).alias(f"number{i}"),
            F.count_if(F.lower(column).isin("true", "false")).alias(f"truth{i}"),
        ]
    row = texts.agg(*measures).first()
    kinds = (("whole", T.LongType()), ("number", T.DoubleType()), ("truth", T.BooleanType()))
    types = []
    for i in range(len(texts.columns)):
        present = row[f"present{i}"]
        fitting = [kind for name, kind in kinds if present and row[f"{name}{i}"] == present]
        types.append(fitting[0] if fitting else T.StringType())
    return types


def read_csv(spark, path, schema=None, options=None):
    """Delimited text. Lines with too many values are left out, short ones end in nulls.

    Values may be quoted, with quotes in them written twice. Files of one path whose headers differ
    are refused; read them as separate sources, which are joined by name. Values may hold line breaks
    within quotes; files are split over tasks all the same. A quote that is never closed is refused.

    Without a schema one further pass finds the types; dates stay text, as in pandas. With one,
    a value that does not fit its type is null.
    """
    options = dict(options or {})
    names = schema.fieldNames() if schema is not None else csv_columns(spark, path, options)
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    texts = _csv_texts(spark, path, names, options, keep_bad=False)
    types = (
        [field.dataType for field in schema.fields]
        if schema is not None
        else _inferred_types(texts)
    )
    return texts.select(
        *[
            F.col(quoted(name))
            if isinstance(kind, T.StringType)
            else F.col(quoted(name)).try_cast(kind).alias(name)
            for name, kind in zip(names, types)
        ]
    )


def count_bad_lines(spark, path, source_format="csv", options=None):
    """Number of lines with too many values."""
    options = dict(options or {})
    if source_format == "tsv":
        options = {"sep": "\t", **options}
    names = csv_columns(spark, path, options)
    return _csv_texts(spark, path, names, options, keep_bad=True).filter(_BAD_LINE).count()


# --- several sources, samples ---------------------------------------------------------


def union_sources(frames):
    """Outer union by column name; columns a source lacks are null.

    A column with types that have no common number type becomes text in all sources.
    """
    types = {}
    for frame in frames:
        for field in frame.schema.fields:
            types.setdefault(field.name, set()).add(field.dataType)

    def as_text(name):
        kinds = types[name]
        return len(kinds) > 1 and not all(isinstance(k, T.NumericType) for k in kinds)

    result = None
    for frame in frames:
        frame = frame.select(
            *[
                F.col(quoted(n)).cast("string").alias(n) if as_text(n) else F.col(quoted(n))
                for n in frame.columns
            ]
        )
        result = frame if result is None else result.unionByName(frame, allowMissingColumns=True)
    return result


def read_many(spark, paths, source_format=None, options=None):
    """Several sources as one frame.

    Sources of one format and schema are read together: one reader, one inference and one scan for
    each group, however many paths there are.
    """
    groups = {}
    for path in paths:
        groups.setdefault(source_format or detect_format(path), []).append(spark_path(path))
    frames = []
    for kind, members in groups.items():
        frames += _read_group(spark, kind, members, dict(options or {}))
    return union_sources(frames)


def _read_group(spark, kind, paths, options):
    """Frames of all sources of one format."""
    if kind == "parquet":
        try:
            # Footers are read and united by tasks; columns that a file lacks are null.
            return [spark.read.options(**{**options, "mergeSchema": "true"}).parquet(*paths)]
        except (PySparkException, Py4JJavaError) as failed:
            if "CANNOT_MERGE_SCHEMAS" not in str(failed):
                raise
            alike = {}
            for path in paths:
                schema = spark.read.options(**options).parquet(path).schema
                alike.setdefault(schema.json(), (schema, []))[1].append(path)
            return [
                spark.read.options(**options).schema(schema).parquet(*members)
                for schema, members in alike.values()
            ]
    if kind in ("csv", "tsv"):
        options = {"sep": "\t", **options} if kind == "tsv" else options
        return [read_csv(spark, members, None, options) for members in _by_header(spark, paths, options)]
    return [read_source(spark, paths, kind, options=options)]


def _by_header(spark, paths, options):
    """Files in groups of one header line, found by one scan that keeps a line of each file."""
    if _csv_options(options)["header"].lower() != "true":
        return [paths]
    lines = spark.read.text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    first = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"))
    groups = {}
    for row in sorted(first.collect(), key=lambda r: r["file"]):
        groups.setdefault(row["header"], []).append(unquote(row["file"]))
    return list(groups.values())


def sample_rows(df, n, key=None, seed=42):
    """``n`` rows chosen by hash order: the same rows on every run and any layout.

    A count gives the share of the hash range that holds ``n`` rows and some more; it is widened
    until it does. Only the rows in that range are sorted, over many tasks, and numbered by the
    sizes of the sorted partitions. Rows of equal key are alike, so any of them may be taken. All
    rows when the frame has no more than ``n``.
    """
    names = list(key) if key else data_columns(df)
    place = F.md5(F.concat(F.lit(f"{seed}|"), row_text(df, names, framed=True)))
    marked = df.withColumn("_sys_place", place)
    total, share = df.count(), 1.0
    if n < total:
        share = (n + 8 * math.sqrt(n) + 64) / total
        while share < 1 and marked.filter(_below(share)).count() < n:
            share *= 2
    if share < 1:
        marked = marked.filter(_below(share))
    # Equal places lie side by side; a second number spreads them over the sorted partitions.
    marked = marked.withColumn("_sys_tie", F.monotonically_increasing_id())
    ordered = cut_lineage(
        marked.repartitionByRange("_sys_place", "_sys_tie")
        .sortWithinPartitions("_sys_place", "_sys_tie")
        .withColumn("_sys_number", F.monotonically_increasing_id())
        .withColumn("_sys_part", F.shiftright("_sys_number", 33))
    )
    sizes = ordered.groupBy("_sys_part").count()
    # One row per partition.
    before = Window.orderBy("_sys_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_sys_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_sys_before"))
    within = F.col("_sys_number") - F.shiftleft(F.col("_sys_part"), 33)
    taken = ordered.join(sizes, "_sys_part").filter(within + F.col("_sys_before") < n)
    return taken.select(*[F.col(quoted(name)) for name in df.columns])


def _below(share):
    """Rows whose place is in the lowest share of the hash range."""
    place = F.conv(F.substring("_sys_place", 1, 12), 16, 10).cast("bigint")
    return place < int(share * 2**48)


def sample_fraction(df, fraction, seed=42):
    """About ``fraction`` of the rows, with no sort at all."""
    return df.sample(fraction=fraction, seed=seed)

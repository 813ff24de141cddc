"""What was read: one row per ingest."""

from pyspark.sql import functions as F

from tidemark.functions.hashing import checksum_numbers, row_hash, summed
from tidemark.operators.profile import schema_rows

__all__ = ["checksum", "manifest", "schema_rows", "source_bytes"]


def checksum(df, columns=None):
    """One row ``row_count, checksum``: order-free checksum of the content of a frame."""
    hashed = df.select(row_hash(df, columns).alias("h"))
    numbers = [number.alias(f"n{i}") for i, number in enumerate(checksum_numbers(F.col("h")))]
    found = hashed.select(*numbers)
    return found.agg(
        F.count(F.lit(1)).alias("row_count"), summed(found.columns, "-").alias("checksum")
    )


def source_bytes(df):
    """One row ``size_bytes, files``: size of the files a file-backed frame reads.

    Reads file metadata columns only; rows of a file combine on the map side. Files without a
    single row do not count.
    """
    files = df.groupBy("_metadata.file_path").agg(F.max("_metadata.file_size").alias("size"))
    return files.agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("size_bytes"),
        F.count(F.lit(1)).alias("files"),
    )


def manifest(df, source_uri, source_type, ingested_at, source_count=1, size_bytes=None):
    """One row: where the rows came from, how many, their checksum and schema.

    ``df`` is the frame as read. Its checksum and row count are one aggregate. Sizes of file
    sources come from ``source_bytes`` and are passed in.
    """
    if source_count > 1:
        source_uri = f"multi:{source_count} sources"
    schema = [
        part for name, kind in df.dtypes for part in (F.lit(name), F.lit(kind))
    ]
    return checksum(df).select(
        F.lit(source_uri).alias("source_uri"),
        F.lit(source_type).alias("source_type"),
        F.lit(ingested_at).cast("timestamp").alias("ingested_at"),
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        F.lit(size_bytes).cast("bigint").alias("size_bytes"),
        "checksum",
        F.create_map(*schema).alias("schema_snapshot"),
        F.lit(source_count).alias("source_count"),
    )

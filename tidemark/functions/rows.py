"""One-row frames for metadata, built from literals so that no data leaves the JVM."""

from datetime import datetime, timezone

from pyspark.sql import functions as F
from pyspark.sql import types as T


def utc(at=None):
    """A time without zone, in UTC; now by default. Metadata knows no other times."""
    if at is None:
        at = datetime.now(timezone.utc)
    if at.tzinfo is not None:
        at = at.astimezone(timezone.utc).replace(tzinfo=None)
    return at


def _literal(value, kind):
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.TimestampType):
        elapsed = utc(value) - datetime(1970, 1, 1)
        seconds = elapsed.days * 86_400 + elapsed.seconds
        return F.timestamp_micros(F.lit(seconds * 1_000_000 + elapsed.microseconds))
    if isinstance(kind, T.ArrayType):
        return F.array(*[F.lit(item) for item in value]).cast(kind)
    if isinstance(kind, T.MapType):
        return F.create_map(*[F.lit(part) for item in value.items() for part in item]).cast(kind)
    return F.lit(value).cast(kind)


def one_row(spark, values, schema):
    columns = [
        _literal(value, field.dataType).alias(field.name)
        for value, field in zip(values, schema.fields, strict=True)
    ]
    return spark.range(0, 1, 1, 1).select(*columns)

"""Partition transforms: identity, bucket, truncate and the calendar units."""

import re
from dataclasses import dataclass

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.names import SYSTEM_PREFIX, quoted

_PARTITIONABLE = (
    T.StringType,
    T.BooleanType,
    T.DateType,
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
)
_CALENDAR = ("year", "month", "day", "hour")


@dataclass(frozen=True)
class PartitionBy:
    """A partition column: ``identity``, ``bucket[N]``, ``truncate[N]`` or a calendar unit."""

    column: str
    transform: str = "identity"

    @property
    def directory(self):
        """Name of the stored partition column."""
        if self.transform == "identity":
            return self.column
        return SYSTEM_PREFIX + re.sub(r"\W+", "_", f"p_{self.transform}_{self.column}")

    @property
    def width(self):
        found = re.fullmatch(r"(?:bucket|truncate)\[(\d+)\]", self.transform)
        if not found or int(found.group(1)) < 1:
            raise ValueError(f"bad partition transform {self.transform!r}")
        return int(found.group(1))


def partition_value(spec, data_type):
    """Column expression of the partition value of ``spec`` for a column of ``data_type``."""
    column = F.col(quoted(spec.column))
    if spec.transform == "identity":
        if not isinstance(data_type, _PARTITIONABLE):
            raise ValueError(f"cannot partition by {spec.column} {data_type.simpleString()}")
        return column
    if spec.transform in _CALENDAR:
        # Counted since 1970 like the calendar transforms of table formats: text-free ints.
        if spec.transform == "year":
            return F.year(column) - 1970
        if spec.transform == "month":
            return (F.year(column) - 1970) * 12 + F.month(column) - 1
        if spec.transform == "day":
            return F.unix_date(column.cast("date"))
        return F.floor(F.unix_seconds(column.cast("timestamp")) / 3600).cast("int")
    if spec.transform.startswith("bucket"):
        return F.pmod(F.xxhash64(column), F.lit(spec.width)).cast("int")
    if spec.transform.startswith("truncate"):
        if isinstance(data_type, T.StringType):
            return F.substring(column, 1, spec.width)
        return column - F.pmod(column, F.lit(spec.width).cast(data_type))
    raise ValueError(f"unknown partition transform {spec.transform!r}")


def partition_type(spec, data_type):
    """Type of the stored partition column."""
    if spec.transform == "identity" or spec.transform.startswith("truncate"):
        return data_type
    return T.IntegerType()

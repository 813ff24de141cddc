"""Joins against a set of keys in which the other side may have hot keys."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.names import quoted


def key_set(df, name, alias=None):
    """Distinct values of a text or binary column, as the right side of a semi or anti join.

    Copies are combined before the shuffle. The value is then written anew: Spark no longer
    knows the rows as partitioned by it and shuffles them once more, keys only. That lets
    adaptive execution see a plain shuffle on both sides of the join and split a hot key of the
    left side over many tasks, which it does not do above an aggregate.
    """
    distinct = df.select(F.col(quoted(name)).alias("_key")).distinct()
    binary = isinstance(distinct.schema["_key"].dataType, T.BinaryType)
    nothing = F.lit(bytearray()) if binary else F.lit("")
    return distinct.select(F.concat(F.col("_key"), nothing).alias(alias or name))

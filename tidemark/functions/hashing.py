"""Row hashes built from Spark's own string and digest functions."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.names import data_columns, quoted

# Separator and null token of the hashed row text.
SEPARATOR = "|"
NULL_TOKEN = "<NA>"

_DIGESTS = {
    "md5": F.md5,
    "sha1": F.sha1,
    "sha256": lambda text: F.sha2(text, 256),
}


def hash_columns(df, columns=None):
    """Columns a row hash is built from.

    A given list keeps its order. The default is every data column sorted by name, so two
    frames with the same columns in another order hash alike.
    """
    if columns:
        missing = [name for name in columns if name not in df.columns]
        if missing:
            raise ValueError(f"hash columns not in the frame: {missing}")
        return list(columns)
    found = sorted(data_columns(df))
    if not found:
        raise ValueError("no data column left to hash")
    return found


def _value_text(df, name):
    kind = df.schema[name].dataType
    value = F.col(quoted(name))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        value = F.when(~F.isnan(value), value)
    if isinstance(kind, T.BinaryType):
        return F.hex(value)
    return value.cast("string")


def row_text(df, columns=None, framed=False):
    """Text of a row: values joined by ``|``, nulls as ``<NA>``.

    ``framed=True`` writes name and value of every column that is not null instead, each after
    its length, in the order of names. No two different rows share such a text, and a column that
    is null does not matter, so rows hash alike before and after it comes or goes.
    """
    names = hash_columns(df, columns)
    if framed:
        parts = []
        for name in sorted(names):
            text = _value_text(df, name)
            tagged = F.concat(F.lit(f"{len(name)}:{name}"), F.length(text), F.lit(":"), text)
            parts.append(F.coalesce(tagged, F.lit("")))
        return F.concat(*parts)
    return F.concat_ws(
        SEPARATOR,
        *[F.coalesce(_value_text(df, name), F.lit(NULL_TOKEN)) for name in names],
    )


def row_hash(df, columns=None, algorithm="sha256", framed=False):
    """Hex digest of the row text as a column expression of ``df``."""
    if algorithm not in _DIGESTS:
        raise ValueError(f"unknown hash {algorithm!r}, use one of {sorted(_DIGESTS)}")
    return _DIGESTS[algorithm](row_text(df, columns, framed))


def checksum_numbers(hash_text):
    """The four numbers of 64 bits that the digits of a hex hash are."""
    groups = [F.substring(hash_text, at, 16) for at in range(1, 65, 16)]
    return [F.conv(group, 16, 10).cast("decimal(20,0)") for group in groups]


def proof_numbers(df, names):
    """Two 64-bit hashes of a row with different seeds; ``names`` as for ``content_proof``."""
    parts = []
    for name in sorted(names, key=names.get):
        column = F.col(quoted(name))
        if _unhashable(df.schema[name].dataType):
            column = F.to_json(column)
        parts += [F.when(column.isNotNull(), F.lit(names[name])), column]
    return [F.xxhash64(F.lit(seed), *parts).cast("decimal(20,0)") for seed in (1, 2)]


def summed(numbers, separator):
    """Aggregate: the sums of some numbers as one text.

    An aggregate over columns that hold the numbers is cheaper than one that has to make them.
    """
    return F.concat_ws(separator, *[F.coalesce(F.sum(n), F.lit(0)).cast("string") for n in numbers])


def content_checksum(hash_text):
    """Aggregate: order-free checksum of a set of rows from their hex hashes.

    The digits of a hash are four numbers of 64 bits, which are summed apart and joined as text, so
    that every digit counts by itself. 10**18 rows fit. Copies of a row count, their order does not.
    """
    return summed(checksum_numbers(hash_text), "-")


def content_proof(df, names):
    """Aggregate: a hash of a set of rows that adds up over sets, as ``a:b``.

    ``names`` maps columns to the names they are hashed under; null columns do not count, so rows
    hash alike before and after a column comes. Two sums of 64-bit row hashes with different seeds:
    equal sets always agree, and a changed, missing or additional row shows but for 1 in 2**128.
    """
    return summed(proof_numbers(df, names), ":")


def _unhashable(kind):
    if isinstance(kind, (T.MapType, T.VariantType)):
        return True
    if isinstance(kind, T.ArrayType):
        return _unhashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_unhashable(field.dataType) for field in kind.fields)
    return False


def proofs_added(*signed):
    """The proof of sets put together (``1, proof``) or taken away (``-1, proof``); None if one is unknown."""
    if any(proof is None for _, proof in signed):
        return None
    pairs = [(sign, proof.split(":")) for sign, proof in signed]
    return ":".join(str(sum(sign * int(parts[i]) for sign, parts in pairs)) for i in (0, 1))

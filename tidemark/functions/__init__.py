from tidemark.functions.hashing import (
    content_checksum,
    hash_columns,
    row_hash,
    row_text,
)
from tidemark.functions.partitioning import PartitionBy, partition_value
from tidemark.functions.text import (
    convertible_to_number,
    normalized_text,
    stripped,
    to_number,
)
from tidemark.functions.typenames import (
    base_type_name,
    canonical_type,
    parse_type,
    schema_from_file,
    schema_from_pairs,
)

__all__ = [
    "PartitionBy",
    "base_type_name",
    "canonical_type",
    "content_checksum",
    "convertible_to_number",
    "hash_columns",
    "normalized_text",
    "parse_type",
    "partition_value",
    "row_hash",
    "row_text",
    "schema_from_file",
    "schema_from_pairs",
    "stripped",
    "to_number",
]

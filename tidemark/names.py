"""System column names and the one mapping from dataset name to directory."""

import hashlib
import re

SYSTEM_PREFIX = "_sys_"
ROW_HASH = SYSTEM_PREFIX + "row_hash"
INGESTED_AT = SYSTEM_PREFIX + "ingested_at"


def is_system(name):
    return name.startswith(SYSTEM_PREFIX)


def data_columns(df):
    """Names of all columns that are not system columns, in frame order."""
    return [name for name in df.columns if not is_system(name)]


def quoted(name):
    """A column name that survives dots and spaces when passed to Spark."""
    return "`" + name.replace("`", "``") + "`"


def dataset_dir(name):
    """Directory of a dataset. Different names never share a directory."""
    plain = re.sub(r"[^A-Za-z0-9_.-]", "_", name)
    if plain == name and not name.startswith(("_", ".")):
        return name
    digest = hashlib.md5(name.encode("utf-8")).hexdigest()[:10]
    return f"d{plain}-{digest}"

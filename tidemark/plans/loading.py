"""Loading a dataset by name, by version tag or by time."""

import logging

from pyspark.sql import functions as F

from tidemark.names import quoted
from tidemark.plans.versions import VersionedDataset

log = logging.getLogger(__name__)


def load(catalog, root, name, version=None, as_of=None, columns=None, limit=None):
    """Rows of a dataset: ``as_of`` before ``version`` before the latest state.

    A version recorded without a snapshot gives the current state, with a warning.
    """
    catalog.get(name)
    dataset = VersionedDataset(catalog.spark, root, name)
    if as_of is not None:
        df = dataset.read(as_of=as_of)
    elif version is not None:
        snapshot_id = catalog.get_version(name, version)["snapshot_id"]
        if snapshot_id is None:
            log.warning("%s@%s has no snapshot, reading the current state", name, version)
        df = dataset.read(snapshot_id=snapshot_id)
    else:
        df = dataset.read()
    if columns:
        df = df.select(*[F.col(quoted(column)) for column in columns])
    return df if limit is None else df.limit(limit)


def load_at_snapshot(spark, root, name, snapshot_id, columns=None):
    df = VersionedDataset(spark, root, name).read(snapshot_id=snapshot_id)
    return df.select(*[F.col(quoted(column)) for column in columns]) if columns else df

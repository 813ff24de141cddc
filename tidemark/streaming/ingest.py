"""Continuous ingest: a file stream into a versioned dataset.

Each micro-batch goes through the same steps as a batch run. Its commit carries the stream and
batch number, so a batch that Spark delivers again after a failure is not appended twice.
"""

from tidemark.names import ROW_HASH
from tidemark.operators import dedup
from tidemark.plans.known import GROUP_ROWS, KnownRows


def stream_into(
    source,
    dataset,
    checkpoint_location,
    cleaning=None,
    stream_name="stream",
    at=None,
    available_now=True,
    hash_columns=None,
    ledger_rows=GROUP_ROWS,
):
    """Start appending a streaming frame to ``dataset`` and return the query.

    Duplicates are dropped within the micro-batch and against everything the dataset holds,
    by the stored row hash. That state is the dataset itself and the ledger beside it, of which a
    micro-batch opens the folders that it needs: it needs no watermark and does not grow in memory.
    ``at`` gives the time of a commit from its batch number, ``ledger_rows`` the rows of a group of
    batches in the ledger.
    """

    def append(batch, number):
        token = f"{stream_name}:{number}"
        if dataset.committed_token(token) is not None:
            return
        rows = cleaning.run(batch) if cleaning is not None else batch
        rows = dedup.deduplicate(rows, hash_columns, framed=True)
        rows = KnownRows(dataset, ledger_rows).drop_from(rows)
        dataset.append(rows, at=at(number) if at else None, token=token)

    writer = source.writeStream.foreachBatch(append).option(
        "checkpointLocation", checkpoint_location
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def stream_distinct(
    source, path, checkpoint_location, time_column, delay, columns=None, available_now=True
):
    """Start writing the different rows of a stream without end as Parquet; return the query.

    State holds the hashes of the last ``delay`` of event time, in RocksDB and so on disk, and goes
    with the watermark. Copies within the delay are dropped by it, later ones as late rows.
    """
    spark = source.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        rows = drop_repeats_within(source, time_column, delay, columns)
        writer = rows.writeStream.format("parquet").outputMode("append")
        writer = writer.option("path", path).option("checkpointLocation", checkpoint_location)
        if available_now:
            writer = writer.trigger(availableNow=True)
        # The query keeps the settings it starts with.
        return writer.start()
    finally:
        spark.conf.set(_PROVIDER, before)


def drop_repeats_within(source, time_column, delay, columns=None):
    """Streaming duplicates removed where copies arrive within ``delay`` of each other.

    State is kept for that long only, which suits streams without end; ``stream_into`` is
    exact over all time.
    """
    hashed = dedup.with_row_hash(source, columns)
    return hashed.withWatermark(time_column, delay).dropDuplicatesWithinWatermark([ROW_HASH])

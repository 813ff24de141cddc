"""Which Parquet codec suits a dataset, from its rows written once per codec."""

import logging
import time

from pyspark.sql import functions as F

from tidemark.functions.files import path_bytes
from tidemark.sources.readers import sample_fraction

log = logging.getLogger(__name__)

# Default codecs and the limits of the recommendation.
CODECS = ("snappy", "gzip", "zstd", "none")
RATIO_LIMIT = 1.2
THROUGHPUT_LIMIT = 1.5
DEFAULT_CODEC = "zstd"


def compare_codecs(df, folder, codecs=CODECS, fraction=None):
    """One row per codec: bytes, ratio to uncompressed, write and read time, throughput.

    All rows are measured, or about the named fraction of them, by as many tasks as the input
    has. ``folder`` must be new and reachable from every executor. The rows are written
    uncompressed first and are the input of all others, so the source is read once. A codec
    Spark cannot write here is left out.
    """
    spark = df.sparkSession
    base = folder.rstrip("/")
    sample = df if fraction is None else sample_fraction(df, fraction)
    plain = f"{base}/sample"
    sample.write.option("compression", "uncompressed").parquet(plain)
    source = spark.read.parquet(plain)
    rows, original = source.count(), path_bytes(spark, plain)
    measured = []
    for codec in codecs:
        target = f"{base}/codec_{codec}"
        option = "uncompressed" if codec == "none" else codec
        try:
            started = time.monotonic()
            source.write.option("compression", option).parquet(target)
            written = time.monotonic()
            spark.read.parquet(target).write.format("noop").mode("overwrite").save()
            read = time.monotonic()
        except Exception as problem:  # the codec, not the data: others still count
            log.warning("codec %s left out: %s", codec, problem)
            continue
        size = path_bytes(spark, target)
        megabytes = original / (1024 * 1024)
        measured.append(
            (
                codec,
                rows,
                len(df.columns),
                original,
                size,
                original / max(size, 1),
                (written - started) * 1000,
                (read - written) * 1000,
                megabytes / max(read - started, 1e-9),
            )
        )
    return spark.createDataFrame(
        measured,
        "codec string, row_count bigint, column_count int, original_bytes bigint, "
        "compressed_bytes bigint, compression_ratio double, write_ms double, read_ms double, "
        "throughput_mb_s double",
    )


def recommend_codec(measured, group_by=()):
    """Recommended codec per group of measured rows, with the best ratio and throughput."""

    def figure(codec, name):
        return F.max(F.when(F.col("codec") == codec, F.col(name)))

    zstd_ratio = figure("zstd", "compression_ratio")
    snappy_ratio = figure("snappy", "compression_ratio")
    zstd_speed = figure("zstd", "throughput_mb_s")
    snappy_speed = figure("snappy", "throughput_mb_s")
    choice = (
        F.when(zstd_ratio > snappy_ratio * RATIO_LIMIT, F.lit("zstd"))
        .when(snappy_speed > zstd_speed * THROUGHPUT_LIMIT, F.lit("snappy"))
        .otherwise(F.lit(DEFAULT_CODEC))
    )
    return measured.groupBy(*group_by).agg(
        choice.alias("recommended"),
        F.max_by("codec", F.struct("compression_ratio", "codec")).alias("best_ratio"),
        F.max_by("codec", F.struct("throughput_mb_s", "codec")).alias("best_throughput"),
    )

"""Datasets and their versions, as events in Parquet tables.

Nothing is updated in place: registering again is one more event, and the state of a dataset is
the newest non-empty value of every field. The folds are aggregates that combine on the map
side; a dataset with most of the events is no bottleneck.
"""

import time

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.files import path_exists
from tidemark.functions.rows import one_row, utc

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("source_uri", T.StringType()),
        T.StructField("table_path", T.StringType()),
        T.StructField("schema", T.MapType(T.StringType(), T.StringType())),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)

VERSION_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("version_tag", T.StringType()),
        T.StructField("snapshot_id", T.LongType()),
        T.StructField("added_rows", T.LongType()),
        T.StructField("total_rows", T.LongType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("checksum", T.StringType()),
        T.StructField("lineage_node_id", T.StringType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)


class DatasetNotFound(LookupError):
    pass


class VersionNotFound(LookupError):
    pass


class DuplicateVersion(ValueError):
    pass


# --- folding events -------------------------------------------------------------------


def live_events(events):
    """Register events after the last delete of their dataset, if any."""
    deleted = (
        events.filter("event = 'delete'").groupBy("name").agg(F.max("seq").alias("deleted_seq"))
    )
    return (
        events.filter("event = 'register'")
        .join(deleted, "name", "left")
        .filter("deleted_seq is null or seq > deleted_seq")
        .drop("deleted_seq")
    )


def current_datasets(events):
    """One row per dataset: newest non-empty values, merged extra entries."""
    live = live_events(events)

    def newest(field, filled):
        value = F.when(filled, F.col(field))
        order = F.when(filled, F.col("seq"))
        return F.max_by(value, order).alias(field)

    fields = live.groupBy("name").agg(
        newest("description", F.col("description") != ""),
        newest("tags", F.size("tags") > 0),
        newest("source_uri", F.col("source_uri") != ""),
        newest("table_path", F.col("table_path") != ""),
        newest("schema", F.size("schema") > 0),
        F.min("at").alias("created_at"),
        F.max("at").alias("updated_at"),
    )
    # Merged key by key, so the lists collected per dataset hold distinct keys only.
    entries = (
        live.select("name", "seq", F.explode("extra").alias("key", "value"))
        .groupBy("name", "key")
        .agg(F.max_by("value", "seq").alias("value"))
        .groupBy("name")
        .agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("extra"))
    )
    no_entries = F.create_map().cast("map<string,string>")
    return fields.join(entries, "name", "left").select(
        "name",
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce("source_uri", F.lit("")).alias("source_uri"),
        F.coalesce("table_path", F.lit("")).alias("table_path"),
        F.coalesce("schema", no_entries).alias("schema"),
        F.coalesce("extra", no_entries).alias("extra"),
        "created_at",
        "updated_at",
    )


def added_last():
    """Order of versions: number of the event that added them, then time and tag."""
    return F.struct("seq", "created_at", "version_tag")


def latest_versions(versions):
    """The version added last, per dataset."""
    newest = F.max_by(F.struct(*[c for c in versions.columns if c != "name"]), added_last())
    return versions.groupBy("name").agg(newest.alias("v")).select("name", "v.*")


def version_counts(versions):
    """Per dataset: number of versions, latest tag and its total rows."""
    return versions.groupBy("name").agg(
        F.count(F.lit(1)).alias("versions"),
        F.max_by("version_tag", added_last()).alias("latest_version"),
        F.max_by("total_rows", added_last()).alias("latest_rows"),
        F.max("created_at").alias("last_version_at"),
    )


# --- questions ------------------------------------------------------------------------


def list_datasets(datasets, versions):
    """Every dataset with the number of its versions and the latest tag."""
    counts = version_counts(versions).select("name", "versions", "latest_version")
    return datasets.select("name").join(counts, "name", "left").fillna({"versions": 0})


def version_history(versions, name=None):
    """Versions with a flag on the latest one of each dataset.

    The latest per dataset is a small aggregate joined back, not a window, so one dataset
    with very many versions needs no single task.
    """
    if name is not None:
        versions = versions.filter(F.col("name") == name)
    latest = versions.groupBy("name").agg(F.max(added_last()).alias("last"))
    return versions.join(latest, "name").select(
        *versions.columns, (added_last() == F.col("last")).alias("is_latest")
    )


def search(datasets, text="", tags=()):
    """Text in name or description, ignoring case; all of ``tags``, exactly as written."""
    found = datasets
    if text:
        wanted = F.lit(text.lower())
        found = found.filter(
            F.contains(F.lower("name"), wanted) | F.contains(F.lower("description"), wanted)
        )
    if tags:
        wanted = F.array(*[F.lit(tag) for tag in tags])
        found = found.filter(F.size(F.array_except(wanted, F.col("tags"))) == 0)
    return found


def all_tags(datasets):
    return datasets.select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


def statistics(datasets, versions):
    """One row: datasets, versions, rows over all versions."""
    counted = versions.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("added_rows").alias("rows")
    )
    return (
        datasets.select("name")
        .join(counted, "name", "left")
        .agg(
            F.count(F.lit(1)).alias("total_datasets"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_versions"),
            F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows_across_versions"),
        )
    )


def listing(datasets, versions):
    """Listing rows: dataset facts, latest version, number of versions, latest rows."""
    counts = version_counts(versions)
    return datasets.join(counts, "name", "left").select(
        "name",
        "description",
        "tags",
        "created_at",
        F.greatest("updated_at", "last_version_at").alias("updated_at"),
        F.col("latest_version").alias("version"),
        F.coalesce("versions", F.lit(0)).alias("num_versions"),
        F.coalesce("latest_rows", F.lit(0)).alias("num_rows"),
        "schema",
    )


def card_facts(df, order_by, n=5):
    """``(facts, sample)``: rows and columns of a dataset, and its first ``n`` rows."""
    facts = df.agg(
        F.count(F.lit(1)).alias("row_count"), F.lit(len(df.columns)).alias("column_count")
    )
    return facts, df.orderBy(*order_by).limit(n)


# --- stored catalog -------------------------------------------------------------------


class Catalog:
    """The event and version tables below one folder. One writer."""

    def __init__(self, spark, root):
        self.spark = spark
        self.events_path = f"{root.rstrip('/')}/datasets"
        self.versions_path = f"{root.rstrip('/')}/versions"

    def _table(self, path, schema):
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def _add(self, path, schema, row):
        one_row(self.spark, row, schema).write.mode("append").parquet(path)

    def events(self):
        return self._table(self.events_path, EVENT_SCHEMA)

    def datasets(self):
        return current_datasets(self.events())

    def versions(self):
        """Versions of the datasets that exist; those before a delete are gone."""
        deleted = (
            self.events()
            .filter("event = 'delete'")
            .groupBy("name")
            .agg(F.max("seq").alias("deleted_seq"))
        )
        return (
            self._table(self.versions_path, VERSION_SCHEMA)
            .join(deleted, "name", "left")
            .filter("deleted_seq is null or seq > deleted_seq")
            .select(VERSION_SCHEMA.fieldNames())
        )

    def _event(self, event, name, at=None, description="", tags=(), source_uri="",
               table_path="", schema=None, extra=None):
        row = (
            event,
            time.time_ns(),
            utc(at),
            name,
            description,
            list(tags),
            source_uri,
            table_path,
            dict(schema or {}),
            {key: str(value) for key, value in (extra or {}).items()},
        )
        self._add(self.events_path, EVENT_SCHEMA, row)

    def register(self, name, **fields):
        """Register a dataset, or update it: empty values keep what was there."""
        self._event("register", name, **fields)

    def _last_events(self, name):
        """Numbers of the last register and the last delete of a dataset, 0 where none."""
        number = F.when(F.col("event") == "register", F.col("seq"))
        deleted = F.when(F.col("event") == "delete", F.col("seq"))
        row = (
            self.events()
            .filter(F.col("name") == name)
            .agg(F.max(number).alias("registered"), F.max(deleted).alias("deleted"))
            .first()
        )
        return row["registered"] or 0, row["deleted"] or 0

    def exists(self, name):
        registered, deleted = self._last_events(name)
        return registered > deleted

    def add_version(self, name, version_tag, added_rows, total_rows=None, snapshot_id=None,
                    checksum="", schema=None, lineage_node_id=None, extra=None, at=None):
        """Add a version; an unknown dataset is registered, a tag in use is refused."""
        registered, deleted = self._last_events(name)
        self._refuse_used_tag(name, version_tag, deleted)
        if schema or registered <= deleted:
            self.register(name, schema=schema, at=at)
        row = (
            time.time_ns(),
            name,
            version_tag,
            snapshot_id,
            added_rows,
            added_rows if total_rows is None else total_rows,
            utc(at),
            checksum,
            lineage_node_id,
            {key: str(value) for key, value in (extra or {}).items()},
        )
        self._add(self.versions_path, VERSION_SCHEMA, row)

    def add_versions(self, rows):
        """Many versions at once, as a frame with the columns of the version table.

        The same rules as for one: a tag in use, or named twice, is refused before anything
        is written, and unknown datasets are registered. All rows get the number of this one
        event, so they come after every earlier event, deletes included; among them the time of
        creation and then the tag say which was last.
        """
        keys = ["name", "version_tag"]
        repeated = rows.groupBy(*keys).count().filter("count > 1").select(*keys)
        used = rows.join(self.versions().select(*keys), keys, "left_semi").select(*keys)
        refused = repeated.unionAll(used).first()
        if refused is not None:
            raise DuplicateVersion(f"{refused['name']} already has {refused['version_tag']}")
        names = rows.groupBy("name").agg(F.min("created_at").alias("at"))
        unknown = names.join(self.datasets(), "name", "left_anti").select(
            F.lit("register").alias("event"), F.lit(time.time_ns()).alias("seq"), "at", "name"
        )
        empty = self.spark.createDataFrame([], EVENT_SCHEMA)
        events = empty.unionByName(unknown, allowMissingColumns=True)
        events.write.mode("append").parquet(self.events_path)
        empty = self.spark.createDataFrame([], VERSION_SCHEMA)
        rows = empty.unionByName(rows, allowMissingColumns=True)
        rows.withColumn("seq", F.lit(time.time_ns())).write.mode("append").parquet(
            self.versions_path
        )

    def tag_token(self, name, version_tag):
        """Text that names a tag of a dataset since its last delete."""
        return f"{name}@{version_tag}#{self._last_events(name)[1]}"

    def check_new_tag(self, name, version_tag):
        self._refuse_used_tag(name, version_tag, self._last_events(name)[1])

    def _refuse_used_tag(self, name, version_tag, deleted):
        used = self._table(self.versions_path, VERSION_SCHEMA).filter(
            (F.col("name") == name)
            & (F.col("version_tag") == version_tag)
            & (F.col("seq") > deleted)
        )
        if not used.isEmpty():
            raise DuplicateVersion(f"{name} already has a version {version_tag}")

    def _versions_of(self, name):
        return self.versions().filter(F.col("name") == name)

    def get(self, name):
        row = current_datasets(self.events().filter(F.col("name") == name)).first()
        if row is None:
            raise DatasetNotFound(name)
        return row

    def get_version(self, name, version_tag):
        self.get(name)
        row = self._versions_of(name).filter(F.col("version_tag") == version_tag).first()
        if row is None:
            raise VersionNotFound(f"{name}@{version_tag}")
        return row

    def latest_version(self, name):
        self.get(name)
        return latest_versions(self._versions_of(name)).first()

    def delete(self, name):
        self.get(name)
        self._event("delete", name)

    def export(self, path):
        """Datasets and versions as JSON lines, one folder each.

        Versions stay rows: a dataset with very many of them is no single document.
        """
        self.datasets().write.mode("errorifexists").json(f"{path}/datasets")
        self.versions().write.mode("errorifexists").json(f"{path}/versions")

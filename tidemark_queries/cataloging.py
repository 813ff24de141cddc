"""Catalog and lineage questions on metadata derived from documents and conversations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import catalog as M
from tidemark.operators import lineage as L
from tidemark_queries.registry import fresh_dir, query, table

# One register event per source and language, numbered by the first document; a dataset is a
# source, a version is a language. English events leave the description empty.
EVENTS_SQL = """(
    select source as name, lang, min(d.doc_id) as seq, count(*) as docs,
           case when lang = 'en' then '' else 'Text in ' || lang end as description,
           case when max(coalesce(toxic, 0)) = 1 then lang || ',toxic'
                when lang = 'en' then '' else lang || ',plain' end as tags,
           sum(n_chars) as chars
    from documents d left join labels l on d.doc_id = l.doc_id group by source, lang)"""
VERSIONS_SQL = f"""(
    select name, lang as version_tag, seq, docs as added_rows,
           sum(docs) over (partition by name order by seq) as total_rows
    from {EVENTS_SQL})"""
DATASETS_SQL = f"""(
    select name, coalesce(arg_max(description, seq) filter (where description <> ''), '')
               as description,
           coalesce(arg_max(tags, seq) filter (where tags <> ''), '') as tags,
           timestamp '2024-01-01' + to_seconds(min(seq)) as created_at,
           timestamp '2024-01-01' + to_seconds(max(seq)) as updated_at
    from {EVENTS_SQL} group by name)"""


def _groups(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    english, toxic = F.col("lang") == "en", F.col("worst") == 1
    return (
        documents.join(labels, "doc_id", "left")
        .groupBy("source", "lang")
        .agg(
            F.min("doc_id").alias("seq"),
            F.count(F.lit(1)).alias("docs"),
            F.max(F.coalesce("toxic", F.lit(0))).alias("worst"),
            F.sum("n_chars").alias("chars"),
        )
        .select(
            F.lit("register").alias("event"),
            "seq",
            F.timestamp_seconds(F.lit(1704067200) + F.col("seq")).alias("at"),
            F.col("source").alias("name"),
            F.when(english, "").otherwise(F.concat(F.lit("Text in "), "lang")).alias(
                "description"
            ),
            F.when(toxic, F.array("lang", F.lit("toxic")))
            .when(english, F.array().cast("array<string>"))
            .otherwise(F.array("lang", F.lit("plain")))
            .alias("tags"),
            F.concat(F.lit("docs/"), "source").alias("source_uri"),
            F.lit("").alias("table_path"),
            F.create_map(F.lit("text"), F.lit("string")).alias("schema"),
            F.create_map(F.col("lang"), F.col("docs").cast("string"), F.lit("last"), "lang").alias(
                "extra"
            ),
            "lang",
            "docs",
        )
    )


def events(spark, sf_dir):
    return _groups(spark, sf_dir).drop("lang", "docs")


def datasets(spark, sf_dir):
    return M.current_datasets(events(spark, sf_dir))


def versions(spark, sf_dir):
    total = F.sum("docs").over(Window.partitionBy("name").orderBy("seq"))
    return _groups(spark, sf_dir).select(
        "seq",
        "name",
        F.col("lang").alias("version_tag"),
        F.col("docs").alias("added_rows"),
        total.alias("total_rows"),
        F.col("at").alias("created_at"),
    )


@query(
    "m1_current_datasets",
    f"""select *, (select string_agg(k || '=' || v, ',' order by k)
                   from (select lang as k, cast(docs as varchar) as v from {EVENTS_SQL} e
                         where e.name = d.name
                         union all select 'last', arg_max(lang, seq) from {EVENTS_SQL} e
                         where e.name = d.name)) as extra
        from {DATASETS_SQL} d""",
)
def current_datasets(spark, sf_dir):
    entries = F.array_sort(
        F.transform(F.map_entries("extra"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    )
    return datasets(spark, sf_dir).select(
        "name",
        "description",
        F.array_join("tags", ",").alias("tags"),
        "created_at",
        "updated_at",
        F.array_join(entries, ",").alias("extra"),
    )


@query(
    "m2_add_version",
    """select source as name, 1::bigint as versions, 'all' as latest_version, count(*) as latest_rows
       from documents group by source""",
)
def add_version(spark, sf_dir):
    """A version per source added to a stored catalog; unknown datasets are registered."""
    catalog = M.Catalog(spark, fresh_dir(spark, "catalog"))
    counts = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("name")).count()
    catalog.add_versions(
        counts.select(
            "name",
            F.lit("all").alias("version_tag"),
            F.col("count").alias("added_rows"),
            F.col("count").alias("total_rows"),
            F.lit("2024-01-01").cast("timestamp").alias("created_at"),
        )
    )
    known = M.version_counts(catalog.versions()).drop("last_version_at")
    return known.join(catalog.datasets().select("name"), "name")


@query(
    "m3_get_version",
    f"select name, version_tag, added_rows from {VERSIONS_SQL} where version_tag = 'de'",
)
def get_version(spark, sf_dir):
    found = versions(spark, sf_dir).filter("version_tag = 'de'")
    return found.select("name", "version_tag", "added_rows")


@query(
    "m4_latest_version",
    f"""select name, arg_max(version_tag, seq) as version_tag, max(seq) as seq
        from {VERSIONS_SQL} group by name""",
)
def latest_version(spark, sf_dir):
    return M.latest_versions(versions(spark, sf_dir)).select("name", "version_tag", "seq")


@query(
    "m5_list_datasets",
    f"""select name, count(*) as versions, arg_max(version_tag, seq) as latest_version
        from {VERSIONS_SQL} group by name""",
)
def list_datasets(spark, sf_dir):
    return M.list_datasets(datasets(spark, sf_dir), versions(spark, sf_dir))


@query(
    "m6_version_history",
    f"""select name, version_tag, added_rows, cast(total_rows as bigint) as total_rows,
               seq = max(seq) over (partition by name) as is_latest
        from {VERSIONS_SQL}""",
)
def version_history(spark, sf_dir):
    found = M.version_history(versions(spark, sf_dir))
    return found.select("name", "version_tag", "added_rows", "total_rows", "is_latest")


@query(
    "m7_search",
    f"""select name, description from {DATASETS_SQL}
        where (contains(lower(name), 'text in') or contains(lower(description), 'text in'))
          and list_contains(string_split(tags, ','), 'plain')""",
)
def search(spark, sf_dir):
    found = M.search(datasets(spark, sf_dir), text="TEXT in", tags=["plain"])
    return found.select("name", "description")


@query(
    "m8_all_tags",
    f"""select distinct unnest(string_split(tags, ',')) as tag
        from {DATASETS_SQL} where tags <> ''""",
)
def all_tags(spark, sf_dir):
    return M.all_tags(datasets(spark, sf_dir))


@query(
    "m9_statistics",
    """select count(distinct source) as total_datasets,
              count(distinct (source, lang)) as total_versions,
              count(*) as total_rows_across_versions from documents""",
)
def statistics(spark, sf_dir):
    return M.statistics(datasets(spark, sf_dir), versions(spark, sf_dir))


@query("m10_delete_dataset", f"select name, description from {DATASETS_SQL} where tags like '%plain'")
def delete_dataset(spark, sf_dir):
    """Datasets are left after a delete event for each of those without the tag plain."""
    known = events(spark, sf_dir)
    unwanted = datasets(spark, sf_dir).filter(~F.array_contains("tags", "plain")).select("name")
    deletes = (
        known.join(unwanted, "name", "left_semi")
        .groupBy("name")
        .agg(F.max("seq").alias("seq"))
        .select(F.lit("delete").alias("event"), "seq", "name")
    )
    left = M.current_datasets(known.unionByName(deletes, allowMissingColumns=True))
    return left.select("name", "description")


@query(
    "m11_export",
    f"""select 'version' as kind, name, version_tag as detail, added_rows as rows
        from {VERSIONS_SQL}
        union all select 'dataset', name, '', 0 from {DATASETS_SQL}""",
)
def export(spark, sf_dir):
    """A stored catalog exported as JSON lines and read back."""
    catalog = M.Catalog(spark, fresh_dir(spark, "exported"))
    catalog.add_versions(versions(spark, sf_dir))
    path = fresh_dir(spark, "export")
    catalog.export(path)
    rows = spark.read.json(f"{path}/versions").select(
        F.lit("version").alias("kind"),
        "name",
        F.col("version_tag").alias("detail"),
        F.col("added_rows").alias("rows"),
    )
    names = spark.read.json(f"{path}/datasets").select(
        F.lit("dataset").alias("kind"),
        "name",
        F.lit("").alias("detail"),
        F.lit(0).cast("bigint").alias("rows"),
    )
    return rows.unionAll(names)


@query(
    "m12_listing",
    f"""select d.name, d.description, d.tags, v.version, v.num_versions, v.num_rows
        from {DATASETS_SQL} d join (
            select name, arg_max(version_tag, seq) as version, count(*) as num_versions,
                   cast(arg_max(total_rows, seq) as bigint) as num_rows
            from {VERSIONS_SQL} group by name) v on d.name = v.name""",
)
def listing(spark, sf_dir):
    found = M.listing(datasets(spark, sf_dir), versions(spark, sf_dir))
    return found.select(
        "name",
        "description",
        F.array_join("tags", ",").alias("tags"),
        "version",
        "num_versions",
        "num_rows",
    )


@query(
    "m13_card_facts",
    """select doc_id, lang, source, (select count(*) from documents) as row_count,
              5 as column_count from documents order by doc_id limit 5""",
)
def card_facts(spark, sf_dir):
    facts, sample = M.card_facts(table(spark, sf_dir, "documents"), ["doc_id"])
    row = facts.first()
    return sample.select(
        "doc_id",
        "lang",
        "source",
        F.lit(row["row_count"]).cast("bigint").alias("row_count"),
        F.lit(row["column_count"]).alias("column_count"),
    )


# --- lineage ----------------------------------------------------------------------------

# A node per turn of a conversation; its parent is the turn before. The parent of the first turn
# is the last one, a cycle, where a conversation ends with the assistant, and absent elsewhere.
NODES_SQL = """(
    select c.conv_id || '-' || turn as node_id, 'conv ' || c.conv_id as dataset, turn,
           case when turn > 0 then c.conv_id || '-' || (turn - 1)
                when last_role = 'assistant' then c.conv_id || '-' || last_turn
                else 'absent' end as parent_id,
           timestamp '2024-01-01' + to_seconds(turn) as created_at,
           length(text) as row_count, role, last_turn
    from conversations c join (
        select conv_id, max(turn) as last_turn, arg_max(role, turn) as last_role
        from conversations group by conv_id) e on c.conv_id = e.conv_id)"""


def nodes(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    ends = turns.groupBy("conv_id").agg(
        F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role")
    )

    def name(turn):
        return F.concat_ws("-", "conv_id", turn)

    parent = (
        F.when(F.col("turn") > 0, name(F.col("turn") - 1))
        .when(F.col("last_role") == "assistant", name(F.col("last_turn")))
        .otherwise(F.lit("absent"))
    )
    return turns.join(ends, "conv_id").select(
        name(F.col("turn")).alias("node_id"),
        F.concat(F.lit("conv "), F.col("conv_id").cast("string")).alias("dataset"),
        "turn",
        F.timestamp_seconds(F.lit(1704067200) + F.col("turn")).alias("created_at"),
        F.array(parent).alias("parent_node_ids"),
        F.array("role", F.concat(F.lit("turn "), F.least("turn", F.lit(1)).cast("string"))).alias(
            "source_uris"
        ),
        F.array(F.lit("strip"), "role").alias("transforms"),
        F.length("text").cast("bigint").alias("row_count"),
        "last_turn",
    )


@query(
    "l2_lineage_of_dataset",
    f"""select node_id, created_at, row_count from {NODES_SQL}
        where dataset = (select 'conv ' || max(conv_id) from conversations)""",
)
def lineage_of_dataset(spark, sf_dir):
    last = table(spark, sf_dir, "conversations").agg(F.max("conv_id")).first()[0]
    found = L.lineage_of(nodes(spark, sf_dir), f"conv {last}")
    return found.select("node_id", "created_at", "row_count")


@query(
    "l3_latest_node",
    f"select node_id, dataset, row_count from {NODES_SQL} where turn = last_turn",
)
def latest_node(spark, sf_dir):
    return L.latest_nodes(nodes(spark, sf_dir)).select("node_id", "dataset", "row_count")


@query(
    "l4_ancestors",
    f"""with recursive n as materialized (select * from {NODES_SQL}),
             up(start_id, node_id) as (
                 select node_id, node_id from n where turn = last_turn
                 union select up.start_id, p.node_id from up
                 join n on n.node_id = up.node_id join n p on p.node_id = n.parent_id)
        select start_id, node_id,
               cast(split_part(start_id, '-', 2) as integer)
               - cast(split_part(node_id, '-', 2) as integer) as distance from up""",
)
def ancestors(spark, sf_dir):
    known = nodes(spark, sf_dir)
    return L.ancestors(known, known.filter("turn = last_turn"))


@query(
    "l5_provenance",
    f"""select dataset, count(*) as version_count, min(created_at) as first_seen,
               max(created_at) as last_seen,
               count(distinct role) + count(distinct least(turn, 1)) as sources,
               1 + count(distinct role) as transforms
        from {NODES_SQL} group by dataset""",
)
def provenance(spark, sf_dir):
    return L.provenance(nodes(spark, sf_dir))


@query(
    "l5_provenance_items",
    f"""with s as (
            select dataset, 'source' as kind, role as value, created_at, node_id, 0 as pos
            from {NODES_SQL}
            union all select dataset, 'source', 'turn ' || least(turn, 1), created_at, node_id, 1
            from {NODES_SQL}
            union all select dataset, 'transform', 'strip', created_at, node_id, 0
            from {NODES_SQL}
            union all select dataset, 'transform', role, created_at, node_id, 1
            from {NODES_SQL})
        select dataset, kind, value, min(created_at) as first_at,
               arg_min(node_id, created_at) as first_node, arg_min(pos, created_at)
               as first_position
        from s group by all""",
)
def provenance_items(spark, sf_dir):
    return L.provenance_items(nodes(spark, sf_dir))


@query("l6_datasets_with_lineage", f"select distinct dataset from {NODES_SQL}")
def datasets_with_lineage(spark, sf_dir):
    return L.datasets_with_lineage(nodes(spark, sf_dir))


@query(
    "l1_record_node",
    """select 'documents' as dataset, 2::bigint as nodes, count(*) as row_count, 'first' as parent
       from documents""",
)
def record_node(spark, sf_dir):
    """Two recorded nodes: the second has the first as parent by default."""
    rows = table(spark, sf_dir, "documents").count()
    lineage = L.LineageTable(spark, fresh_dir(spark, "lineage"))
    for tag in ("first", "second"):
        lineage.record("documents", tag, ["docs"], ["strip"], {"text": "string"}, rows,
                       node_id=tag, at=_at(tag))
    latest = L.latest_nodes(lineage.nodes())
    count = lineage.nodes().groupBy("dataset").agg(F.count(F.lit(1)).alias("nodes"))
    return latest.join(count, "dataset").select(
        "dataset", "nodes", "row_count", F.element_at("parent_node_ids", 1).alias("parent")
    )


def _at(tag):
    from datetime import datetime

    return datetime(2024, 1, 1 if tag == "first" else 2)

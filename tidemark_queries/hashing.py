"""Row hashes and duplicates."""

from pyspark.sql import functions as F

from tidemark.functions.hashing import hash_columns, row_hash
from tidemark.operators import dedup
from tidemark_queries.registry import (
    EVENTS,
    LINEITEM,
    fresh_dir,
    query,
    sql_framed,
    sql_hash,
    sql_text,
    table,
)

# lineitem with every returned line a second time.
DUPLICATED = """(select * from lineitem union all
                 select * from lineitem where l_returnflag = 'R')"""
NULLED = """(select event_id, ts, user_id,
                    case when user_id < 10 then null else event_type end as event_type,
                    case when event_type = 'click' then null else value end as value, props
             from events)"""


def duplicated(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.unionAll(lines.filter("l_returnflag = 'R'"))


def nulled(spark, sf_dir):
    """events without the types of some users and without the values of clicks."""
    return (
        table(spark, sf_dir, "events")
        .withColumn("value", F.when(F.col("event_type") != "click", F.col("value")))
        .withColumn("event_type", F.when(F.col("user_id") >= 10, F.col("event_type")))
    )


@query(
    "h1_row_hash",
    f"""select l_orderkey, l_linenumber, l_partkey,
               sha256({sql_text(LINEITEM)}) as sha256, md5({sql_text(LINEITEM)}) as md5,
               sha1({sql_text(LINEITEM)}) as sha1, sha256({sql_framed(LINEITEM)}) as framed
        from lineitem""",
)
def row_hashes(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        row_hash(lines).alias("sha256"),
        row_hash(lines, algorithm="md5").alias("md5"),
        row_hash(lines, algorithm="sha1").alias("sha1"),
        row_hash(lines, framed=True).alias("framed"),
    )


@query(
    "h2_hash_columns",
    f"""select {sql_hash(["l_shipdate", "l_orderkey"])} as chosen,
               {sql_hash(LINEITEM)} as all_sorted, count(*) as lines
        from lineitem group by 1, 2""",
)
def chosen_hash_columns(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("_sys_note", F.lit("not hashed"))
    return (
        lines.select(
            row_hash(lines, ["l_shipdate", "l_orderkey"]).alias("chosen"),
            row_hash(lines, hash_columns(lines)).alias("all_sorted"),
        )
        .groupBy("chosen", "all_sorted")
        .agg(F.count(F.lit(1)).alias("lines"))
    )


@query(
    "h3_compute_hashes",
    f"select event_id, {sql_hash(EVENTS)} as _sys_row_hash from {NULLED}",
)
def compute_hashes(spark, sf_dir):
    return dedup.with_row_hash(nulled(spark, sf_dir)).select("event_id", "_sys_row_hash")


@query(
    "h4_deduplicate",
    f"""select *, {sql_hash(LINEITEM)} as _sys_row_hash
        from (select distinct * from {DUPLICATED})""",
)
def deduplicate_rows(spark, sf_dir):
    return dedup.deduplicate(duplicated(spark, sf_dir))


def _first(order):
    return f"""select event_id, ts, user_id, event_type, value, props,
                      {sql_hash(["user_id", "event_type"])} as _sys_row_hash
               from (select *, row_number() over (
                         partition by user_id, event_type order by {order}) as rn from events)
               where rn = 1"""


@query("h4_deduplicate_subset", _first("ts, event_id"))
def deduplicate_subset(spark, sf_dir):
    return dedup.deduplicate(
        table(spark, sf_dir, "events"), ["user_id", "event_type"], order_by=["ts", "event_id"]
    )


@query(
    "h4_deduplicate_text",
    f"""select doc_id, text, lang, source, n_chars, {sql_hash(["text"])} as _sys_row_hash
        from (select *, row_number() over (partition by text order by doc_id) as rn
              from documents) where rn = 1""",
)
def deduplicate_text(spark, sf_dir):
    return dedup.deduplicate(table(spark, sf_dir, "documents"), ["text"], order_by=["doc_id"])


@query("h5_keep_last", _first("ts desc, event_id desc"))
def keep_last(spark, sf_dir):
    return dedup.deduplicate(
        table(spark, sf_dir, "events"),
        ["user_id", "event_type"],
        keep="last",
        order_by=["ts", "event_id"],
    )


@query(
    "h6_drop_known",
    f"""select *, {sql_hash(LINEITEM)} as _sys_row_hash
        from (select distinct * from {DUPLICATED})
        where {sql_hash(LINEITEM)} not in (
            select {sql_hash(LINEITEM)} from lineitem where l_linestatus = 'O')""",
)
def drop_known_rows(spark, sf_dir):
    known = dedup.with_row_hash(table(spark, sf_dir, "lineitem").filter("l_linestatus = 'O'"))
    return dedup.drop_known(dedup.deduplicate(duplicated(spark, sf_dir)), known)


@query(
    "h6_drop_known_by_ledger",
    f"""select *, {sql_hash(EVENTS)} as _sys_row_hash from events
        where event_type <> 'click' and not (event_type = 'view' and user_id % 2 = 0)""",
)
def drop_known_by_ledger(spark, sf_dir):
    """Rows that neither of two labels of a stored ledger holds; one label was added twice."""
    hashed = dedup.with_row_hash(table(spark, sf_dir, "events"))
    ledger = dedup.HashLedger(spark, fresh_dir(spark, "ledger"))
    ledger.add(hashed.filter("event_type = 'click'"), "clicks")
    ledger.add(hashed.filter("event_type in ('click', 'view') and user_id % 2 = 0"), "even")
    ledger.add(hashed.filter("event_type in ('click', 'view') and user_id % 2 = 0"), "even")
    return ledger.drop_known(hashed)


@query(
    "h7_ledger_folders",
    f"""select substr(h, 1, 2) as prefix, count(*) as digests, min(h) as first_hash, max(h) as last_hash
        from (select distinct {sql_hash(LINEITEM)} as h from {DUPLICATED}) group by 1""",
)
def ledger_folders(spark, sf_dir):
    """Digests in each folder of a ledger of lineitem with repeated rows."""
    ledger = dedup.HashLedger(spark, fresh_dir(spark, "ledger"))
    ledger.add(dedup.with_row_hash(duplicated(spark, sf_dir)), "all")
    hexed = F.lower(F.hex("digest"))
    return ledger.digests().groupBy("prefix").agg(
        F.count(F.lit(1)).alias("digests"), F.min(hexed).alias("first_hash"), F.max(hexed).alias("last_hash")
    )


@query(
    "h7_hash_ledger",
    f"""select count(distinct {sql_hash(EVENTS)}) as known_hashes,
               (select count(*) from events) - count(*) as new_rows
        from events""",
)
def hash_ledger(spark, sf_dir):
    ledger = dedup.HashLedger(spark, fresh_dir(spark, "ledger"))
    hashed = dedup.with_row_hash(table(spark, sf_dir, "events"))
    ledger.add(hashed.filter("event_type <> 'click'"), batch=1)
    ledger.add(hashed.filter("event_type <> 'view'"), batch=2)
    new = dedup.drop_known(hashed, ledger.hashes()).agg(F.count(F.lit(1)).alias("n"))
    known = ledger.hashes().distinct().agg(F.count(F.lit(1)).alias("n"))
    return (
        known.select(F.lit("known_hashes").alias("what"), "n")
        .unionAll(new.select(F.lit("new_rows").alias("what"), "n"))
        .agg(
            F.max(F.when(F.col("what") == "known_hashes", F.col("n"))).alias("known_hashes"),
            F.max(F.when(F.col("what") == "new_rows", F.col("n"))).alias("new_rows"),
        )
    )


@query(
    "h8_duplicates",
    f"""select * exclude (rn), {sql_hash(LINEITEM)} as _sys_row_hash
        from (select *, row_number() over (partition by {", ".join(LINEITEM)}) as rn
              from {DUPLICATED}) where rn > 1""",
)
def duplicate_rows(spark, sf_dir):
    return dedup.duplicates(duplicated(spark, sf_dir))


@query("h8_duplicates_subset", _first("ts, event_id").replace("where rn = 1", "where rn > 1"))
def duplicate_rows_subset(spark, sf_dir):
    return dedup.duplicates(
        table(spark, sf_dir, "events"), ["user_id", "event_type"], order_by=["ts", "event_id"]
    )


@query(
    "h9_duplicate_statistics",
    f"""select original_rows, deduplicated_rows,
               original_rows - deduplicated_rows as duplicates_removed,
               (original_rows - deduplicated_rows) / original_rows as duplicate_fraction
        from (select count(*) as original_rows,
                     count(distinct {sql_hash(LINEITEM)}) as deduplicated_rows
              from {DUPLICATED})""",
)
def duplicate_statistics(spark, sf_dir):
    return dedup.duplicate_statistics(duplicated(spark, sf_dir))


@query("h10_native_duplicates", f"select distinct * from {DUPLICATED}")
def native_duplicates(spark, sf_dir):
    return dedup.drop_duplicates_native(duplicated(spark, sf_dir))


@query("h10_native_subset", "select distinct l_suppkey, l_shipdate from lineitem")
def native_subset(spark, sf_dir):
    keys = ["l_suppkey", "l_shipdate"]
    lines = table(spark, sf_dir, "lineitem")
    return dedup.drop_duplicates_native(lines, keys).select(*keys)

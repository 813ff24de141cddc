"""Cleaning steps on tables made dirty by plain expressions."""

from pyspark.sql import functions as F

from tidemark.operators import cleaning as C
from tidemark_queries.registry import query, table

# customer with white space of several kinds around names, and some names the text nan.
DIRTY = """(select c_custkey, c_nationkey, c_acctbal, c_mktsegment,
                   case when c_mktsegment = 'BUILDING' then ' nan'
                        else chr(9) || chr(160) || c_name || chr(8195) || chr(10) end as c_name
            from customer)"""
# customer with whole rows null, and a column that is null in all others too.
HOLES = """(select case when c_mktsegment = 'BUILDING' then null else c_custkey end as c_custkey,
                   case when c_mktsegment = 'BUILDING' then null else c_name end as c_name,
                   case when c_mktsegment = 'MACHINERY' then c_acctbal end as c_acctbal
            from customer)"""
# events with numbers as text: few texts in one column, many in the other.
TEXTS = """(select event_id, user_id,
                   case when event_type = 'click' then 'n/a' else cast(value as varchar) end
                       as few_bad,
                   case when event_type in ('click', 'view', 'purchase') then 'n/a'
                        else cast(value as varchar) end as many_bad,
                   cast(user_id as varchar) as whole
            from events)"""
NUMERIC = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"


def dirty(spark, sf_dir):
    padded = F.concat(F.lit("\t\u00a0"), F.col("c_name"), F.lit("\u2003\n"))
    return table(spark, sf_dir, "customer").withColumn(
        "c_name", F.when(F.col("c_mktsegment") == "BUILDING", F.lit(" nan")).otherwise(padded)
    )


def holes(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    kept = F.col("c_mktsegment") != "BUILDING"
    return customer.select(
        F.when(kept, F.col("c_custkey")).alias("c_custkey"),
        F.when(kept, F.col("c_name")).alias("c_name"),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.col("c_acctbal")).alias("c_acctbal"),
        F.lit(None).cast("string").alias("nothing"),
    )


def number_texts(spark, sf_dir):
    value = F.col("value").cast("string")
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.when(kind == "click", F.lit("n/a")).otherwise(value).alias("few_bad"),
        F.when(kind.isin("click", "view", "purchase"), F.lit("n/a"))
        .otherwise(value)
        .alias("many_bad"),
        F.col("user_id").cast("string").alias("whole"),
    )


@query(
    "c1_lowercase_columns",
    """select p_partkey as p_key, p_name as p_name, p_brand as brand_no_1, p_size as col,
              p_type as _sys_x from part""",
)
def lowercase_columns(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias(" P-Key "),
        F.col("p_name").alias("_P Name"),
        F.col("p_brand").alias("Brand No.1"),
        F.col("p_size").alias("名前"),
        F.col("p_type").alias("_sys_x"),
    )
    return C.lowercase_columns(part)


@query(
    "c2_deduplicate_column_names",
    "select p_partkey as a, p_name as a_2, p_brand as a_1, p_size as a_3 from part",
)
def deduplicate_column_names(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    return C.deduplicate_column_names(part.toDF("a", "a", "a_1", "a"))


@query(
    "c3_strip_whitespace",
    """select c_custkey, case when c_mktsegment <> 'BUILDING' then c_name end as c_name,
              c_nationkey, c_acctbal, c_mktsegment from customer""",
)
def strip_whitespace(spark, sf_dir):
    return C.strip_whitespace(dirty(spark, sf_dir))


@query(
    "c3_strip_some_columns",
    r"""select c_custkey, regexp_replace(c_name, '^[\s\x{00a0}\x{2003}]+|[\s\x{00a0}\x{2003}]+$',
                                         '', 'g') as c_name, '  ' || c_mktsegment as padded
        from customer""",
)
def strip_some_columns(spark, sf_dir):
    padded = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.concat(F.lit("\u2003\u00a0"), F.col("c_name"), F.lit("\u00a0")).alias("c_name"),
        F.concat(F.lit("  "), F.col("c_mktsegment")).alias("padded"),
    )
    return C.strip_whitespace(padded, ["c_name", "absent"])


@query("c4_drop_empty_rows", f"select * from {HOLES} where c_custkey is not null")
def drop_empty_rows(spark, sf_dir):
    return C.drop_empty_rows(holes(spark, sf_dir)).drop("nothing")


@query("c5_drop_empty_columns", f"select * from {HOLES}")
def drop_empty_columns(spark, sf_dir):
    return C.drop_empty_columns(holes(spark, sf_dir))


@query("c5_drop_sparse_columns", f"select c_custkey, c_name from {HOLES}")
def drop_sparse_columns(spark, sf_dir):
    return C.drop_empty_columns(holes(spark, sf_dir), threshold=0.5)


@query(
    "c6_cast_numeric_columns",
    f"""select event_id, user_id,
               case when regexp_matches(few_bad, {NUMERIC}) then try_cast(few_bad as double) end
                   as few_bad,
               many_bad, cast(whole as bigint) as whole
        from {TEXTS}""",
)
def cast_numeric_columns(spark, sf_dir):
    return C.cast_numeric_columns(number_texts(spark, sf_dir))


@query(
    "c7_normalize_unicode",
    """select doc_id, nfc_normalize('e' || chr(769) || text) as text, lang, source, n_chars
       from documents""",
)
def normalize_unicode(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    decomposed = F.concat(F.lit("e\u0301"), F.col("text"))
    return C.normalize_unicode(documents.withColumn("text", decomposed))


@query(
    "c8_add_ingestion_timestamp",
    """select s_suppkey, s_name, timestamp '2024-06-01 12:00:00' as _sys_ingested_at
       from supplier""",
)
def add_ingestion_timestamp(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return C.add_ingestion_timestamp(supplier, "2024-06-01 12:00:00")


@query("c9_select_columns", "select p_type, p_partkey from part")
def select_columns(spark, sf_dir):
    return C.select_columns(table(spark, sf_dir, "part"), ["p_type", "p_partkey"])


@query("c10_rename_columns", "select s_suppkey as id, s_name, s_nationkey, s_acctbal from supplier")
def rename_columns(spark, sf_dir):
    return C.rename_columns(
        table(spark, sf_dir, "supplier"), {"s_suppkey": "id", "absent": "nothing"}
    )


@query("c11_drop_columns", "select s_suppkey, s_name from supplier")
def drop_columns(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    return C.drop_columns(supplier, ["s_nationkey", "s_acctbal", "absent"])


@query(
    "c12_fill_nulls",
    """select case when c_mktsegment = 'BUILDING' then -1 else c_custkey end as c_custkey,
              case when c_mktsegment = 'BUILDING' then 'unknown' else c_name end as c_name,
              case when c_mktsegment = 'MACHINERY' then c_acctbal else 0.5 end as c_acctbal
       from customer""",
)
def fill_nulls(spark, sf_dir):
    values = {"c_custkey": -1, "c_name": "unknown", "c_acctbal": 0.5, "absent": 1}
    return C.fill_nulls(holes(spark, sf_dir).drop("nothing"), values)


@query(
    "c13_coerce_dtypes",
    f"""select event_id, cast(user_id as varchar) as user_id, few_bad, many_bad,
               cast(whole as integer) as whole from {TEXTS}""",
)
def coerce_dtypes(spark, sf_dir):
    types = {"user_id": "object", "few_bad": "float64", "whole": "int32", "absent": "int64"}
    return C.coerce_dtypes(number_texts(spark, sf_dir), types)


def _doubled(df):
    return df.withColumn("c_acctbal", F.col("c_acctbal") * 2)


@query(
    "c14_step_chain",
    f"select c_custkey as id, c_acctbal * 2 as c_acctbal from {HOLES} where c_custkey is not null",
)
def step_chain(spark, sf_dir):
    chain = (
        C.Cleaning([_doubled])
        .add(C.drop_empty_rows)
        .add(C.rename_columns, {"c_custkey": "id"})
        .add(C.select_columns, ["id", "c_acctbal"])
    )
    return chain.run(holes(spark, sf_dir))


@query(
    "c15_standard_chain",
    """select c_custkey as c_custkey, c_name as c_name_1,
              case when c_mktsegment = 'MACHINERY' then c_acctbal end as c_acctbal,
              chr(233) || '-' || c_name as c_name,
              timestamp '2024-06-01 00:00:00' as _sys_ingested_at
       from customer where c_mktsegment <> 'BUILDING'""",
)
def standard_chain(spark, sf_dir):
    name = F.concat(F.lit("\te\u0301-"), F.col("c_name"), F.lit("\u00a0"))
    messy = holes(spark, sf_dir).select(
        F.col("c_custkey").alias("C CustKey"),
        name.alias(" C-Name"),
        F.col("c_name").alias("C_Name "),
        F.col("c_acctbal").alias("c_acctbal"),
        F.col("nothing").alias("Nothing"),
    )
    return C.Cleaning.standard("2024-06-01 00:00:00").run(messy)

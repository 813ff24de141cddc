"""Reading files, several sources, samples, manifests, codecs."""

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions.files import path_bytes
from tidemark.functions.typenames import schema_from_pairs
from tidemark.operators import codecs
from tidemark.operators.profile import profile
from tidemark.sources import manifest as manifests
from tidemark.sources import readers
from tidemark_queries.registry import (
    LINEITEM,
    fresh_dir,
    query,
    sql_checksum,
    sql_hash,
    table,
)

CUSTOMER = ["c_acctbal", "c_custkey", "c_mktsegment", "c_name", "c_nationkey"]
ORDER_LINES = """select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority
                 from orders"""


def _order_lines(spark, sf_dir):
    return table(spark, sf_dir, "orders").drop("o_orderdate")


@query(
    "s1_format_from_path",
    """select 'csv' as format, count(*) as rows from region union all
       select 'tsv', count(*) from nation union all
       select 'jsonl', count(*) from supplier union all
       select 'parquet', count(*) from lineitem""",
)
def format_from_path(spark, sf_dir):
    """The same call reads all kinds of files; the format comes from the ending."""
    base = fresh_dir(spark, "formats")
    table(spark, sf_dir, "region").write.option("header", True).csv(f"{base}/region.csv")
    table(spark, sf_dir, "nation").write.options(header=True, sep="\t").csv(f"{base}/nation.tsv")
    table(spark, sf_dir, "supplier").write.json(f"{base}/supplier.ndjson")
    result = None
    for path in (
        f"{base}/region.csv",
        f"{base}/nation.tsv",
        f"{base}/supplier.ndjson",
        f"{sf_dir}/lineitem.parquet",
    ):
        rows = readers.read_source(spark, path).agg(F.count(F.lit(1)).alias("rows"))
        rows = rows.select(F.lit(readers.detect_format(path)).alias("format"), "rows")
        result = rows if result is None else result.unionAll(rows)
    return result


@query("s2_csv", ORDER_LINES)
def csv_source(spark, sf_dir):
    """orders as CSV with inferred types; a line with a value too many is left out."""
    path = fresh_dir(spark, "orders") + ".csv"
    lines = _order_lines(spark, sf_dir)
    lines.write.option("header", True).csv(path)
    too_long = "\n".join([",".join(lines.columns), "1,2,P,3.0,5-LOW,too long"])
    spark.range(1).select(F.lit(too_long)).write.mode("append").text(path)
    return readers.read_source(spark, path)


@query("s3_tsv", ORDER_LINES)
def tsv_source(spark, sf_dir):
    path = fresh_dir(spark, "orders") + ".tsv"
    _order_lines(spark, sf_dir).write.options(header=True, sep="\t").csv(path)
    return readers.read_source(spark, path)


@query(
    "s4_parquet",
    """select l_returnflag, count(*) as lines, round(sum(l_quantity), 2) as quantity
       from lineitem group by l_returnflag""",
)
def parquet_source(spark, sf_dir):
    lines = readers.read_source(spark, f"{sf_dir}/lineitem*.parquet")
    return lines.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


@query("s5_json_document", "select * from customer")
def json_document(spark, sf_dir):
    """customer as JSON documents, each one array of objects."""
    path = fresh_dir(spark, "customer") + ".json"
    customer = table(spark, sf_dir, "customer")
    objects = F.to_json(F.struct(*customer.columns))
    # Five hundred keys to a document, however large the table.
    documents = customer.groupBy(F.floor(F.col("c_custkey") / 500)).agg(
        F.concat(F.lit("[\n"), F.concat_ws(",\n", F.collect_list(objects)), F.lit("]")).alias("d")
    )
    documents.select("d").repartition(16, "d").write.option("lineSep", "\n").option(
        "maxRecordsPerFile", 1
    ).text(path)
    return readers.read_source(spark, path, schema=customer.schema)


@query("s6_json_lines", "select * from events")
def json_lines(spark, sf_dir):
    path = fresh_dir(spark, "events") + ".jsonl"
    events = table(spark, sf_dir, "events")
    micros = {"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}
    events.write.options(**micros).json(path)
    return readers.read_source(spark, path, schema=events.schema, options=micros)


@query("s8_reader_options", ORDER_LINES)
def reader_options(spark, sf_dir):
    """Caller options override the defaults: separator, no header, own names."""
    path = fresh_dir(spark, "orders") + ".csv"
    lines = _order_lines(spark, sf_dir)
    lines.write.options(sep=";", header=False).csv(path)
    options = {"sep": ";", "header": "false"}
    return readers.read_source(spark, path, schema=lines.schema, options=options)


@query(
    "s9_many_sources",
    """select coalesce(c_name, '-') as c_name, coalesce(s_name, '-') as s_name
       from customer full join supplier on false""",
)
def many_sources(spark, sf_dir):
    paths = [f"{sf_dir}/customer.parquet", f"{sf_dir}/supplier.parquet"]
    return readers.read_many(spark, paths).select("c_name", "s_name").fillna("-")


@query(
    "s9_many_files",
    """select c_custkey, c_name, case when c_custkey % 3 = 1 then c_acctbal end as c_acctbal,
              case when c_custkey % 3 = 2 then c_nationkey end as c_nationkey from customer""",
)
def many_files(spark, sf_dir):
    """Sixty files of three schemas, two delimited ones and Parquet, given one by one."""
    customer, base, paths = table(spark, sf_dir, "customer"), fresh_dir(spark, "many"), []
    for i, more in enumerate(([], ["c_acctbal"], ["c_nationkey"])):
        part = customer.filter(F.col("c_custkey") % 3 == i).select("c_custkey", "c_name", *more)
        part = part.repartition(20, "c_custkey")
        if i == 2:
            part.write.parquet(f"{base}/2.parquet")
        else:
            part.write.option("header", True).csv(f"{base}/{i}.csv")
        files = spark.read.format("binaryFile").load(f"{base}/{i}.{'parquet' if i == 2 else 'csv'}")
        paths += [row["path"] for row in files.select("path").collect()]
    return readers.read_many(spark, sorted(paths))


# Fixed value: bytes of documents that go into one file of text, so that one task writes no more.
TEXT_FILE_BYTES = 128 * 1024 * 1024


@query(
    "s2_csv_with_line_breaks",
    """select doc_id, case when text not in ('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN',
              '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a',
              'nan', 'null') then text end as text, lang, n_chars from documents""",
)
def csv_with_line_breaks(spark, sf_dir):
    """Texts with line breaks, quotes and separators through delimited files that many tasks read."""
    path = fresh_dir(spark, "texts") + ".csv"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    # Two files or more, each larger than what one task reads of it.
    files = max(2, path_bytes(spark, f"{sf_dir}/documents.parquet") // TEXT_FILE_BYTES)
    docs.coalesce(files).write.options(header=True, quoteAll=True, escape='"').csv(path)
    return readers.read_source(spark, path)


@query(
    "s10_sample",
    """select o_orderkey, o_custkey from orders
       order by md5('42|10:o_orderkey' || length(o_orderkey::varchar) || ':' || o_orderkey)
       limit 100""",
)
def sample(spark, sf_dir):
    return readers.sample_rows(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 100, ["o_orderkey"]
    )


@query(
    "s11_manifest",
    f"""select 'customer' as source_uri, 'parquet' as source_type,
               timestamp '2024-06-01' as ingested_at, count(*) as row_count,
               5 as column_count, {sql_checksum(sql_hash(CUSTOMER))} as checksum,
               'double' as type_of_balance, true as has_bytes
        from customer""",
)
def manifest(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    size = manifests.source_bytes(customer).first()["size_bytes"]
    found = manifests.manifest(
        customer, "customer", "parquet", datetime(2024, 6, 1), size_bytes=size
    )
    return found.select(
        "source_uri",
        "source_type",
        "ingested_at",
        "row_count",
        "column_count",
        "checksum",
        F.element_at("schema_snapshot", "c_acctbal").alias("type_of_balance"),
        (F.col("size_bytes") > 0).alias("has_bytes"),
    )


@query(
    "s12_checksum",
    f"select count(*) as row_count, {sql_checksum(sql_hash(LINEITEM))} as checksum from lineitem",
)
def content_checksum(spark, sf_dir):
    """Rows in any order: they are dealt anew, into as many parts as their size asks for."""
    return manifests.checksum(table(spark, sf_dir, "lineitem").hint("rebalance"))


@query(
    "s13_schema_snapshot",
    """select 0 as position, 'p_partkey' as "column", 'bigint' as type, count(p_partkey) as filled
       from part
       union all select 1, 'p_name', 'string', count(p_name) from part
       union all select 2, 'p_brand', 'string', count(p_brand) from part
       union all select 3, 'p_type', 'string', count(p_type) from part
       union all select 4, 'p_size', 'int', count(p_size) from part
       union all select 5, 'p_retailprice', 'double', count(p_retailprice) from part""",
)
def schema_snapshot(spark, sf_dir):
    """Columns and types with the number of values they hold."""
    part = table(spark, sf_dir, "part")
    filled = profile(part, unique=None).select(
        "column", (F.col("rows") - F.col("null_count")).alias("filled")
    )
    return manifests.schema_rows(part).join(filled, "column")


@query("s14_declared_schema", "select * from part")
def declared_schema(spark, sf_dir):
    path = fresh_dir(spark, "part") + ".csv"
    table(spark, sf_dir, "part").write.option("header", True).csv(path)
    schema = schema_from_pairs(
        [
            "p_partkey:long",
            "p_name:varchar",
            "p_brand:text",
            "p_type:string",
            "p_size:integer",
            "p_retailprice:float64",
        ]
    )
    return readers.read_source(spark, path, schema=schema)


@query(
    "a1_codec_comparison",
    """select codec, count(*) as row_count, 11 as column_count,
              true as is_smaller
       from lineitem, (values ('snappy'), ('gzip'), ('zstd'), ('none')) c(codec)
       group by codec""",
)
def codec_comparison(spark, sf_dir):
    measured = codecs.compare_codecs(table(spark, sf_dir, "lineitem"), fresh_dir(spark, "codecs"))
    ratio = F.col("compression_ratio")
    smaller = F.when(F.col("codec") == "none", ratio >= 0.99).otherwise(ratio > 1)
    return measured.select("codec", "row_count", "column_count", smaller.alias("is_smaller"))


# Figures per supplier that stand for measured codecs: whole numbers, so sums are exact.
_FIGURES = """(select l_suppkey, 'zstd' as codec, sum(l_linenumber)::double as ratio,
                      sum(l_quantity) as speed from lineitem group by 1
               union all select l_suppkey, 'snappy', sum(l_quantity) / 8,
                      sum(l_linenumber) * 10.0::double from lineitem group by 1
               union all select l_suppkey, 'none', count(*)::double, sum(l_quantity) / 2
               from lineitem group by 1)"""


@query(
    "a2_codec_recommendation",
    f"""select l_suppkey, case when z > s * 1.2 then 'zstd' when sv > zv * 1.5 then 'snappy'
                               else 'zstd' end as recommended, best_ratio, best_throughput
        from (select l_suppkey, max(ratio) filter (where codec = 'zstd') as z,
                     max(ratio) filter (where codec = 'snappy') as s,
                     max(speed) filter (where codec = 'zstd') as zv,
                     max(speed) filter (where codec = 'snappy') as sv,
                     arg_max(codec, (ratio, codec)) as best_ratio,
                     arg_max(codec, (speed, codec)) as best_throughput
              from {_FIGURES} group by l_suppkey)""",
)
def codec_recommendation(spark, sf_dir):
    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.sum("l_linenumber").cast("double").alias("numbers"),
        F.sum("l_quantity").alias("quantity"),
        F.count(F.lit(1)).cast("double").alias("lines"),
    )

    def measured(codec, ratio, speed):
        return F.struct(
            F.lit(codec).alias("codec"),
            ratio.alias("compression_ratio"),
            speed.alias("throughput_mb_s"),
        )

    figures = sums.select(
        "l_suppkey",
        F.inline(
            F.array(
                measured("zstd", F.col("numbers"), F.col("quantity")),
                measured("snappy", F.col("quantity") / 8, F.col("numbers") * 10),
                measured("none", F.col("lines"), F.col("quantity") / 2),
            )
        ),
    )
    return codecs.recommend_codec(figures, ["l_suppkey"])

"""Reader, sink and corpus queries on files that Spark writes from the tables."""

import zipfile

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F, types as T

from ..operators.transforms import image_column_to_path
from ..session import scratch_path
from ..sources import files, sniff
from ..sources.arrow import read_arrow
from ..sources.sinks import publish, write_table
from ..sources.storage import open_filesystem
from ..sources.tables import read_table, row_limited
from ..sources.text import rejected_lines
from .registry import query

ORDERS_SQL = "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders"
ORDER_FIELDS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
# Files of JSON arrays at least, and rows of one (150 MB with their filler).
ARRAY_FILES, ARRAY_ROWS = 5, 30_000


def written(t, fmt: str) -> str:
    """Orders written in a format to a fresh folder."""
    return write_table(t.orders.select(*ORDER_FIELDS), scratch_path(t.spark, fmt), fmt)


@query(ORDERS_SQL)
def scan_csv_orders(t):
    """Delimited text, types found by content."""
    return read_table(t.spark, written(t, "csv"))


@query("select doc_id, text || chr(10) || 'a \"b\", c' as text, source from documents")
def scan_csv_documents(t):
    """Texts with line breaks, quotes and separators."""
    text = F.concat("text", F.lit('\na "b", c'))
    path = write_table(t.documents.select("doc_id", text.alias("text"), "source"), scratch_path(t.spark, "csv"), "csv")
    return read_table(t.spark, path)


@query(ORDERS_SQL)
def scan_csv_permuted(t):
    """Files of one folder with their columns in another order."""
    path = scratch_path(t.spark, "permuted")
    for half, fields in enumerate((ORDER_FIELDS, ORDER_FIELDS[::-1])):
        part = t.orders.filter(F.col("o_orderkey") % 2 == half).select(*fields)
        part.write.mode("append").option("header", True).csv(path)
    return read_table(t.spark, path, fmt="csv").select(*ORDER_FIELDS)


@query("select o_orderkey || ',x,y' as line from orders where o_orderkey % 3 = 0")
def rejected_order_lines(t):
    """Lines with a field too many."""
    path = scratch_path(t.spark, "bad")
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), F.lit("x"), F.when(F.col("o_orderkey") % 3 == 0, "y"))
    t.orders.select(line.alias("k,v")).write.option("header", True).option("sep", "\x01").csv(path)
    return rejected_lines(t.spark, path)


def _with_ends(batches):
    """Rows of a task with columns that tell its first and its last one."""
    held, begun = None, False

    def told(batch, first, last):
        at = range(batch.num_rows)
        ends = [pa.array([first and i == 0 for i in at]), pa.array([last and i == at[-1] for i in at])]
        return pa.RecordBatch.from_arrays([*batch.columns, *ends], [*batch.schema.names, "is_first", "is_last"])

    for batch in batches:
        if batch.num_rows:
            if held is not None:
                yield told(held, not begun, False)
                begun = True
            held = batch
    if held is not None:
        yield told(held, not begun, True)


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders")
def scan_json_array_orders(t):
    """Documents over several lines whose first row is longer than a sample.

    Every task writes its rows as one array, row by row; larger tables make more files.
    """
    path = scratch_path(t.spark, "arrays")
    orders = t.orders.select(*ORDER_FIELDS)
    dealt = orders.repartition(max(ARRAY_FILES, -(-orders.count() // ARRAY_ROWS)))
    ends = [T.StructField(x, T.BooleanType()) for x in ("is_first", "is_last")]
    rows = dealt.mapInArrow(_with_ends, T.StructType([*orders.schema.fields, *ends]))
    row = F.to_json(F.struct(*ORDER_FIELDS, F.repeat(F.lit("x"), F.lit(5000)).alias("filler")))
    begin, end = F.when(F.col("is_first"), "[").otherwise(""), F.when(F.col("is_last"), "]").otherwise(",")
    rows.select(F.concat(begin, row, end).alias("value")).write.text(path)
    return read_table(t.spark, path, fmt="json").select(*ORDER_FIELDS)


@query(ORDERS_SQL)
def scan_mixed_folder(t):
    """Two appended writes and a stray file of another format: all rows of the preferred one."""
    path = scratch_path(t.spark, "mixed")
    for half in (0, 1):
        t.orders.filter(F.col("o_orderkey") % 2 == half).select(*ORDER_FIELDS).write.mode("append").parquet(path)
    t.orders.limit(3).select("o_orderkey").coalesce(1).write.mode("append").option("header", True).csv(path)
    return read_table(t.spark, path)


@query(ORDERS_SQL)
def scan_tsv_orders(t):
    return read_table(t.spark, written(t, "tsv"))


@query(ORDERS_SQL)
def scan_json_orders(t):
    return read_table(t.spark, written(t, "json")).select(*ORDER_FIELDS)


@query(ORDERS_SQL)
def scan_parquet_orders(t):
    return read_table(t.spark, publish(t.orders.select(*ORDER_FIELDS), scratch_path(t.spark, "published"), fmt="parquet"))


@query(ORDERS_SQL)
def scan_feather_orders(t):
    return read_table(t.spark, written(t, "feather"))


@query("select o_orderpriority, count(*) as cnt from orders group by 1")
def scan_arrow_column(t):
    """One column of an Arrow folder, split at the record batches."""
    path = written(t, "arrow")
    return read_arrow(t.spark, path, ["o_orderpriority"], split_bytes=64 * 1024).groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("cnt")
    )


@query("select * from (values ('csv', ',', true), ('json-lines', null, true), ('tsv', '\t', true)) as f(format, separator, seen)")
def sniffed_formats(t):
    """Formats told from content; all files are named alike."""
    root = scratch_path(t.spark, "formats")
    table = t.orders.select(*ORDER_FIELDS)
    for fmt in ("csv", "tsv", "json"):
        write_table(table, f"{root}/{fmt}", fmt)
    found = sniff.sniff_formats(sniff.text_files(t.spark, root))
    return found.groupBy("format", "separator").agg((F.count(F.lit(1)) > 0).alias("seen"))


@query()
def file_catalog_totals(t):
    """The inventory of the table folder itself."""
    return files.catalog_totals(files.file_catalog(t.spark, t.folder))


@query()
def picked_dataset(t):
    return files.pick_dataset(files.file_catalog(t.spark, t.folder)).select("ext", "length", "priority")


@query(
    "select 'utf-8' as encoding, cast(sum(octet_length(encode(text)) + 1) as bigint) as n_bytes from documents"
)
def encoding_audit_documents(t):
    """Whole texts as files of lines; every byte is checked."""
    path = scratch_path(t.spark, "texts")
    t.documents.select("text").write.text(path)
    audit = files.encoding_audit(t.spark, path, glob="*.txt")
    return files.encoding_totals(audit.filter("n_bytes > 0")).select("encoding", "n_bytes")


@query("select doc_id, text, true as is_safe from documents")
def expanded_archives(t):
    """Texts packed by Spark tasks, one archive per task, then unpacked."""
    folder = scratch_path(t.spark, "archives")

    def pack(batches):
        name = f"{folder}/part-{TaskContext.get().partitionId()}.zip"
        filesystem, path = open_filesystem(name)
        filesystem.create_dir(open_filesystem(folder)[1], recursive=True)
        with filesystem.open_output_stream(path) as sink:
            with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as archive:
                for batch in batches:
                    for doc_id, text in zip(batch["doc_id"], batch["text"]):
                        archive.writestr(f"{doc_id}.txt", text)
        yield pd.DataFrame({"path": [name]})

    t.documents.select("doc_id", "text").mapInPandas(pack, "path string").write.parquet(f"{folder}-written")
    members = files.expand_zip(files.zip_files(t.spark, folder))
    return members.select(
        F.regexp_extract("member", r"^([0-9]+)\.txt$", 1).cast("long").alias("doc_id"),
        F.decode("content", "UTF-8").alias("text"),
        "is_safe",
    )


@query(
    "select ext, cast(count(distinct o_orderstatus) as bigint) as files, is_table, true as has_bytes from orders, "
    "(values ('csv', true), ('parquet', true)) as f(ext, is_table) group by ext, is_table"
)
def catalog_of_partitions(t):
    """The inventory of a folder with one file for each order status and format."""
    root = scratch_path(t.spark, "catalog")
    for fmt in ("csv", "parquet"):
        by_status = t.orders.select(*ORDER_FIELDS).repartition("o_orderstatus")
        by_status.write.option("header", True).partitionBy("o_orderstatus").format(fmt).save(f"{root}/{fmt}")
    totals = files.catalog_totals(files.file_catalog(t.spark, root))
    return totals.select("ext", "files", "is_table", (F.col("bytes") > 0).alias("has_bytes"))


@query(ORDERS_SQL)
def scan_partitioned_mixed_folder(t):
    """A data set in partition folders beside a file of another format."""
    path = scratch_path(t.spark, "partitioned")
    t.orders.select(*ORDER_FIELDS).write.partitionBy("o_orderstatus", "o_orderpriority").parquet(path)
    t.orders.limit(3).select("o_orderkey").coalesce(1).write.mode("append").option("header", True).csv(path)
    return read_table(t.spark, path).select(*ORDER_FIELDS)


@query("select (select count(*) from orders) > 100 as over_100, (select count(*) from orders) > 10000000000 as over_all")
def bounded_scan_orders(t):
    """Whether bounds cut the table."""
    low, high = (row_limited(t.orders, n) for n in (100, 2_000_000_000))
    return low.select(F.col("row_limited").alias("over_100")).join(high.select(F.col("row_limited").alias("over_all")))


@query("select page_id, url as image from pages")
def image_paths_pages(t):
    """Images as rows of path and bytes: only the path goes on."""
    images = t.pages.select("page_id", F.struct(F.col("url").alias("path"), F.encode("html", "UTF-8").alias("data")).alias("image"))
    return image_column_to_path(images, "image")

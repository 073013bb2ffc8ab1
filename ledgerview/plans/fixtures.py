"""Views over the fixture tables: invoices, their items, and the event table as a document log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerview.engine import Engine
from ledgerview.schema import ROWNUM, ViewSpec
from ledgerview.types import Column

INVOICE = ViewSpec(
    "SalesInvoice",
    (
        Column("CustomerName", "string"),
        Column("NoCase", "string", nocase=True),
        Column("Date", "datetime"),
        Column("Serial", "int"),
        Column("Status", "byte"),
        Column("Approved", "bool"),
        Column("Checked", "bool"),
        Column("Priority", "string"),
        Column("Note", "string", nocase=True),
        Column("Remark", "string", fulltext=True),
        Column("Total", "double"),
    ),
    doctype="invoice",
    primary=True,
)
ITEMS = ViewSpec("SalesItemRows", (Column("Product", "string"), Column("QTY", "decimal"), Column("Price", "decimal"), Column("Discount", "decimal")), doctype="invoice")
EVENT = ViewSpec("Events", (Column("Kind", "string"), Column("At", "datetime"), Column("UserId", "long"), Column("Value", "double")), doctype="event")
DOCUMENT = ViewSpec("Documents", (Column("Text", "string", fulltext=True), Column("Lang", "string"), Column("Source", "string")), doctype="document")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def invoices(spark: SparkSession, d: str) -> DataFrame:
    """Invoice rows, one for each order; the customer side joins by key and is pruned to its name."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_name")
    k = F.col("o_orderkey")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.md5(F.concat(F.lit("orders:"), k.cast("string"))).alias("docid"), k.alias(ROWNUM), F.col("c_name").alias("CustomerName"),
        F.concat(F.lit("Me "), (k % 10).cast("string")).alias("NoCase"), F.col("o_orderdate").alias("Date"), (k % 10000).cast("int").alias("Serial"),
        (k % 4).cast("short").alias("Status"), (k % 100 == 0).alias("Approved"), F.when(k % 7 != 0, k % 3 == 0).alias("Checked"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("Priority"), F.when(k % 5 != 0, F.concat(F.lit("Note "), (k % 3).cast("string"))).alias("Note"),
        F.concat_ws(" ", F.col("o_orderpriority"), F.lit("Status"), F.col("o_orderstatus"), F.lit("group"), (k % 13).cast("string")).alias("Remark"),
        F.col("o_totalprice").alias("Total"),
    )


INVOICE_SQL = """inv AS (SELECT md5('orders:' || o_orderkey) AS docid, o_orderkey AS _rownum, c_name AS "CustomerName",
 'Me ' || (o_orderkey % 10) AS "NoCase", o_orderdate AS "Date", CAST(o_orderkey % 10000 AS INTEGER) AS "Serial",
 CAST(o_orderkey % 4 AS SMALLINT) AS "Status", (o_orderkey % 100 = 0) AS "Approved",
 CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 3 = 0 END AS "Checked", nullif(o_orderpriority, '5-LOW') AS "Priority",
 CASE WHEN o_orderkey % 5 <> 0 THEN 'Note ' || (o_orderkey % 3) END AS "Note",
 o_orderpriority || ' Status ' || o_orderstatus || ' group ' || (o_orderkey % 13) AS "Remark", o_totalprice AS "Total"
 FROM orders JOIN customer ON o_custkey = c_custkey)"""


def invoice_documents(spark: SparkSession, d: str) -> DataFrame:
    """Nested invoices: order columns and an array of their items, in line order."""
    item = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    money = lambda c: F.col(c).cast("decimal(18,2)")
    cells = F.struct(F.col("l_linenumber").alias("Line"), F.col("p_brand").alias("Product"), money("l_quantity").alias("QTY"), money("l_extendedprice").alias("Price"), money("l_discount").alias("Discount"))
    grouped = item.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(cells)).alias("Items"))
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.join(grouped, k == F.col("l_orderkey"), "left").select(
        F.md5(F.concat(F.lit("orders:"), k.cast("string"))).alias("docid"), k.alias(ROWNUM), (k % 4).cast("short").alias("Status"), (k % 10000).cast("int").alias("Serial"), "Items"
    )


def item_rows(spark: SparkSession, d: str, status: int | None = 3) -> DataFrame:
    """The exploded item view straight from the flat tables: no nesting that the explode would undo again."""
    k = F.col("l_orderkey")
    li = table(spark, d, "lineitem")
    li = li.filter(k % 4 == status) if status is not None else li
    money = lambda c: F.col(c).cast("decimal(18,2)")
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.md5(F.concat(F.lit("orders:"), k.cast("string"))).alias("docid"), (k * 1_000_000 + F.col("l_linenumber")).alias(ROWNUM),
        F.col("p_brand").alias("Product"), money("l_quantity").alias("QTY"), money("l_extendedprice").alias("Price"), money("l_discount").alias("Discount"),
    )


ITEMS_SQL = """items AS (SELECT md5('orders:' || l_orderkey) AS docid, p_brand AS "Product", CAST(l_quantity AS DECIMAL(18,2)) AS "QTY",
 CAST(l_extendedprice AS DECIMAL(18,2)) AS "Price", CAST(l_discount AS DECIMAL(18,2)) AS "Discount", l_linenumber
 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 4 = 3)"""


def event_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as a version log: the user is the document, an error its tombstone."""
    e = table(spark, d, "events")
    return e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("docid"), F.col("event_type").alias("typename"), F.col("event_id").alias("version"), "ts",
        (F.col("event_type") == DEAD).alias("is_deleted"), (F.col("event_id") % 5 == 0).alias("is_replicated"), F.col("props").alias("body"),
    )


DEAD = "error"
LOG_SQL = """log AS (SELECT 'u' || user_id AS docid, event_type AS typename, event_id AS version, ts, event_type = 'error' AS is_deleted,
 event_id % 5 = 0 AS is_replicated, props AS body FROM events)"""


def event_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.md5(F.concat(F.lit("events:"), F.col("event_id").cast("string"))).alias("docid"), F.col("event_id").alias(ROWNUM), F.col("event_type").alias("Kind"), F.col("ts").alias("At"), F.col("user_id").alias("UserId"), F.col("value").alias("Value"))


EVENTS_SQL = """ev AS (SELECT md5('events:' || event_id) AS docid, event_id AS _rownum, event_type AS "Kind", ts AS "At", user_id AS "UserId", value AS "Value" FROM events)"""


def document_rows(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.select(F.md5(F.concat(F.lit("documents:"), F.col("doc_id").cast("string"))).alias("docid"), F.col("doc_id").alias(ROWNUM), F.col("text").alias("Text"), F.col("lang").alias("Lang"), F.col("source").alias("Source"))


def engine(spark: SparkSession, d: str) -> Engine:
    """All fixture views; tables are opened only for the views that a query asks for."""
    found = Engine(spark)
    for view, rows in ((INVOICE, invoices), (ITEMS, item_rows), (EVENT, event_rows), (DOCUMENT, document_rows)):
        found.register(view, lambda rows=rows: rows(spark, d))
    return found

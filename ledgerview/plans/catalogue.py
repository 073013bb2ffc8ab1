"""The reference queries over the fixture tables, each beside its SQL oracle."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerview.engine import Engine
from ledgerview.functions import cron, fulltext
from ledgerview.operators import kv, sync, views
from ledgerview.plans import fixtures as X
from ledgerview.schema import ROWNUM, Registry, ViewSpec
from ledgerview.sources import export, store
from ledgerview.sources.shared import shared_dir
from ledgerview.streaming import maintain
from ledgerview.types import Column

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}

#: Filters on invoices: name -> (filter, SQL condition).
INVOICE_FILTERS = {
    "filter_eq": ("Serial = 100", '"Serial" = 100'),
    "filter_ne": ("status != 2", '"Status" <> 2'),
    "filter_ne_null": ('Priority <> "1-URGENT"', "\"Priority\" IS DISTINCT FROM '1-URGENT'"),
    "filter_lt": ("Serial < 100", '"Serial" < 100'),
    "filter_le": ("serial <= 100", '"Serial" <= 100'),
    "filter_gt": ("Serial > 9900", '"Serial" > 9900'),
    "filter_ge": ("9900 <= Serial", '"Serial" >= 9900'),
    "filter_and_or": ('Serial < 100 && (Status = 2 or Status == 3) and Approved = false', '"Serial" < 100 AND "Status" IN (2, 3) AND NOT "Approved"'),
    "filter_not": ('not (Priority = "1-URGENT" or Serial > 50)', "NOT coalesce(\"Priority\" = '1-URGENT' OR \"Serial\" > 50, FALSE) AND \"Serial\" <= 50"),
    "filter_const_true": ("true", "TRUE"),
    "filter_const_false": ("false", "FALSE"),
    "filter_const_inside": ("Serial < 5 && true || false", '"Serial" < 5'),
    "filter_empty": ("", "TRUE"),
    "filter_between": ("Serial.Between(1, 3)", '"Serial" BETWEEN 1 AND 3'),
    "filter_between_swapped": ("Serial.Between(3, 1)", '"Serial" BETWEEN 1 AND 3'),
    "filter_date_between": ('Date.Between("2000-1-1", "2000-2-1")', "\"Date\" BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '2000-02-01'"),
    "filter_date_literal": ('Date >= "2001-06-01"', "\"Date\" >= TIMESTAMP '2001-06-01'"),
    "filter_in": ("Serial.In(20, 30, 40)", '"Serial" IN (20, 30, 40)'),
    "filter_in_byte": ("Status.In(1, 3) and Serial < 1000", '"Status" IN (1, 3) AND "Serial" < 1000'),
    "date_year": ("Date.Year = 2000", 'year("Date") = 2000'),
    "date_year_range": ("Date.Year >= 1999 and Date.Year < 2001", 'year("Date") BETWEEN 1999 AND 2000'),
    "date_month": ("Date.Month = 7 and Date.Year != 1999", 'month("Date") = 7 AND year("Date") <> 1999'),
    "date_day": ("Date.Day > 30", 'day("Date") > 30'),
    "date_part_in": ("Date.Year.In(1996, 2000) && Date.Month.In(2, 3)", 'year("Date") IN (1996, 2000) AND month("Date") IN (2, 3)'),
    "date_part_between": ("Date.Year.Between(1998, 1996)", 'year("Date") BETWEEN 1996 AND 1998'),
    "filter_bool_true": ("Approved = true", '"Approved"'),
    "filter_bool_false_null": ("Checked = false", '"Checked" IS DISTINCT FROM TRUE'),
    "filter_bool_ne": ("Checked != true", '"Checked" IS DISTINCT FROM TRUE'),
    "filter_bool_bare": ("Checked and Serial < 500", '"Checked" AND "Serial" < 500'),
    "filter_nocase": ('NoCase = "ME 4" and Serial < 1000', "lower(\"NoCase\") = 'me 4' AND \"Serial\" < 1000"),
    "filter_nocase_null": ('Note = ""', "lower(coalesce(\"Note\", '')) = ''"),
    "filter_is_null": ("Priority = null", '"Priority" IS NULL'),
    "filter_column_pair": ("Serial <= Status", '"Serial" <= "Status"'),
    "filter_negative": ("Total > -1.5 and Serial < 3", '"Total" > -1.5 AND "Serial" < 3'),
    "ft_column_eq": ('Remark = "1-urgent"', "list_contains(w, '1-urgent')"),
    "ft_column_and": ('Remark = "1-urgent Group"', "list_contains(w, '1-urgent') AND list_contains(w, 'group')"),
    "ft_column_or": ('Remark = "1-urgent 7 +12"', "(list_contains(w, '1-urgent') AND list_contains(w, '7')) OR list_contains(w, '12')"),
    "ft_column_not": ('Remark = "1-urgent -7"', "list_contains(w, '1-urgent') AND NOT list_contains(w, '7')"),
    "ft_column_leading_not": ('Remark = "-o -p"', "NOT list_contains(w, 'o') AND NOT list_contains(w, 'p')"),
    "ft_column_wildcard": ('Remark = "*high 1?"', "len(list_filter(w, lambda x: regexp_full_match(x, '.*high'))) > 0 AND len(list_filter(w, lambda x: regexp_full_match(x, '1.'))) > 0"),
    "ft_column_unknown_word": ('Remark = "nosuchword group +12"', "list_contains(w, '12')"),
    "ft_column_ne": ('Remark != "1-urgent"', "NOT list_contains(w, '1-urgent')"),
}
INVOICE_SQL = f"WITH {X.INVOICE_SQL}, words AS (SELECT *, string_split(lower(\"Remark\"), ' ') AS w FROM inv)"


def _add(name: str, sql: str = "") -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _oracles[name] = sql
        return f

    return keep


def _filters() -> None:
    for name, (where, sql) in INVOICE_FILTERS.items():
        query = lambda s, d, where=where: X.engine(s, d).query("SalesInvoice", where).df.select("docid", ROWNUM)
        _add(name, f"{INVOICE_SQL} SELECT docid, _rownum FROM words WHERE {sql}")(query)


_filters()


def _invoices(s, d, where="", start=0, count=-1, orderby="", select=("docid", ROWNUM)):
    return X.engine(s, d).query("SalesInvoice", where, start, count, orderby).df.select(*select)


@_add("filter_guid", f"{INVOICE_SQL} SELECT docid, _rownum FROM inv WHERE docid = md5('orders:7')")
def filter_guid(s, d):
    import hashlib

    return _invoices(s, d, f'docid = Guid("{{{hashlib.md5(b"orders:7").hexdigest().upper()}}}")')


@_add("filter_lambda", f'{INVOICE_SQL} SELECT docid, _rownum FROM inv WHERE "Serial" BETWEEN 1 AND 300 AND "Status" = 2')
def filter_lambda(s, d):
    low, high = 1, 300
    return _invoices(s, d, lambda v: v.Serial.between(low, high) & (v.Status == 2))


def _event_filters() -> None:
    for name, where, sql in (
        ("date_hour", "At.Hour = 3", 'hour("At") = 3'),
        ("date_minute", "At.Minute.In(0, 30) and At.Hour >= 12", 'minute("At") IN (0, 30) AND hour("At") >= 12'),
        ("filter_datetime_time", 'At < "2024-01-02 06:30:00"', "\"At\" < TIMESTAMP '2024-01-02 06:30:00'"),
    ):
        _add(name, f"WITH {X.EVENTS_SQL} SELECT docid, _rownum FROM ev WHERE {sql}")(lambda s, d, where=where: X.engine(s, d).query("Events", where).df.select("docid", ROWNUM))


_event_filters()


@_add("view_scan", f'WITH {X.INVOICE_SQL} SELECT docid, "CustomerName", "Serial", "Total" FROM inv')
def view_scan(s, d):
    return _invoices(s, d, select=("docid", "CustomerName", "Serial", "Total"))


@_add("view_project_by_name", "SELECT md5('orders:' || o_orderkey) AS docid, o_totalprice AS \"O_TotalPrice\", o_orderstatus AS \"O_OrderStatus\", CAST(NULL AS VARCHAR) AS \"Missing\" FROM orders")
def view_project_by_name(s, d):
    view = ViewSpec("ByName", (Column("O_TotalPrice", "double"), Column("O_OrderStatus"), Column("Missing")))
    docs = X.table(s, d, "orders").withColumn("docid", F.md5(F.concat(F.lit("orders:"), F.col("o_orderkey").cast("string"))))
    return views.emit_object(docs, view)


@_add("view_project_by_position", "SELECT md5('orders:' || o_orderkey) AS docid, CAST(o_orderkey % 10 AS INTEGER) AS \"A\", upper(o_orderstatus) AS \"B\" FROM orders")
def view_project_by_position(s, d):
    view = ViewSpec("ByPosition", (Column("A", "int"), Column("B")))
    docs = X.table(s, d, "orders").withColumn("docid", F.md5(F.concat(F.lit("orders:"), F.col("o_orderkey").cast("string"))))
    return views.emit(docs, view, F.col("o_orderkey") % 10, F.upper("o_orderstatus"))


@_add("view_filtered_explode", f'WITH {X.ITEMS_SQL} SELECT items.docid, "Product", "QTY", "Price", "Discount" FROM items JOIN orders ON items.docid = md5(\'orders:\' || o_orderkey)')
def view_filtered_explode(s, d):
    docs = X.invoice_documents(s, d).filter("Status = 3 and Items is not null")
    return views.emit_each(docs, X.ITEMS, "Items").select("docid", "Product", *(F.col(c).cast("decimal(18,2)").alias(c) for c in ("QTY", "Price", "Discount")))


@_add("count_all", f"WITH {X.INVOICE_SQL} SELECT count(*) AS n FROM inv")
def count_all(s, d):
    return X.engine(s, d).query("SalesInvoice").matched.agg(F.count("*").alias("n"))


@_add("count_filter", f'WITH {X.INVOICE_SQL} SELECT count(*) AS n FROM inv WHERE "Serial" < 100')
def count_filter(s, d):
    return X.engine(s, d).query("SalesInvoice", "Serial < 100").matched.agg(F.count("*").alias("n"))


@_add("group_sum", f'WITH {X.ITEMS_SQL} SELECT "Product", sum("Price") AS "TotalPrice", sum("QTY") AS "TotalQTY" FROM items WHERE "Product" IN (\'Brand#1\', \'Brand#3\') GROUP BY 1')
def group_sum(s, d):
    return X.engine(s, d).call("sum_by_product", 'product = "Brand#1" or product = "Brand#3"')


@_add("group_sum_args", f'WITH {X.ITEMS_SQL} SELECT "Product", sum("Price") AS "TotalPrice", sum("QTY") AS "TotalQTY" FROM items GROUP BY 1')
def group_sum_args(s, d):
    return X.engine(s, d).call("sum_by_product", "", "SalesItemRows")


PAGE = ("docid", ROWNUM, "Serial", "Priority")
for _name, _where, _sql, _start, _count, _order, _keys in (
    ("sort_page_asc", "Serial < 100", '"Serial" < 100', 0, 10, "serial", '"Serial", _rownum'),
    ("sort_page_desc", "Serial < 100", '"Serial" < 100', 5, 10, "serial desc", '"Serial" DESC, _rownum DESC'),
    ("sort_nulls_asc", "Serial < 40", '"Serial" < 40', 0, 30, "Priority", '"Priority" ASC NULLS LAST, _rownum'),
    ("sort_nulls_desc", "Serial < 40", '"Serial" < 40', 0, 38, "Priority desc", '"Priority" DESC NULLS LAST, CASE WHEN "Priority" IS NULL THEN _rownum ELSE -_rownum END'),
    ("sort_bool", "Serial < 200", '"Serial" < 200', 0, 150, "Checked", 'coalesce("Checked", FALSE), _rownum'),
    ("page_unsorted", "", "TRUE", 20, 10, "", "_rownum"),
    ("page_unknown_column", "Serial > 5", '"Serial" > 5', 0, 7, "nosuch desc", "_rownum"),
    ("page_count_zero", "Serial < 9", '"Serial" < 9', 0, 0, "serial", '"Serial"'),
):
    _add(_name, f'WITH {X.INVOICE_SQL} SELECT docid, _rownum, "Serial", "Priority" FROM inv WHERE {_sql} ORDER BY {_keys} LIMIT {_count} OFFSET {_start}')(
        lambda s, d, w=_where, a=_start, c=_count, o=_order: _invoices(s, d, w, a, c, o, PAGE)
    )


@_add("total_count", f'WITH {X.INVOICE_SQL} SELECT count(*) AS total_count, least(count(*), 10) AS "count" FROM inv WHERE "Serial" < 100')
def total_count(s, d):
    found = X.engine(s, d).query("SalesInvoice", "Serial < 100", 0, 10, "serial desc")
    return found.matched.agg(F.count("*").alias("total_count"), F.least(F.count("*"), F.lit(10)).cast("long").alias("count"))


TOKENS_SQL = r"list_filter(regexp_extract_all(lower(text), '\p{Nd}+|\p{L}+'), lambda x: length(x) BETWEEN 2 AND 60)"
WORDS_SQL = f"WITH t AS (SELECT doc_id, {TOKENS_SQL} AS w FROM documents)"


def _document_search(query):
    def run(s, d):
        docs = X.table(s, d, "documents")
        return docs.filter(fulltext.query_column(fulltext.document_tokens(F.col("text")), query, F.lower("text"))).select("doc_id")

    return run


for _name, _query, _sql in (
    ("ft_document_and", "the of", "list_contains(w, 'the') AND list_contains(w, 'of')"),
    ("ft_document_or", "license +que", "list_contains(w, 'license') OR list_contains(w, 'que')"),
    ("ft_document_not", "the -of", "list_contains(w, 'the') AND NOT list_contains(w, 'of')"),
    ("ft_document_wildcard", "lic?nse* -the", "len(list_filter(w, lambda x: regexp_full_match(x, 'lic.nse.*'))) > 0 AND NOT list_contains(w, 'the')"),
):
    _add(_name, f"{WORDS_SQL} SELECT doc_id FROM t WHERE {_sql}")(_document_search(_query))


@_add("ft_body_search", r"SELECT event_id AS version FROM events WHERE list_contains(list_filter(regexp_extract_all(lower(translate(props, '[]\"{}:,', '       ')), '\p{Nd}+|\p{L}+'), lambda x: length(x) BETWEEN 2 AND 60), '69')")
def ft_body_search(s, d):
    return fulltext.search_documents(X.event_log(s, d), "69", json=True)


@_add("word_freq", f"{WORDS_SQL} SELECT word, count(*) AS freq FROM (SELECT unnest(w) AS word FROM t) GROUP BY 1")
def word_freq(s, d):
    return fulltext.word_frequency(X.table(s, d, "documents"))


@_add("vocabulary", f"{WORDS_SQL} SELECT DISTINCT unnest(w) AS word FROM t")
def vocabulary(s, d):
    return fulltext.vocabulary(X.table(s, d, "documents"))


@_add("vocabulary_count", f"{WORDS_SQL} SELECT count(DISTINCT word) AS n FROM (SELECT unnest(w) AS word FROM t)")
def vocabulary_count(s, d):
    return fulltext.vocabulary(X.table(s, d, "documents")).agg(F.count("*").alias("n"))


@_add("ft_postings_minus_removed", f"{WORDS_SQL} SELECT word, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct(w)) AS word FROM t WHERE doc_id % 10 <> 3) GROUP BY 1")
def ft_postings_minus_removed(s, d):
    docs = X.table(s, d, "documents")
    removed = docs.filter("doc_id % 10 = 3").select("doc_id")
    return fulltext.postings(docs.join(removed, "doc_id", "left_anti"), "doc_id").groupBy("word").agg(F.count("*").alias("n"))


LOG = f"WITH {X.LOG_SQL}"
LATEST = f"{LOG}, top AS (SELECT *, row_number() OVER (PARTITION BY docid ORDER BY version DESC) AS r FROM log), live AS (SELECT * FROM top WHERE r = 1 AND NOT is_deleted)"


@_add("doc_latest", f"{LATEST} SELECT docid, typename, version FROM live")
def doc_latest(s, d):
    return store.latest(X.event_log(s, d)).select("docid", "typename", "version")


@_add("doc_fetch", f"{LATEST} SELECT docid, version, body FROM live WHERE docid = 'u7'")
def doc_fetch(s, d):
    return store.fetch(X.event_log(s, d), "u7").select("docid", "version", "body")


HISTORY = f"{LOG}, dead AS (SELECT docid, max(version) AS v FROM log WHERE is_deleted GROUP BY 1), alive AS (SELECT log.* FROM log LEFT JOIN dead USING (docid) WHERE v IS NULL OR version > v)"


@_add("doc_history", f"{HISTORY} SELECT docid, version FROM alive")
def doc_history(s, d):
    return store.history(X.event_log(s, d))


@_add("doc_history_info", f"{HISTORY} SELECT docid, version, ts AS change_date FROM alive WHERE docid IN ('u1', 'u2', 'u3')")
def doc_history_info(s, d):
    return store.history_info(X.event_log(s, d).filter(F.col("docid").isin("u1", "u2", "u3")))


@_add("doc_version", f"{LOG} SELECT docid, typename, version, is_deleted FROM log WHERE version = 42")
def doc_version(s, d):
    return store.fetch_version(X.event_log(s, d), 42).select("docid", "typename", "version", "is_deleted")


@_add("doc_delete", f"{LATEST} SELECT docid FROM live WHERE docid NOT IN ('u1', 'u2')")
def doc_delete(s, d):
    log = X.event_log(s, d)
    gone = s.createDataFrame([("u1", 0), ("u2", 1)], "docid string, ordinal long").withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    return store.latest(store.delete(log, gone, 10_000_000_000)).select("docid")


@_add("doc_save", f"{LATEST} SELECT docid, version FROM live WHERE docid NOT IN ('u1', 'new') UNION ALL SELECT * FROM (VALUES ('u1', 10000000000), ('new', 10000000001))")
def doc_save(s, d):
    new = s.createDataFrame([("u1", 0, "{}"), ("new", 1, "{}")], "docid string, ordinal long, body string").withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    return store.latest(store.append(X.event_log(s, d), new, "view", 10_000_000_000)).select("docid", "version")


@_add("doc_count", f"{LOG}, per AS (SELECT docid, count(*) AS c, count(*) FILTER (is_deleted) AS t, arg_max(is_deleted, version) AS dead FROM log GROUP BY 1) SELECT CAST(sum(c) - 2 * sum(t) AS BIGINT) AS n, count(*) FILTER (NOT dead) AS n_live FROM per")
def doc_count(s, d):
    return store.document_count(X.event_log(s, d))


EVENT_VIEW = ViewSpec("EventView", (Column("k", "int"), Column("typename")), doctype="any", mapper=lambda docs: docs.select("docid", ROWNUM, F.get_json_object("body", "$.k").cast("int").alias("k"), "typename"))


def _registry() -> Registry:
    found = Registry()
    for name in ("view", "click", "signup", "purchase"):
        found.is_a(name, "any")
    found.is_a("view", "seen")
    found.is_a("seen", "any")
    return found


def _spec(**changes) -> ViewSpec:
    from dataclasses import replace

    return replace(EVENT_VIEW, **changes)


@_add("view_rebuild", f"{LATEST} SELECT docid, version AS _rownum, CAST(json_extract_string(body, '$.k') AS INTEGER) AS k, typename FROM live")
def view_rebuild(s, d):
    return views.rebuild(X.event_log(s, d), EVENT_VIEW, _registry())


@_add("view_append_mode", f"{LOG} SELECT docid, version AS _rownum, CAST(json_extract_string(body, '$.k') AS INTEGER) AS k, typename FROM log LEFT JOIN (SELECT docid AS gone, max(version) AS dead FROM log WHERE is_deleted GROUP BY 1) ON docid = gone WHERE NOT is_deleted AND version > coalesce(dead, -1)")
def view_append_mode(s, d):
    return views.rebuild(X.event_log(s, d), _spec(replace_rows=False), _registry())


ROWS = f"{LATEST}, rows_ AS (SELECT docid, version AS _rownum, CAST(json_extract_string(body, '$.k') AS INTEGER) AS k, typename FROM live)"


@_add("view_insert", f"{ROWS} SELECT * FROM rows_ UNION ALL SELECT * FROM (VALUES ('direct', 20000000000, 5, 'x'), ('direct', 20000000001, 95, 'x'))")
def view_insert(s, d):
    new = s.createDataFrame([("direct", 20_000_000_000, 5, "x"), ("direct", 20_000_000_001, 95, "x")], "docid string, _rownum long, k int, typename string")
    return views.rebuild(X.event_log(s, d), EVENT_VIEW, _registry(), new)


@_add("view_delete", f"{ROWS}, more AS (SELECT * FROM rows_ UNION ALL SELECT * FROM (VALUES ('direct', 20000000000, 5, 'x'), ('direct', 20000000001, 95, 'x'))) SELECT * FROM more WHERE NOT (coalesce(k < 50, FALSE) AND _rownum < 15000000000)")
def view_delete(s, d):
    new = s.createDataFrame([("direct", 20_000_000_000, 5, "x"), ("direct", 20_000_000_001, 95, "x")], "docid string, _rownum long, k int, typename string")
    return views.rebuild(X.event_log(s, d), EVENT_VIEW, _registry(), new, [(15_000_000_000, "k < 50"), (30_000_000_000, "")])


@_add("view_delete_count", f"{ROWS} SELECT count(*) AS n FROM rows_ WHERE k < 50")
def view_delete_count(s, d):
    return views.view_delete(views.rebuild(X.event_log(s, d), EVENT_VIEW, _registry()), EVENT_VIEW, "k < 50")[1]


@_add("view_inactive", f"{ROWS} SELECT count(*) AS active, CAST(0 AS BIGINT) AS inactive FROM rows_")
def view_inactive(s, d):
    n = lambda active, name: views.rebuild(X.event_log(s, d), _spec(active=active), _registry()).agg(F.count("*").alias(name))
    return n(True, "active").join(n(False, "inactive"))


@_add("subclass_dispatch", f"{LATEST} SELECT docid, typename FROM live WHERE typename IN ('view', 'seen')")
def subclass_dispatch(s, d):
    return views.rebuild(X.event_log(s, d), _spec(doctype="seen"), _registry()).select("docid", "typename")


@_add("rollback_validation", f"{ROWS} SELECT * FROM rows_ WHERE k >= 10")
def rollback_validation(s, d):
    return views.rebuild(X.event_log(s, d), _spec(primary=True, transaction=True, valid=lambda docs: F.get_json_object("body", "$.k").cast("int") >= 10), _registry())


@_add("map_lookup", "SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def map_lookup(s, d):
    orders, customer, nation = (X.table(s, d, t) for t in ("orders", "customer", "nation"))
    with_name = views.lookup(orders, customer, F.col("o_custkey") == F.col("c_custkey"), "c_custkey", "c_name", "c_nationkey")
    return views.lookup(with_name, nation, F.col("c_nationkey") == F.col("n_nationkey"), "n_nationkey", "n_name").select("o_orderkey", "c_name", "n_name")


@_add("map_count_subquery", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1) ON c_custkey = o_custkey")
def map_count_subquery(s, d):
    counts = X.table(s, d, "orders").filter("o_totalprice > 100000").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return X.table(s, d, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@_add("map_existence", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def map_existence(s, d):
    found = X.table(s, d, "orders").filter("o_orderstatus = 'F'")
    return X.table(s, d, "customer").join(found, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@_add("map_kv_lookup", "SELECT o_orderkey, v.value FROM orders LEFT JOIN (SELECT 'u' || user_id AS key, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS t FROM events GROUP BY 1) v ON key = 'u' || (o_orderkey % 200) AND t <> 'error'")
def map_kv_lookup(s, d):
    o = X.table(s, d, "orders").select("o_orderkey", F.concat(F.lit("u"), (F.col("o_orderkey") % 200).cast("string")).alias("key"))
    return o.join(kv.current(_kv(s, d)), "key", "left").select("o_orderkey", "value")


@_add("next_row_number", f"{LOG} SELECT docid, version, row_number() OVER (PARTITION BY docid ORDER BY version) AS row_number FROM log")
def next_row_number(s, d):
    return views.next_row_number(X.event_log(s, d).select("docid", "version"), "version", "docid")


@_add("row_to_document", f'WITH {X.INVOICE_SQL} SELECT _rownum, o_orderpriority FROM inv JOIN orders ON _rownum = o_orderkey WHERE "Serial" < 50')
def row_to_document(s, d):
    rows = _invoices(s, d, "Serial < 50", select=(ROWNUM,))
    return rows.join(X.table(s, d, "orders"), F.col(ROWNUM) == F.col("o_orderkey")).select(ROWNUM, "o_orderpriority")


def _kv(s, d):
    e = X.table(s, d, "events")
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("version"), (F.col("event_type") == X.DEAD).alias("is_deleted"), "value")


KV = "WITH kv AS (SELECT 'u' || user_id AS key, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS t FROM events GROUP BY 1), live AS (SELECT key, value FROM kv WHERE t <> 'error')"


@_add("kv_last_value", f"{KV} SELECT key, value FROM live")
def kv_last_value(s, d):
    return kv.current(_kv(s, d))


@_add("kv_compact", f"{KV} SELECT key, value FROM live")
def kv_compact(s, d):
    return kv.current(kv.compact(_kv(s, d)))


@_add("kv_set_delete", f"{KV} SELECT key, value FROM live WHERE key NOT IN ('u1', 'u2') UNION ALL SELECT 'u2', 102.0")
def kv_set_delete(s, d):
    log = kv.put(_kv(s, d), s.createDataFrame([("u1", 10**10, 100.0), ("u2", 10**10, 102.0)], "key string, version long, value double"))
    return kv.current(kv.remove(log, s.createDataFrame([("u1", 10**10 + 1)], "key string, version long")))


@_add("kv_counter", "SELECT 'u' || user_id AS key, sum(CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE -1 END)::BIGINT AS value FROM events GROUP BY 1")
def kv_counter(s, d):
    e = X.table(s, d, "events")
    deltas = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.when(F.col("event_type").isin("click", "view"), 1).otherwise(-1).alias("delta"))
    return kv.counters(deltas)


@_add("kv_keys", f"{KV} SELECT key FROM live ORDER BY key LIMIT 15 OFFSET 5")
def kv_keys(s, d):
    return kv.keys(_kv(s, d), 5, 15)


@_add("kv_count", f"{KV} SELECT count(*) AS n FROM live")
def kv_count(s, d):
    return kv.count(_kv(s, d))


FILES = "WITH f AS (SELECT url AS fileid, max(page_id) AS version, arg_max(html, page_id) AS html FROM pages GROUP BY 1)"


@_add("file_fetch", f"{FILES} SELECT fileid, version, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes FROM f")
def file_fetch(s, d):
    p = X.table(s, d, "pages")
    log = p.select(F.col("url").alias("fileid"), F.col("page_id").alias("version"), F.lit(False).alias("is_deleted"), F.encode("html", "UTF-8").alias("content"))
    return store.latest(log, "fileid").select("fileid", "version", F.octet_length("content").cast("long").alias("n_bytes"))


PAGES = "WITH log AS (SELECT 'f' || (page_id % 40) AS fileid, page_id AS version, page_id % 11 = 0 AS is_deleted, html FROM pages)"


def _files(s, d):
    p = X.table(s, d, "pages")
    fileid = F.concat(F.lit("f"), (F.col("page_id") % 40).cast("string"))
    return p.select(fileid.alias("fileid"), F.col("page_id").alias("version"), F.lit(None).cast("timestamp_ntz").alias("ts"), (F.col("page_id") % 11 == 0).alias("is_deleted"), F.encode("html", "UTF-8").alias("content"))


@_add("file_history", f"{PAGES}, dead AS (SELECT fileid, max(version) AS v FROM log WHERE is_deleted GROUP BY 1) SELECT fileid, version FROM log LEFT JOIN dead USING (fileid) WHERE v IS NULL OR version > v")
def file_history(s, d):
    return store.history(_files(s, d), key="fileid")


@_add("file_delete", f"{PAGES}, top AS (SELECT fileid, arg_max(is_deleted, version) AS dead, max(version) AS version FROM log GROUP BY 1) SELECT fileid, version FROM top WHERE NOT dead AND fileid NOT IN ('f3', 'f5')")
def file_delete(s, d):
    gone = s.createDataFrame([("f3", 0), ("f5", 1)], "fileid string, ordinal long").withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    return store.latest(store.delete_file(_files(s, d), gone, 10**10), "fileid").select("fileid", "version")


@_add("file_version", f"{PAGES} SELECT fileid, version, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes FROM log WHERE version = 7")
def file_version(s, d):
    return store.fetch_version(_files(s, d), 7).select("fileid", "version", F.octet_length("content").cast("long").alias("n_bytes"))


@_add("view_sql_script", "SELECT md5('orders:' || o_orderkey) AS docid, l_linenumber AS \"Line\", CAST(l_quantity AS DECIMAL(18,2)) AS \"QTY\" FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 4 = 1")
def view_sql_script(s, d):
    mapper = views.sql_mapper("SELECT docid, item.Line, item.QTY FROM {docs} LATERAL VIEW explode(Items) AS item WHERE Status = 1")
    return mapper(X.invoice_documents(s, d))


@_add("view_pending", f"{ROWS} SELECT * FROM rows_ WHERE docid <> 'u1' UNION ALL SELECT 'u1', 20000000000, 7, 'x'")
def view_pending(s, d):
    pending = s.createDataFrame([("u1", 20_000_000_000, 7, "x")], "docid string, _rownum long, k int, typename string")
    return views.with_pending(views.rebuild(X.event_log(s, d), EVENT_VIEW, _registry()), pending)


@_add("map_correlated_count", "SELECT n_nationkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def map_correlated_count(s, d):
    nation, customer = X.table(s, d, "nation"), X.table(s, d, "customer")
    return views.correlated_count(nation, customer, F.col("n_nationkey") == F.col("c_nationkey"), "c_nationkey").select("n_nationkey", "n")


@_add("ft_search_paged", r"SELECT event_id AS version FROM events WHERE list_contains(regexp_extract_all(props, '\d+'), '69') ORDER BY 1 LIMIT 4 OFFSET 1")
def ft_search_paged(s, d):
    from ledgerview.engine import Engine

    return Engine(s, X.event_log(s, d)).full_text_search("69", 1, 4).df


@_add("text_index", f"{WORDS_SQL} SELECT doc_id FROM t WHERE doc_id % 10 <> 3 AND list_contains(w, 'the') AND NOT list_contains(w, 'of')")
def text_index(s, d):
    docs = X.table(s, d, "documents").select("doc_id", "text")
    index = fulltext.TextIndex(docs, "doc_id").remove(docs.filter("doc_id % 10 = 3"))
    return index.find_names("the -of")


@_add("url_query", f'WITH {X.INVOICE_SQL} SELECT docid, _rownum FROM inv WHERE "Serial" < 100 ORDER BY "Serial" DESC, _rownum DESC LIMIT 10 OFFSET 5')
def url_query(s, d):
    return X.engine(s, d).request("SalesInvoice", "?serial%20%3C%20100&start=5&count=10&orderby=serial%20desc").df.select("docid", ROWNUM)


# Not in the reference: what Spark offers over views anyway.


@_add("superset_rollup", f'WITH {X.INVOICE_SQL} SELECT "Status", "Approved", count(*) AS n FROM inv GROUP BY ROLLUP ("Status", "Approved")')
def superset_rollup(s, d):
    return X.engine(s, d).view("SalesInvoice").rollup("Status", "Approved").agg(F.count("*").alias("n"))


@_add("superset_window_top", f'WITH {X.INVOICE_SQL} SELECT docid, "Status" FROM (SELECT *, row_number() OVER (PARTITION BY "Status" ORDER BY "Total" DESC, _rownum) AS r FROM inv) WHERE r <= 3')
def superset_window_top(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("Status").orderBy(F.desc("Total"), ROWNUM)
    return X.engine(s, d).view("SalesInvoice").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("docid", "Status")


@_add("superset_set_ops", f'WITH {X.INVOICE_SQL} SELECT docid FROM inv WHERE "Serial" < 50 INTERSECT SELECT docid FROM inv WHERE "Status" = 1 EXCEPT SELECT docid FROM inv WHERE "Serial" = 5')
def superset_set_ops(s, d):
    e = X.engine(s, d)
    ids = lambda where: e.query("SalesInvoice", where).df.select("docid")
    return ids("Serial < 50").intersect(ids("Status = 1")).exceptAll(ids("Serial = 5"))


@_add("changes_since", f"{LOG} SELECT docid, typename, version FROM log WHERE version > 500")
def changes_since(s, d):
    return sync.changes_since(X.event_log(s, d), 500).select("docid", "typename", "version")


@_add("replicate_type_glob", f"{LOG} SELECT docid, typename, version FROM log WHERE version > 100 AND NOT is_deleted AND NOT is_replicated AND (typename LIKE 's%' OR typename LIKE 'cl_ck')")
def replicate_type_glob(s, d):
    return sync.changes_since(X.event_log(s, d), 100, ("S*", "cl?ck"), deletes=False, own_only=True).select("docid", "typename", "version")


@_add("apply_changes", f"{LOG} SELECT is_replicated, count(*) AS n FROM (SELECT docid, version, is_replicated FROM log WHERE version <= 600 UNION ALL SELECT docid, version, TRUE FROM log WHERE version > 600) GROUP BY 1")
def apply_changes(s, d):
    log = X.event_log(s, d)
    merged = sync.apply_changes(log.filter("version <= 600"), sync.changes_since(log, 500))
    return merged.groupBy("is_replicated").agg(F.count("*").alias("n"))


@_add("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(s, d):
    return X.table(s, d, "events").select("event_id", F.from_json("props", "k int").getField("k").alias("k"))


@_add("json_roundtrip", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def json_roundtrip(s, d):
    text = X.table(s, d, "orders").select(F.to_json(F.struct("o_orderkey", "o_orderstatus", "o_totalprice")).alias("j"))
    return text.select(F.from_json("j", "o_orderkey long, o_orderstatus string, o_totalprice double").alias("x")).select("x.*")


@_add("json_variant", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")
def json_variant(s, d):
    return X.table(s, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k")).filter("k > 50")


@_add("view_catalog")
def view_catalog(s, d):
    return X.engine(s, d).views()


@_add("schema_catalog")
def schema_catalog(s, d):
    return X.engine(s, d).schema("SalesInvoice")


def _engine_on_events(s, d, **rows):
    engine = Engine(s, X.event_log(s, d))
    engine.registry = _registry()
    engine.register(EVENT_VIEW, **rows)
    return engine


@_add("view_delete_engine", f"WITH {X.EVENTS_SQL} SELECT docid, _rownum FROM ev WHERE NOT (\"UserId\" < 40) UNION ALL SELECT 'direct', (SELECT greatest(max(_rownum), 0) + 2 FROM ev)")
def view_delete_engine(s, d):
    """Delete rows of a view of given rows, then insert one that the filter would have taken."""
    engine = X.engine(s, d)
    engine.view_delete("Events", "UserId < 40")
    engine.view_insert("Events", s.range(1).select(F.lit("direct").alias("docid"), F.lit(0).alias("ordinal"), F.lit("k").alias("Kind"), F.lit(None).alias("At"), F.lit(1).alias("UserId"), F.lit(0.0).alias("Value")))
    return engine.view("Events").select("docid", ROWNUM)


@_add("view_delete_exploded", f"WITH {X.ITEMS_SQL} SELECT items.docid, \"Product\", l_linenumber FROM items JOIN orders ON items.docid = md5('orders:' || o_orderkey) WHERE NOT \"QTY\" < 10")
def view_delete_exploded(s, d):
    """Delete rows of a view with several rows a document, through the engine."""
    docs = X.invoice_documents(s, d).filter("Status = 3 and Items is not null")
    # line numbers count from 1 in every document, ordinals from 0
    engine = Engine(s)
    engine.register(X.ITEMS, views.emit_each(docs, X.ITEMS, "Items"))
    engine.view_delete(X.ITEMS.name, "QTY < 10")
    lines = docs.select("docid", F.posexplode("Items.Line").alias("_item", "l_linenumber"))
    return engine.view(X.ITEMS.name).join(lines, ["docid", "_item"]).select("docid", "Product", "l_linenumber")


@_add("kv_mode_save", f"{LOG} SELECT count(*) + 1 AS n, 0 AS refused FROM log")
def kv_mode_save(s, d):
    """Documents of a type without a primary view are refused, unless none is required."""
    engine = _engine_on_events(s, d)
    new = s.range(1).select(F.lit("kv").alias("docid"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit("{}").alias("body"), F.lit(0).alias("ordinal"))
    refused = int(engine.save(new, "plain"))
    engine.save(new, "plain", require_primary_view=False)
    return engine.log.agg(F.count("*").alias("n"), F.lit(refused).alias("refused"))


def _folder(s) -> str:
    return f"{shared_dir(s)}/catalogue-{uuid.uuid4().hex}"


@_add("csv_roundtrip", "SELECT p_partkey, p_name, p_retailprice FROM part")
def csv_roundtrip(s, d):
    part, path = X.table(s, d, "part").select("p_partkey", "p_name", "p_retailprice"), _folder(s)
    export.to_csv(part, path)
    return export.from_csv(s, path, part.schema)


@_add("backup_restore", f"{LOG} SELECT docid, typename, version, is_deleted, body FROM log WHERE version > 100")
def backup_restore(s, d):
    """Entries after version 100 as gzipped JSON, read back through a checkpointed stream."""
    path = _folder(s)
    sync.backup(X.event_log(s, d), 100, f"{path}/box")
    sync.restore(s, f"{path}/box", f"{path}/log", f"{path}/cp")
    return store.read(s, f"{path}/log").select("docid", "typename", "version", "is_deleted", "body")


@_add("stream_view", f"{LATEST} SELECT docid, version, CAST(json_extract_string(body, '$.k') AS INTEGER) AS k FROM live WHERE CAST(json_extract_string(body, '$.k') AS INTEGER) < 50")
def stream_view(s, d):
    """A view that follows the log in micro-batches; versions that map to nothing hide what was before."""
    path = _folder(s)
    k = F.get_json_object("body", "$.k").cast("int")
    mapper = lambda docs: docs.filter(k < 50).select("docid", "version", k.alias("k"))
    for low, high in ((0, 300), (300, 1 << 62)):  # each part of the log is a micro-batch of as many tasks as it takes
        X.event_log(s, d).filter((F.col("version") >= low) & (F.col("version") < high)).write.mode("append").parquet(f"{path}/log")
        maintain.follow_view(s, f"{path}/log", mapper, f"{path}/view", f"{path}/cp")
    return maintain.current_view(s, f"{path}/view")


@_add("cron_match", "SELECT event_id FROM events WHERE minute(ts) % 15 = 0 AND hour(ts) BETWEEN 8 AND 17 AND dayofweek(ts) BETWEEN 1 AND 5")
def cron_match(s, d):
    return X.table(s, d, "events").filter(cron.fires("*/15 8-17 * * 1-5", F.col("ts"))).select("event_id")


@_add("map_exists", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000) AS found FROM customer")
def map_exists(s, d):
    big = X.table(s, d, "orders").filter("o_totalprice > 150000")
    return views.exists(X.table(s, d, "customer").select("c_custkey"), big, F.col("c_custkey") == F.col("o_custkey"), "o_custkey").select("c_custkey", "found")


@_add("sort_unfiltered_nulls", f'WITH {X.INVOICE_SQL} SELECT docid, _rownum, "Serial", "Priority" FROM inv ORDER BY "Priority" ASC NULLS LAST, _rownum LIMIT 25 OFFSET 5')
def sort_unfiltered_nulls(s, d):
    return _invoices(s, d, "", 5, 25, "Priority", select=("docid", ROWNUM, "Serial", "Priority"))


@_add("replication_packages", f"{LOG} SELECT CAST(floor(version / 200) AS BIGINT) AS package, count(*) AS n FROM log WHERE version > 100 GROUP BY 1")
def replication_packages(s, d):
    return sync.packages(sync.changes_since(X.event_log(s, d), 100), 200).groupBy("package").agg(F.count("*").alias("n"))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)

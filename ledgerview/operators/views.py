"""Views: mapping documents to flat rows, rebuilding, direct inserts and deletes in log order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerview.plans.filter_language import to_column
from ledgerview.schema import DOCID, ITEM, ROWNUM, Registry, ViewSpec
from ledgerview.sources import store


def emit_object(docs: DataFrame, view: ViewSpec, source: str = "") -> DataFrame:
    """Project by name: a schema column takes the document's member of that name; missing members are null."""
    names = docs.select(f"{source}.*").columns if source else docs.columns
    have = {n.lower(): n for n in names}
    prefix = f"{source}." if source else ""
    cell = lambda c: F.col(f"{prefix}`{have[c.name.lower()]}`") if c.name.lower() in have else F.lit(None)
    return docs.select(DOCID, *([ROWNUM] if ROWNUM in docs.columns else []), *(cell(c).cast(c.spark_type).alias(c.name) for c in view.columns))


def emit(docs: DataFrame, view: ViewSpec, *values: Column) -> DataFrame:
    """Project by position, in the order of the schema."""
    if len(values) != len(view.columns):
        raise ValueError(f"view {view.name} has {len(view.columns)} columns")
    return docs.select(DOCID, *([ROWNUM] if ROWNUM in docs.columns else []), *(v.cast(c.spark_type).alias(c.name) for v, c in zip(values, view.columns, strict=True)))


def emit_each(docs: DataFrame, view: ViewSpec, items: str) -> DataFrame:
    """One row for each element of an array of structs; empty and null arrays give none. Rows keep their document's row
    number, and their ordinal in the array where there is one, so that any number of items stays in order."""
    number = [ROWNUM] if ROWNUM in docs.columns else []
    rows = docs.select(DOCID, *number, F.posexplode(items).alias(ITEM, "__item"))
    cells = [F.col(f"__item.{c.name}").cast(c.spark_type).alias(c.name) for c in view.columns]
    return rows.select(DOCID, *number, *([ITEM] if number else []), *cells)


def lookup(docs: DataFrame, other: DataFrame, on: Column | str, *columns: str) -> DataFrame:
    """Fetch while mapping: a left join with the (latest) documents of another type."""
    return docs.join(other.select(*columns), on, "left")


def next_row_number(rows: DataFrame, by: str, group: str | None = None) -> DataFrame:
    """Row numbers from 1 in log order; within groups where there are any, so that no task gets all rows."""
    w = Window.partitionBy(group).orderBy(by) if group else Window.orderBy(by)
    return rows.withColumn("row_number", F.row_number().over(w).cast("long"))


def documents_for(log: DataFrame, view: ViewSpec, registry: Registry) -> DataFrame:
    """What a view maps: the latest versions of its type and subtypes, or all versions in append mode."""
    kinds = registry.descendants(view.doctype)
    # a document may change its type, and tombstones have none, so types are told apart after versions; a delete also
    # hides the rows of all earlier versions in append mode
    live = store.latest(log) if view.replace_rows else store.lives(log).filter(~F.col("is_deleted"))
    return live.filter(F.col("typename").isin(kinds)) if view.doctype else live


def rebuild(log: DataFrame, view: ViewSpec, registry: Registry, inserts: DataFrame | None = None, deletes: Iterable[tuple[int, str]] = ()) -> DataFrame:
    """A view from the log: mapped rows, direct inserts, then direct deletes, each on the rows before it only."""
    if not view.active:
        return log.sparkSession.createDataFrame([], view.struct().add(DOCID, "string").add(ROWNUM, "long")).select(DOCID, ROWNUM, *(c.name for c in view.columns))
    docs = documents_for(log, view, registry).withColumn(ROWNUM, F.col("version"))
    if view.transaction and view.valid is not None:
        docs = docs.filter(F.coalesce(view.valid(docs), F.lit(False)))
    rows = view.mapper(docs) if view.mapper else emit_object(docs, view)
    if inserts is not None:
        rows = rows.unionByName(inserts, allowMissingColumns=True)
    return replay_deletes(rows, view, deletes)


def replay_deletes(rows: DataFrame, view: ViewSpec, deletes: Iterable[tuple[int, str]]) -> DataFrame:
    """Rows that no delete (position, filter) took; an empty filter deletes nothing."""
    for position, where in deletes:
        if where.strip():
            gone = F.coalesce(to_column(where, view), F.lit(False)) & (F.col(ROWNUM) < position)
            rows = rows.filter(~gone)
    return rows


def view_delete(rows: DataFrame, view: ViewSpec, where: str) -> tuple[DataFrame, DataFrame]:
    """The rows left, and one row with n, the number deleted."""
    if not where.strip():
        return rows, rows.limit(0).agg(F.count("*").alias("n"))
    gone = F.coalesce(to_column(where, view), F.lit(False))
    return rows.filter(~gone), rows.filter(gone).agg(F.count("*").alias("n"))


def commit(log: DataFrame, docs: DataFrame, view: ViewSpec, start: int) -> tuple[DataFrame, bool]:
    """A transaction: all of docs(docid, ts, body, ordinal) are appended, or none if one is invalid."""
    if view.transaction and view.valid is not None and not docs.filter(~F.coalesce(view.valid(docs), F.lit(False))).isEmpty():
        return log, False
    return store.append(log, docs, view.doctype, start), True


def sql_mapper(text: str):
    """A mapper from one SELECT over {docs}: the declarative form of a script view. Nothing else is executed."""
    if not text.lstrip().lower().startswith(("select", "with")):
        raise ValueError("a script view is one SELECT")
    return lambda docs: docs.sparkSession.sql(text, docs=docs)


def with_pending(rows: DataFrame, pending: DataFrame) -> DataFrame:
    """Rows and, after them, the rows of a transaction that is still open, which take the place of their documents' rows."""
    kept = rows.join(pending.select(DOCID).distinct(), DOCID, "left_anti")
    return kept.unionByName(pending, allowMissingColumns=True)


def exists(rows: DataFrame, other: DataFrame, on: Column, key: str, name: str = "found") -> DataFrame:
    """Whether another view has a matching row, for each row: the keys once, and one join."""
    keys = other.select(key).distinct().withColumn(name, F.lit(True))
    return rows.join(keys, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def correlated_count(rows: DataFrame, other: DataFrame, on: Column, key: str, name: str = "n") -> DataFrame:
    """A count of matching rows of another view for each row: one aggregate and one join instead of a query a row."""
    per = other.groupBy(key).agg(F.count("*").alias(name))
    return rows.join(per, on, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))

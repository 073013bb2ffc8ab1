"""One entry point over registered views and the document log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerview.functions import fulltext, registered
from ledgerview.operators import views
from ledgerview.plans import query as queries
from ledgerview.schema import DOCID, ROWNUM, Registry, ViewSpec
from ledgerview.sources import store


class _Fields:
    """Attributes are the view's columns: v.Serial, v.Date."""

    def __init__(self, view: ViewSpec):
        self._view = view

    def __getattr__(self, name: str) -> Column:
        found = self._view.column(name)
        if found is None:
            raise AttributeError(f"view {self._view.name} has no column {name}")
        return F.col(f"`{found.name}`")


class Engine:
    """Views are DataFrames: given ones, or ones mapped from the log."""

    def __init__(self, spark: SparkSession, log: DataFrame | None = None, compat: bool = False):
        self.spark, self.log, self.compat = spark, log, compat
        self.registry, self.rows = Registry(), {}
        self.inserts: dict[str, DataFrame] = {}
        self.deletes: dict[str, list[tuple[int, str]]] = {}

    def register(self, view: ViewSpec, rows: DataFrame | Callable[[], DataFrame] | None = None) -> ViewSpec:
        """rows: the view's rows, or a function that makes them when they are first asked for."""
        self.registry.add(view)
        if rows is not None:
            self.rows[view.name.lower()] = rows
        elif self.log is None:
            raise ValueError(f"view {view.name} has neither rows nor a log")
        return view

    def view(self, name: str) -> DataFrame:
        spec = self.registry.get(name)
        found = self.rows.get(spec.name.lower())
        key = spec.name.lower()
        if found is None:
            return views.rebuild(self.log, spec, self.registry, self.inserts.get(key), self.deletes.get(key, ()))
        if not isinstance(found, DataFrame):
            found = self.rows[key] = found()
        if key in self.inserts:
            found = found.unionByName(self.inserts[key], allowMissingColumns=True)
        return views.replay_deletes(found, spec, self.deletes.get(key, ()))

    def next_version(self, view: str | None = None) -> int:
        """One more than any version or row number given so far, in the log and in a view of given rows: one aggregate each."""
        last = self.log.agg(F.max("version")).first()[0] if self.log is not None else None
        held = [df.agg(F.max(ROWNUM)).first()[0] for df in self.inserts.values()]
        if view is not None and view in self.rows:
            held.append(self.view(view).agg(F.max(ROWNUM)).first()[0])
        return 1 + max([last or 0, *(x or 0 for x in held), *(at for d in self.deletes.values() for at, _ in d)])

    def save(self, docs: DataFrame, typename: str, require_primary_view: bool = True) -> bool:
        """Append docs(docid, ts, body, ordinal) as one transaction; False if a document is invalid, or if the type has no
        primary view although one is required (without: a plain key/value store of documents)."""
        view = self.registry.primary_of(typename)
        if view is None and require_primary_view:
            return False
        start = self.next_version()
        # all views of the type that check documents must accept them, not only the primary one
        kinds = {v.name: v for v in self.registry.views.values() if v.transaction and v.active and (v is view or typename in self.registry.descendants(v.doctype))}
        if not all(views.commit(self.log, docs, v, start)[1] for v in kinds.values()):
            return False
        self.log = store.append(self.log, docs, typename, start)
        return True

    def delete(self, docids: DataFrame) -> None:
        """Append tombstones for docids(docid, ts, ordinal)."""
        self.log = store.delete(self.log, docids, self.next_version())

    def view_insert(self, name: str, rows: DataFrame) -> None:
        """Rows (docid, ordinal, columns) straight into a view; a rebuild keeps them."""
        spec = self.registry.get(name)
        key = spec.name.lower()
        new = rows.select(DOCID, (F.lit(self.next_version(key)) + F.col("ordinal")).cast("long").alias(ROWNUM), *(F.col(c.name).cast(c.spark_type).alias(c.name) for c in spec.columns))
        self.inserts[key] = self.inserts[key].unionByName(new) if key in self.inserts else new

    def view_delete(self, name: str, where: str) -> int:
        """Delete the rows of a view that match; later inserts and versions are not affected. Returns how many went."""
        spec = self.registry.get(name)
        gone = views.view_delete(self.view(name), spec, where)[1].first().n
        if where.strip():
            self.deletes.setdefault(spec.name.lower(), []).append((self.next_version(spec.name.lower()), where))
        return gone

    def query(self, name: str, where: str | Callable = "", start: int = 0, count: int = -1, orderby: str = "") -> queries.Result:
        """where: filter text, or a function of the view's columns: lambda v: v.Serial.between(1, 3) & (v.Status == 2)."""
        spec = self.registry.get(name)
        return queries.query(self.view(name), spec, where(_Fields(spec)) if callable(where) else where, start, count, orderby, self.compat)

    def count(self, name: str, where: str | Callable = "") -> int:
        return self.query(name, where).total_count

    def fetch(self, docid: str) -> DataFrame:
        return store.fetch(self.log, docid)

    def full_text_search(self, text: str, start: int = 0, count: int = -1, latest_only: bool = False) -> queries.Result:
        """Versions of documents that match, in order, a page of them."""
        log = store.latest(self.log) if latest_only else self.log
        matched = fulltext.search_documents(log, text, json=True)
        page = matched.orderBy("version")
        page = page.offset(start) if start else page
        return queries.Result(page.limit(count) if count >= 0 else page, matched, "documents")

    def request(self, name: str, url_query: str) -> queries.Result:
        """A query as a URL carries it: ?filter&start=&count=&orderby=."""
        return self.query(name, **queries.parse_url(url_query))

    def call(self, function: str, where: str = "", *args) -> DataFrame:
        return registered.call(function, self, where, *args)

    def views(self) -> DataFrame:
        rows = [(v.name, v.doctype, v.primary, v.active, v.version) for v in self.registry.views.values()]
        return self.spark.createDataFrame(rows, "name string, doctype string, is_primary boolean, is_active boolean, version int")

    def schema(self, name: str) -> DataFrame:
        rows = [(c.name, c.kind, c.fulltext, c.nocase, c.noindex) for c in self.registry.get(name).columns]
        return self.spark.createDataFrame(rows, "name string, kind string, fulltext boolean, nocase boolean, noindex boolean")

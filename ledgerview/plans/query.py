"""Queries on one view: a filter, one sort column, a page; and counts."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property
from urllib.parse import parse_qs

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerview.plans.filter_language import to_column
from ledgerview.schema import ITEM, ROWNUM, ViewSpec


@dataclass
class Result:
    """A page of rows, and the number of rows before paging, counted only when asked for."""

    df: DataFrame
    matched: DataFrame = field(repr=False)
    title: str = ""
    ok: bool = True

    @cached_property
    def total_count(self) -> int:
        return self.matched.count()

    @cached_property
    def count(self) -> int:
        return self.df.count()


def order_columns(view: ViewSpec, orderby: str, compat: bool = False, items: bool = False) -> list[Column]:
    """Sort keys: nulls last both ways; ties by row number (and item), backwards when descending (nulls always forwards)."""
    places = [ROWNUM, ITEM] if items else [ROWNUM]
    words = orderby.split()
    down = " desc" in f" {orderby.lower()}"
    found = next((view.column(w) for w in words if w.lower() not in ("asc", "desc") and view.column(w)), None)
    if found is None and compat:
        found = next((c for c in view.columns if c.name.lower() in orderby.lower()), None)
    if found is None:
        return [F.col(p).asc() for p in places]
    c = F.coalesce(F.col(found.name), F.lit(False)) if found.kind == "bool" else F.col(f"`{found.name}`")
    if not down:
        return [c.asc_nulls_last(), *(F.col(p).asc() for p in places)]
    return [c.desc_nulls_last(), *(F.when(c.isNotNull(), -F.col(p)).asc() for p in places), *(F.col(p).asc() for p in places)]


def query(df: DataFrame, view: ViewSpec, where: str | Column = "", start: int = 0, count: int = -1, orderby: str = "", compat: bool = False) -> Result:
    """Rows of a view; count -1: all of them. Pages are top-k plans, never whole sorts of the view."""
    matched = df.filter(to_column(where, view, compat) if isinstance(where, str) else where) if isinstance(where, Column) or where.strip() else df
    page = matched
    if orderby or start or count >= 0:
        page = matched.orderBy(*order_columns(view, orderby, compat, ITEM in matched.columns))
    if start:
        page = page.offset(start)
    if count >= 0:
        page = page.limit(count)
    return Result(page, matched, view.name)


def count(df: DataFrame, view: ViewSpec, where: str | Column = "") -> DataFrame:
    """One row: n, the number of matching rows."""
    return query(df, view, where).matched.agg(F.count("*").alias("n"))


def parse_url(text: str) -> dict:
    """The arguments of query() from ?filter&start=&count=&orderby= as a URL carries them."""
    text = text.lstrip("?")
    where, _, rest = text.partition("&") if text and not text.split("&")[0].startswith(("start=", "count=", "orderby=")) else ("", "", text)
    args = {k.lower(): v[0] for k, v in parse_qs(rest).items()}
    from urllib.parse import unquote_plus

    return {"where": unquote_plus(where), "start": int(args.get("start", 0)), "count": int(args.get("count", -1)), "orderby": args.get("orderby", "")}

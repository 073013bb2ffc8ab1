"""View specifications and their registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerview.types import Column

#: A row's place: the version (or row number) it came with, and its ordinal among the rows of one document.
ROWNUM, DOCID, ITEM = "_rownum", "docid", "_item"
Mapper = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class ViewSpec:
    """A flat view: rows of `columns` plus docid, made by `mapper` from documents of `doctype`."""

    name: str
    columns: tuple[Column, ...]
    doctype: str = ""
    mapper: Mapper | None = None
    primary: bool = False
    active: bool = True
    replace_rows: bool = True  # False keeps the rows of earlier versions of a document
    transaction: bool = False
    valid: Callable[[DataFrame], object] | None = None  # a boolean Column over documents; a false one rolls back
    version: int = 1

    def __post_init__(self) -> None:
        if not self.name or not self.columns:
            raise ValueError("a view needs a name and columns")
        lower = [c.name.lower() for c in self.columns]
        if len(set(lower)) < len(lower):
            raise ValueError(f"view {self.name}: column names differ only by case")
        if self.transaction and not self.primary:
            raise ValueError(f"view {self.name}: only primary views can be transactional")

    def column(self, name: str) -> Column | None:
        wanted = name.lower()
        if wanted == DOCID:
            return Column(DOCID, "guid")
        return next((c for c in self.columns if c.name.lower() == wanted), None)

    def struct(self) -> T.StructType:
        return T.StructType([c.field() for c in self.columns])


@dataclass
class Registry:
    """Views by name, and the parents of document types."""

    views: dict[str, ViewSpec] = field(default_factory=dict)
    parents: dict[str, str] = field(default_factory=dict)

    def add(self, spec: ViewSpec) -> ViewSpec:
        if spec.primary and any(v.primary and v.doctype == spec.doctype and v.name != spec.name for v in self.views.values()):
            raise ValueError(f"{spec.doctype} has a primary view already")
        self.views[spec.name.lower()] = spec
        return spec

    def is_a(self, child: str, parent: str) -> None:
        self.parents[child] = parent

    def get(self, name: str) -> ViewSpec:
        found = self.views.get(name.lower())
        if found is None:
            raise KeyError(f"no view named {name}")
        return found

    def ancestry(self, doctype: str) -> list[str]:
        found = [doctype]
        while found[-1] in self.parents and self.parents[found[-1]] not in found:
            found.append(self.parents[found[-1]])
        return found

    def primary_of(self, doctype: str) -> ViewSpec | None:
        """The primary view of a type or of its nearest ancestor."""
        for name in self.ancestry(doctype):
            for view in self.views.values():
                if view.primary and view.doctype == name:
                    return view
        return None

    def descendants(self, doctype: str) -> list[str]:
        return sorted({doctype} | {c for c in self.parents if doctype in self.ancestry(c)})

"""The filter language: text -> tree -> Spark Column (or SQL text).

Trees are two-valued: a comparison with a null is false, and "not" and "!=" are complements over all rows. Columns stay
bare comparisons wherever nulls cannot matter, so that Spark can push them down to the files.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from ledgerview.functions import fulltext
from ledgerview.schema import ViewSpec
from ledgerview.types import Column

PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute}
COMPARE = {"=": "=", "==": "=", "!=": "!=", "<>": "!=", "<": "<", "<=": "<=", ">": ">", ">=": ">="}
MIRROR = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "=", "!=": "!="}
_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<real>\d+\.\d+(?:[eE][+-]?\d+)?[fFmM]?|\d+[fFmM])|(?P<int>\d+)|(?P<name>[A-Za-z_@$][\w$]*)
    |"(?P<text>(?:[^"]|"")*)"|'(?P<char>(?:[^']|''))'|(?P<sign>&&|\|\||==|!=|<>|<=|>=|[=<>!&|().,-])""",
    re.VERBOSE,
)


class FilterError(ValueError):
    """A filter that cannot be understood; `at` is the position in its text."""

    def __init__(self, message: str, at: int):
        super().__init__(f"{message} (at {at})")
        self.at = at


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Field:
    name: str
    part: str | None = None
    at: int = 0


@dataclass(frozen=True)
class Compare:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Between:
    field: Field
    low: Any
    high: Any


@dataclass(frozen=True)
class In:
    field: Field
    values: tuple


@dataclass(frozen=True)
class Junction:
    op: str  # "and", "or"
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: Any


def tokens(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise FilterError(f"unexpected character {text[at]!r}", at)
        if m.lastgroup != "space":
            out.append((m.lastgroup, m[m.lastgroup], at))
        at = m.end()
    return [*out, ("end", "", at)]


class Parser:
    """Precedence climbing over the token list."""

    def __init__(self, text: str):
        self.tokens, self.k = tokens(text), 0

    def look(self, *signs: str) -> bool:
        kind, value, _ = self.tokens[self.k]
        return kind in ("sign", "name") and value.lower() in signs

    def take(self, *signs: str) -> bool:
        found = self.look(*signs)
        self.k += found
        return found

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise FilterError(f"{sign!r} expected", self.tokens[self.k][2])

    def whole(self) -> Any:
        tree = self.junction("or")
        if self.tokens[self.k][0] != "end":
            raise FilterError("end of filter expected", self.tokens[self.k][2])
        return tree

    def junction(self, op: str) -> Any:
        below = (lambda: self.junction("and")) if op == "or" else self.comparison
        signs = ("or", "||", "|") if op == "or" else ("and", "&&", "&")
        parts = [below()]
        while self.take(*signs):
            parts.append(below())
        return parts[0] if len(parts) == 1 else Junction(op, tuple(parts))

    def comparison(self) -> Any:
        left = self.unary()
        while self.look(*COMPARE):
            op = COMPARE[self.tokens[self.k][1]]
            self.k += 1
            left = Compare(op, left, self.unary())
        return left

    def unary(self) -> Any:
        _, _, at = self.tokens[self.k]
        if self.take("!", "not"):
            return Not(self.unary())
        if self.take("-"):
            found = self.unary()
            if not (isinstance(found, Literal) and isinstance(found.value, (int, float, Decimal)) and not isinstance(found.value, bool)):
                raise FilterError("a number expected after '-'", at)
            return Literal(-found.value)
        return self.primary()

    def primary(self) -> Any:
        kind, value, at = self.tokens[self.k]
        self.k += 1
        if kind == "int":
            return Literal(int(value))
        if kind == "real":
            return Literal(Decimal(value[:-1]) if value[-1] in "mM" else float(value.rstrip("fF")))
        if kind == "text":
            return Literal(value.replace('""', '"'))
        if kind == "char":
            return Literal(value[0])
        if kind == "sign" and value == "(":
            tree = self.junction("or")
            self.need(")")
            return tree
        if kind != "name":
            raise FilterError("an expression expected", at)
        if value.lower() in ("true", "false", "null"):
            return Literal({"true": True, "false": False, "null": None}[value.lower()])
        if value.lower() in ("guid", "datetime") and self.take("("):
            inner = self.primary()
            self.need(")")
            return inner
        return self.members(Field(value, None, at))

    def members(self, found: Field) -> Any:
        while self.take("."):
            _, name, at = self.tokens[self.k]
            self.k += 1
            low = name.lower()
            if low in ("between", "in") and self.look("("):
                values = self.arguments()
                if low == "in":
                    return In(found, values)
                if len(values) != 2:
                    raise FilterError("Between takes two values", at)
                return Between(found, *values)
            if low in PARTS and found.part is None:
                found = Field(found.name, low, found.at)
            else:
                raise FilterError(f"no member named {name}", at)
        return found

    def arguments(self) -> tuple:
        self.need("(")
        values = [self.literal()]
        while self.take(","):
            values.append(self.literal())
        self.need(")")
        return tuple(values)

    def literal(self) -> Any:
        at = self.tokens[self.k][2]
        found = self.unary()
        if not isinstance(found, Literal):
            raise FilterError("a constant expected", at)
        return found.value


def parse(text: str) -> Any:
    """The tree of a filter; an empty one is the constant true."""
    return Parser(text).whole() if text.strip() else Literal(True)


def as_timestamp(value: Any) -> dt.datetime:
    if isinstance(value, dt.datetime):
        return value
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    m = re.fullmatch(r"\s*(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[ T](\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,6}))?)?)?\s*", str(value))
    if not m:
        raise FilterError(f"not a date: {value!r}", 0)
    return dt.datetime(*(int(x or 0) for x in m.groups()[:6]), int((m[7] or "0").ljust(6, "0")))


def as_guid(value: str) -> str:
    return str(value).strip().strip("{}()").lower()


class Compiler:
    """Trees as Spark columns over one view."""

    def __init__(self, view: ViewSpec, compat: bool = False):
        self.view, self.compat = view, compat

    def known(self, field: Field) -> Column:
        found = self.view.column(field.name)
        if found is None:
            raise FilterError(f"no column named {field.name} in view {self.view.name}", field.at)
        return found

    def coerced(self, value: Any, column: Column, part: str | None) -> Any:
        if part:
            return F.lit(int(value))
        if column.kind == "datetime":
            return F.lit(as_timestamp(value)).cast("timestamp_ntz")
        if column.kind == "guid":
            return F.lit(as_guid(value))
        if (column.kind == "bool") != isinstance(value, bool):
            raise FilterError(f"{column.name} is of type {column.kind}; {value!r} is not", 0)
        return F.lit(value).cast(column.spark_type)

    def side(self, field: Field) -> SparkColumn:
        column = F.col(f"`{self.known(field).name}`")
        return PARTS[field.part](column) if field.part else column

    def predicate(self, tree: Any) -> SparkColumn:
        """True for the rows that match; may be null where it is not true."""
        if isinstance(tree, Literal):
            if not isinstance(tree.value, bool):
                raise FilterError("a condition expected", 0)
            return F.lit(tree.value)
        if isinstance(tree, Junction):
            parts = [self.predicate(p) for p in tree.parts]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if tree.op == "and" else out | p
            return out
        if isinstance(tree, Not):
            return ~F.coalesce(self.predicate(tree.part), F.lit(False))
        if isinstance(tree, Field):
            if self.known(tree).kind != "bool" or tree.part:
                raise FilterError("a condition expected", tree.at)
            return self.compare("=", tree, True)
        if isinstance(tree, Between):
            return self.between(tree)
        if isinstance(tree, In):
            return self.within(tree)
        left, right, op = tree.left, tree.right, tree.op
        if isinstance(left, Literal) and isinstance(right, Field):
            left, right, op = right, left, MIRROR[op]
        if isinstance(left, Field) and isinstance(right, Literal):
            return self.compare(op, left, right.value)
        if isinstance(left, Field) and isinstance(right, Field):
            a, b = self.side(left), self.side(right)
            return ~a.eqNullSafe(b) if op == "!=" else _plain(op, a, b)
        raise FilterError("a column and a constant expected", 0)

    def compare(self, op: str, field: Field, value: Any) -> SparkColumn:
        column = self.known(field)
        if column.noindex and self.compat:
            return F.lit(True)
        side = F.col(f"`{column.name}`")
        if value is None:
            if op not in ("=", "!="):
                raise FilterError("null is compared with = or != only", field.at)
            return side.isNull() if op == "=" else side.isNotNull()
        if column.fulltext and not field.part:
            if op not in ("=", "!="):
                raise FilterError(f"{column.name} is a full-text column; it takes = and != only", field.at)
            match = fulltext.matches(side, str(value))
            return match if op == "=" else ~F.coalesce(match, F.lit(False))
        if column.kind == "bool":
            if op not in ("=", "!="):
                raise FilterError(f"{column.name} takes = and != only", field.at)
            self.coerced(value, column, None)
            true = side.eqNullSafe(F.lit(True))
            return true if value == (op == "=") else ~true
        if column.nocase:
            return _plain(op, F.lower(F.coalesce(side, F.lit(""))), F.lit(str(value).lower()))
        if field.part == "year" and op != "!=":
            return self.year(op, side, int(value), int(value))
        literal = self.coerced(value, column, field.part)
        side = self.side(field)
        return ~side.eqNullSafe(literal) if op == "!=" else _plain(op, side, literal)

    @staticmethod
    def year(op: str, side: SparkColumn, low: int, high: int) -> SparkColumn:
        """Years as ranges of timestamps, which files can skip by."""
        start, end = (F.lit(dt.datetime(y, 1, 1)).cast("timestamp_ntz") for y in (low, high + 1))
        return {"=": (side >= start) & (side < end), "<": side < start, "<=": side < end, ">": side >= end, ">=": side >= start}[op]

    def between(self, tree: Between) -> SparkColumn:
        column = self.known(tree.field)
        if column.noindex and self.compat:
            return F.lit(True)
        low, high = tree.low, tree.high
        if column.kind == "datetime" and not tree.field.part:
            low, high = as_timestamp(low), as_timestamp(high)
        low, high = min(low, high), max(low, high)
        if column.nocase:
            return F.lower(F.coalesce(self.side(tree.field), F.lit(""))).between(str(low).lower(), str(high).lower())
        if tree.field.part == "year":
            return self.year("=", F.col(f"`{column.name}`"), int(low), int(high))
        return self.side(tree.field).between(*(self.coerced(v, column, tree.field.part) for v in (low, high)))

    def within(self, tree: In) -> SparkColumn:
        column = self.known(tree.field)
        if column.noindex and self.compat:
            return F.lit(True)
        if column.nocase:
            return F.lower(F.coalesce(self.side(tree.field), F.lit(""))).isin([str(v).lower() for v in tree.values])
        return self.side(tree.field).isin([self.coerced(v, column, tree.field.part) for v in tree.values])


def _plain(op: str, a: SparkColumn, b: SparkColumn) -> SparkColumn:
    return {"=": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}[op]()


def to_column(text: str, view: ViewSpec, compat: bool = False) -> SparkColumn:
    return Compiler(view, compat).predicate(parse(text))


def to_sql(tree: Any) -> str:
    """ANSI SQL for a tree over plain columns, two-valued like the Columns; the tests' second opinion."""
    if isinstance(tree, Literal):
        v = tree.value
        return "TRUE" if v is True else "FALSE" if v is False else "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    if isinstance(tree, Field):
        return f"extract({tree.part} FROM {tree.name})" if tree.part else tree.name
    if isinstance(tree, Junction):
        return "(" + f" {tree.op.upper()} ".join(map(to_sql, tree.parts)) + ")"
    if isinstance(tree, Not):
        return f"(NOT {to_sql(tree.part)})"
    if isinstance(tree, Between):
        low, high = sorted((tree.low, tree.high))
        return f"coalesce({to_sql(tree.field)} BETWEEN {to_sql(Literal(low))} AND {to_sql(Literal(high))}, FALSE)"
    if isinstance(tree, In):
        return f"coalesce({to_sql(tree.field)} IN ({', '.join(to_sql(Literal(v)) for v in tree.values)}), FALSE)"
    if tree.op == "!=":
        return f"({to_sql(tree.left)} IS DISTINCT FROM {to_sql(tree.right)})"
    return f"coalesce({to_sql(tree.left)} {tree.op} {to_sql(tree.right)}, FALSE)"

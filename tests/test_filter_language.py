import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerview.plans.filter_language import Between, Compare, Field, FilterError, In, Junction, Literal, Not, Compiler, as_timestamp, parse, to_column, to_sql
from ledgerview.schema import ViewSpec
from ledgerview.types import Column

VIEW = ViewSpec("V", (Column("a", "int"), Column("b", "int"), Column("s", "string")))
ROWS = [(a, b, s) for a in (None, 0, 1, 2) for b in (None, 1, 2) for s in (None, "", "x", "y")]


def test_precedence_and_case():
    assert parse("A = 1 OR b = 2 and NOT b = 3") == Junction("or", (Compare("=", Field("A", None, 0), Literal(1)), Junction("and", (Compare("=", Field("b", None, 9), Literal(2)), Compare("=", Not(Field("b", None, 23)), Literal(3))))))
    assert parse('s == "a""b"') == Compare("=", Field("s", None, 0), Literal('a"b'))
    assert parse("d.Year.In(1, 2)") == In(Field("d", "year", 0), (1, 2))
    assert parse("") == Literal(True)


@pytest.mark.parametrize("text", ["a = ", "a ** 2", "a = 1 b", "(a = 1", "a.Between(1)", "a.nosuch = 1", "a = 'xy'", "nosuch = 1", "a", "a = true", '"x" = "y"', "a < null"])
def test_errors_have_a_place(spark, text):
    with pytest.raises(FilterError):
        to_column(text, VIEW)


def test_dates():
    assert as_timestamp("2001-1-1").year == 2001
    assert as_timestamp("2001-01-01 10:05:07.5").microsecond == 500_000
    with pytest.raises(FilterError):
        as_timestamp("1/1/01")


def test_fulltext_and_noindex_flags(spark):
    view = ViewSpec("F", (Column("t", fulltext=True), Column("n", "int", noindex=True)))
    df = spark.createDataFrame([("Red car", 1), ("blue car", 2), (None, 3)], "t string, n int")
    rows = lambda where, compat=False: sorted(r.n for r in df.filter(to_column(where, view, compat)).collect())
    assert rows('t = "car -red"') == [2]
    assert rows('t != "car"') == [3]
    assert rows("n = 1") == [1]
    assert rows("n = 1", True) == [1, 2, 3]
    with pytest.raises(FilterError):
        to_column('t > "a"', view)


numbers = st.integers(-1, 3)
leaf = st.one_of(
    st.builds(Compare, st.sampled_from(["=", "!=", "<", "<=", ">", ">="]), st.builds(Field, st.sampled_from("ab")), st.builds(Literal, numbers)),
    st.builds(Compare, st.sampled_from(["=", "!="]), st.just(Field("s")), st.builds(Literal, st.sampled_from(["", "x", "z"]))),
    st.builds(Between, st.builds(Field, st.sampled_from("ab")), numbers, numbers),
    st.builds(In, st.builds(Field, st.sampled_from("ab")), st.tuples(numbers, numbers)),
    st.builds(Literal, st.booleans()),
)
trees = st.recursive(leaf, lambda t: st.one_of(st.builds(Not, t), st.builds(lambda op, *p: Junction(op, p), st.sampled_from(["and", "or"]), t, t)), max_leaves=6)


@settings(max_examples=30, deadline=None, suppress_health_check=list(HealthCheck))
@given(trees)
def test_columns_agree_with_sql(spark, tree):
    df = spark.createDataFrame(ROWS, "a int, b int, s string").coalesce(1)
    got = sorted(map(str, map(tuple, df.filter(Compiler(VIEW).predicate(tree)).collect())))
    con = duckdb.connect()
    con.execute("CREATE TABLE t (a INT, b INT, s VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", ROWS)
    assert got == sorted(map(str, con.execute(f"SELECT * FROM t WHERE {to_sql(tree)}").fetchall()))

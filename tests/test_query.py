"""The parser, the join graph and predicates."""

import pytest

from cardinia.plans.predicates import condition, integer_range, like_pattern, micros
from cardinia.plans.query import Join, Predicate, Query, workload_columns


def parse(where, tables="a AS x, b y"):
    return Query.parse(f"SELECT COUNT(*) FROM {tables} WHERE {where};")


def test_relations_with_and_without_as():
    q = parse("x.k = y.k", "a AS x, b y, c as z")
    assert q.tables == (("x", "a"), ("y", "b"), ("z", "c"))


@pytest.mark.parametrize(("text", "op", "value"), [
    ("x.c >= 5", ">=", "5"), ("x.c<=5", "<=", "5"), ("x.c <> 5", "<>", "5"), ("x.c != 5", "<>", "5"), ("x.c == 5", "=", "5"),
    ("x.c > -1.5", ">", "-1.5"), ("x.c = 'it''s'", "=", "it's"), ("x.d < '2010-01-01 00:00:00'::timestamp", "<", "2010-01-01 00:00:00"), ("x.c LIKE 'a%'", "LIKE", "a%"), ("x.c NOT LIKE 'a%'", "NOT LIKE", "a%"),
])
def test_predicates(text, op, value):
    (p,) = parse(f"x.k = y.k AND {text}").filters["x"]
    assert (p.op, p.value) == (op, value)


def test_between_and_in():
    q = parse("x.k = y.k AND x.c BETWEEN 1 AND 2 AND y.d IN (1, 2)")
    assert [(p.op, p.value) for p in q.filters["x"]] == [(">=", "1"), ("<=", "2")]
    assert q.filters["y"][0].value == ("1", "2")


def test_the_same_column_may_be_filtered_twice():
    q = parse("x.k = y.k AND x.c < 9 AND x.c < 7")
    assert len(q.filters["x"]) == 2


@pytest.mark.parametrize("text", ["x.a = 1 OR x.b = 2", "1 = x.a", "NOT x.a = 1", "x.a NOT IN (1)"])
def test_unsupported(text):
    with pytest.raises(NotImplementedError):
        parse(text)


@pytest.mark.parametrize("text", ["x.a < y.b", "x.a", "z.a = 1", "x.a = ", "x.a LIKE y.b"])
def test_malformed(text):
    with pytest.raises(ValueError):
        parse(text)


def test_alias_is_needed_and_unique():
    with pytest.raises(ValueError):
        Query.parse("SELECT COUNT(*) FROM a WHERE a.x = 1")
    with pytest.raises(ValueError):
        Query.parse("SELECT COUNT(*) FROM a x, b x")


def test_components_are_numbered_by_smallest_node():
    q = parse("x.k = y.k AND y.j = z.j", "a x, b y, c z")
    assert q.components == {"x.k": 0, "y.j": 1, "y.k": 0, "z.j": 1}
    assert q.joined == {"x": {"k": (0,)}, "y": {"k": (0,), "j": (1,)}, "z": {"j": (1,)}}
    assert q.joins_of("y") == [Join(("y", "k"), ("x", "k")), Join(("y", "j"), ("z", "j"))]
    assert q.joined_nodes("y") == ["y.j", "y.k"] and q.joined_with("y.k") == ["x.k"] and q.root() == "x.k"


def test_redundant_equalities_are_dropped():
    q = parse("x.k = y.k AND y.k = z.k AND x.k = z.k", "a x, b y, c z")
    assert len(q.joins) == 2 and q.is_tree()


def test_cycles_are_noticed():
    assert not parse("x.k = y.k AND x.j = y.j").is_tree()
    assert not parse("x.k = y.k", "a x, b y, c z").is_tree()


def test_workload_columns():
    found = workload_columns(["SELECT COUNT(*) FROM a x, b y WHERE x.k = y.k AND x.c > 1", "SELECT COUNT(*) FROM a x, b y WHERE x.k = y.j"])
    assert found == [("a", "key", "k"), ("a", "predicate", "c"), ("b", "key", "j"), ("b", "key", "k")]


def test_like_knows_percent_and_question_mark_only():
    assert like_pattern("a_b%c?\\") == "a\\_b%c_\\\\"
    assert condition(Predicate("c", "LIKE", "o'x%"), "string", "duckdb").startswith("\"c\" ILIKE 'o''x%'")
    assert condition(Predicate("select", "NOT LIKE", "x"), "string").startswith("`select` NOT ILIKE 'x'")


def test_integer_ranges():
    def span(*ps, kind="int", low=0, high=100):
        return integer_range(tuple(Predicate("c", op, v) for op, v in ps), kind, low, high)

    assert span((">", "5"), ("<", "9"))[:2] == (6, 8)
    assert span((">", "5.5"), ("<=", "9.5"))[:2] == (6, 9)
    assert span(("=", "7"))[:2] == (7, 7)
    assert span(("=", "7.5")) is None
    assert span((">", "100")) is None
    assert span(("<>", "5"))[:2] == (0, 100)
    assert span(("<>", "5"), low=5, high=5) is None
    assert span((">=", "1970-01-01 00:00:01"), kind="timestamp", high=10**7)[:2] == (10**6, 10**7)
    assert micros("1969-12-31 23:59:59.999999") == -1
    with pytest.raises(NotImplementedError):
        span(("LIKE", "a"))

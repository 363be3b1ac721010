"""COUNT(*) queries over equi-joins and conjunctive filters: parsing and join graph."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

_LEX = re.compile(
    r"""\s+
      | (?P<string>'(?:[^']|'')*'(?:::\w+)?)
      | (?P<number>[-+]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][-+]?\d+)?(?:::\w+)?)
      | (?P<op><>|!=|<=|>=|==|=|<|>)
      | (?P<name>"[^"]+"|[A-Za-z_][A-Za-z_0-9$]*)
      | (?P<mark>[(),.;*])
    """,
    re.X,
)
OPERATORS = ("=", "<>", "<", "<=", ">", ">=", "LIKE", "NOT LIKE", "IN")


@dataclass(frozen=True)
class Predicate:
    """column op value; value is the literal's text (a tuple of texts for IN)."""

    column: str
    op: str
    value: str | tuple[str, ...]
    quoted: bool = False


@dataclass(frozen=True)
class Join:
    """left = right, each an (alias, attribute) node."""

    left: tuple[str, str]
    right: tuple[str, str]


class _Tokens:
    def __init__(self, sql: str):
        self.items: list[tuple[str, str]] = []
        at = 0
        while at < len(sql):
            m = _LEX.match(sql, at)
            if m is None:
                raise ValueError(f"cannot read {sql[at : at + 20]!r}")
            if m.lastgroup:
                self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        i = self.at + ahead
        return self.items[i] if i < len(self.items) else ("end", "")

    def next(self) -> tuple[str, str]:
        token = self.peek()
        self.at += 1
        return token

    def word(self, *words: str) -> bool:
        """Takes the next token if it is one of these words."""
        kind, text = self.peek()
        if kind == "name" and text.upper() in words:
            self.at += 1
            return True
        return False

    def mark(self, text: str) -> bool:
        if self.peek() == ("mark", text):
            self.at += 1
            return True
        return False


def _literal(kind: str, text: str) -> tuple[str, bool]:
    text = re.sub(r"::\w+$", "", text)
    return (text[1:-1].replace("''", "'"), True) if kind == "string" else (text, False)


@dataclass(frozen=True)
class Query:
    """tables: (alias, table) in order; joins: a spanning forest of each component; filters by alias."""

    sql: str
    tables: tuple[tuple[str, str], ...]
    joins: tuple[Join, ...]
    filters: dict[str, tuple[Predicate, ...]] = field(hash=False)

    @staticmethod
    def parse(sql: str) -> Query:
        """Accepts aliases with or without AS (mandatory), =, <>, !=, <, <=, >, >=, LIKE, NOT LIKE, IN and BETWEEN.

        Raises NotImplementedError for OR, any other NOT and a literal on the left, ValueError for
        other malformed text and for joins that are not equalities of columns.
        """
        t = _Tokens(sql)
        while t.peek()[0] != "end" and not t.word("FROM"):
            t.next()
        tables: list[tuple[str, str]] = []
        while True:
            kind, name = t.next()
            if kind != "name":
                raise ValueError("a table name is expected in FROM")
            t.word("AS")
            kind, alias = t.peek()
            if kind != "name" or alias.upper() == "WHERE":
                raise ValueError(f"table {name} needs an alias")
            t.next()
            if alias in dict(tables):
                raise ValueError(f"alias {alias} is used twice")
            tables.append((alias, name))
            if not t.mark(","):
                break
        joins: list[Join] = []
        filters: dict[str, list[Predicate]] = {}
        if t.word("WHERE"):
            while True:
                _condition(t, dict(tables), joins, filters)
                if t.word("OR"):
                    raise NotImplementedError("OR")
                if not t.word("AND"):
                    break
        while t.mark(";"):
            pass
        if t.peek()[0] != "end":
            raise ValueError(f"unexpected {t.peek()[1]!r}")
        return Query(sql, tuple(tables), tuple(_forest(joins)), {a: tuple(p) for a, p in filters.items()})

    @cached_property
    def nodes(self) -> tuple[str, ...]:
        return tuple(sorted({f"{a}.{c}" for j in self.joins for a, c in (j.left, j.right)}))

    @cached_property
    def components(self) -> dict[str, int]:
        """Node -> number of its connected set of equated columns, numbered in the order of their smallest nodes."""
        root = _union((f"{j.left[0]}.{j.left[1]}", f"{j.right[0]}.{j.right[1]}") for j in self.joins)
        numbers: dict[str, int] = {}
        return {n: numbers.setdefault(root[n], len(numbers)) for n in self.nodes}

    @cached_property
    def joined(self) -> dict[str, dict[str, tuple[int, ...]]]:
        """alias -> attribute -> the joins that touch it."""
        out: dict[str, dict[str, tuple[int, ...]]] = {a: {} for a, _ in self.tables}
        for k, j in enumerate(self.joins):
            for a, c in (j.left, j.right):
                out[a][c] = (*out[a].get(c, ()), k)
        return out

    def joins_of(self, alias: str) -> list[Join]:
        """The alias's joins, it being on the left."""
        return [j if j.left[0] == alias else Join(j.right, j.left) for j in self.joins if alias in (j.left[0], j.right[0])]

    def joined_nodes(self, alias: str) -> list[str]:
        return [n for n in self.nodes if n.split(".")[0] == alias]

    def joined_with(self, node: str) -> list[str]:
        """Nodes that a join equates with this one."""
        pairs = [(".".join(j.left), ".".join(j.right)) for j in self.joins]
        return sorted({b for a, b in pairs if a == node} | {a for a, b in pairs if b == node})

    def root(self) -> str:
        """The node that contraction starts from; any gives the same estimate."""
        return min(self.nodes)

    def is_tree(self) -> bool:
        """Whether relations and components form one connected tree, which contraction needs."""
        links = {(a, self.components[f"{a}.{c}"]) for a, cs in self.joined.items() for c in cs}
        root = _union((f"t {a}", f"c {c}") for a, c in links)
        vertices = {a for a, _ in self.tables} | {c for _, c in links}
        whole = len({root.get(f"t {a}", a) for a, _ in self.tables}) == 1
        return whole and len(links) == len(vertices) - 1


def _column(t: _Tokens, tables: dict[str, str]) -> tuple[str, str] | None:
    """alias.column at the next tokens, if they are one."""
    (k0, a), (k1, dot), (k2, c) = t.peek(), t.peek(1), t.peek(2)
    if k0 == "name" and (k1, dot) == ("mark", ".") and k2 == "name":
        if a not in tables:
            raise ValueError(f"unknown alias {a}")
        t.at += 3
        return a, c.strip('"')
    return None


def _condition(t: _Tokens, tables: dict[str, str], joins: list[Join], filters: dict[str, list[Predicate]]) -> None:
    if t.peek()[0] in ("string", "number") or (t.peek()[0] == "name" and t.peek()[1].upper() == "NOT"):
        raise NotImplementedError("a condition starts with a column")
    left = _column(t, tables)
    if left is None:
        raise ValueError(f"a column is expected, not {t.peek()[1]!r}")

    def add(op: str, value: str | tuple[str, ...], quoted: bool) -> None:
        filters.setdefault(left[0], []).append(Predicate(left[1], op, value, quoted))

    def literal() -> tuple[str, bool]:
        kind, text = t.next()
        if kind not in ("string", "number"):
            raise ValueError(f"a literal is expected, not {text!r}")
        return _literal(kind, text)

    if t.word("BETWEEN"):
        add(">=", *literal())
        if not t.word("AND"):
            raise ValueError("BETWEEN needs AND")
        add("<=", *literal())
    elif t.word("LIKE"):
        add("LIKE", *literal())
    elif t.word("IN"):
        if not t.mark("("):
            raise ValueError("IN needs a list")
        values = [literal()]
        while t.mark(","):
            values.append(literal())
        if not t.mark(")"):
            raise ValueError("the list of IN is not closed")
        add("IN", tuple(v for v, _ in values), values[0][1])
    elif t.word("NOT"):
        if not t.word("LIKE"):
            raise NotImplementedError("of NOT only NOT LIKE")
        add("NOT LIKE", *literal())
    else:
        kind, op = t.next()
        if kind != "op":
            raise ValueError(f"an operator is expected, not {op!r}")
        op = {"==": "=", "!=": "<>"}.get(op, op)
        right = _column(t, tables)
        if right is None:
            add(op, *literal())
        elif op == "=":
            joins.append(Join(left, right))
        else:
            raise ValueError("only equi-joins can be estimated")


def _union(pairs) -> dict[str, str]:
    """Each member's smallest connected member."""
    parent: dict[str, str] = {}

    def top(x: str) -> str:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {x: top(x) for x in parent}


def _forest(joins: list[Join]) -> list[Join]:
    """Without equalities that follow from the others."""
    kept: list[Join] = []
    for j in joins:
        root = _union((".".join(k.left), ".".join(k.right)) for k in kept)
        a, b = ".".join(j.left), ".".join(j.right)
        if a != b and (a not in root or root.get(a) != root.get(b)):
            kept.append(j)
    return kept


def workload_columns(queries: list[str]) -> list[tuple[str, str, str]]:
    """(table, role, column), role 'key' or 'predicate', over all queries of a workload."""
    found: set[tuple[str, str, str]] = set()
    for sql in queries:
        q = Query.parse(sql)
        names = dict(q.tables)
        found |= {(names[a], "key", c) for a, cs in q.joined.items() for c in cs}
        found |= {(names[a], "predicate", p.column) for a, ps in q.filters.items() for p in ps}
    return sorted(found)

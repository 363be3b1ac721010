"""Predicates as SQL text and as integer ranges."""

from __future__ import annotations

from datetime import datetime, timezone

from cardinia.functions.hashing import DUCKDB, SPARK
from cardinia.plans.query import Predicate


#: Operators that are no ranges.
UNRANGED = ("LIKE", "NOT LIKE", "IN")


def micros(text: str) -> int:
    at = datetime.fromisoformat(text.strip())
    at = at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at
    delta = at - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def like_pattern(pattern: str) -> str:
    """% is any text and ? any one character; _ and \\ stand for themselves."""
    return pattern.replace("\\", "\\\\").replace("_", "\\_").replace("?", "_")


def _quoted(text: str, dialect: str) -> str:
    text = text.replace("'", "''") if dialect == DUCKDB else text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def literal(value: str, kind: str, dialect: str = SPARK) -> str:
    """A literal of the column's kind."""
    if kind in ("int", "double"):
        float(value)
        return value
    if kind == "timestamp":
        micros(value)
        return f"TIMESTAMP_NTZ '{value}'" if dialect == SPARK else f"TIMESTAMP '{value}'"
    return _quoted(value, dialect)


def name_of(column: str, dialect: str = SPARK) -> str:
    """A column's name, quoted: it may be a reserved word or hold blanks."""
    return "`" + column.replace("`", "``") + "`" if dialect == SPARK else '"' + column.replace('"', '""') + '"'


def condition(p: Predicate, kind: str, dialect: str = SPARK) -> str:
    """SQL for one predicate; LIKE ignores case, as the estimators do."""
    name = name_of(p.column, dialect)
    if p.op in ("LIKE", "NOT LIKE"):
        return f"{name} {p.op.replace('LIKE', 'ILIKE')} {_quoted(like_pattern(str(p.value)), dialect)} ESCAPE {_quoted(chr(92), dialect)}"
    if p.op == "IN":
        return f"{name} IN ({', '.join(literal(v, kind, dialect) for v in p.value)})"
    return f"{name} {p.op} {literal(str(p.value), kind, dialect)}"


def conjunction(ps: tuple[Predicate, ...], kinds: dict[str, str], dialect: str = SPARK) -> str:
    return " AND ".join(condition(p, kinds[p.column], dialect) for p in ps) or "TRUE"


def integer_range(ps: tuple[Predicate, ...], kind: str, low: int, high: int, point_out: bool = False) -> tuple[int, int, tuple[int, ...]] | None:
    """(left, right, points to leave out), both ends inclusive and within the column's domain; None if nothing qualifies.

    Doubles count by their floor. <> has no effect on a range, unless the domain is that
    one value; with ``point_out`` its value is returned for subtraction.
    """
    left, right, out = low, high, []
    for p in ps:
        if p.op in UNRANGED:
            raise NotImplementedError(f"{p.op} has no range")
        text = str(p.value)
        number = micros(text) if kind == "timestamp" else float(text)
        whole = int(number // 1)
        exact = whole == number
        if p.op == "=":
            left, right = (max(left, whole), min(right, whole)) if exact or kind == "double" else (1, 0)
        elif p.op == ">=":
            left = max(left, whole if exact or kind == "double" else whole + 1)
        elif p.op == ">":
            # A double above n.0 may still have the floor n.
            left = max(left, whole if kind == "double" else whole + 1)
        elif p.op == "<=":
            right = min(right, whole)
        elif p.op == "<":
            right = min(right, whole - 1 if exact else whole)
        elif p.op == "<>":
            if low == high == whole and exact:
                return None
            if exact:
                out.append(whole)
    if left > right:
        return None
    return left, right, tuple(x for x in out if left <= x <= right) if point_out else ()

"""Expressions told once for Spark and, for the oracle, as SQL of DuckDB.

Spark runs the Column; the SQL text is only what results are held against."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from shirabe.functions.lazy import F, ready


@dataclass(frozen=True)
class Dual:
    made: Column
    sql: str

    @property
    def col(self) -> Column:
        return ready(self.made)


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def name(column: str) -> Dual:
    return Dual(F.col(column), column)


def lit(value: str | int | float) -> Dual:
    return Dual(F.lit(value), quote(value) if isinstance(value, str) else str(value))


def extract(x: Dual, pattern: str, group: int = 1) -> Dual:
    """The group of the first match; '' without one."""
    return Dual(F.regexp_extract(x.col, pattern, group), f"regexp_extract({x.sql}, {quote(pattern)}, {group})")


def extract_all(x: Dual, pattern: str, group: int = 0) -> Dual:
    return Dual(F.regexp_extract_all(x.col, F.lit(pattern), F.lit(group)), f"regexp_extract_all({x.sql}, {quote(pattern)}, {group})")


def count(x: Dual, pattern: str) -> Dual:
    return Dual(F.regexp_count(x.col, F.lit(pattern)), f"len(regexp_extract_all({x.sql}, {quote(pattern)}))::INT")


def sub(x: Dual, pattern: str, by: str) -> Dual:
    return Dual(F.regexp_replace(x.col, pattern, by), f"regexp_replace({x.sql}, {quote(pattern)}, {quote(by)}, 'g')")


def swap(x: Dual, text: str, by: str | Dual) -> Dual:
    """Literal replacement."""
    by = lit(by) if isinstance(by, str) else by
    return Dual(F.replace(x.col, F.lit(text), by.col), f"replace({x.sql}, {quote(text)}, {by.sql})")


def like(x: Dual, pattern: str) -> Dual:
    return Dual(x.col.rlike(pattern), f"regexp_matches({x.sql}, {quote(pattern)})")


def lower(x: Dual) -> Dual:
    return Dual(F.lower(x.col), f"lower({x.sql})")


def length(x: Dual) -> Dual:
    return Dual(F.char_length(x.col), f"length({x.sql})::INT")


def join(*parts: Dual) -> Dual:
    return Dual(F.concat(*[p.col for p in parts]), "(" + " || ".join(p.sql for p in parts) + ")")


def case(*branches: tuple[Dual, Dual], other: Dual) -> Dual:
    col: Column | None = None
    for test, value in branches:
        col = F.when(test.col, value.col) if col is None else col.when(test.col, value.col)
    assert col is not None
    return Dual(col.otherwise(other.col), "CASE " + " ".join(f"WHEN {t.sql} THEN {v.sql}" for t, v in branches) + f" ELSE {other.sql} END")


def expr(text: str) -> Dual:
    """Text that both dialects read alike."""
    return Dual(F.expr(text), text)


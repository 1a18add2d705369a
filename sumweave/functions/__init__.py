"""Per-row functions: each is a Spark column and a SQL text at once.

A function reads one or more attributes of the join.  Factors of a product are
functions; a product without factors is the constant 1.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Function:
    """vars: attributes read; sql: text with ``{0}``, ``{1}`` ... for them; column: the same for Spark.

    exact: integer-valued, so that sums of it are exact.
    """

    name: str
    vars: tuple[str, ...]
    sql: str
    column: Callable[..., Column]

    def to_column(self) -> Column:
        return self.column(*(F.col(v) for v in self.vars))

    def to_sql(self, quote: Callable[[str], str] = lambda v: v) -> str:
        return "(" + self.sql.format(*(quote(v) for v in self.vars)) + ")"

    def __hash__(self) -> int:
        return hash((self.name, self.vars, self.sql))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Function) and (self.name, self.vars, self.sql) == (other.name, other.vars, other.sql)


def literal(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return repr(value)


def x(var: str) -> Function:
    """The value itself."""
    return Function("x", (var,), "{0}", lambda c: c)


def power(var: str, n: int) -> Function:
    """x to a power from 1 to 4 (or more), by multiplication."""
    if n < 1:
        raise ValueError("powers start at 1")

    def column(c: Column) -> Column:
        out = c
        for _ in range(n - 1):
            out = out * c
        return out

    return Function(f"power{n}", (var,), " * ".join(["{0}"] * n), column)


def exponential(var: str) -> Function:
    return Function("exp", (var,), "exp({0})", F.exp)


def product(*names: str) -> Function:
    """The product of several attributes."""

    def column(*cs: Column) -> Column:
        out = cs[0]
        for c in cs[1:]:
            out = out * c
        return out

    return Function("prod", names, " * ".join(f"{{{i}}}" for i in range(len(names))), column)


def _indicator(name: str, sign: str, compare: Callable[[Column, object], Column]) -> Callable[[str, object], Function]:
    def make(var: str, value) -> Function:
        return Function(
            f"{name}:{value!r}",
            (var,),
            f"CASE WHEN {{0}} {sign} {literal(value)} THEN 1 ELSE 0 END",
            lambda c: F.when(compare(c, value), 1).otherwise(0),
        )

    make.__doc__ = f"1 where x {sign} value, else 0."
    return make


eq = _indicator("eq", "=", lambda c, v: c == F.lit(v))
neq = _indicator("neq", "<>", lambda c, v: c != F.lit(v))
le = _indicator("le", "<=", lambda c, v: c <= F.lit(v))
gt = _indicator("gt", ">", lambda c, v: c > F.lit(v))


def theta_cont(var: str, theta: float) -> Function:
    """theta * x, a continuous parameter's term."""
    return Function(f"theta:{theta!r}", (var,), f"{theta!r} * {{0}}", lambda c: F.lit(theta) * c)


def theta_cat(var: str, thetas: dict) -> Function:
    """theta[x], a categorical parameter's term; 0 for values without one."""
    cases = " ".join(f"WHEN {{0}} = {literal(k)} THEN {v!r}" for k, v in thetas.items())

    def column(c: Column) -> Column:
        pairs = [F.lit(p) for kv in thetas.items() for p in kv]
        return F.coalesce(F.element_at(F.create_map(*pairs), c), F.lit(0.0)) if pairs else F.lit(0.0)

    return Function(f"thetas:{sorted(thetas.items())!r}", (var,), f"CASE {cases} ELSE 0.0 END" if thetas else "0.0", column)


def custom(name: str, names: tuple[str, ...] | list[str], column: Callable[..., Column], sql: str) -> Function:
    """Any expression over several attributes; sql has {0}, {1} ... for them."""
    return Function(f"custom:{name}", tuple(names), sql, column)

"""Attributes, relations and the join tree."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Declared type names; any other name means int (fixed values).
TYPES = {"int": T.IntegerType(), "double": T.DoubleType(), "short": T.ShortType(), "uint": T.LongType()}
SQL_TYPES = {"int": "int", "short": "int", "uint": "int", "double": "numeric"}


@dataclass
class Attribute:
    id: int
    name: str
    type: str = "int"
    constant: float | int | None = None


@dataclass
class Relation:
    name: str
    columns: list[str]
    df: DataFrame | None = None
    threads: int = 0


@dataclass
class JoinTree:
    """Relations joined naturally along the edges of a tree; equal names are join columns.

    unique: relations whose columns shared with their parent (seen from ``root``) are a key.
    complete: those of them that have a match for every row of their parent; where none of
    their other attributes is asked for, they are left out of the join.  Both are declared by
    whoever knows the tables, as foreign keys are; nothing is assumed by default.
    domains: at most how many values an attribute has, where that is known: batches grouped by few
    values are summed once for all combinations.  A wrong number costs time, not rows.
    """

    relations: dict[str, Relation]
    edges: list[tuple[str, str]]
    root: str | None = None
    attributes: dict[str, Attribute] = field(default_factory=dict)
    unique: frozenset[str] = frozenset()
    complete: frozenset[str] = frozenset()
    domains: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.relations:
            raise ValueError("a join tree needs a relation")
        self.root = self.root or next(iter(self.relations))
        for name in [self.root, *(n for e in self.edges for n in e)]:
            if name not in self.relations:
                raise ValueError(f"unknown relation {name!r}")
        self.near: dict[str, list[str]] = {r: [] for r in self.relations}
        for a, b in self.edges:
            self.near[a].append(b)
            self.near[b].append(a)
        if len(self.edges) != len(self.relations) - 1 or len(self._below(self.root, None)) != len(self.relations):
            raise ValueError("the edges must form a tree over all relations; materialise the bags of a cyclic join first")
        for attribute in self.columns():
            own = {r for r in self.relations.values() if attribute in r.columns for r in [r.name]}
            links = sum(a in own and b in own for a, b in self.edges)
            if links != len(own) - 1:
                raise ValueError(f"the relations with {attribute!r} aren't connected (running intersection)")
        self._schema: dict[tuple[str, str | None], frozenset[str]] = {}
        self._parents = dict(self.order())
        for a, b in self.edges:
            if not self.shared(a, b):
                warnings.warn(f"{a} and {b} share no column: their join has all pairs of rows", stacklevel=2)

    def needless(self, node: str, parent: str, used: set[str] | frozenset[str]) -> bool:
        """Whether the subtree at ``node`` changes neither the rows of ``parent`` nor any used attribute."""
        below = self._below(node, parent)
        links = all(r in self.unique and r in self.complete for r in below) and self._parents[node] == parent
        return links and not (self.subtree(node, parent) & set(used)) - set(self.shared(node, parent))

    def kept(self, used: set[str], root: str | None = None) -> list[tuple[str, str | None]]:
        """``order`` without needless subtrees."""
        out: list[tuple[str, str | None]] = []
        have: set[str] = set()
        for name, parent in self.order(root):
            if parent is None or (parent in have and not self.needless(name, parent, used)):
                out.append((name, parent))
                have.add(name)
        return out

    def _below(self, node: str, parent: str | None) -> list[str]:
        """Relations of the subtree at ``node`` seen from ``parent``."""
        out, stack = [], [(node, parent)]
        while stack:
            n, p = stack.pop()
            out.append(n)
            if len(out) > len(self.relations):
                break
            stack += [(m, n) for m in self.near[n] if m != p]
        return out

    def subtree(self, node: str, parent: str | None) -> frozenset[str]:
        """All attributes of the subtree at ``node`` seen from ``parent``."""
        key = (node, parent)
        if key not in self._schema:
            self._schema[key] = frozenset(c for r in self._below(node, parent) for c in self.relations[r].columns)
        return self._schema[key]

    def columns(self) -> list[str]:
        return list(dict.fromkeys(c for r in self.relations.values() for c in r.columns))

    def shared(self, a: str, b: str) -> list[str]:
        return [c for c in self.relations[a].columns if c in self.relations[b].columns]

    def order(self, root: str | None = None) -> list[tuple[str, str | None]]:
        """(relation, parent), parents first."""
        out, stack = [], [(root or self.root, None)]
        while stack:
            n, p = stack.pop(0)
            out.append((n, p))
            stack += [(m, n) for m in self.near[n] if m != p]
        return out

    def owner(self, attribute: str) -> str:
        """The first relation, from the root, that has the attribute."""
        for r, _ in self.order():
            if attribute in self.relations[r].columns:
                return r
        raise ValueError(f"unknown attribute {attribute!r}")

    def frame(self, relation: str) -> DataFrame:
        own = self.relations[relation]
        if own.df is None:
            raise ValueError(f"relation {relation!r} has no data")
        return own.df.select(*own.columns)

    def join(self, columns: list[str] | None = None, nested: bool = False) -> DataFrame:
        """The natural join, with the columns asked for; each relation is pruned first.

        nested: a subtree of keys (``unique``) is joined to its top before the top meets its parent.  It has no more rows than
        its top, and the root's rows move only by keys of their own.  Small tables may be shuffled that would else be
        broadcast, as Spark knows no size of a join before it has run.
        """
        wanted = set(self.columns() if columns is None else columns)
        kept = self.kept(wanted)
        keys = {c for name, parent in kept if parent for c in self.shared(name, parent)}
        done: set[str] = set()

        def add(out: DataFrame | None, name: str, parent: str | None) -> DataFrame:
            df = self.frame(name)
            df = df.select(*(c for c in df.columns if c in wanted or c in keys))
            done.add(name)
            if nested and parent is not None and all(r in self.unique for r in self._below(name, parent)):
                for n, p in kept:
                    if p == name:
                        df = add(df, n, p)
            if out is None:
                return df
            on = self.shared(name, parent)
            return out.join(df, on) if on else out.join(df)  # relations without a common name: all pairs, as natural joins have it

        out = None
        for name, parent in kept:
            if name not in done:
                out = add(out, name, parent)
        return out if columns is None else out.select(*columns)

    def with_attribute(self, relation: str, name: str, column, type: str = "int") -> JoinTree:
        """A tree whose ``relation`` has one more column, an expression over its own columns or a constant."""
        if name in self.columns():
            raise ValueError(f"attribute {name!r} exists")
        out = self._copy()
        own = out.relations[relation]
        own.df, own.columns = own.df.withColumn(name, column if hasattr(column, "alias") else F.lit(column)), [*own.columns, name]
        out.attributes[name] = Attribute(len(out.attributes), name, type)
        return JoinTree(out.relations, out.edges, out.root, out.attributes, out.unique, out.complete, out.domains)

    def replace(self, relation: str, df: DataFrame) -> JoinTree:
        """A tree with other rows in ``relation``, which is no longer known to have a match for every row of its parent."""
        out = self._copy()
        out.relations[relation].df = df
        out.complete = self.complete - {relation}
        return out

    def _copy(self) -> JoinTree:
        relations = {k: Relation(r.name, list(r.columns), r.df, r.threads) for k, r in self.relations.items()}
        return JoinTree(relations, list(self.edges), self.root, dict(self.attributes), self.unique, self.complete, self.domains)

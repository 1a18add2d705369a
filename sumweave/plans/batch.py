"""Queries (sums of products grouped by attributes) and their batches.

Two strategies:

* ``flat``: join once, pruned to the columns in use, and aggregate.
* ``views``: aggregates are pushed below the joins.  Each edge of the tree gets a view:
  the partial aggregates of its subtree, grouped by the join columns and by whatever
  attributes are still needed above.  Equal partial aggregates are computed once, and
  products that differ below one edge only are merged there.

Both read each relation once for a whole batch (``shared``): rows of the join are marked with
the group-by sets and aggregated for all of them at once; a sum is evaluated only for the
sets that ask for it, and partial sums combine before they are shuffled.  With ``views``, the queries
of one pass share one view an edge, grouped by all that any of them needs.  Relations whose
join columns are no key could multiply such a view, so queries share a pass only if one
of them needs the attributes of all such relations that the others need.

``auto`` takes views where an edge away from the query's root may multiply rows, else flat
(joins to unique keys shrink nothing below the largest table).

Nulls: rows with a null in a join column meet nothing; null is a group of its own; a product with a null factor
counts for nothing; a sum is null if none of its products has a value, on any plan.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from functools import reduce
from math import prod
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import Function
from .schema import JoinTree

Product = tuple[Function, ...]
#: The column that tells which group-by set a row of a shared aggregation belongs to.
SET = "__set"
#: Up to so many combinations of all group-by attributes of a pass, sums are made for these first.
COMBINATIONS = 100_000
#: Whether products that differ below one edge only are added there (else each has sums of its own).
COMPRESS = True


@dataclass(frozen=True)
class Aggregate:
    """SUM over the join of a sum of products.  exact: decimal arithmetic, the result a double."""

    products: tuple[Product, ...]
    name: str
    type: str = "double"

    def vars(self) -> set[str]:
        return {v for p in self.products for f in p for v in f.vars}


def agg(name: str, *products: Function | Product | list[Function], type: str = "double") -> Aggregate:
    """agg("n"), agg("s", x("a")), agg("s", (x("a"), x("b"))), agg("s", x("a"), x("b")) (a sum of products)."""
    return Aggregate(tuple(tuple(p) if isinstance(p, (tuple, list)) else (p,) for p in products) or ((),), name, type)


def count(name: str = "n") -> Aggregate:
    return Aggregate(((),), name, "long")


@dataclass
class Query:
    group_by: list[str]
    aggregates: list[Aggregate]
    root: str | None = None
    name: str = ""


@dataclass
class View:
    """Partial aggregates of the subtree at ``origin`` for ``destination`` (None: a query's result)."""

    id: int
    origin: str
    destination: str | None
    group_by: tuple[str, ...]
    #: views that are joined to the origin
    children: tuple[int, ...] = ()
    #: name -> terms: (local functions, (child view id, child aggregate) ...)
    aggregates: dict[str, list[tuple[Product, tuple[tuple[int, str], ...]]]] = field(default_factory=dict)


@dataclass
class Shared:
    """All results of a batch in one table: ``SET``, the group-by attributes (null where a set hasn't them) and sums.

    places: for each query its set and the columns of its aggregates.
    """

    df: DataFrame
    places: list[tuple[int, list[str]]]
    queries: list[Query]

    def frame(self, i: int) -> DataFrame:
        q, (k, names) = self.queries[i], self.places[i]
        return self.df.filter(F.col(SET) == k).select(*q.group_by, *(F.col(n).alias(a.name) for n, a in zip(names, q.aggregates)))


def _typed(total: Column, type: str) -> Column:
    return total.cast({"double": "double", "long": "long", "decimal": "decimal(38,6)"}[type])


def _times(factors: list) -> Column:
    return reduce(lambda a, b: a * b, factors) if factors else F.lit(1).cast("long")


def _total(terms: list[Column], mask: Column | None = None) -> Column:
    """The sum over rows of each term, added: null only if all are."""
    sums = [F.sum(t if mask is None else F.when(mask, t)) for t in terms]
    if len(sums) == 1:
        return sums[0]
    return F.when(F.coalesce(*sums).isNotNull(), reduce(add, (F.coalesce(s, F.lit(0)) for s in sums)))


def _sets(df: DataFrame, sets: list[tuple[tuple[str, ...], dict[str, tuple[list[Column], str | None]]]], domains: dict[str, int]) -> DataFrame:
    """One aggregation of ``df`` for several sets (group-by attributes; name -> terms, type).

    Where few combinations of all attributes are known to exist, these are summed first and the
    sets from their sums; else each row is marked with every set.  Partial sums combine before any shuffle in both.
    """
    every = list(dict.fromkeys(c for by, _ in sets for c in by))
    if len(sets) > 1 and all(c in domains for c in every) and prod(domains[c] for c in every) <= COMBINATIONS:
        sums = {n: terms for _, own in sets for n, (terms, _) in own.items()}
        df = df.groupBy(*every).agg(*(_total(t).alias(n) for n, t in sums.items()))
        sets = [(by, {n: ([F.col(n)], kind) for n, (_, kind) in own.items()}) for by, own in sets]
    if len(sets) == 1:
        by, sums = sets[0]
        out = df.groupBy(*by).agg(*(_typed(_total(t), k).alias(n) for n, (t, k) in sums.items()))
        return out.select(F.lit(0).alias(SET), "*")
    marked = df.withColumn(SET, F.explode(F.array(*(F.lit(i) for i in range(len(sets))))))
    within = lambda ids: None if len(ids) == len(sets) else F.col(SET).isin(*ids)
    keys = [SET]
    for c in every:
        mask = within([i for i, (by, _) in enumerate(sets) if c in by])
        keys.append(F.col(c) if mask is None else F.when(mask, F.col(c)).alias(c))
    wanted: dict[str, tuple[list[int], list[Column], str | None]] = {}
    for i, (_, sums) in enumerate(sets):
        for n, (terms, kind) in sums.items():
            wanted.setdefault(n, ([], terms, kind))[0].append(i)
    return marked.groupBy(*keys).agg(*(_typed(_total(terms, within(ids)), kind).alias(n) for n, (ids, terms, kind) in wanted.items()))


class Plan:
    """The views of a batch, and what queries share a pass."""

    def __init__(self, tree: JoinTree, queries: list[Query], unique: frozenset[str] = frozenset()) -> None:
        self.tree, self.queries, self.views = tree, queries, []
        self._edges: dict[tuple, int] = {}
        self._known: dict[tuple, str] = {}
        self.asked = self.reused = 0
        #: for each query: the view and the aggregates' names in it
        self.results: list[tuple[int, list[str]]] = [(0, [])] * len(queries)
        #: result views that are computed together
        self.passes: list[list[int]] = []
        for members in self._grouped(frozenset(unique) | tree.unique):
            self._pass(members)

    def _grouped(self, unique: frozenset[str]) -> list[list[int]]:
        """Queries of one pass: no more multiplying relations than one of them needs."""
        parents = dict(self.tree.order())

        def reach(q: Query) -> frozenset[str]:
            out = set()
            for a in q.group_by:
                r = self.tree.owner(a)
                while parents[r]:
                    if r not in unique:
                        out.add(r)
                    r = parents[r]
            return frozenset(out)

        found: list[tuple[frozenset[str], str | None, list[int]]] = []
        reaches = [reach(q) for q in self.queries]
        for i in sorted(range(len(self.queries)), key=lambda i: -len(reaches[i])):
            for own, root, members in found:
                if reaches[i] <= own and root == self.queries[i].root:
                    members.append(i)
                    break
            else:
                found.append((reaches[i], self.queries[i].root, [i]))
        return [sorted(members) for _, _, members in found]

    def _pass(self, members: list[int]) -> None:
        queries = [self.queries[i] for i in members]
        free = {v for q in queries for v in q.group_by}
        root = queries[0].root or self._root(free)
        functions = {f for q in queries for a in q.aggregates for p in a.products for f in p}
        self._place = {f: self._home(f, root) for f in functions}
        self._free, self._used = free, free | {v for f in functions for v in f.vars}
        children = tuple(self._edge(c, root) for c in self._children(root, None))
        by_set: dict[tuple[str, ...], int] = {}
        for i in members:
            q = self.queries[i]
            by = tuple(sorted(q.group_by))
            if by not in by_set:
                by_set[by] = len(self.views)
                self.views.append(View(len(self.views), root, None, by, children))
            view = self.views[by_set[by]]
            self.results[i] = (view.id, [self._aggregate(view, a.products, f"{a.type}:") for a in q.aggregates])
        self.passes.append(list(by_set.values()))

    def _root(self, wanted: set[str]) -> str:
        """The relation with most of the group-by attributes; the tree's root on ties."""
        return max(self.tree.relations, key=lambda r: (len(wanted & set(self.tree.relations[r].columns)), r == self.tree.root)) if wanted else self.tree.root

    def _children(self, node: str, parent: str | None) -> list[str]:
        return [c for c in self.tree.near[node] if c != parent and not self.tree.needless(c, node, self._used)]

    def _home(self, f: Function, root: str) -> str:
        """The lowest relation whose subtree has all of the function's attributes."""
        node, parent = root, None
        while not set(f.vars) <= set(self.tree.relations[node].columns):
            below = next((c for c in self.tree.near[node] if c != parent and set(f.vars) <= self.tree.subtree(c, node)), None)
            if below is None:
                break
            node, parent = below, node
        return node

    def _edge(self, node: str, parent: str) -> int:
        """The view of the subtree at ``node``, for ``parent``."""
        tree, inside = self.tree, set(self.tree._below(node, parent))
        pulled = {v for f, home in self._place.items() if home not in inside for v in f.vars}
        by = tuple(sorted(set(tree.shared(node, parent)) | ((self._free | pulled) & tree.subtree(node, parent))))
        children = tuple(self._edge(c, node) for c in self._children(node, parent))
        key = (node, parent, by, children)
        if key not in self._edges:
            self._edges[key] = len(self.views)
            self.views.append(View(len(self.views), node, parent, by, children))
        return self._edges[key]

    def _aggregate(self, view: View, products: tuple[Product, ...], kind: str = "") -> str:
        """The name in ``view`` of the sum of these products over its subtree."""
        self.asked += 1
        key = (view.id, kind, frozenset(Counter(products).items()))
        if key in self._known:
            self.reused += 1
            return self._known[key]
        children = [self.views[c] for c in view.children]
        inside = [set(self.tree._below(c.origin, view.origin)) for c in children]
        split = []
        for p in products:
            below = tuple(tuple(f for f in p if self._place[f] in i) for i in inside)
            split.append((tuple(f for f in p if not any(self._place[f] in i for i in inside)), below))
        terms = []
        for local, below in self._merge(split):
            terms.append((local, tuple((c.id, self._aggregate(c, own)) for c, own in zip(children, below))))
        name = f"__v{view.id}_{len(view.aggregates)}"
        view.aggregates[name] = terms
        self._known[key] = name
        return name

    @staticmethod
    def _merge(split: list[tuple[Product, tuple[Product, ...]]]) -> list[tuple[Product, tuple[tuple[Product, ...], ...]]]:
        """Products with one local part that differ below at most one edge become one term with a sum there."""
        out: list[tuple[Product, list[list[Product]]]] = []
        for local, below in split:
            for own, sums in out:
                differ = [i for i, b in enumerate(below) if sums[i] != [b]]
                if COMPRESS and own == local and len(differ) == 1 and all(len(s) == 1 for i, s in enumerate(sums) if i not in differ):
                    sums[differ[0]].append(below[differ[0]])
                    break
            else:
                out.append((local, [[b] for b in below]))
        return [(local, tuple(tuple(s) for s in sums)) for local, sums in out]

    def joined(self, views: list[View], made: dict[int, DataFrame]) -> DataFrame:
        """The views' common origin with their common children."""
        origin, children = views[0].origin, views[0].children
        df = self.tree.frame(origin)
        used = {v for view in views for terms in view.aggregates.values() for local, _ in terms for f in local for v in f.vars}
        used |= {v for view in views for v in view.group_by} | {v for c in children for v in self.views[c].group_by}
        df = df.select(*(c for c in df.columns if c in used))
        for c in children:
            on = self.tree.shared(origin, self.views[c].origin)
            child = self.frame(c, made)
            df = df.join(child, on) if on else df.join(child)
        return df

    def frame(self, i: int, made: dict[int, DataFrame]) -> DataFrame:
        """The partial aggregates of view ``i``."""
        if i not in made:
            view = self.views[i]
            df = self.joined([view], made)
            made[i] = df.groupBy(*view.group_by).agg(*(_total(terms).alias(n) for n, terms in self.terms(view).items()))
        return made[i]

    def terms(self, view: View) -> dict[str, list[Column]]:
        return {n: [_times([*(f.to_column() for f in local), *(F.col(x) for _, x in inc)]) for local, inc in terms] for n, terms in view.aggregates.items()}


class AggregateBatch:
    def __init__(self, tree: JoinTree) -> None:
        self.tree, self.queries = tree, []

    def add(self, query: Query) -> AggregateBatch:
        unknown = ({*query.group_by} | {v for a in query.aggregates for v in a.vars()}) - set(self.tree.columns())
        if unknown:
            raise ValueError(f"unknown attributes {sorted(unknown)}")
        self.queries.append(query)
        return self

    def plan(self, unique: set[str] | frozenset[str] = frozenset()) -> Plan:
        return Plan(self.tree, self.queries, frozenset(unique))

    def stats(self) -> dict[str, int]:
        """Numbers of queries, aggregates asked for, views, aggregates computed, passes, partial aggregates shared."""
        plan = self.plan()
        return {
            "queries": len(self.queries),
            "aggregates": sum(len(q.aggregates) for q in self.queries),
            "views": len(plan.views),
            "view_aggregates": sum(len(v.aggregates) for v in plan.views),
            "groups": len({(v.origin, v.destination) for v in plan.views}),
            "passes": len(plan.passes),
            "shared": plan.reused,
        }

    def strategy(self, unique: set[str] | frozenset[str] = frozenset()) -> str:
        """unique: relations whose columns shared with their parent are a key, besides those that the tree declares."""
        keys = set(unique) | self.tree.unique
        return "flat" if all(r in keys for r, p in self.tree.order() if p is not None) else "views"

    def execute(self, strategy: str = "flat", unique: set[str] | frozenset[str] = frozenset(), folder: str | None = None) -> list[DataFrame]:
        """A DataFrame for each query.

        Each is a job of its own when it is run.  With ``folder`` (shared by driver and executors) the whole
        batch is computed now, in one pass, and written there; the DataFrames read it.
        """
        if folder is not None:
            shared = self.shared(strategy, unique)
            shared.df.write.partitionBy(SET).parquet(folder)
            shared.df = self.tree.frame(self.tree.root).sparkSession.read.schema(shared.df.schema).parquet(folder)
            return [shared.frame(i) for i in range(len(self.queries))]
        out = []
        for q in self.queries:
            own = AggregateBatch(self.tree).add(q).shared(strategy, unique)
            out.append(own.frame(0) if len(q.group_by) else own.df.select(*(F.col(n).alias(a.name) for n, a in zip(own.places[0][1], q.aggregates))))
        return out

    def shared(self, strategy: str = "flat", unique: set[str] | frozenset[str] = frozenset()) -> Shared:
        """All queries' results in one table, from one pass over the join."""
        if strategy == "auto":
            strategy = self.strategy(unique)
        return {"flat": self._flat, "views": self._views}[strategy](frozenset(unique))

    def _flat(self, unique: frozenset[str]) -> Shared:
        sets: dict[tuple[str, ...], dict[str, tuple[list[Column], str]]] = {}
        names: dict[Aggregate, str] = {}
        places = []
        for q in self.queries:
            own = sets.setdefault(tuple(sorted(q.group_by)), {})
            columns = []
            for a in q.aggregates:
                n = names.setdefault(Aggregate(a.products, "", a.type), f"__a{len(names)}")
                own[n] = ([_times([f.to_column() for f in p]) for p in a.products], a.type)
                columns.append(n)
            places.append((list(sets).index(tuple(sorted(q.group_by))), columns))
        used = {c for by in sets for c in by} | {v for a in names for v in a.vars()}
        df = self.tree.join([c for c in self.tree.columns() if c in used])
        return Shared(_sets(df, list(sets.items()), self.tree.domains), places, self.queries)

    def _views(self, unique: frozenset[str]) -> Shared:
        plan = self.plan(unique)
        made: dict[int, DataFrame] = {}
        types = {n: a.type for (_, names), q in zip(plan.results, self.queries) for n, a in zip(names, q.aggregates)}
        number, parts = {}, []
        for ids in plan.passes:
            views = [plan.views[i] for i in ids]
            sets = [(v.group_by, {n: (t, types[n]) for n, t in plan.terms(v).items()}) for v in views]
            first = len(number)
            number |= {v.id: first + k for k, v in enumerate(views)}
            part = _sets(plan.joined(views, made), sets, self.tree.domains)
            parts.append(part.withColumn(SET, F.col(SET) + first) if first else part)
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return Shared(df, [(number[v], names) for v, names in plan.results], self.queries)

    def to_sql(self, mode: str = "merged") -> list[str]:
        """SQL of the queries.  flat: one text each; merged: one for each group-by set; views: one CREATE TABLE a view."""
        from .sqlgen import batch_sql

        return batch_sql(self, mode)

    def explain(self) -> str:
        lines = []
        for v in self.plan().views:
            lines.append(f"view {v.id}: {v.origin} -> {v.destination or 'result'} by ({', '.join(v.group_by)}), {len(v.aggregates)} aggregates")
        return "\n".join(lines)

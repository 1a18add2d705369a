"""SQL text of join trees, batches and view plans."""

from __future__ import annotations

from .schema import SQL_TYPES, JoinTree

_CASTS = {"double": "DOUBLE", "long": "BIGINT", "decimal": "DECIMAL(38,6)"}


def product_sql(product) -> str:
    return " * ".join(f.to_sql() for f in product) or "1"


def total_sql(terms: list[str]) -> str:
    """The sum over rows of each term, added: null only if all are."""
    sums = [f"SUM({t})" for t in terms]
    if len(sums) == 1:
        return sums[0]
    return f"CASE WHEN COALESCE({', '.join(sums)}) IS NOT NULL THEN {' + '.join(f'COALESCE({s}, 0)' for s in sums)} END"


def aggregate_sql(a) -> str:
    return f"CAST({total_sql([product_sql(p) for p in a.products])} AS {_CASTS[a.type]}) AS {a.name}"


def from_sql(tree: JoinTree, tables: dict[str, str] | None = None) -> str:
    """FROM clause of the natural join, parents first.  tables: SQL to use for a relation."""
    out = ""
    for name, parent in tree.order():
        table = f"{tables[name]} AS {name}" if tables and name in tables else name
        if parent is None:
            out = table
        else:
            on = tree.shared(name, parent)
            out += f" JOIN {table} USING ({', '.join(on)})" if on else f" CROSS JOIN {table}"
    return out


def query_sql(tree: JoinTree, group_by, aggregates, tables=None) -> str:
    columns = ", ".join([*group_by, *(aggregate_sql(a) for a in aggregates)])
    tail = f" GROUP BY {', '.join(group_by)}" if group_by else ""
    return f"SELECT {columns} FROM {from_sql(tree, tables)}{tail}"


def join_sql(tree: JoinTree, columns=None, tables=None) -> str:
    return f"SELECT {', '.join(columns or tree.columns())} FROM {from_sql(tree, tables)}"


def load_sql(tree: JoinTree, path: str) -> list[str]:
    """CREATE TABLE and copy commands for ``|``-separated files."""
    out = []
    for r in tree.relations.values():
        kinds = [f"{c} {SQL_TYPES.get(tree.attributes[c].type, 'int') if c in tree.attributes else 'int'}" for c in r.columns]
        out += [f"DROP TABLE IF EXISTS {r.name};", f"CREATE TABLE {r.name} ({', '.join(kinds)});", f"\\COPY {r.name} FROM '{path}/{r.name}.tbl' DELIMITER '|' CSV;"]
    return out


def drop_sql(tree: JoinTree) -> list[str]:
    return [f"DROP TABLE IF EXISTS {name};" for name in tree.relations]


def drop_views_sql(batch) -> list[str]:
    return [f"DROP TABLE IF EXISTS view_{v.id};" for v in batch.plan().views]


def scripts(batch, path: str, target: str) -> dict[str, str]:
    """File name -> text: tables loaded from ``path``, views made, results exported to ``target``, everything dropped."""
    return {
        "load_data.sql": "\n".join(load_sql(batch.tree, path)),
        "views.sql": "\n".join(batch_sql(batch, "views")),
        "output.sql": "\n".join(output_sql(batch, target)),
        "cleanup.sql": "\n".join(drop_views_sql(batch)),
        "drop_data.sql": "\n".join([*drop_sql(batch.tree), *drop_views_sql(batch)]),
    }


def output_sql(batch, target: str) -> list[str]:
    """Copy commands that export each query's rows in order, with two decimals."""
    out = []
    for i, q in enumerate(batch.queries):
        rows = ", ".join([*q.group_by, *(f"CAST({a.name} AS DECIMAL(53,2)) AS {a.name}" for a in q.aggregates)])
        order = f" ORDER BY {', '.join(q.group_by)}" if q.group_by else ""
        out.append(f"\\COPY (SELECT {rows} FROM ({query_sql(batch.tree, q.group_by, q.aggregates)}) AS q{order}) TO '{target}/query_{i}.tbl' DELIMITER '|' CSV;")
    return out


def batch_sql(batch, mode: str) -> list[str]:
    tree = batch.tree
    if mode == "flat":
        return [query_sql(tree, q.group_by, q.aggregates) for q in batch.queries]
    if mode == "merged":
        groups: dict[tuple[str, ...], dict] = {}
        for q in batch.queries:
            groups.setdefault(tuple(q.group_by), {}).update({a.name: a for a in q.aggregates})
        return [query_sql(tree, by, own.values()) for by, own in groups.items()]
    if mode != "views":
        raise ValueError(f"unknown mode {mode!r}")
    plan, done, out = batch.plan(), set(), []

    def write(view) -> None:
        if view.id in done:
            return
        done.add(view.id)
        joins = ""
        for c in view.children:
            write(plan.views[c])
            on = tree.shared(view.origin, plan.views[c].origin)
            joins += f" JOIN view_{c} USING ({', '.join(on)})" if on else f" CROSS JOIN view_{c}"
        sums = []
        for name, terms in view.aggregates.items():
            parts = [" * ".join([*(f.to_sql() for f in local), *(n for _, n in inc)]) or "1" for local, inc in terms]
            sums.append(f"{total_sql(parts)} AS {name}")
        by = f" GROUP BY {', '.join(view.group_by)}" if view.group_by else ""
        out.append(f"CREATE TABLE view_{view.id} AS SELECT {', '.join([*view.group_by, *sums])} FROM {view.origin}{joins}{by};")

    for view in plan.views:
        write(view)
    return out

"""Which scanned columns a table depends on, read from its analysed plan, so that outcomes can be proved unread before they may be.

Every column of a plan is followed to the columns of the tables at its leaves, through projections, aggregates, windows, generators and unions.  What
only decides which rows there are, or how they are grouped and ordered (filters, join conditions, grouping and sort keys), counts for all columns.
A node whose columns can't be told apart, such as a Python function over whole rows, makes all that it returns depend on all that it gets.  Nothing is run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def _each(seq):
    return [seq.apply(i) for i in range(seq.size())]


def _ids(expression) -> set[int]:
    return {a.exprId().id() for a in _each(expression.references().toSeq())}


#: kinds of nodes, and their fields of expressions that decide on rows, groups or order
_DECIDING = {"Sort": ["order"], "Window": ["partitionSpec", "orderSpec"], "Aggregate": ["groupingExpressions"], "RepartitionByExpression": ["partitionExpressions"]}


def _deciding(plan, kind: str) -> list:
    if kind == "Filter":
        return [plan.condition()]
    if kind == "Join":
        return [plan.condition().get()] if plan.condition().nonEmpty() else []
    return [e for name in _DECIDING.get(kind, []) for e in _each(getattr(plan, name)())]


def _node(plan, known: dict[int, frozenset], control: set) -> None:
    children = _each(plan.children())
    for child in children:
        _node(child, known, control)
    kind = plan.nodeName()
    output = _each(plan.output())
    if not children:
        for a in output:
            known[a.exprId().id()] = frozenset([a.name()])
        return
    of = lambda ids: frozenset().union(*[known.get(i, frozenset()) for i in ids]) if ids else frozenset()
    if kind == "Union":
        for i, a in enumerate(output):
            known[a.exprId().id()] = of([_each(c.output())[i].exprId().id() for c in children])
        return
    for expression in _deciding(plan, kind):
        control |= of(_ids(expression))
    for inner in _each(plan.subqueries()):
        _node(inner, known, control)
        control |= of([a.exprId().id() for a in _each(inner.output())])
    made = {e.exprId().id(): _ids(e) for e in _each(plan.expressions()) if e.getClass().getSimpleName() == "Alias"}
    everything = None
    for a in output:
        i = a.exprId().id()
        if i in made:
            known[i] = of(made[i])
        elif i not in known:
            if everything is None:
                own = _ids(plan.generator()) if kind == "Generate" else [x.exprId().id() for c in children for x in _each(c.output())]
                everything = of(own)
            known[i] = everything


def sources(df: DataFrame) -> tuple[dict[str, set[str]], set[str]]:
    """({column: scanned columns that its values come from}, scanned columns that decide on rows, groups and order)."""
    plan = df._jdf.queryExecution().analyzed()
    known: dict[int, frozenset] = {}
    control: set[str] = set()
    _node(plan, known, control)
    return {a.name(): set(known[a.exprId().id()]) for a in _each(plan.output())}, control


def leaks(df: DataFrame, forbidden: list[str], columns: list[str] | None = None) -> dict[str, list[str]]:
    """The ``columns`` (all) that depend on a forbidden one, and under ``rows`` what decides on rows."""
    of, control = sources(df)
    found = {c: sorted(set(s) & set(forbidden)) for c, s in of.items() if columns is None or c in columns}
    return {c: s for c, s in {**found, "rows": sorted(control & set(forbidden))}.items() if s}


def check_unread(df: DataFrame, forbidden: list[str]) -> DataFrame:
    """``df`` itself, if nothing in it depends on a forbidden column."""
    found = leaks(df, forbidden)
    if found:
        raise ValueError("outcomes are read before the lock: " + "; ".join(f"{c} from {', '.join(s)}" for c, s in sorted(found.items())))
    return df

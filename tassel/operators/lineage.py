"""Where the columns of a DataFrame come from, read off Spark's analyzed plan."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame


def _each(seq) -> Iterator:
    for i in range(seq.size()):
        yield seq.apply(i)


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _inner_plans(expression) -> Iterator:
    """Plans of the subqueries anywhere in an expression."""
    if "Subquery" in _kind(expression) or _kind(expression) == "Exists":
        yield expression.plan()
    for child in _each(expression.children()):
        yield from _inner_plans(child)


def _needs(expression, traced: set[int], hidden: set[str]) -> bool:
    """The expression reads a traced column, itself or in a subquery."""
    if any(a.exprId().id() in traced for a in _each(expression.references().toSeq())):
        return True
    return any(_trace(plan, hidden) & {a.exprId().id() for a in _each(plan.output())} for plan in _inner_plans(expression))


def _trace(plan, hidden: set[str]) -> set[int]:
    """Ids of all columns in the plan that hold, or are computed from, a column named in ``hidden``.

    A column that no listed rule explains counts as traced if its node's input has any traced column.
    """
    children = list(_each(plan.children()))
    traced: set[int] = set()
    for child in children:
        traced |= _trace(child, hidden)
    output = list(_each(plan.output()))
    if not children:
        # a table, or a cached or written one: columns go by their names
        return {a.exprId().id() for a in output if a.name().lower() in hidden}
    kind = _kind(plan)
    if kind in ("Union", "Intersect", "Except"):
        for i, a in enumerate(output):
            if any(c.output().apply(i).exprId().id() in traced for c in children):
                traced.add(a.exprId().id())
        return traced
    known = {a.exprId().id() for c in children for a in _each(c.output())}
    tainted_input = bool(traced & known)
    for expression in _each(plan.expressions()):
        if _kind(expression) == "Alias":
            known.add(expression.exprId().id())
            if _needs(expression, traced, hidden):
                traced.add(expression.exprId().id())
    if tainted_input:
        traced |= {a.exprId().id() for a in output} - known
    return traced


def derived_from(df: DataFrame, names: list[str]) -> list[str]:
    """Output columns of ``df`` that hold or are computed from columns named in ``names`` (in any case), through
    renames, expressions, aggregates, joins, unions and subqueries, however far back."""
    plan = df._jdf.queryExecution().analyzed()
    traced = _trace(plan, {n.lower() for n in names})
    return [a.name() for a in _each(plan.output()) if a.exprId().id() in traced]

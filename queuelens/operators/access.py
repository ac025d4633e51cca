"""Row security, cascading option lists and free SQL over one secured frame."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .predicates import all_of, present


def secured(df: DataFrame, user: str | None) -> DataFrame:
    """No caller sees no rows; a known caller sees all of them."""
    return df.filter(F.lit(user is not None))


def _filled(c: Column, kind: str | None) -> Column:
    """Value that is not missing; only texts can be empty."""
    return present(c) if kind in (None, "string") else c.isNotNull()


def options(df: DataFrame, column: str | Column, predicate: Column | None = None, name: str | None = None) -> DataFrame:
    """Distinct non-empty values of a column or expression under the filters chosen so far, in
    order. ``name`` is the result column of an expression."""
    value = F.col(column) if isinstance(column, str) else column
    name = name or (column if isinstance(column, str) else "value")
    rows = (df if predicate is None else df.filter(predicate)).select(value.alias(name))
    return rows.filter(_filled(F.col(name), dict(rows.dtypes)[name])).distinct().orderBy(F.col(name).asc_nulls_last())


def cascading_options(df: DataFrame, steps: Mapping[str, Column | None]) -> DataFrame:
    """Option lists where each column sees the filters of all earlier columns, in the order of
    the steps and of the values.

    All lists come from a single pass: every row is turned into (column, value) pairs
    for the columns whose earlier filters it meets, and the pairs are made distinct.
    """
    pairs, so_far, kinds = [], F.lit(True), dict(df.dtypes)
    for place, (column, clause) in enumerate(steps.items()):
        c = F.col(column)
        pairs.append(F.when(so_far & _filled(c, kinds.get(column)), F.struct(
            F.lit(place).alias("place"), F.lit(column).alias("column"), c.cast("string").alias("value"))))
        so_far = all_of([so_far, clause])
    return (df.select(F.explode(F.array(*pairs)).alias("o")).filter("o IS NOT NULL")
            .select("o.*").distinct().orderBy("place", "value").select("column", "value"))


#: Plan nodes of a plain query. Everything else (commands, writes, settings, table functions) is refused.
QUERY_NODES = frozenset("""Project Filter Aggregate UnresolvedHaving Join LateralJoin Sort GlobalLimit LocalLimit Limit Offset
    Distinct Union Except Intersect SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedWith WithWindowDefinition
    UnresolvedInlineTable LocalRelation OneRowRelation UnresolvedRelation Pivot Unpivot UnresolvedHint""".split())
#: Functions that reach outside of the query.
CLOSED_FUNCTIONS = frozenset(["reflect", "java_method", "try_reflect", "input_file_name"])


def _items(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]


def _check_expression(e) -> None:
    if e.getClass().getSimpleName() == "UnresolvedFunction":
        name = _items(e.nameParts())[-1].lower()
        if name in CLOSED_FUNCTIONS:
            raise ValueError(f"function {name!r} is not allowed")
    for child in _items(e.children()):
        _check_expression(child)


def _check_plan(node, visible: frozenset[str]) -> None:
    """Walk a parsed plan; ``visible`` holds the names that may be read at this place."""
    kind = node.getClass().getSimpleName()
    if kind not in QUERY_NODES:
        raise ValueError(f"only queries are allowed, not {kind}")
    if kind == "UnresolvedRelation":
        name = ".".join(_items(node.multipartIdentifier()))
        if name.lower() not in visible:
            raise ValueError(f"direct access to {name!r} is not allowed")
    for e in _items(node.expressions()):
        _check_expression(e)
    if kind == "UnresolvedWith":
        for pair in _items(node.cteRelations()):
            _check_plan(pair._2(), visible)
            visible = visible | {pair._1().lower()}
        _check_plan(node.child(), visible)
        return
    for child in [*_items(node.children()), *_items(node.innerChildren())]:
        _check_plan(child, visible)


def custom_sql(spark: SparkSession, sql: str, df: DataFrame, user: str | None,
               predicate: Column | None = None) -> DataFrame:
    """Run a caller's SQL over ``{requests}``, bound to the secured and filtered frame.

    The text is parsed first and its plan walked: it may hold plain query nodes only, and
    read nothing but the bound frame and its own common table expressions, each where it is
    in scope. Tables, views, global views, files and table functions are refused with
    ``ValueError``, as are commands and functions that reach outside of the query.
    """
    bound = f"requests_{uuid.uuid4().hex}"
    text = sql.replace("{requests}", bound)
    _check_plan(spark._jsparkSession.sessionState().sqlParser().parsePlan(text), frozenset([bound]))
    frame = secured(df, user)
    (frame if predicate is None else frame.filter(predicate)).createTempView(bound)
    try:
        return spark.sql(text)
    finally:
        spark.catalog.dropTempView(bound)

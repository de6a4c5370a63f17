"""SELECT: scan, join, filter, projection. Catalyst does the pushdown and picks the join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.dialect.nodes import Name, Select
from veldra.functions.lowering import COMPARISONS, Lowering
from veldra.plans.access import choose
from veldra.plans.scope import Scope, fields_of
from veldra.sources.catalog import RID, Catalog
from veldra.types import Family


@dataclass(frozen=True)
class Query:
    """``frame`` has the output columns; ``base`` and ``outputs`` make it, ``order`` is that of the rows."""

    base: DataFrame
    outputs: list[Column]
    names: list[str]
    order: list[str]

    @property
    def frame(self) -> DataFrame:
        return self.base.select(*self.outputs)

    def ordered(self) -> DataFrame:
        """In insertion order of the tables that keep one, or in key order of an index."""
        return self.base.orderBy(*self.order).select(*self.outputs) if self.order else self.frame


def scope_of(catalog: Catalog, select: Select) -> Scope:
    left = catalog.table(select.table)
    right = catalog.table(select.join.table, "Join table") if select.join else None
    return Scope(fields_of(left.name, left.types, "l"), fields_of(right.name, right.types, "r") if right else ())


def _output(scope: Scope, columns: tuple[Name, ...] | None) -> tuple[list[Column], list[str]]:
    """Qualifiers are dropped from output names, and names may repeat."""
    fields = scope.fields if columns is None else [scope.resolve(c) for c in columns]
    return [F.col(f.alias).alias(f.column) for f in fields], [f.column for f in fields]


def build(catalog: Catalog, select: Select, null_mode: str = "three_valued") -> Query:
    scope = scope_of(catalog, select)
    access = choose(catalog, select, scope, null_mode)
    outputs, names = _output(scope, select.columns)
    where = None if select.where is None else Lowering(scope, null_mode).predicate(select.where)
    left = catalog.table(select.table)
    use = lambda side, table, prefix: catalog.index_copy(access.index, prefix) if access.index is not None and access.side == side else catalog.scan(table, prefix)
    base = use("left", left, "l")
    order = [f"l{RID}"] if left.managed else []
    if select.join:
        right = catalog.table(select.join.table)
        base = join(base, use("right", right, "r"), *scope.keys(select.join), null_mode)
        order += [f"r{RID}"] if right.managed else []
    elif access.kind == "IndexScan":
        order = [scope.resolve(access.key).alias, *order]
    return Query(base if where is None else base.where(where), outputs, names, order)


def join(left: DataFrame, right: DataFrame, a, b, null_mode: str) -> DataFrame:
    """Inner equi-join; keys of different families never meet, nor do nulls in three-valued logic."""
    if a.family is not b.family or (a.family is Family.OTHER and a.kind != b.kind):
        return left.limit(0).join(right.limit(0), F.lit(True))
    return left.join(right, COMPARISONS[null_mode]["="](F.col(a.alias), F.col(b.alias)), "inner")

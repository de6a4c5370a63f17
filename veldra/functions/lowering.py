"""Expressions to Spark columns, strictly typed: Spark never gets to coerce an operand."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldra.dialect.nodes import Binary, Expression, Literal, Name
from veldra.errors import AnalysisError
from veldra.plans.scope import Scope
from veldra.types import SPARK_TYPE, Family

#: Comparisons by SQL's three-valued logic, where a null operand gives null.
THREE_VALUED = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
}
#: Comparisons that are always true or false: null equals null, and is neither less nor greater.
TWO_VALUED = {
    "=": lambda a, b: a.eqNullSafe(b),
    "<>": lambda a, b: ~a.eqNullSafe(b),
    "<": lambda a, b: F.coalesce(a < b, F.lit(False)),
    ">": lambda a, b: F.coalesce(b < a, F.lit(False)),
    "<=": lambda a, b: ~F.coalesce(b < a, F.lit(False)),
    ">=": lambda a, b: ~F.coalesce(a < b, F.lit(False)),
}
COMPARISONS = {"three_valued": THREE_VALUED, "two_valued": TWO_VALUED}


@dataclass(frozen=True)
class Typed:
    column: Column
    kind: T.DataType
    family: Family


def _wider(a: T.DataType, b: T.DataType) -> T.DataType:
    order = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    return max(a, b, T.IntegerType(), key=lambda t: order.index(type(t)))


class Lowering:
    """Of one scope. Without a scope (constants) a column has nothing to refer to."""

    def __init__(self, scope: Scope | None, null_mode: str = "three_valued"):
        self.scope = scope
        self.comparisons = COMPARISONS[null_mode]

    def __call__(self, e: Expression) -> Typed:
        match e:
            case Literal(value, family):
                return Typed(F.lit(value).cast(SPARK_TYPE[family]), SPARK_TYPE[family], family)
            case Name():
                if self.scope is None:
                    raise AnalysisError(f"Column reference without tuple context: {e}")
                field = self.scope.resolve(e)
                return Typed(F.col(field.alias), field.kind, field.family)
            case Binary(op, left, right):
                a, b = self(left), self(right)
                if op in ("AND", "OR"):
                    x, y = self._boolean(a), self._boolean(b)
                    return self._truth(x & y if op == "AND" else x | y)
                return self._compare(op, a, b) if op in self.comparisons else self._compute(op, a, b)
        raise TypeError(e)

    @staticmethod
    def _truth(column: Column) -> Typed:
        return Typed(column, T.BooleanType(), Family.BOOLEAN)

    @staticmethod
    def _boolean(x: Typed) -> Column:
        if x.family is not Family.BOOLEAN:
            raise AnalysisError("Type mismatch: Expected BOOLEAN")
        return x.column

    def predicate(self, e: Expression) -> Column:
        return self._boolean(self(e))

    def _compare(self, op: str, a: Typed, b: Typed) -> Typed:
        """Values of different families are unequal; to order them is an error."""
        if a.family is b.family and (a.family is not Family.OTHER or a.kind == b.kind):
            return self._truth(self.comparisons[op](a.column, b.column))
        if op in ("=", "<>"):
            return self._truth(F.lit(op == "<>"))
        raise AnalysisError(f"Cannot compare different types: {a.family.value} {op} {b.family.value}")

    @staticmethod
    def _compute(op: str, a: Typed, b: Typed) -> Typed:
        """Integers give integers, of the wider width; division of them truncates toward zero."""
        if a.family is not b.family or a.family not in (Family.INTEGER, Family.FLOAT):
            raise AnalysisError(f"Type mismatch: Expected {'FLOAT' if Family.FLOAT in (a.family, b.family) else 'INTEGER'}")
        whole = a.family is Family.INTEGER
        kind = _wider(a.kind, b.kind) if whole else T.DoubleType()
        x, y = a.column.cast(kind), b.column.cast(kind)
        if op == "/":
            quotient = F.call_function("div", x, y).cast(kind) if whole else x / y
            made = F.when(y == 0, F.raise_error(F.lit("Division by zero")).cast(kind)).otherwise(quotient)
        else:
            made = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y}[op]()
        return Typed(made, kind, a.family)

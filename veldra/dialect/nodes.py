"""Statements and expressions."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Union

from veldra.types import Family, show_value


@dataclass(frozen=True)
class Literal:
    value: object
    family: Family


@dataclass(frozen=True)
class Name:
    """A column, with its table if the text names one."""

    column: str
    table: str | None = None

    def __str__(self) -> str:
        return self.column if self.table is None else f"{self.table}.{self.column}"


@dataclass(frozen=True)
class Binary:
    op: str
    left: Expression
    right: Expression


Expression = Union[Literal, Name, Binary]


@dataclass(frozen=True)
class Join:
    table: str
    first: Name
    second: Name


@dataclass(frozen=True)
class Select:
    table: str
    columns: tuple[Name, ...] | None  # None: all
    join: Join | None = None
    where: Expression | None = None


@dataclass(frozen=True)
class ColumnDefinition:
    name: str
    family: Family
    length: int = 0


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[ColumnDefinition, ...]


@dataclass(frozen=True)
class DropTable:
    table: str


@dataclass(frozen=True)
class Insert:
    table: str
    rows: tuple[tuple[Expression, ...], ...]


@dataclass(frozen=True)
class Update:
    table: str
    assignments: tuple[tuple[str, Expression], ...]
    where: Expression | None = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Expression | None = None


@dataclass(frozen=True)
class CreateIndex:
    index: str
    table: str
    column: str


@dataclass(frozen=True)
class Explain:
    select: Select


Statement = Union[Select, CreateTable, DropTable, Insert, Update, Delete, CreateIndex, Explain]

# Names of operators in dumps.
OPERATOR_NAMES = {"=": "EQ", "<>": "NEQ", "<": "LT", ">": "GT", "<=": "LEQ", ">=": "GEQ", "AND": "AND", "OR": "OR", "+": "PLUS", "-": "MINUS", "*": "STAR", "/": "SLASH"}


def dump_expression(e: Expression | None, indent: int = 0) -> str:
    """A tree, two spaces a level."""
    pad = "  " * indent
    match e:
        case None:
            return pad + "null"
        case Literal(value):
            return f"{pad}Literal({show_value(value)})"
        case Name():
            return f"{pad}Column({e})"
        case Binary(op, left, right):
            return "\n".join((f"{pad}BinaryOp({OPERATOR_NAMES[op]})", dump_expression(left, indent + 1), dump_expression(right, indent + 1)))
    raise TypeError(e)


def show_columns(columns: tuple[Name, ...] | None) -> str:
    return "*" if columns is None else f"[{', '.join(map(str, columns))}]"


def dump(s: Statement) -> str:
    """Readable form of a statement."""
    where = lambda e: f"  where:\n{dump_expression(e, 2)}"
    match s:
        case Select():
            join = f", join={s.join.table}, on={s.join.first} = {s.join.second}" if s.join else ""
            return f"SelectStatement(table={s.table}, columns={show_columns(s.columns)}){join}\n{where(s.where)}"
        case CreateTable():
            types = [f"\n  - {c.name} {c.family.value}" + (f"({c.length})" if c.family is Family.VARCHAR else "") for c in s.columns]
            return f"CreateTableStatement(table={s.table})\n  columns:{''.join(types)}"
        case DropTable():
            return f"DropTableStatement(table={s.table})"
        case Insert():
            rows = [f"\n  row[{k}]" + "".join("\n" + dump_expression(e, 2) for e in row) for k, row in enumerate(s.rows)]
            return f"InsertStatement(table={s.table}, rows={len(s.rows)}){''.join(rows)}"
        case Update():
            sets = [f"\n  - {name} =\n{dump_expression(e, 2)}" for name, e in s.assignments]
            return f"UpdateStatement(table={s.table})\n  assignments:{''.join(sets)}\n{where(s.where)}"
        case Delete():
            return f"DeleteStatement(table={s.table})\n{where(s.where)}"
        case CreateIndex():
            return f"CreateIndexStatement(index={s.index}, table={s.table}, column={s.column})"
        case Explain():
            return "ExplainStatement\n" + dump(s.select)
    raise TypeError(s)

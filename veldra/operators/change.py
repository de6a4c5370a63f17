"""INSERT, UPDATE, DELETE and copies of tables: new snapshots from old ones, published when written."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.dialect.nodes import Delete, Expression, Insert, Literal, Update
from veldra.errors import AnalysisError
from veldra.functions.lowering import Lowering, Typed
from veldra.plans.scope import Scope, fields_of
from veldra.sources.catalog import RID, Catalog, Segment, Table
from veldra.types import Family, family_of

#: Segments of one size tier, each ``TIER_BITS`` doublings wide, that an insert merges.
MERGE_AT, TIER_BITS = 16, 4
#: Rows of a file that merged segments are written to.
FILE_ROWS = 1 << 20


def own(catalog: Catalog, name: str) -> Table:
    """A managed table to change; a registered one is copied first, and the copy takes its name."""
    table = catalog.table(name)
    return table if table.managed else copy(catalog, table, name)


def copy(catalog: Catalog, source: Table, name: str) -> Table:
    """Rows of ``source`` as a managed table."""
    order = F.col(f"c{RID}") if source.managed else F.monotonically_increasing_id()
    rows = catalog.scan(source).withColumn(RID, order).select(*[f"c{k}" for k in range(len(source.columns))], RID)
    made = Table(name, source.columns, source.version + 1)
    segment = catalog.written(made, rows)
    last = catalog.scan(replace(made, segments=(segment,))).agg(F.max(f"c{RID}")).first()[0]
    made = replace(made, segments=(segment,), rows=segment.rows, next_rid=0 if last is None else last + 1)
    catalog.publish(made)
    return made


def _fits(table: Table, k: int, value: Typed) -> None:
    """Same family, but for integers stored in FLOAT columns."""
    column = table.columns[k]
    want = family_of(column.kind)
    if value.family is not want and (value.family, want) != (Family.INTEGER, Family.FLOAT) or (want is Family.OTHER and value.kind != column.kind):
        raise AnalysisError(f"Type mismatch: Expected {want.value} for column {column.name}, got {value.family.value}")


def _constants(catalog: Catalog, expressions: list[Expression]) -> list[object]:
    """Values of expressions without columns: literals as they are, others by one job together."""
    lower = Lowering(None)
    computed = {k: lower(e).column.alias(f"x{k}") for k, e in enumerate(expressions) if not isinstance(e, Literal)}
    row = catalog.spark.range(1).select(*computed.values()).first() if computed else {}
    return [row[f"x{k}"] if k in computed else e.value for k, e in enumerate(expressions)]


def insert(catalog: Catalog, statement: Insert) -> int:
    """All rows or none: everything is checked and evaluated before anything is written."""
    table = catalog.table(statement.table)
    width = len(table.columns)
    for row in statement.rows:
        if len(row) != width:
            raise AnalysisError(f"Column count mismatch: expected {width}, got {len(row)}")
    lower = Lowering(None)
    for row in statement.rows:
        for k, e in enumerate(row):
            _fits(table, k, lower(e))
    values = _constants(catalog, [e for row in statement.rows for e in row])
    table = own(catalog, statement.table)
    floats = [family_of(c.kind) is Family.FLOAT for c in table.columns]
    rows = []
    for i in range(len(statement.rows)):
        own_values = values[i * width : (i + 1) * width]
        rows.append((*[float(v) if f and v is not None else v for v, f in zip(own_values, floats, strict=True)], table.next_rid + i))
    fresh: DataFrame = catalog.spark.createDataFrame(rows, catalog.stored(table.columns)).coalesce(1)
    merged = _to_merge(table.segments, len(rows))
    if merged:
        size = sum(s.rows for s in merged) + len(rows)
        fresh = catalog.scan(replace(table, segments=tuple(merged))).toDF(*fresh.columns).union(fresh).coalesce(1 + size // FILE_ROWS)
    segments = (*[s for s in table.segments if s not in merged], catalog.written(table, fresh))
    catalog.publish(replace(table, version=table.version + 1, segments=segments, rows=table.rows + len(rows), next_rid=table.next_rid + len(rows)))
    return len(rows)


def _to_merge(segments: tuple[Segment, ...], rows: int) -> list[Segment]:
    """What a new segment of so many rows is written together with: whenever MERGE_AT are of one size, they become one.

    So a row is written again as often as the table grows by a tier, and large segments are left alone.
    """
    tier = lambda n: max(n, 1).bit_length() // TIER_BITS
    out: list[Segment] = []
    while len(same := [s for s in segments if s not in out and tier(s.rows) <= tier(rows)]) + 1 >= MERGE_AT:
        out += same
        rows += sum(s.rows for s in same)
    return out


def _scope(table: Table) -> Scope:
    return Scope(fields_of(table.name, table.types, "c"))


@dataclass(frozen=True)
class Touched:
    """A file of a segment, and how many of its rows a predicate is true for."""

    folder: str
    file: str
    rows: int


def _touched(catalog: Catalog, table: Table, predicate: Column) -> list[Touched]:
    """Files with hits, and those only; the predicate is pushed down, so statistics skip most others."""
    if not table.segments:
        return []
    by_file = catalog.scan(table).where(predicate).groupBy(F.input_file_name().alias("path")).agg(F.count("*").alias("n"))
    return [Touched(*path.rsplit("/", 2)[-2:], n) for path, n in by_file.collect()]  # paths are split once a file, not in every row


def _replaced(catalog: Catalog, table: Table, touched: list[Touched], rows: Callable[[DataFrame], DataFrame]) -> Table:
    """The table with the rows of the touched files written anew as a segment; all other files stay."""
    files, folders = [t.file for t in touched], {t.folder for t in touched}
    made = catalog.written(table, rows(catalog.scan(table, only=files)))
    without, kept = {*table.without, *files}, []
    for s in table.segments:
        own = {p.rsplit("/", 1)[-1] for p in catalog.store.children(s.path) if p.endswith(".parquet")} if s.path.rsplit("/", 1)[-1] in folders else set()
        if own and own <= without:
            without -= own
        else:
            kept.append(s)
    if not made.rows:
        catalog.store.delete(made.path)
    return replace(table, version=table.version + 1, segments=(*kept, *([made] if made.rows else [])), without=tuple(sorted(without)))


def update(catalog: Catalog, statement: Update, null_mode: str = "three_valued") -> int:
    """Right-hand sides see the old row; of repeated targets the last counts. Files without a hit stay."""
    table = catalog.table(statement.table)
    lower = Lowering(_scope(table), null_mode)
    predicate = F.lit(True) if statement.where is None else lower.predicate(statement.where)
    hit = F.coalesce(predicate, F.lit(False))
    new: dict[int, Typed] = {}
    for target, e in statement.assignments:
        k = table.position(target)
        if k is None:
            raise AnalysisError(f"Unknown column: {target}")
        new[k] = lower(e)
        _fits(table, k, new[k])
    table = own(catalog, statement.table)
    touched = _touched(catalog, table, predicate)
    if touched:
        columns = [F.when(hit, new[k].column.cast(c.kind)).otherwise(F.col(f"c{k}")).alias(f"c{k}") if k in new else F.col(f"c{k}") for k, c in enumerate(table.columns)]
        catalog.publish(_replaced(catalog, table, touched, lambda rows: rows.select(*columns, f"c{RID}")))
    return sum(t.rows for t in touched)


def delete(catalog: Catalog, statement: Delete, null_mode: str = "three_valued") -> int:
    """Rows for which the predicate is true go; the others keep their order, and files without a hit stay."""
    table = catalog.table(statement.table)
    if statement.where is None:
        n = catalog.count(table)
        catalog.publish(replace(table, version=table.version + 1, segments=(), without=(), rows=0, path=None, frame=None, seen=None))
        return n
    predicate = Lowering(_scope(table), null_mode).predicate(statement.where)
    table = own(catalog, statement.table)
    touched = _touched(catalog, table, predicate)
    gone = sum(t.rows for t in touched)
    if touched:
        made = _replaced(catalog, table, touched, lambda rows: rows.where(~F.coalesce(predicate, F.lit(False))))
        catalog.publish(replace(made, rows=table.rows - gone))
    return gone

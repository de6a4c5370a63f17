"""The engine: SQL text in, results out."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

from veldra.dialect import nodes as N
from veldra.dialect import parse
from veldra.errors import AnalysisError, CatalogError, EngineError, ExecutionError
from veldra.operators import change, select
from veldra.plans import access
from veldra.sources.catalog import Catalog, Column, Index, Table
from veldra.sources.index import SortedIndex
from veldra.types import SPARK_TYPE, show_value


log = logging.getLogger("veldra")
#: Rows that ``lines`` and ``show`` print at most, unless told otherwise.
SHOWN = 1000


def _reason(e: PySparkException) -> str:
    return "Division by zero" if "Division by zero" in str(e) else str(e)


@dataclass
class Result:
    """Of one statement. ``frame`` is lazy; only ``collect``, ``lines`` and ``show`` run it."""

    success: bool
    message: str = ""
    column_names: list[str] = field(default_factory=list)
    frame: DataFrame | None = None
    query: select.Query | None = None

    def collect(self) -> list[Row]:
        """Rows in order: that of insertion, or of the index used. For results that fit the driver."""
        try:
            return [] if self.query is None else self.query.ordered().collect()
        except PySparkException as e:
            raise ExecutionError(_reason(e)) from e

    def lines(self, limit: int = SHOWN) -> Iterator[str]:
        """As the console prints it, up to ``limit`` rows; the driver gets one more at most."""
        if not self.success:
            yield f"Error: {self.message}"
            return
        if self.query is None:
            yield self.message
            return
        try:
            rows = self.query.ordered().limit(limit + 1).collect()
        except PySparkException as e:
            yield f"Error: {_reason(e)}"
            return
        yield from print_rows(self.column_names, rows[:limit])
        if len(rows) > limit:
            yield f"Only the first {limit} rows are shown."

    def show(self, limit: int = SHOWN) -> None:
        print("\n".join(self.lines(limit)))


def print_rows(names: list[str], rows: list[Row]) -> Iterator[str]:
    if not rows:
        yield "(0 rows)"
        return
    yield ""
    yield " | ".join(f"{n:>12}" for n in names)
    yield "-+-".join("-" * 12 for _ in names)
    for row in rows:
        yield " | ".join(f"{show_value(v):>12}" for v in row)
    yield f"({len(rows)} row{'' if len(rows) == 1 else 's'})"
    yield ""


class Engine:
    """Tables in one folder, and the statements on them.

    ``folder`` may be in any store that Spark reaches. Without one, a new folder in the session's
    warehouse serves, and goes when the driver ends unless the catalog is saved. ``autosave``
    publishes the catalog after every statement; otherwise ``save`` does.
    ``null_mode="two_valued"`` makes comparisons with null true or false.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, *, null_mode: str = "three_valued", autosave: bool = False):
        self.spark, self.null_mode = spark, null_mode
        self.catalog = Catalog(spark, folder or self._own_folder(spark), autosave)
        if folder is None:
            self.catalog.store.forget_at_exit(self.catalog.folder)

    @staticmethod
    def _own_folder(spark: SparkSession) -> str:
        """On a cluster the warehouse must have been chosen, for its default is a folder of one machine."""
        if spark.sparkContext.getConf().get("spark.sql.warehouse.dir", None) is None and not spark.sparkContext.master.startswith("local"):
            raise CatalogError("Name a folder that all machines share, or set spark.sql.warehouse.dir.")
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/veldra-{uuid.uuid4().hex}"

    # tables from elsewhere

    def register_parquet(self, name: str, path: str) -> None:
        """A Parquet path as a table; its columns keep their types, and it isn't changed in place."""
        self.catalog.create(Table(name, self._columns(self.spark.read.parquet(path).schema), rows=None, path=path))

    def register_frame(self, name: str, frame: DataFrame) -> None:
        """A DataFrame, also a streaming one, as a table of this session."""
        self.catalog.create(Table(name, self._columns(frame.schema), rows=None, frame=frame))

    def copy_table(self, name: str, source: str) -> None:
        """A managed copy of a table."""
        if name in self.catalog.tables:
            raise CatalogError(f"Table '{name}' already exists.")
        change.copy(self.catalog, self.catalog.table(source), name)

    @staticmethod
    def _columns(schema: T.StructType) -> tuple[Column, ...]:
        return tuple(Column(f.name, f.dataType, int(f.metadata.get("length", 0))) for f in schema.fields)

    # statements

    def sql(self, text: str) -> Result:
        """Runs the first statement of a text. What doesn't parse raises ParseError; other failures are results."""
        return self.execute(parse(text))

    def execute(self, statement: N.Statement) -> Result:
        log.debug("%s", statement)
        try:
            return self._run(statement)
        except EngineError as e:
            return Result(False, str(e))
        except PySparkException as e:
            return Result(False, _reason(e))

    def _run(self, s: N.Statement) -> Result:
        match s:
            case N.Select():
                made = select.build(self.catalog, s, self.null_mode)
                return Result(True, column_names=made.names, frame=made.frame, query=made)
            case N.CreateTable():
                self.catalog.create(Table(s.table, tuple(Column(c.name, SPARK_TYPE[c.family], c.length) for c in s.columns)))
                return Result(True, f"Table '{s.table}' created.")
            case N.DropTable():
                self.catalog.drop(s.table)
                return Result(True, f"Table '{s.table}' dropped.")
            case N.Insert():
                return Result(True, f"{change.insert(self.catalog, s)} row(s) inserted.")
            case N.Update():
                return Result(True, f"{change.update(self.catalog, s, self.null_mode)} row(s) updated.")
            case N.Delete():
                return Result(True, f"{change.delete(self.catalog, s, self.null_mode)} row(s) deleted.")
            case N.CreateIndex():
                self.catalog.create_index(Index(s.index, s.table, s.column))
                return Result(True, f"Index '{s.index}' created on {s.table}({s.column}).")
            case N.Explain():
                return Result(True, self.explain(s.select))
        raise TypeError(s)

    def explain(self, s: N.Select) -> str:
        """The plan by the planner's rules; names and types are checked as for running it."""
        scope = select.scope_of(self.catalog, s)
        for c in s.columns or ():
            scope.resolve(c)
        if s.where is not None:
            select.Lowering(scope, self.null_mode).predicate(s.where)
        return access.explain(self.catalog, s, scope, self.null_mode)

    def logical_plan(self, text: str) -> str:
        """Of a SELECT or EXPLAIN, as written: scans, join, filter and projection, before any choice of access path."""
        s = parse(text)
        s = s.select if isinstance(s, N.Explain) else s
        if not isinstance(s, N.Select):
            raise AnalysisError("Only SELECT has a logical plan")
        select.scope_of(self.catalog, s)
        return access.logical(s)

    def spark_plan(self, text: str, mode: str = "formatted") -> str:
        """What Spark will run for a SELECT, as its own EXPLAIN says."""
        frame = self.sql(text).frame
        return frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), mode)

    # catalog

    def index(self, name: str) -> SortedIndex:
        """Lookups and ranges by an index, as DataFrames."""
        return SortedIndex(self.catalog, name)

    def show_tables(self) -> DataFrame:
        """``name, row_count, columns``."""
        rows = [(t.name, self.catalog.count(t), ", ".join(c.name for c in t.columns)) for t in self.catalog.tables.values()]
        return self.spark.createDataFrame(rows, "name string, row_count long, columns string")

    def save(self) -> None:
        self.catalog.save()

    def load(self) -> int:
        return self.catalog.load()

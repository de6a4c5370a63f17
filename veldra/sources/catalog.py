"""The catalog: tables, their snapshots, and indexes.

A managed table is a list of Parquet folders (segments), with columns ``c0, c1, ..`` and the
hidden row number ``__rid`` of insertion order, and the names of those files in them that later
statements have replaced. Statements write new segments and then publish a new version of the
entry; a folder that is being read is never written, and a failed statement publishes nothing.
Registered tables are Parquet paths or DataFrames of others; a statement that changes one first
copies it, and a fingerprint of a path's files tells whether others have changed it.

A saved catalog is a numbered file. ``save`` adds the next number, and fails if another engine has
added it already, so that no engine overwrites what another one has saved.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldra.errors import CatalogError
from veldra.sources.files import Store

RID = "__rid"
#: Name of a saved catalog, with its number.
FILE = "catalog-{:010d}.json"
_FILE = re.compile(r"/catalog-(\d{10})\.json$")


@dataclass(frozen=True)
class Column:
    name: str
    kind: T.DataType
    length: int = 0  # of VARCHAR; kept, never enforced


@dataclass(frozen=True)
class Segment:
    """One folder. ``rows`` is the number it was written with."""

    path: str
    rows: int


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    version: int = 0
    segments: tuple[Segment, ...] = ()
    without: tuple[str, ...] = ()  # names of replaced files; they are unique
    rows: int | None = 0  # None: not counted yet
    next_rid: int = 0
    path: str | None = None  # of a registered Parquet table
    frame: DataFrame | None = field(default=None, compare=False)  # of a registered DataFrame
    seen: str | None = None  # fingerprint of the path's files when they were counted

    @property
    def managed(self) -> bool:
        return self.path is None and self.frame is None

    @property
    def types(self) -> list[tuple[str, T.DataType]]:
        return [(c.name, c.kind) for c in self.columns]

    def position(self, column: str) -> int | None:
        return next((k for k, c in enumerate(self.columns) if c.name == column), None)


@dataclass(frozen=True)
class Index:
    name: str
    table: str
    column: str
    version: int = -1  # of the table that the copy was made from
    path: str | None = None
    seen: str | None = None  # fingerprint of a registered path's files then


class Catalog:
    """In memory until saved, or with ``autosave`` published at every change."""

    def __init__(self, spark: SparkSession, folder: str, autosave: bool = False):
        self.spark, self.folder, self.autosave = spark, folder.rstrip("/"), autosave
        self.store = Store(spark)
        self.tables: dict[str, Table] = {}
        self.indexes: dict[str, Index] = {}
        self.saved = 0  # number of the saved catalog that this one continues

    # tables

    def table(self, name: str, what: str = "Table") -> Table:
        if name not in self.tables:
            raise CatalogError(f"{what} not found: {name}")
        return self.tables[name]

    def publish(self, table: Table) -> None:
        self.tables[table.name] = table
        self._changed()

    def create(self, table: Table) -> None:
        if table.name in self.tables:
            raise CatalogError(f"Table '{table.name}' already exists.")
        self.publish(table)

    def drop(self, name: str) -> None:
        """Its indexes go too, and their names are free again."""
        if name not in self.tables:
            raise CatalogError(f"Table '{name}' does not exist.")
        del self.tables[name]
        self.indexes = {k: x for k, x in self.indexes.items() if x.table != name}
        self._changed()

    def new_folder(self, table: str, what: str) -> str:
        return f"{self.folder}/{table}/{what}-{uuid.uuid4().hex}"

    def stored(self, columns: tuple[Column, ...]) -> T.StructType:
        return T.StructType([*(T.StructField(f"c{k}", c.kind) for k, c in enumerate(columns)), T.StructField(RID, T.LongType())])

    def scan(self, table: Table, prefix: str = "c", only: Sequence[str] | None = None) -> DataFrame:
        """Columns ``<prefix>0, ..`` and, of managed tables, ``<prefix>__rid``; of the files named ``only``, if given.

        Files are left out by name when Spark plans the scan, so they aren't opened.
        """
        if not table.managed:
            source = table.frame if table.frame is not None else self.spark.read.parquet(table.path)
            return source.toDF(*[f"{prefix}{k}" for k in range(len(table.columns))])
        schema = self.stored(table.columns)
        read = self.spark.read.schema(schema).parquet(*[s.path for s in table.segments]) if table.segments else self.spark.createDataFrame([], schema)
        if table.segments and table.without:
            read = read.where(~F.col("_metadata.file_name").isin(*table.without))
        if table.segments and only is not None:
            read = read.where(F.col("_metadata.file_name").isin(*only))
        return read.toDF(*[f"{prefix}{k}" for k in range(len(table.columns))], prefix + RID)

    def written(self, table: Table, rows: DataFrame) -> Segment:
        """A new segment of rows with the stored columns; they are counted from the files' footers."""
        path = self.new_folder(table.name, "v")
        rows.toDF(*self.stored(table.columns).names).write.parquet(path)
        return Segment(path, self.spark.read.schema(self.stored(table.columns)).parquet(path).count())

    def fingerprint(self, table: Table) -> str | None:
        """Of a registered path's files as they are now."""
        return None if table.path is None else self.store.fingerprint(table.path)

    def count(self, table: Table) -> int:
        """Rows. Those of a registered path are counted anew when its files have changed, those of a DataFrame each time."""
        if table.frame is not None:
            return table.frame.count()
        seen = self.fingerprint(table)
        if table.rows is None or seen != table.seen:
            table = replace(table, rows=self.scan(table).count(), seen=seen)
            if table.name in self.tables:
                self.tables[table.name] = table
        return table.rows

    # indexes

    def index_on(self, table: str, column: str) -> Index | None:
        """Of a registered DataFrame none: nothing tells when its rows change, so no copy could be trusted."""
        if self.table(table).frame is not None:
            return None
        return next((x for x in self.indexes.values() if x.table == table and x.column == column), None)

    def create_index(self, index: Index) -> None:
        table = self.tables.get(index.table)
        if index.name in self.indexes or table is None or table.position(index.column) is None:
            raise CatalogError(f"Failed to create index '{index.name}'. Table or column may not exist, or index name is already taken.")
        self.indexes[index.name] = index
        self._changed()

    def is_current(self, index: Index) -> bool:
        """Whether the copy has been made since the table last changed, or a registered path's files did."""
        table = self.table(index.table)
        return index.path is not None and index.version == table.version and index.seen == self.fingerprint(table)

    def index_copy(self, index: Index, prefix: str = "c") -> DataFrame:
        """The table without null keys, range-partitioned and sorted by the indexed column.

        Parquet's statistics of the sorted copy let a predicate on the key skip files and row
        groups. It is made at the first use after a change of the table; several names of one
        column share it. Row numbers are the second key of the ranges, so that the rows of one
        frequent key are dealt to several files.
        """
        table = self.table(index.table)
        names = [f"c{k}" for k in range(len(table.columns))]
        if not self.is_current(index):
            seen = self.fingerprint(table)
            key, path, rid = f"c{table.position(index.column)}", self.new_folder(table.name, "index"), f"c{RID}"
            rows = self.scan(table).where(F.col(key).isNotNull())
            rows = rows if table.managed else rows.withColumn(rid, F.monotonically_increasing_id())
            rows.repartitionByRange(key, rid).sortWithinPartitions(key, rid).write.parquet(path)
            for name, x in self.indexes.items():
                if (x.table, x.column) == (index.table, index.column):
                    self.indexes[name] = replace(x, version=table.version, path=path, seen=seen)
            index = self.indexes[index.name]
            self._changed()
        schema = T.StructType([*self.stored(table.columns).fields[:-1], T.StructField(f"c{RID}", T.LongType())])
        return self.spark.read.schema(schema).parquet(index.path).toDF(*[prefix + n[1:] for n in names], prefix + RID)

    # persistence

    def _changed(self) -> None:
        if self.autosave:
            self.save()

    def _stored_number(self) -> int:
        """Of the newest saved catalog; 0: none."""
        return max((int(m[1]) for m in map(_FILE.search, self.store.children(self.folder)) if m), default=0)

    def save(self) -> None:
        """Everything but registered DataFrames, whose definitions live in the session only."""
        tables = []
        for t in self.tables.values():
            if t.frame is None:
                columns = [{"name": c.name, "type": c.kind.jsonValue(), "length": c.length} for c in t.columns]
                own = {k: getattr(t, k) for k in ("name", "version", "without", "rows", "next_rid", "path", "seen")}
                tables.append(own | {"columns": columns, "segments": [asdict(s) for s in t.segments]})
        kept = {t["name"] for t in tables}
        indexes = [asdict(x) for x in self.indexes.values() if x.table in kept]
        text = json.dumps({"tables": tables, "indexes": indexes}, indent=1)
        path = lambda n: f"{self.folder}/{FILE.format(n)}"
        if self._stored_number() != self.saved or not self.store.create(path(self.saved + 1), text):
            raise CatalogError("Another engine has saved this catalog; load it and repeat the changes.")
        self.store.keep(self.folder)
        self.saved += 1
        if self.saved > 2:  # the last one stays for those who are reading it
            self.store.delete(path(self.saved - 2))

    def _read(self) -> tuple[int, dict[str, Table], dict[str, Index]]:
        """Number, tables and indexes of the newest saved catalog."""
        number = self._stored_number()
        if not number:
            return 0, {}, {}
        saved, tables = json.loads(self.store.read(f"{self.folder}/{FILE.format(number)}")), {}
        for t in saved["tables"]:
            kinds = T.StructType.fromJson({"type": "struct", "fields": [{"name": c["name"], "type": c["type"], "nullable": True, "metadata": {}} for c in t["columns"]]})
            columns = tuple(Column(c["name"], f.dataType, c["length"]) for c, f in zip(t["columns"], kinds.fields, strict=True))
            tables[t["name"]] = Table(**t | {"columns": columns, "segments": tuple(Segment(**s) for s in t["segments"]), "without": tuple(t["without"])})
        return number, tables, {x["name"]: Index(**x) for x in saved["indexes"]}

    def load(self) -> int:
        """Number of tables found; none if nothing was saved."""
        self.saved, tables, indexes = self._read()
        self.tables |= tables
        self.indexes |= indexes
        return len(tables)

    def vacuum(self) -> int:
        """Deletes the folders that neither this catalog nor the newest saved one refers to; results read earlier must not be in use."""
        _, tables, indexes = self._read()
        used = {s.path for t in (*self.tables.values(), *tables.values()) for s in t.segments} | {x.path for x in (*self.indexes.values(), *indexes.values())}
        keep = {"/".join(u.rstrip("/").rsplit("/", 2)[-2:]) for u in used if u}
        gone = 0
        for folder in self.store.children(self.folder):
            for path in self.store.children(folder) if not folder.endswith(".json") else ():
                if "/".join(path.rsplit("/", 2)[-2:]) not in keep:
                    self.store.delete(path)
                    gone += 1
        return gone

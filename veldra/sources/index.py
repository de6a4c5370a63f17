"""Direct use of an index: lookups, ranges and the whole key order of its sorted copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.errors import CatalogError
from veldra.sources.catalog import RID, Catalog


class SortedIndex:
    """Of one catalog entry. Rows with a null key aren't in it; equal keys keep the table's order."""

    def __init__(self, catalog: Catalog, name: str):
        if name not in catalog.indexes:
            raise CatalogError(f"Index not found: {name}")
        self.catalog, self.name = catalog, name

    def build(self) -> None:
        """Makes the copy if the table has changed since the last one."""
        self.catalog.index_copy(self.catalog.indexes[self.name])

    def _rows(self, wanted: Column | None) -> DataFrame:
        index = self.catalog.indexes[self.name]
        table = self.catalog.table(index.table)
        key = f"c{table.position(index.column)}"
        copy = self.catalog.index_copy(index)
        copy = copy if wanted is None else copy.where(wanted)
        order = [key, f"c{RID}"] if table.managed else [key]
        return copy.orderBy(*order).select(*[F.col(f"c{k}").alias(c.name) for k, c in enumerate(table.columns)])

    @property
    def _key(self) -> Column:
        index = self.catalog.indexes[self.name]
        return F.col(f"c{self.catalog.table(index.table).position(index.column)}")

    def search(self, value: object) -> DataFrame:
        """Rows of one key."""
        return self._rows(self._key == F.lit(value))

    def range(self, low: object = None, high: object = None, *, low_inclusive: bool = True, high_inclusive: bool = True) -> DataFrame:
        """Rows between the bounds in key order; None is no bound."""
        wanted = F.lit(True)
        if low is not None:
            wanted &= self._key >= F.lit(low) if low_inclusive else self._key > F.lit(low)
        if high is not None:
            wanted &= self._key <= F.lit(high) if high_inclusive else self._key < F.lit(high)
        return self._rows(wanted)

    def entries(self) -> DataFrame:
        """All rows in key order."""
        return self._rows(None)

    def is_empty(self) -> bool:
        return self.entries().isEmpty()

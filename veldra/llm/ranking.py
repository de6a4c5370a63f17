"""Global positions of sorted rows, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldra.llm.common import checkpoint, released


def positioned(df: DataFrame, *order: str, sums: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``position`` (long, from 0) in the order of the columns ``order``.

    For each of ``sums``, long columns without nulls, ``before_<name>`` is its sum over the rows
    before. The rows are range-partitioned and sorted; each partition numbers its own, and the
    partitions' totals (a row for each, to the driver) shift them. Equal keys may be split over
    partitions, so ``order`` must end with something unique for the same positions each time.
    """
    import pyarrow as pa

    schema = df.select("*").schema.add("part__", "integer").add("position", "long")
    for name in sums:
        schema = schema.add(f"before_{name}", "long")
    names = [f.name for f in schema.fields]

    def run(batches):
        import numpy as np
        from pyspark import TaskContext

        part, n, totals = TaskContext.get().partitionId(), 0, dict.fromkeys(sums, 0)
        for b in batches:
            columns = list(b.columns)
            columns.append(pa.array(np.full(b.num_rows, part, np.int32)))
            columns.append(pa.array(np.arange(n, n + b.num_rows, dtype=np.int64)))
            n += b.num_rows
            for name in sums:
                own = b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64)
                columns.append(pa.array(totals[name] + np.cumsum(own) - own))
                totals[name] += int(own.sum())
            yield pa.RecordBatch.from_arrays(columns, names)

    local = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(released(run), schema))
    ends = local.groupBy("part__").agg(F.count("*").alias("n"), *[F.sum(x).alias(x) for x in sums]).orderBy("part__").collect()
    shifts, at = [], [0] * (1 + len(sums))
    for row in ends:
        shifts.append((row["part__"], *at))
        at = [a + row[x] for a, x in zip(at, ("n", *sums), strict=True)]
    spark = df.sparkSession
    table = spark.createDataFrame(shifts, "part__ int, s0__ long" + "".join(f", s{k}__ long" for k in range(1, len(sums) + 1)))
    moved = local.join(F.broadcast(table), "part__")
    return moved.select(*df.columns, (F.col("position") + F.col("s0__")).alias("position"), *[(F.col(f"before_{x}") + F.col(f"s{k}__")).alias(f"before_{x}") for k, x in enumerate(sums, 1)])

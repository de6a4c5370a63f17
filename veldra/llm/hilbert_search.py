"""Approximate nearest neighbours by inner product along shifted space-filling curves.

For each curve the vectors are projected by a seeded random rotation onto a few axes, shifted by
a seeded offset, cut into a grid, and ordered by the cell's Hilbert index. Spark range-partitions
and sorts the keys; a row's position gives its window of consecutive keys. A query goes to its own
window and those around, on each curve; in each it is scored against the window's rows, and the
best of all windows and curves are merged and reranked exactly in double precision.

How far a query must look depends on the data: in clusters its neighbours stand close by on some
curve, without clusters they lie spread over a share of any. So the reach is measured: ``PROBES``
of the queries (those of the least hashes) are searched by brute force, in blocks, against all rows, and
the least of ``REACHES`` by which the curves hold ``RECALL`` of their true neighbours is taken (the
largest, if none does). It is a share of all rows on either side. Windows hold as many rows as the
reach, between ``LEAST_WINDOW`` and ``WINDOW_ROWS``; a task holds one window's rows and
``ASKERS`` queries at a time.

Equal vectors have equal scores, and ties go to smaller ids, so of equal vectors only the k + 1
least ids can be in any result: each distinct vector is indexed once, with these ids. Rows with
the query's own vector are found by that vector too.

Defined results: rows whose vec_id is null, or whose vector is null, empty, zero or holds a null
or non-finite component, take no part; shorter vectors count as ended by zeros; a row is no
candidate of its own, but repeated rows are of each other; rows of one vec_id with different vectors
are rows of their own; an empty table gives no rows; only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldra.llm.common import checkpoint, released
from veldra.llm.impact_search import usable
from veldra.llm.ranking import positioned

TOP = 20
CURVES = 8
AXES = 12
BITS = 6
#: Bits that order the rows of a cell, so that groups of nearly equal vectors are ordered by each curve too.
FINE = 18
#: Shares of all rows to look at on either side, of which the data decide.
REACHES = (0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.16)
#: Share of the probes' true neighbours that the reach must hold; above the 0.9 asked for, since probes are a sample; windows reach farther than they must.
RECALL, PROBES = 0.93, 200
LEAST_WINDOW, WINDOW_ROWS = 256, 4096
ASKERS = 512
SEED = 20


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of ``cells`` (unsigned, below 2**bits), as big-endian bytes.

    Skilling's transform, on all rows at once: undo the excess work of the inverse, then Gray
    code; the transposed bits are interleaved from the highest.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    planes = [(x[i] >> b) & 1 for b in range(bits - 1, -1, -1) for i in range(n)]
    return np.packbits(np.stack(planes, axis=1).astype(np.uint8), axis=1)


def projection(dims: int, curve: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal axes (dims x AXES) and the shift of a curve's grid, in cells."""
    rng = np.random.default_rng([seed, curve, dims])
    q, _ = np.linalg.qr(rng.standard_normal((dims, min(AXES, dims))))
    return q, rng.random(q.shape[1])


def keys(v: np.ndarray, curve: int, seed: int, bits: int = BITS, fine: int = FINE) -> list[bytes]:
    """Of unit vectors' projections: a cell is as wide as the spread over 2**bits, whatever the rows, and is cut 2**fine times itself."""
    axes, shift = projection(v.shape[1], curve, seed)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    spread = 6 / np.sqrt(max(v.shape[1], 36))
    cells = np.floor((((unit @ axes) / (2 * spread) + 0.5) * ((1 << bits) - 1) + shift) * (1 << fine))
    return [x.tobytes() for x in hilbert(np.clip(cells, 0, (1 << bits + fine) - 1), bits + fine)]


def _measured_reach(askers: DataFrame, distinct: DataFrame, placed: DataFrame, matrix, n: int, k: int) -> float:
    """The least of REACHES that holds RECALL of the true neighbours of PROBES of the askers.

    To the driver come the probes, and for each of them and its neighbours a place on each curve.
    """
    import pyarrow as pa

    probes = askers.orderBy(F.xxhash64("data"), "first").limit(PROBES).select("first", "data").collect()
    if not probes or n <= k + 1:
        return REACHES[0]
    asked, q = np.array([r["first"] for r in probes], np.int64), matrix([r["data"] for r in probes])

    def best(batches):
        for b in batches:
            ids, data = b.column(0).to_numpy(), b.column(1).to_pylist()
            for begin in range(0, len(ids), 4096):
                scores, here = q @ matrix(data[begin : begin + 4096]).T, ids[begin : begin + 4096]
                top = np.argpartition(-scores, min(k, scores.shape[1] - 1), axis=1)[:, : k + 1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, top.shape[1])), pa.array(here[top].ravel()), pa.array(np.take_along_axis(scores, top, axis=1).ravel())], ["probe", "near", "score"])

    found = distinct.select("first", "data").mapInArrow(released(best), "probe long, near long, score double").where("probe <> near")
    order = Window.partitionBy("probe").orderBy(F.desc("score"), "near")
    true = checkpoint(found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("probe", "near"))
    known = true.select(F.col("near").alias("first")).union(true.select("probe")).distinct()
    places: dict[int, dict[int, int]] = {}
    for r in placed.join(F.broadcast(known), "first", "left_semi").select("curve", "first", "place").collect():
        places.setdefault(r["first"], {})[r["curve"]] = r["place"]
    apart = np.array([min(abs(places[r["probe"]][c] - x) for c, x in places[r["near"]].items()) for r in true.collect()])
    return next((x for x in REACHES if np.mean(apart <= x * n) >= RECALL), REACHES[-1])


def nearest(vectors: DataFrame, divisor: int, k: int = TOP, curves: int = CURVES, reach: float | None = None, seed: int = SEED) -> DataFrame:
    """``query_id, rank, vec_id, score``; queries are the rows whose id the divisor divides. Without ``reach`` it is measured."""
    import pyarrow as pa

    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")) & F.exists("v", lambda x: x != 0))

    def packed(batches):
        for b in batches:
            data = [np.trim_zeros(np.array(x) + 0.0, "b").tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["vec_id", "data"])

    rows = checkpoint(rows.mapInArrow(released(packed), "vec_id long, data binary"))
    # of equal vectors the k + 1 least ids; Spark applies the limit within each task before the shuffle too
    least = rows.withColumn("r", F.row_number().over(Window.partitionBy("data").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    distinct = checkpoint(least.groupBy("data").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select("data", "ids", F.monotonically_increasing_id().alias("first")))
    size = distinct.agg(F.count("*").alias("n"), F.max(F.octet_length("data")).alias("most")).first()
    n, dims = size["n"], (size["most"] or 8) // 8

    def matrix(data):
        out = np.zeros((len(data), dims))
        for i, x in enumerate(data):
            out[i, : len(x) // 8] = np.frombuffer(x)
        return out

    def keyed(batches):
        for b in batches:
            if not b.num_rows:
                continue
            m = matrix(b.column(0).to_pylist())
            for c in range(curves):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), c, np.int32)), pa.array(keys(m, c, seed), pa.binary()), b.column(1), b.column(0)], ["curve", "key", "first", "data"])

    curved = distinct.select("data", "first").mapInArrow(released(keyed), "curve int, key binary, first long, data binary")
    placed = positioned(curved, "curve", "key", "first").withColumn("place", F.col("position") - F.col("curve") * n)
    placed = checkpoint(placed.select("curve", "first", "data", "place"))
    queries = checkpoint(rows.where(F.col("vec_id") % divisor == 0).join(distinct.select("data", "first"), "data").select(F.col("vec_id").alias("query_id"), "first"))
    if reach is None:
        reach = _measured_reach(distinct.join(queries.select("first").distinct(), "first", "left_semi"), distinct, placed, matrix, n, k)
    wide = min(max(int(reach * n), LEAST_WINDOW), WINDOW_ROWS)
    around = max(1, round(reach * n / wide))
    window = F.floor(F.col("place") / wide).cast("int")
    last = max(0, (n - 1) // wide)
    visits = F.explode(F.sequence(F.greatest(window - around, F.lit(0)), F.least(window + around, F.lit(last))))
    # rows of one vector ask the same: the vector asks once, and they share the answer
    asking = placed.join(queries.select("first").distinct(), "first", "left_semi").select("curve", visits.alias("window"), F.lit(True).alias("asks"), "first", "data")
    members = placed.select("curve", window.alias("window"), F.lit(False).alias("asks"), "first", "data")

    def score(batches):
        at, ids, m, mine, theirs = None, None, None, [], []

        def answers():
            q, out = matrix([r[1] for r in theirs]), []
            rough = q @ m.T
            for i, (asker, _) in enumerate(theirs):
                near = np.arange(len(m)) if len(m) <= k + 1 else np.flatnonzero(rough[i] >= np.partition(rough[i], -k - 1)[-k - 1] - 1e-9 * np.abs(rough[i]).max())
                exact = (m[near] * q[i]).sum(axis=1)
                best = np.lexsort((ids[near], -exact))[: k + 1]
                out.append((np.full(len(best), asker), ids[near[best]], exact[best]))
            theirs.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["query", "candidate", "score"])

        # a window's rows come first, then its queries, ASKERS at a time
        for b in batches:
            for curve, place, asks, first, data in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if at != (curve, place):
                    if theirs:
                        yield answers()
                    at, m, mine = (curve, place), None, []
                if not asks:
                    mine.append((first, data))
                    continue
                if m is None:
                    m, ids, mine = matrix([x for _, x in mine]), np.array([x for x, _ in mine], np.int64), []
                if len(m):
                    theirs.append((first, data))
                if len(theirs) == ASKERS:
                    yield answers()
        if theirs:
            yield answers()

    met = members.union(asking).repartition("curve", "window").sortWithinPartitions("curve", "window", "asks").mapInArrow(released(score), "query long, candidate long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "candidate")
    merged = met.groupBy("query", "candidate").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    named = merged.join(distinct.select(F.col("first").alias("candidate"), "ids"), "candidate").select("query", "candidate", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    named = named.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    answer = F.array_sort(F.collect_list(F.struct("r", "vec_id", "score", (F.col("query") == F.col("candidate")).alias("own"))))
    shared = named.groupBy("query").agg(answer.alias("found"))
    each = queries.join(shared, F.col("first") == F.col("query"))
    at = F.array_position(F.transform("found", lambda x: x["own"] & (x["vec_id"] == F.col("query_id"))), True)
    others = F.slice(F.when(at > 0, F.filter("found", lambda x, i: i + 1 != at)).otherwise(F.col("found")), 1, k)
    flat = each.select("query_id", F.posexplode(others).alias("p", "x"))
    return flat.select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))

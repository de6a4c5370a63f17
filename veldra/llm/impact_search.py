"""Exact top-k search by inner product over an impact-ordered, score-at-a-time index.

Vectors are turned into integers, floor(scale * x). They are dealt into blocks; in each, every
dimension's postings (rows) are grouped into segments of equal quantised value. For a query, a
segment's impact is the most that its value adds to a score, above the least that the dimension
can add. Segments are processed by descending impact, adding impacts and hits to the rows'
accumulators. After any prefix, a row's score is at most

    accumulated impact + (dimensions - hits) * next impact,

and at least ``accumulated impact - accumulated width``, both above the sum of what the dimensions
add at least; a segment's width is its spread of values times the query's weight. A block's search
stops when this proves that all but a few rows are below the k-th best lower bound; those few are
rescored exactly, so the result is exact. Without such proof all segments are processed, and the
bounds still prune.

Defined results: a row whose vec_id is null, or whose vector is null or holds a null or
non-finite component, takes no part; shorter vectors count as ended by zeros; an empty vector has
score 0 with every other; a row is no candidate of its own, but repeated rows are of each other;
ties go to smaller ids; an empty table gives no rows. Bounds and scores are exact while a sum of products
stays below 2**53 (components up to about a million, of 64 dimensions); components whose integers
could give more are an error, never a wrong score. Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldra.llm.common import checkpoint, released

SCALE = 1024
TOP = 10
#: Rows of an index block, and queries of a query block.
BLOCK_ROWS = 8192
BLOCK_QUERIES = 1024
#: Quantised values of a dimension in a block, at most: half of equal numbers of rows, half of equal ranges.
LEVELS = 48
#: Integers below it, and sums of them, are exact as doubles too.
EXACT = 2**53
#: Prefixes of the postings after which the bounds are tested.
TESTS = (0.25, 0.5, 0.75, 1.0)
#: Candidates that may be left to rescore when the search stops.
RESCORE = 64


class Block:
    """Index of up to BLOCK_ROWS integer vectors (rows of ``v``)."""

    def __init__(self, v: np.ndarray):
        self.v = v
        self.most = int(np.abs(v).max()) if v.size else 0
        n, d = v.shape
        lows, highs, dims, starts, order = [], [], [], [], []
        at = 0
        for j in range(d):
            by_value = np.argsort(v[:, j], kind="stable")
            values = v[by_value, j]
            depth = np.linspace(0, n, LEVELS // 2 + 1).astype(int)
            height = np.searchsorted(values, np.linspace(values[0], values[-1], LEVELS // 2 + 1)) if n else depth
            edges = np.unique(np.concatenate([depth, height]))
            for a, b in zip(edges, edges[1:], strict=False):
                rows = by_value[a:b]
                lows.append(v[rows[0], j])
                highs.append(v[rows[-1], j])
                dims.append(j)
                starts.append(at)
                order.append(rows)
                at += len(rows)
        self.low, self.high, self.dim = np.array(lows, np.int64), np.array(highs, np.int64), np.array(dims, np.int64)
        self.start = np.array([*starts, at], np.int64)
        self.postings = np.concatenate(order).astype(np.int32) if order else np.zeros(0, np.int32)
        self.first_of_dim = np.searchsorted(self.dim, np.arange(d))

    def search(self, q: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may be among the k best and their exact scores; ``skip`` is left out (-1: none)."""
        n, d = self.v.shape
        if d * self.most * int(np.abs(q).max(initial=0)) >= EXACT:
            raise OverflowError("components are too large for exact scores")
        if not d:
            rows = np.arange(n)
            return rows[rows != skip], np.zeros(n - (0 <= skip < n), np.int64)
        weight = q[self.dim]
        a, b = weight * self.low, weight * self.high
        most, least = np.maximum(a, b), np.minimum(a, b)
        floor = np.minimum.reduceat(least, self.first_of_dim)
        impact, width = most - floor[self.dim], most - least
        by_impact = np.argsort(-impact, kind="stable")
        sizes = np.diff(self.start)[by_impact]
        done_at = np.cumsum(sizes)
        upper, hits, slack = np.zeros(n), np.zeros(n, np.int64), np.zeros(n)
        rows, begin = np.arange(n), 0
        for share in TESTS:
            end = int(np.searchsorted(done_at, share * done_at[-1], "left")) + 1 if share < 1 else len(by_impact)
            if end > begin:
                segs = by_impact[begin:end]
                counts = sizes[begin:end]
                ends = np.cumsum(counts)
                picked = self.postings[np.arange(ends[-1]) + np.repeat(self.start[segs] - ends + counts, counts)]
                upper += np.bincount(picked, np.repeat(impact[segs], counts), n)
                slack += np.bincount(picked, np.repeat(width[segs], counts), n)
                hits += np.bincount(picked, minlength=n)
                begin = end
            ahead = int(impact[by_impact[begin]]) if begin < len(by_impact) else 0
            lower = upper - slack
            if 0 <= skip < n:
                lower[skip] = -np.inf
            if n <= k:
                break
            kth = np.partition(lower, n - k)[n - k]
            rows = np.flatnonzero(upper + (d - hits) * ahead >= kth)
            if len(rows) <= max(RESCORE, 2 * k):
                break
        rows = rows[rows != skip]
        return rows, self.v[rows] @ q


def usable(vector: Column) -> Column:
    """Neither null nor with a null, NaN or infinite component."""
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))


def _packed(vectors: DataFrame, scale: int) -> DataFrame:
    """``block, rows, dims, ids, data``: blocks of whole partitions' rows, as bytes."""
    import pyarrow as pa

    def run(batches):
        from pyspark import TaskContext

        part, k, ids, data = TaskContext.get().partitionId(), 0, [], []

        def block():
            width = max(len(x) for x in data)
            v = np.zeros((len(data), width), np.int64)
            for i, x in enumerate(data):
                v[i, : len(x)] = x
            one = [pa.array([x], t) for x, t in ((part * 2**31 + k, pa.int64()), (len(data), pa.int32()), (width, pa.int32()), (np.array(ids, "<i8").tobytes(), pa.binary()), (v.tobytes(), pa.binary()))]
            return pa.RecordBatch.from_arrays(one, ["block", "rows", "dims", "ids", "data"])

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                whole = np.floor(scale * np.array(x, np.float64))
                if np.abs(whole).max(initial=0) >= EXACT:
                    raise OverflowError("a component is too large for exact scores")
                data.append(whole.astype(np.int64))
                if len(ids) == BLOCK_ROWS:
                    yield block()
                    k, ids, data = k + 1, [], []
        if ids:
            yield block()

    vector = F.col("embedding").cast("array<double>")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v"))).mapInArrow(released(run), "block long, rows int, dims int, ids binary, data binary")


def _queries(blocks: DataFrame, divisor: int) -> DataFrame:
    """``id, home, row, vector``: the rows whose id the divisor divides, with their places in the index."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for name, n, d, ids, data in zip(*[c.to_pylist() for c in b.columns], strict=True):
                ids, v = np.frombuffer(ids, "<i8"), np.frombuffer(data, np.int64).reshape(n, d)
                at = np.flatnonzero(ids % divisor == 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(np.full(len(at), name)), pa.array(at), pa.array([v[i].tobytes() for i in at], pa.binary())], ["id", "home", "row", "vector"])

    return blocks.mapInArrow(released(run), "id long, home long, row long, vector binary")


def top_k(vectors: DataFrame, divisor: int, k: int = TOP, scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best for each query, ties to smaller ids.

    Queries are the rows whose id the divisor divides. They are dealt into blocks too, and every
    block of queries meets every block of the index under a key of its own, so that each meeting
    is a task of bounded size; bytes of blocks move, no pairs of rows. It gives k rows a query.
    They meet by a shuffle at any size: Spark sees how large the queries are, not that each is
    repeated for every block of the index, and would broadcast all of that from the driver.
    """
    import pyarrow as pa

    blocks = checkpoint(_packed(vectors, scale))
    queries = checkpoint(_queries(blocks, divisor))
    groups = max(1, blocks.count())
    qblocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    qblock = F.pmod(F.xxhash64("id", "home", "row"), F.lit(qblocks)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    asked = queries.groupBy(qblock.alias("qblock")).agg(F.collect_list(F.struct("id", "home", "row", "vector")).alias("q")).select("qblock", "q", each.alias("g"))
    index = blocks.select("*", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1))).alias("qblock"))
    pairs = index.join(asked.hint("merge"), ["g", "qblock"]).select("block", "rows", "dims", "ids", "data", "q.id", "q.home", "q.row", "q.vector")

    def run(batches):
        index, built = None, None
        for b in batches:
            for name, n, d, ids, data, qids, home, row, q in zip(*[c.to_pylist() for c in b.columns], strict=True):
                ids = np.frombuffer(ids, "<i8")
                q = [np.frombuffer(x, np.int64) for x in q]
                width = max(d, *map(len, q))
                if built != (name, width):
                    v = np.zeros((n, width), np.int64)
                    v[:, :d] = np.frombuffer(data, np.int64).reshape(n, d)
                    index, built = Block(v), (name, width)
                out = []
                for qid, h, r, x in zip(qids, home, row, q, strict=True):
                    rows, scores = index.search(np.pad(x, (0, width - len(x))), k, r if h == name else -1)
                    best = np.lexsort((ids[rows], -scores))[:k]
                    out.append(np.stack([np.full(len(best), qid), np.full(len(best), h), np.full(len(best), r), ids[rows[best]], scores[best]]))
                made = np.concatenate(out, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in made], ["query_id", "home", "row", "vec_id", "score"])

    found = pairs.mapInArrow(released(run), "query_id long, home long, row long, vec_id long, score long")
    order = Window.partitionBy("home", "row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""op1 and op2 against brute force."""

import numpy as np
import pytest

from veldra.llm import hilbert_search, impact_search

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "s", 1) for i, v in rows], SCHEMA)


def vectors(n, dims, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dims)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[:copies] = v[0]
    return v


def exact(ids, ints, divisor, k):
    out = []
    for i in np.flatnonzero(ids % divisor == 0):
        scores = ints @ ints[i]
        rest = np.flatnonzero(np.arange(len(ids)) != i)
        best = rest[np.lexsort((ids[rest], -scores[rest]))[:k]]
        out += [(int(ids[i]), r, int(ids[j]), int(scores[j])) for r, j in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize(("n", "dims", "copies"), [(700, 16, 0), (400, 5, 150), (7, 3, 0), (1, 4, 0)])
def test_exact_top_k(spark, n, dims, copies):
    v, ids = vectors(n, dims, n, copies), np.random.default_rng(1).permutation(n)
    got = impact_search.top_k(frame(spark, list(zip(ids.tolist(), v.tolist(), strict=True))), 10).collect()
    assert sorted(tuple(r) for r in got) == exact(ids, np.floor(1024 * v.astype(np.float64)).astype(np.int64), 10, 10)


def test_blocks_of_rows_and_queries(spark, monkeypatch):
    monkeypatch.setattr(impact_search, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(impact_search, "BLOCK_ROWS", 50)
    v, ids = vectors(300, 8, 5), np.arange(300)
    got = impact_search.top_k(frame(spark, list(zip(ids.tolist(), v.tolist(), strict=True))), 3).collect()
    assert sorted(tuple(r) for r in got) == exact(ids, np.floor(1024 * v.astype(np.float64)).astype(np.int64), 3, 10)


def test_queries_are_never_broadcast(spark):
    """They are repeated for every block of the index, which the driver would have to hold."""
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.normal(size=4)]) for k in range(300)]
    found = impact_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), divisor=100)
    assert found.count() == 30
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan.split("== Initial Plan ==")[0]


def test_the_search_stops_on_proof():
    rng = np.random.default_rng(2)
    v = rng.integers(-40, 40, (4000, 24))
    v[:15] = rng.integers(300, 400, (15, 24))
    rows, scores = impact_search.Block(v).search(v[0], 10, 0)
    assert len(rows) <= impact_search.RESCORE
    wanted = np.sort(v[1:] @ v[0])[::-1][:10]
    assert sorted(scores)[::-1][:10] == wanted.tolist()


EDGES = [(0, [1.0, 0.0]), (None, [1.0, 0.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.5]), (6, [0.5, 0.5, 0.5]), (7, []), (8, [0.0, 0.0]), (0, [1.0, 0.0])]


def test_exact_edges(spark):
    got = sorted(tuple(r) for r in impact_search.top_k(frame(spark, EDGES), 100).collect())
    one = [(0, 1, 0, 1024 * 1024), (0, 2, 5, 512 * 1024), (0, 3, 6, 512 * 1024), (0, 4, 7, 0), (0, 5, 8, 0)]
    assert got == sorted(one * 2)  # the repeated row asks too, and is found
    assert impact_search.top_k(frame(spark, []), 100).collect() == []
    assert impact_search.top_k(frame(spark, [(3, [1.0])]), 100).collect() == []


def test_hilbert_curve_is_a_walk():
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    keys = [bytes(k) for k in hilbert_search.hilbert(cells, 3)]
    assert len(set(keys)) == 512
    path = cells[np.argsort(np.array([int.from_bytes(k, "big") for k in keys]))]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_components_too_large_for_exact_scores(spark):
    for rows in ([(0, [1e17, 1.0]), (1, [-1.0, 1.0])], [(0, [3e5] * 64), (1, [3e5] * 64)]):
        with pytest.raises(Exception, match="too large"):
            impact_search.top_k(frame(spark, rows), 100).collect()
    assert [tuple(r) for r in impact_search.top_k(frame(spark, [(0, [2000.0]), (1, [-2000.0])]), 100).collect()] == [(0, 1, 1, -(2000 * 1024) ** 2)]


def recall(v, found, ids):
    hits, w = 0, v.astype(np.float32).astype(np.float64)
    for q, near in found.items():
        rest, scores = ids[ids != q], w @ w[q]
        hits += len(set(near) & set(rest[np.lexsort((rest, -scores[rest]))[:20]].tolist()))
    return hits / (20 * len(found))


@pytest.mark.parametrize("clusters", [0, 60])
def test_reach_follows_the_data(spark, clusters, monkeypatch):
    """With production parameters, over many windows: clusters need a small part of the rows, data without them a larger one."""
    seen, measured = [], hilbert_search._measured_reach
    monkeypatch.setattr(hilbert_search, "_measured_reach", lambda *a: seen.append(measured(*a)) or seen[-1])
    n, ids = 20_000, np.arange(20_000)
    v = vectors(n, 64, 8).astype(np.float64)
    if clusters:
        v = vectors(clusters, 64, 9)[ids % clusters] + 0.25 * v
    got = hilbert_search.nearest(frame(spark, list(zip(ids.tolist(), v.tolist(), strict=True))), 100).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert len(found) == 200 and recall(v, found, ids) >= 0.9
    rows_read = hilbert_search.CURVES * 3 * max(seen[0], hilbert_search.LEAST_WINDOW / n)
    print("reach", seen, "rows scored a query, of all:", rows_read, "recall", recall(v, found, ids))
    assert (rows_read < 0.5) == bool(clusters)


def test_one_id_with_two_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.9, 0.0]), (2, [0.0, 0.8])]
    got = sorted(tuple(r) for r in hilbert_search.nearest(frame(spark, rows), 20).collect())
    one, two = float(np.float32(0.9)), float(np.float32(0.8))
    assert [x[2:] for x in got if x[1] == 1] == [(2, two), (1, one)] or [x[2:] for x in got if x[1] == 1] == [(1, one), (2, two)]


def test_neighbours_recall(spark, monkeypatch):
    monkeypatch.setattr(hilbert_search, "WINDOW_ROWS", 256)
    v, ids = vectors(6000, 64, 3, copies=40).astype(np.float64), np.arange(6000)
    rows = frame(spark, list(zip(ids.tolist(), v.tolist(), strict=True)))
    got = hilbert_search.nearest(rows, 20).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append(r)
    assert len(found) == 300 and all(len(x) == 20 for x in found.values())
    hits, w = 0, v.astype(np.float32).astype(np.float64)
    for q, rs in found.items():
        rs.sort(key=lambda r: r["rank"])
        scores = w @ w[q]
        assert [r["rank"] for r in rs] == list(range(1, 21)) and all(abs(scores[r["vec_id"]] - r["score"]) < 1e-12 for r in rs)
        assert [(-r["score"], r["vec_id"]) for r in rs] == sorted((-r["score"], r["vec_id"]) for r in rs)
        rest = ids[ids != q]
        hits += len({r["vec_id"] for r in rs} & set(rest[np.lexsort((rest, -scores[rest]))[:20]].tolist()))
    assert hits / 6000 >= 0.9
    assert [r["vec_id"] for r in sorted(found[20], key=lambda r: r["rank"])] == [*range(20)]  # copies: least ids first


def test_recall_in_a_group_of_nearly_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(hilbert_search, "WINDOW_ROWS", 64)
    rng = np.random.default_rng(11)
    v, ids = vectors(6000, 64, 5).astype(np.float64), np.arange(6000)
    v[::3] = v[0] + 1e-4 * rng.standard_normal((2000, 64))
    v = v.astype(np.float32)
    got = hilbert_search.nearest(frame(spark, list(zip(ids.tolist(), v.tolist(), strict=True))), 60).collect()
    found, w, hits = {}, v.astype(np.float64), 0
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert len(found) == 100 and all(q % 3 == 0 for q in found)
    for q, near in found.items():
        rest, scores = ids[ids != q], w @ w[q]
        hits += len(near & set(rest[np.lexsort((rest, -scores[rest]))[:20]].tolist()))
    assert hits / 2000 >= 0.9


def test_neighbour_edges(spark):
    got = sorted(tuple(r) for r in hilbert_search.nearest(frame(spark, EDGES), 20).collect())
    one = [(0, 1, 0, 1.0), (0, 2, 5, 0.5), (0, 3, 6, 0.5)]
    assert got == sorted(one * 2)
    assert hilbert_search.nearest(frame(spark, []), 20).collect() == []
    assert hilbert_search.nearest(frame(spark, [(0, [1.0])]), 20).collect() == []

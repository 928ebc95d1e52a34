import numpy as np
from cases import told

from filigree.llm.graph_ann import DEGREE, beam_search, build_graph, equal_norms, nearest, robust_prune

FIELDS = "vec_id long, embedding array<float>, rank string, shard string"


def brute(rows, k, every):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    out = []
    for q in np.flatnonzero(ids % every == 0):
        score = (x * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -score)) if i != q][:k]
        out += [(int(ids[q]), r, int(ids[i]), float(score[i])) for r, i in enumerate(order, 1)]
    return out


def test_recall_on_vectors_of_any_norm(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16))
    x = centres[rng.integers(0, 8, 3000)] + rng.normal(size=(3000, 16)) * 0.7
    x *= rng.uniform(0.3, 2, (3000, 1))
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    table = spark.createDataFrame([(i, v, "x", "x") for i, v in rows], FIELDS)
    got, expected = told(nearest(table, 10, 50)), brute(rows, 10, 50)
    hit = {(q, v) for q, _, v, _ in got} & {(q, v) for q, _, v, _ in expected}
    assert len(got) == len(expected) and len(hit) >= 0.9 * len(expected)
    scores = {(q, v): s for q, _, v, s in got}
    assert all(np.isclose(scores[q, v], s, rtol=1e-12) for q, _, v, s in expected if (q, v) in scores)


def test_copies_tie_to_the_smaller_id(spark):
    rows = [(i, [1.0, 0.0]) for i in range(100)] + [(100 + i, [0.5, float(i)]) for i in range(3)]
    table = spark.createDataFrame([(i, v, "", "") for i, v in rows], FIELDS)
    assert told(nearest(table, 20, 20)) == sorted(brute(rows, 20, 20), key=str)


def test_awkward_vectors(spark):
    bad = [(20, None), (40, []), (60, [0.0, 0.0]), (80, [None, 1.0]), (100, [float("nan"), 1.0]), (120, [float("inf"), 1.0]), (140, [1.0]), (None, [1.0, 1.0])]
    good = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (160, [-1.0, 0.5]), (160, [-1.0, 0.5])]
    table = spark.createDataFrame([(i, v, "", "") for i, v in bad + good], FIELDS)
    assert told(nearest(table, 20, 20)) == sorted(brute(good[:3], 20, 20), key=str)
    assert told(nearest(table.where("false"), 20, 20)) == []


def test_edges_are_few_and_diverse():
    points = equal_norms(np.random.default_rng(2).normal(size=(600, 8)))
    graph, entry = build_graph(points)
    assert graph.shape == (600, DEGREE)
    ids, gaps = beam_search(points, graph, entry, points[:50], 32)
    assert (ids[:, 0] == np.arange(50)).mean() > 0.95 and (np.diff(gaps, axis=1) >= 0).all()
    kept = robust_prune(np.array([[0.0, 0], [1, 0], [1.1, 0], [0, 1]], np.float32), np.array([0]), np.array([[1, 2, 3]]), 1.0)
    assert set(kept[0].tolist()) - {-1} == {1, 3}

import numpy as np
import pytest
from pyspark.sql import functions as F

from farebox.llm import mtree as mt


def brute(ids, vectors, query, own, k):
    scores = vectors @ query
    return sorted((-int(s), int(i)) for s, i in zip(scores, ids) if i != own)[:k]


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("page", [2, 8, 128])
def test_search_equals_brute_force(seed, page):
    rng = np.random.default_rng(seed)
    n, width = int(rng.choice([1, 2, 9, 300])), int(rng.choice([1, 3, 16]))
    vectors = rng.integers(-3 if seed % 2 else -300, 4 if seed % 2 else 300, (n, width))
    if seed > 4:
        vectors[: n // 2] = vectors[0]
    ids = rng.permutation(n) * 3
    tree = mt.MTree.load(mt.MTree(ids, vectors, page).dump())
    for q in range(0, n, 7):
        assert tree.search(vectors[q], ids[q], 5)[0] == brute(ids, vectors, vectors[q], ids[q], 5)
    for q in rng.integers(-400, 400, (10, width)):
        assert tree.search(q, -1, 5)[0] == brute(ids, vectors, q, -1, 5)


def test_tree_keeps_its_bounds_and_saves_distances():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 8)) * 200
    vectors = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8))).astype(np.int64)
    tree = mt.MTree(np.arange(4000), vectors, 128)

    def below(number):
        first, rows, _, _, children = tree.pages[number]
        return np.arange(first, first + rows) if first >= 0 else np.concatenate([below(c) for c in children])

    assert sorted(below(tree.root)) == list(range(4000))
    for first, rows, _, radius, children in tree.pages:
        if first < 0:
            for p, r, c in zip(rows, radius, children):
                under, child = below(c), tree.pages[c]
                assert (tree._to(under, p) <= r + 1e-9).all()
                assert np.allclose(child[2], tree._to(under if child[0] >= 0 else child[1], p))
    computed = [tree.search(vectors[q], q, 5)[1] for q in range(0, 4000, 100)]
    assert np.mean(computed) < 2000


def test_large_components_stay_exact():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-(2**30), 2**30, (50, 3))
    tree = mt.MTree.load(mt.MTree(np.arange(50), vectors, 4).dump())
    for q in range(50):
        assert tree.search(vectors[q], q, 5)[0] == brute(np.arange(50), vectors, vectors[q], q, 5)


@pytest.mark.parametrize("sizes", [(8192, 2048), (7, 3)])
def test_frames(spark, sizes):
    rng = np.random.default_rng(5)
    data = {i: rng.normal(size=4).tolist() for i in range(60)}
    data[3] = data[10] = data[20]
    rows = [(i, v, "x") for i, v in data.items()]
    rows += [(20, data[20], "x"), (61, None, "x"), (62, [1.0, None, 0.0, 0.0], "x"), (63, [float("nan")] * 4, "x"), (64, [float("inf"), 0.0, 0.0, 0.0], "x"), (None, data[1], "x"), (65, [0.5], "x"), (70, [-9.0] * 4, "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = mt.top_inner_products(frame, F.col("id") % 10 == 0, shard_rows=sizes[0], query_rows=sizes[1]).collect()
    ints = {i: np.floor(256 * np.array([*v, 0, 0, 0][:4], np.float32).astype(np.float64)).astype(np.int64) for i, v in {**data, 65: [0.5], 70: [-9.0] * 4}.items()}
    # The row of id 20 is there twice: two candidates, and two queries that share a list.
    pairs = [*ints.items(), (20, ints[20])]
    best = {q: sorted((-int(a @ b), j) for i, a in pairs if i == q for j, b in pairs if j != q)[:5] for q in ints if q % 10 == 0}
    want = [(q, r + 1, i, -s) for q, found in best.items() for r, (s, i) in enumerate(found)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    few = mt.top_inner_products(frame.where("vec_id IN (10, 20, 3)"), F.col("id") % 10 == 0).collect()
    assert len(few) == 3 + 2 * 2 and sorted(r.vec_id for r in few if r.query_id == 10) == [3, 20, 20]
    assert mt.top_inner_products(frame.limit(0), F.col("id") % 10 == 0).count() == 0


def test_rows_with_one_id_all_take_part(spark):
    """As the query's SQL has it: two rows of one id are two candidates, and queries of one id share a list."""
    rows = [(0, [1.0, 0.0]), (1, [9.0, 0.0]), (1, [2.0, 1.0]), (2, [3.0, 0.0]), (2, [3.0, 0.0])] + [(3, [0.5, float(k)]) for k in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ints = [(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v in rows]
    for shard_rows in (8192, 5):
        got = mt.top_inner_products(frame, F.col("id") >= 0, shard_rows=shard_rows, query_rows=7).collect()
        for q in range(4):
            scores = sorted((-int(a @ b), j) for i, a in ints if i == q for j, b in ints if j != q)[:5]
            mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
            assert mine == [(n, j, -s) for n, (s, j) in enumerate(scores, 1)]

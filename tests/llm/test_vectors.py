import numpy as np
import pytest

from kbcurate.llm import ann, vectors


def made(seed, n, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    near = base[rng.integers(0, n // 4, n)] + rng.normal(scale=0.12, size=(n, dim))
    rows = np.concatenate([base[: n // 2], near, base[:5], np.tile(base[7], (40, 1))]).astype(np.float32)
    rows *= rng.choice([1, 1e-20, 1e15], size=(len(rows), 1)).astype(np.float32)
    out = [(int(i), [float(x) for x in r]) for i, r in enumerate(rows)]
    m = len(out)
    odd = [None, [], [0.0] * dim, [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0, 2.0], [2.0, 4.0]]
    out += [(m + i, v) for i, v in enumerate(odd)] + [(None, out[0][1]), (3, out[3][1])]
    return out


def good(v, dim):
    return v is not None and len(v) == dim and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, n_links int").repartition(3)


@pytest.mark.parametrize("cell,block", [(4096, 4096), (40, 16)])
def test_links_and_components(spark, cell, block):
    rows = made(1, 240)
    got = sorted((tuple(r) for r in vectors.near_vectors(frame(spark, rows), cell=cell, block=block).collect()), key=repr)
    links, root = {}, {i: i for i, _ in rows}
    for dim in (2, 16):
        mine = {i: np.array(v, np.float64) for i, v in rows if i is not None and good(v, dim)}
        ids = sorted(mine)
        m = np.array([mine[i] / np.abs(mine[i]).max() for i in ids])
        m /= np.linalg.norm(m, axis=1)[:, None]
        near = m @ m.T >= 0.9
        for a, i in enumerate(ids):
            links[i] = int(near[a].sum()) - 1
        label = np.arange(len(ids))
        for _ in range(len(ids)):
            new = np.array([label[near[a]].min() for a in range(len(ids))])
            if (new == label).all():
                break
            label = new
        root |= {i: ids[label[a]] for a, i in enumerate(ids)}
    want = [(i, links.get(i, 0) if i is not None else 0, root[i], True if i is None else root[i] == i) for i, _ in rows]
    assert got == sorted(want, key=repr)
    assert max(links.values()) > 40


def test_empty(spark):
    assert vectors.near_vectors(frame(spark, [])).collect() == []
    assert ann.search(frame(spark, []), frame(spark, [])).collect() == []


def test_search_of_few_is_exact(spark):
    rows = made(2, 60)
    df = frame(spark, rows)
    got = [tuple(r) for r in ann.search(df, df.where("vec_id % 7 = 0"), k=200, recall=1.0).orderBy("query_id", "rank").collect()]
    mine = {i: np.array(v, np.float64) for i, v in rows if i is not None and good(v, 16)}
    want = []
    for q in sorted(i for i in mine if i % 7 == 0):
        found = sorted((-float((mine[q] * v).sum()), i) for i, v in mine.items() if i != q)[:200]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert {g[::2] for g in got} == {w[::2] for w in want}
    np.testing.assert_allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


def test_recall_of_the_bundled_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = ann.search(df, df.where("vec_id % 20 = 0"), leaf=64).collect()
    m = np.array([r["embedding"] for r in df.orderBy("vec_id").collect()], np.float64)
    hits, total = 0, 0
    by = {}
    for r in found:
        by.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q in range(0, len(m), 20):
        s = m @ m[q]
        s[q] = -np.inf
        top = set(np.argsort(-s, kind="stable")[:20].tolist())
        hits, total = hits + len(top & by[q]), total + 20
    assert all(len(x) == 20 for x in by.values()) and hits / total >= 0.9


def test_tree_walk_reaches_every_leaf_once_nearest_first():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(500, 4))
    tree = ann.Tree(rows, 40)
    leaf = tree.assign(rows)
    assert tree.leaves == 40 and set(leaf) <= set(range(40))
    for row, at in zip(rows[:50], leaf):
        walk = tree.visits(row, 40)
        assert walk[0] == at and sorted(walk) == list(range(40))
    assert ann.Tree(np.ones((10, 4)), 5).leaves == 1

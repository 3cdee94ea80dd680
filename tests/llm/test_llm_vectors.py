import numpy as np
import pytest

from aislecast.llm import vectors as v

SCHEMA = "vec_id long, embedding array<float>, label int, node long, copies string"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, l, 0, "x") for i, e, l in rows], SCHEMA)


def brute(rows, threshold):
    ok = [i is not None and l is not None and e is not None and len(e) > 0 and all(x is not None and np.isfinite(x) for x in e) and any(e) for i, e, l in rows]
    links = [set() for _ in rows]
    for p, (_, e, l) in enumerate(rows):
        for q, (_, f, m) in enumerate(rows):
            if p != q and ok[p] and ok[q] and l == m and len(e) == len(f):
                a, b = np.float32(e).astype(float), np.float32(f).astype(float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[p].add(q)
    out = []
    for p, (i, _, _) in enumerate(rows):
        seen, todo = {p}, [p]
        while todo:
            for q in links[todo.pop()] - seen:
                seen.add(q)
                todo.append(q)
        least = min((rows[q][0] for q in seen), default=None) if ok[p] else i
        out.append((i, len(links[p]), least, i == least))
    return sorted(out, key=repr)


def near_rows(seed, dims=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    rows = []
    for i in range(260):
        x = centres[i % 5] + rng.normal(size=dims) * rng.choice([0.0, 0.15, 0.3, 1.0])
        rows.append((1000 - i * 3, x.tolist(), int(i % 5 == 0) if i % 17 else None))
    return rows


def edge_rows():
    nan, inf = float("nan"), float("inf")
    return [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, None, 1), (8, [], 1),
            (9, [1.0, None], 1), (10, [1.0, 0.0], None), (11, [1.0, 0.0], 1), (11, [1.0, 0.0], 1), (12, [1.0, 0.0, 0.0], 1), (13, [1.0], 1), (14, [-3.0], 1), (15, [5.0], 1)]


@pytest.mark.parametrize("tile", [16, 2048])
@pytest.mark.parametrize("rows", [near_rows(1), near_rows(2, 70), edge_rows()])
def test_against_brute_force(spark, rows, tile):
    got = v.near_duplicates(frame(spark, rows), tile=tile).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, v.THRESHOLD)


def test_null_id(spark):
    rows = [(None, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (5, [1.0, 0.1], 1)]
    got = {r.vec_id: tuple(r)[1:] for r in v.near_duplicates(frame(spark, rows)).collect()}
    assert got == {None: (0, None, True), 3: (1, 3, True), 5: (1, 3, False)}


def test_empty_table(spark):
    assert v.near_duplicates(frame(spark, [])).count() == 0


def test_bounds_lose_nothing():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 50)) * np.linspace(3, 0.1, 50)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for threshold in (0.2, 0.6, 0.93):
        i, j, s = v._linked(x[:150], x[150:], threshold)
        full = x[:150] @ x[150:].T
        assert set(zip(*np.nonzero(full >= threshold))) <= set(zip(i, j))
        assert np.allclose(s, full[i, j])


def test_very_small_and_very_large_vectors(spark):
    rows = [(1, [1e-200] * 20, 1), (2, [1e200] * 20, 1), (3, [1.0] * 20, 1), (4, [1e200] * 19 + [-1e200], 1), (5, [5e-324] * 20, 1), (6, [1e308] + [-1e308] * 19, 1), (7, [1e-300] + [0.0] * 19, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in v.near_duplicates(frame).collect()}
    # 4 has a cosine of 0.9 to the vectors of equal components, 6 one of -0.9
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 5: (3, 1), 4: (0, 4), 6: (0, 6), 7: (0, 7)}

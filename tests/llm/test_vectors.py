import math

import numpy as np

from presswork.llm import vectors


def _rows():
    rng = np.random.default_rng(4)
    rows = []
    for g in range(30):
        base = rng.standard_normal(32)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((len(rows), (base + rng.standard_normal(32) * rng.choice([0, 0.1, 0.17, 0.22])).tolist(), g % 3))
    odd = [None, [], [0.0] * 32, [math.nan] * 32, [1.0, None], [math.inf] + [1.0] * 31, [1.0, 2.0], [2.0, 4.0]]
    rows += [(1000 + i, v, 1) for i, v in enumerate(odd)] + [(2000, rows[0][1], None), (2001, rows[0][1], 0), (2002, [5 * x for x in rows[0][1]], 0), (-3, rows[7][1], rows[7][2])]
    return rows


def test_matches_brute_force(spark):
    rows = _rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, id int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()}
    assert got == vectors.brute_force(rows, 0.98)


def test_bands_and_blocks_find_the_links(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BUCKET_ROWS", 8)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 4)
    rows = _rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()}
    want = vectors.brute_force(rows, 0.98)
    assert all(got[k][0] <= want[k][0] for k in want)
    assert sum(v[0] for v in got.values()) >= 0.97 * sum(v[0] for v in want.values())


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in vectors.near_vectors(df).distinct().collect()] == [(1, 1, 1, True)]
    assert vectors.near_vectors(df.limit(0)).collect() == []


def test_estimate_is_unbiased_and_within_its_bound():
    rng = np.random.default_rng(0)
    rotation = vectors.Rotation(64)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rotated = rotation.rotate(x)
    assert np.allclose(rotated @ rotated.T, x @ x.T)
    code, factor, near, scale = rotation.encode(x)
    positive = np.unpackbits(code, axis=1)
    error = rotation.estimates(positive, factor, near.astype(np.float32), scale) - x @ x.T
    np.fill_diagonal(error, 0)
    assert abs(error.mean()) < 0.002 and (np.abs(error) <= rotation.errors(factor, scale)).mean() > 0.999


def test_bound_leaves_few_pairs_and_loses_no_link(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 48))
    rows = [(i, (base[i % 60] + rng.standard_normal(48) * (0.08 if i < 120 else 4)).tolist(), 0) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    fetched = []
    kept = vectors.common.stored

    def stored(x):
        out = kept(x)
        if out.columns[:2] == ["group", "id"]:
            fetched.append(out.count())
        return out

    monkeypatch.setattr(vectors.common, "stored", stored)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()}
    tables = -(-math.log(0.002) // math.log(1 - (1 - math.acos(0.98) / math.pi) ** 2))  # two band bits for 600 rows
    want = vectors.brute_force(rows, 0.98)
    assert sum(v[0] for v in got.values()) >= 0.99 * sum(v[0] for v in want.values()) > 0
    assert fetched[0] <= 600 * tables / 2  # most rows have no pair left, and their vectors stay where they are


def test_very_long_vectors_and_a_tie_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    long = rng.standard_normal(9000)
    rows = [(1, long.tolist(), 1), (2, (long * 3).tolist(), 1), (3, rng.standard_normal(9000).tolist(), 1), (4, [1.0, 0.0], 1), (5, [0.6, 0.8], 1), (6, [0.8, 0.6], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), threshold=0.6).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (2, 4), 5: (2, 4), 6: (2, 4)}

"""Whitening, exact top-k search and hard negatives against plain NumPy."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from heirline.llm import eigen, exacttopk, hardnegatives, lengthblocks, queries, whitening
from heirline.llm.integers import coded

SCHEMA = "vec_id long, embedding array<float>, label int, code int, length int, block int, query_id long, slot int, low int, share int, rank int"
ODD_ROWS = [
    (None, [1.0, 2.0], 1), (900, None, 1), (901, [None, 1.0], 1), (902, [float("nan"), 1.0], 1), (903, [float("inf"), 1.0], 1),
    (904, [], 1), (905, [1.0, 2.0, 3.0], 1), (906, [0.5, 0.5], None),
]


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], l, *[1] * 8) for i, v, l in rows], SCHEMA)


def drawn(n, d, seed=1, spread=0.3, groups=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d)) * rng.uniform(0.2, 2, size=(groups, 1))
    at = rng.integers(0, groups, n)
    x = (centres[at] + spread * rng.normal(size=(n, d))).astype(np.float32)
    return [(i, v, int(l)) for i, (v, l) in enumerate(zip(x.tolist(), at, strict=True))]


def whole(rows, scale):
    return np.floor(scale * np.array([v for _, v, _ in rows], np.float32).astype(float)).astype(np.int64)


# Whitening


def characteristic(matrix):
    primes = eigen.needed_primes(matrix)
    return eigen.from_remainders(primes, eigen.polynomials_modulo(matrix, np.array(primes)).tolist())


def test_characteristic_polynomial_is_exact():
    assert characteristic([[7]]) == [-7, 1]
    assert characteristic([[2, 1], [1, 3]]) == [5, -5, 1]
    assert characteristic([[5, 0, 0], [0, 5, 0], [0, 0, 2]]) == [-50, 45, -12, 1]
    rng = np.random.default_rng(2)
    x = rng.integers(-9, 9, (20, 6))
    m = (x.T @ x).tolist()
    c = characteristic(m)
    # The matrix is a root of its own polynomial.
    power, total = np.eye(6, dtype=object), np.zeros((6, 6), object)
    for a in c:
        total, power = total + a * power, power @ np.array(m, object)
    assert not total.any() and c[-1] == 1 and c[-2] == -sum(m[i][i] for i in range(6))


def test_roots_and_their_multiplicity():
    # (x - 3)^2 (x - 8) x
    roots = eigen.Roots([0, -72, 57, -14, 1])
    assert [(round(a / 2**s), m) for a, s, m in roots.largest(4)] == [(8, 1), (3, 2)]
    assert [roots.above(a, 0) for a in (0, 2, 3, 7, 8)] == [3, 3, 1, 1, 0]
    close = eigen.Roots([(10**12) * (10**12 + 1), -(2 * 10**12 + 1), 1])
    assert [(a >> s if s >= 0 else a << -s) + round((a / 2**s) % 1) for a, s, _ in close.largest(2)] == [10**12 + 1, 10**12]


def white(spark, rows, **options):
    out = {}
    for r in whitening.whiten(spark, table(spark, rows), **options).collect():
        out.setdefault(r.vec_id, {})[r.component] = r
    return out


@pytest.mark.parametrize(("n", "d"), [(400, 12), (40, 3), (9, 12), (500, 1)])
def test_whitening_against_numpy(spark, n, d):
    rows = drawn(n, d) + [(n + i, drawn(n, d)[0][1], 0) for i in range(n // 2)]
    got = white(spark, rows)
    x = whole(rows, 256)
    fit = np.unique(x, axis=0)
    m, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / m
    values, axes = np.linalg.eigh(centred.T @ centred / m)
    k = min(4, np.linalg.matrix_rank(centred))
    assert set(got) == {i for i, *_ in rows} and all(sorted(g) == list(range(1, k + 1)) for g in got.values())
    for j in range(k):
        e, axis = values[-1 - j], axes[:, -1 - j]
        want = (x - sums / m) @ axis / np.sqrt(e)
        have = np.array([got[i][j + 1].whitened for i, *_ in rows])
        assert np.allclose(have * np.sign(have @ want), want, atol=1e-7)
        assert got[0][j + 1].explained == pytest.approx(e / values.sum(), rel=1e-9)
    exact = ((m * x - sums) ** 2).sum(axis=1)
    assert [got[i][1].deviation for i, *_ in rows] == exact.tolist()
    assert {(r.n, r.identity_error) for g in got.values() for r in g.values()} == {(m, got[0][1].identity_error)}
    assert got[0][1].identity_error < 1e-9


def test_whitening_edge_cases(spark):
    rows = [(0, [1, 0], 0), (1, [0, 1], 0), (2, [1, 1], 0), (2, [1, 1], 0), *ODD_ROWS]
    got = white(spark, rows)
    assert set(got) == {None, 0, 1, 2, 906} and len(whitening.whiten(spark, table(spark, rows)).collect()) == 12
    assert got[0][1].n == 5
    assert white(spark, []) == {} and white(spark, [(1, [2, 3], 0)] * 3) == {} and white(spark, ODD_ROWS[1:6]) == {}
    # Eigenvalues that repeat: any two orthogonal axes.
    got = white(spark, [(0, [1, 0], 0), (1, [-1, 0], 0), (2, [0, 1], 0), (3, [0, -1], 0)])
    assert sorted(got[0]) == [1, 2] and got[0][1].explained == got[0][2].explained == 0.5 and got[0][1].identity_error < 1e-12
    for g in got.values():
        assert g[1].whitened ** 2 + g[2].whitened ** 2 == pytest.approx(2)
    # What a long cannot hold is null; what a double cannot is refused.
    got = white(spark, [(0, [2.0**40, 0], 0), (1, [0, 1], 0), (2, [1, 2.0**39], 0)])
    assert got[0][1].deviation is None and got[0][1].identity_error < 1e-9
    with pytest.raises(ValueError, match="too large"):
        white(spark, [(0, [1e30, 0], 0)])


# Searches


def best_of(rows, k, scale, wanted):
    x, ids = whole(rows, scale), [i for i, *_ in rows]
    out = {}
    for q in (j for j, i in enumerate(ids) if wanted(i)):
        order = sorted((-int(x[q] @ x[j]), ids[j]) for j in range(len(ids)) if ids[j] != ids[q])
        out[ids[q]] = [(i, -s) for s, i in order[:k]]
    return out


def top(spark, rows, **options):
    out = {}
    for r in exacttopk.exact_top(spark, table(spark, rows), F.col("vec_id") % 20 == 0, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r.rank
    return out


def negatives_of(rows, positives, negatives, scale):
    x, out = whole(rows, scale), []
    for a, (i, _, label) in enumerate(rows):
        if i % 10 == 0:
            scored = sorted((-int(x[a] @ x[j]), rows[j][0], rows[j][2] == label) for j in range(len(rows)) if rows[j][0] != i)
            for p, pid, _ in [s for s in scored if s[2]][:positives]:
                fit = [(s, n) for s, n, same in scored if not same and -30 * p <= -100 * s <= -90 * p]
                out += [(i, pid, r + 1, n, -p, -s) for r, (s, n) in enumerate(fit[:negatives])]
    return sorted(out)


def mined(spark, rows, **options):
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    made = hardnegatives.hard_negatives(spark, table(spark, rows), F.col("vec_id") % 10 == 0, **options)
    return sorted(tuple(r) for r in made.select(*columns).collect())


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("LEAST_BLOCK_ROWS", 64), ("BUCKET_ROWS", 32), ("BLOCK_ROWS", 64), ("SCORES_TOGETHER", 256)):
        monkeypatch.setattr(lengthblocks, name, value)


@pytest.mark.parametrize(("spread", "groups"), [(0.05, 5), (0.2, 30)])
def test_searches_equal_brute_force(spark, small_blocks, spread, groups):
    rows = drawn(260, 8, spread=spread, groups=groups)
    rows += [(500 + i, rows[3][1], i % 3) for i in range(80)] + [(700 + i, [0.0] * 8, 1) for i in range(30)]
    assert top(spark, rows, k=7) == best_of(rows, 7, 64, lambda i: i % 20 == 0)
    rows = [(i, v, l % 4) for i, v, l in rows]
    assert mined(spark, rows, positives=3, negatives=4) == negatives_of(rows, 3, 4, 256)


def test_coordinates_prune(monkeypatch):
    """Where a high cosine is needed, only rows in the ranges are verified; nothing is lost."""
    rng = np.random.default_rng(4)
    centres = 100 * rng.normal(size=(50, 16))
    v = np.rint(centres[rng.integers(0, 50, 4000)] + 3 * rng.normal(size=(4000, 16))).astype(np.int64)
    q = v[::40]
    seen = []
    plain = lengthblocks._by_coordinate

    def watched(*args):
        dense, found = plain(*args)
        seen.append((np.count_nonzero(~dense), sum(map(len, found)), len(args[3])))
        return dense, found

    monkeypatch.setattr(lengthblocks, "_by_coordinate", watched)
    scores = q @ v.T
    want = []
    for i in range(len(q)):
        order = [j for j in np.lexsort((np.arange(len(v)), -scores[i])) if j != 40 * i][:10]
        want += [(i, 0, -scores[i, j], j) for j in order]
    # As the first block tells it, a score that the best rows just reach.
    least = np.array([-s for _, _, s, _ in want[9::10]], float)[:, None]
    got = lengthblocks.search_rows(q, np.arange(len(q)) * 40, v, np.arange(len(v)), least, np.full(least.shape, np.inf), 10)
    assert [tuple(c) for c in got.T.tolist()] == want
    used = sum(n for n, *_ in seen)
    assert used > len(q) / 2 and sum(m for _, m, _ in seen) < 0.2 * sum(n * size for n, _, size in seen)


def test_search_edge_cases(spark):
    rows = [(0, [1, 0], 1), (1, [0, 1], 1), (2, [2, 0], 2), (20, [0, 0], 1), (0, [1, 0], 1), (3, [2, 0], 2), (10, [-1, -1], 2), *ODD_ROWS]
    got = top(spark, rows)
    assert got == {0: [(2, 8192), (3, 8192), (906, 2048), (1, 0), (20, 0), (10, -4096)], 20: [(i, 0) for i in (0, 0, 1, 2, 3, 10, 906)]}
    assert top(spark, []) == {} and top(spark, ODD_ROWS[1:6]) == {} and top(spark, [(20, [1], 1)]) == {}
    plain = [r for r in rows[:7] if r[0] != 20]
    assert mined(spark, rows[:3] + rows[4:]) == negatives_of(plain[:1] + plain[1:3] + plain[4:], 5, 10, 256)
    assert mined(spark, []) == [] and mined(spark, [(0, [1, 1], None)]) == [] and mined(spark, [(0, [1, 1], 1)]) == []


def test_codes_are_narrow(spark):
    for size, dtype in ((0.4, "int8"), (100, "int16"), (1e5, "int32"), (1e9, "int64")):
        rows, form = coded(table(spark, [(1, [size, -size, 0], 0)]), 256, "vec_id")
        code = rows.first().code
        assert form.dtype == dtype and np.frombuffer(code, dtype).tolist() == np.floor(256 * np.array([np.float32(size), -np.float32(size), 0], float)).tolist()


def test_sql(spark, tmp_path):
    """The registered queries equal their SQL on the given table with odd rows."""
    rows = [(i, v, l) for i, v, l in drawn(300, 8, groups=9)] + [(10_000 + 100 * i, v, 1) for i, (_, v, _) in enumerate(r for r in ODD_ROWS if r[1] is None or len(r[1]) == 0)]
    table(spark, rows).select("vec_id", "embedding", "label").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("op12_exact_top", "op13_hard_negatives"):
        got = queries.QUERIES[name](spark, str(tmp_path))
        want = duckdb.sql(queries.ORACLE[name])
        assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall()) and got.count()

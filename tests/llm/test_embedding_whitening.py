"""op12 against a plain eigendecomposition, and its rank-one updates on hard spectra."""

import numpy as np
import pytest

from flowscore.llm import op12_embedding_whitening as op


def shaped(kind, n, d, rng):
    if kind == "spread":
        return rng.normal(size=(n, d)) * np.logspace(0, 3, d)
    if kind == "copies":
        return np.repeat(rng.normal(size=(3, d)) * 100, n // 3, axis=0)
    if kind == "corners":
        return np.eye(d)[rng.integers(0, d, n)] * 100
    if kind == "constant":
        x = np.round(rng.normal(size=(n, d)) * 50)
        x[:, 0] = 5
        return x
    return rng.normal(size=(n, d)) * 100


@pytest.mark.parametrize("kind", ["spread", "copies", "corners", "constant", "even"])
@pytest.mark.parametrize("d", [1, 2, 7, 32])
def test_spectrum_of_updates_and_of_a_merge(kind, d):
    rng = np.random.default_rng(d)
    x = shaped(kind, 240, d, rng)
    y = x - x.mean(0)
    want = y.T @ y
    whole, one, two = op.Spectrum(d, 64), op.Spectrum(d, 64), op.Spectrum(d, 64)
    for i, v in enumerate(x):
        whole.add(v)
        (one if i < 80 else two).add(v)
    one.merge(two)
    for s in (whole, one):
        made = s.basis @ np.diag(s.lam) @ s.basis.T
        assert np.abs(made - want).max() <= 1e-11 * max(np.abs(want).max(), 1)
        assert np.abs(s.basis.T @ s.basis - np.eye(len(s.lam))).max(initial=0) < 1e-11
        assert s.n == len(x) and np.abs(s.mean - x.mean(0)).max() < 1e-8


@pytest.mark.parametrize("seed", range(20))
def test_secular_roots_interlace_and_solve(seed):
    rng = np.random.default_rng(seed)
    m = int(rng.integers(1, 30))
    d = np.cumsum(10.0 ** rng.uniform(-9, 2, m))
    w = 10.0 ** rng.uniform(-6, 2, m) * rng.choice([-1, 1], m)
    base, tau, gaps = op.secular_roots(d, w)
    root = base + tau
    want = np.linalg.eigvalsh(np.diag(d) + np.outer(w, w))
    assert np.abs(root - want).max() <= 1e-12 * want.max()
    assert (gaps[np.arange(m), np.arange(m)] < 0).all() and (gaps[np.arange(m - 1), np.arange(1, m)] > 0).all()


def test_a_kept_rank_is_enough_for_few_directions():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 50)) * 100
    s = op.Spectrum(50, 8)
    for v in x:
        s.add(v)
    want = np.linalg.eigvalsh(np.cov(x.T, bias=True) * len(x))[::-1]
    assert np.allclose(s.lam[::-1][:4], want[:4], rtol=1e-10) and s.basis.shape[1] <= 8


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n long, component int, whitened string").repartition(5)


def row(i, v):
    return (i, v, 0, 7, 7, "clash")


def check(spark, rows, k, **params):
    """The whole result against numpy, whichever the signs."""
    df = frame(spark, [row(i, v) for i, v in rows])
    good = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(np.float32(c)) for c in v)]
    d = max({len(v) for _, v in good}, key=lambda s: (sum(len(v) == s for _, v in good), s))
    good = [(i, v) for i, v in good if len(v) == d]
    x = np.floor(1024 * np.array([v for _, v in good], np.float32).astype(float)).astype(np.int64) + 100000
    n, s = len(x), x.sum(0)
    y = x - s / n
    cov = y.T @ y / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    got = op.whiten(df, op.fit_whitening(df, k, **params)).collect()
    assert len(got) == n * min(k, d)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    assert {r.n for r in got} == {n}
    assert sorted((r.deviation for r in got if r.component == 1)) == sorted(int(((n * v - s) ** 2).sum()) for v in x)
    for c in range(min(k, d)):
        if e[c] <= 1e-12 * e[0]:
            assert all(r.whitened is None for r in got if r.component == c + 1)
            continue
        mine = sorted(r.whitened for r in got if r.component == c + 1)
        z = y @ u[:, c] / np.sqrt(e[c])
        assert min(np.abs(np.sort(z) - mine).max(), np.abs(np.sort(-z) - mine).max()) < 1e-7
        assert all(abs(r.explained - e[c] / np.trace(cov)) <= 1e-10 for r in got if r.component == c + 1)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    return got


def test_rows_left_out_ties_and_repeats(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.normal(size=12) * np.linspace(1, 4, 12)]) for i in range(200)]
    rows += [(None, rows[0][1]), (5, rows[1][1]), (5, rows[1][1])] + [(900 + i, rows[7][1]) for i in range(40)]
    rows += [(300, None), (301, []), (302, [None] * 12), (303, [float("nan")] * 12), (304, [1.0] * 11 + [float("inf")]), (305, [1.0] * 9),
             (306, [1.0] * 11 + [None])]
    check(spark, rows, 8)


def test_more_dimensions_than_the_kept_rank(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in rng.normal(size=40) / np.sqrt(np.arange(1, 41))]) for i in range(300)]
    check(spark, rows, 4, rank=6, fan_in=2)


def test_few_rows_and_no_variance(spark):
    check(spark, [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.5, 2.0])], 8)
    got = check(spark, [(1, [0.5, 0.25])], 8)
    assert {(r.whitened, r.explained, r.identity_error, r.deviation) for r in got} == {(None, 0.0, 0.0, 0)}


def test_empty_tables(spark):
    df = frame(spark, [])
    assert op.fit_whitening(df) is None and op.whiten(df, None).count() == 0
    assert op.whiten(df, None).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert op.fit_whitening(frame(spark, [row(1, None), row(2, [])])) is None

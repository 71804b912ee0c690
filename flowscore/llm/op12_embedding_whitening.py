"""Embedding whitening: incremental eigendecomposition, merged spectra, Rayleigh-Ritz.

1. One pass sums the fixed-point vectors x = floor(1024 c) + 100000 exactly.
2. Each task keeps the spectrum of the scatter matrix of its own rows: a new
   vector is a centred rank-one update whose eigenvalues are the roots of a
   secular equation; components of the update that vanish, and equal
   eigenvalues, are deflated first. The spectrum has at most ``rank``
   eigenpairs, so a task holds dimension x rank numbers whatever its rows.
3. Spectra of groups of tasks are joined in rounds: the eigenpairs of the one
   and the difference of the means are rank-one updates of the other.
4. Rayleigh-Ritz: the leading vectors and a few guards span a space; one
   distributed pass applies the covariance to it, the small projected problem
   rotates it, and as long as the residual is above rounding the residuals
   join the space. Only matrices of dimension x (components + guards) are
   gathered, summed on the way.
5. A last pass measures the covariance of the whitened rows.

Defined results: vectors that are null, empty, or hold null or non-finite
entries are left out; of several lengths the most frequent one counts (of
equals the longer) and vectors of other lengths are left out; entries beyond
2**53 after scaling are cut to it; a deviation beyond 64 bits is null; a
direction without variance (constant entries, fewer rows than components) has
a null ``whitened``, is no part of ``identity_error``, and explains 0; with
fewer than ``k`` dimensions there are as many components; a null vec_id and
repeated rows are rows like any other; each component's largest entry is
positive; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscore.llm.common import table, written

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
GUARDS = 8
RANK = 64
FAN_IN = 8
PASSES = 10
EPS = np.finfo(float).eps
SPECTRUM = "grp long, n long, mean array<double>, lam array<double>, basis array<double>"


# --- vectors of a batch -------------------------------------------------------

def vectors(col: pa.Array, dim: int | None = None):
    """(row numbers, fixed-point vectors) of the usable rows by length: {length: (rows, int64 matrix)}."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    values = pc.list_flatten(col).cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null entry becomes NaN
    row = pc.list_parent_indices(col).to_numpy(zero_copy_only=False)
    size = np.bincount(row, minlength=len(col))
    bad = np.bincount(row, ~np.isfinite(values), len(col)) > 0
    out = {}
    for d in [dim] if dim else np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero((size == d) & ~bad)
        if len(rows):
            keep = np.zeros(len(col), bool)
            keep[rows] = True
            x = np.floor(np.clip(values[keep[row]] * SCALE, -2.0 ** 53, 2.0 ** 53)).astype(np.int64)
            out[d] = rows, x.reshape(-1, d) + SHIFT
    return out


def _sums(batches):
    """Per task and length: how many vectors (pos -1) and the sum of each entry."""
    total = {}
    for b in batches:
        for d, (_, x) in vectors(b.column("embedding")).items():
            s = np.append(len(x), x.sum(0))
            total[d] = total[d] + s if d in total else s
    for d, s in total.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d + 1, d, np.int32)), pa.array(np.arange(-1, d, dtype=np.int32)), pa.array(s)],
                                         names=["dim", "pos", "s"])


# --- rank-one updates ---------------------------------------------------------

def secular_roots(d: np.ndarray, w: np.ndarray):
    """Roots of 1 + sum w**2 / (d - mu), d strictly rising, no w zero.

    Returns (base, tau, gaps): root i is base[i] + tau[i], base the nearer
    pole, and gaps[i, j] = d[j] - root i, free of cancellation.
    """
    m, w2 = len(d), w * w
    at = np.arange(m)
    top = w2.sum()
    gap = np.append(d[1:] - d[:-1], top)
    mid = 0.5 * gap
    f_mid = 1 + (w2 / ((d[None, :] - d[:, None]) - mid[:, None])).sum(1)
    low = (f_mid >= 0) | (at == m - 1)  # the pole below is the nearer one
    pole = np.where(low, at, np.minimum(at + 1, m - 1))
    dist = d[None, :] - d[pole][:, None]
    last = at == m - 1
    lo = np.where(low, 0.0, -mid)
    hi = np.where(low, np.where(last, np.where(f_mid >= 0, mid, gap), mid), 0.0)
    lo = np.where(last & (f_mid < 0), mid, lo)
    hi = hi * (1 + 8 * EPS * low)  # the last root may be the upper end itself
    tau = 0.5 * (lo + hi)
    left = np.tri(m)
    for _ in range(80):
        e = dist - tau[:, None]
        t = w2 / e
        t2 = t / e
        below, slope = t * left, t2 * left
        psi, phi = below.sum(1), (t - below).sum(1)
        dpsi, dphi = slope.sum(1), (t2 - slope).sum(1)
        f = 1 + psi + phi
        lo, hi = np.where(f < 0, tau, lo), np.where(f >= 0, tau, hi)
        done = (np.abs(f) <= 2 * EPS * m * (1 + np.abs(psi) + phi)) | (hi - lo <= 2 * EPS * np.maximum(np.abs(lo), np.abs(hi)))
        if done.all():
            break
        # both sums as a constant and the nearest pole each, equal in value and slope
        a = e[at, at]
        b = np.append(e[at[:-1], at[:-1] + 1], 1.0)
        s1, s2 = dpsi * a * a, np.where(last, 0.0, dphi * b * b)
        c = f - dpsi * a - np.where(last, 0.0, dphi * b)
        q0, q1 = a * b * f, c * (a + b) + s1 + s2
        root = np.sqrt(np.maximum(q1 * q1 - 4 * c * q0, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            eta = np.where(q1 <= 0, (q1 - root) / (2 * c), 2 * q0 / (q1 + root))
            eta = np.where(last, a + s1 / c, eta)
        new = tau + eta
        new = np.where(np.isfinite(new) & (new > lo) & (new < hi), new, 0.5 * (lo + hi))
        tau = np.where(done, tau, new)
    return d[pole], tau, dist - tau[:, None]


def _deflate(lam: np.ndarray, w: np.ndarray, basis: np.ndarray, tol: float) -> None:
    """Rotate pairs of (nearly) equal eigenvalues so that the update misses one of each; in place."""
    prev = -1
    for j in np.flatnonzero(np.abs(w) > 0):
        if prev >= 0:
            r = np.hypot(w[prev], w[j])
            c, s = w[j] / r, w[prev] / r
            if abs((lam[j] - lam[prev]) * c * s) <= tol:
                u, v = basis[:, prev].copy(), basis[:, j].copy()
                basis[:, prev], basis[:, j] = c * u - s * v, s * u + c * v
                p, q = lam[prev], lam[j]
                lam[prev], lam[j] = c * c * p + s * s * q, s * s * p + c * c * q
                w[prev], w[j] = 0.0, r
        prev = j


def rank_one(lam: np.ndarray, basis: np.ndarray, v: np.ndarray, rank: int):
    """Eigenpairs (rising, at most ``rank``) of basis diag(lam) basis' + v v'."""
    size = np.sqrt(v @ v)
    if size == 0:
        return lam, basis
    w = v @ basis
    rest = v - basis @ w
    more = rest @ basis  # once more, for orthogonality
    rest, w = rest - basis @ more, w + more
    left = np.sqrt(rest @ rest)
    if len(lam) < len(v) and left > 64 * EPS * size:
        lam, basis, w = np.append(0.0, lam), np.column_stack([rest / left, basis]), np.append(left, w)
    else:
        lam, basis = lam.copy(), basis.copy()
    tol = 8 * EPS * max(lam[-1], size * size)
    w[np.abs(w) * size <= tol] = 0.0
    near = np.flatnonzero(w)
    if len(near) > 1:
        p, q = w[near[:-1]], w[near[1:]]
        if (np.diff(lam[near]) * np.abs(p * q) <= tol * (p * p + q * q)).any():
            _deflate(lam, w, basis, tol)
            order = np.argsort(lam, kind="stable")
            lam, w, basis = lam[order], w[order], basis[:, order]
    on = np.flatnonzero(w)
    if len(on):
        d, z = lam[on], w[on]
        base, tau, e = secular_roots(d, z)
        # the update of which these roots are the exact ones: its vectors are orthogonal to rounding
        ratio = d[:, None] - d[None, :]
        np.fill_diagonal(ratio, 1.0)
        z = np.sqrt(np.abs((-e / ratio).prod(0))) * np.sign(z)
        turn = z[None, :] / e
        turn /= np.sqrt((turn * turn).sum(1, keepdims=True))
        basis[:, on] = basis[:, on] @ turn.T
        lam[on] = base + tau
        order = np.argsort(lam, kind="stable")
        lam, basis = lam[order], basis[:, order]
    return np.maximum(lam[-rank:], 0.0), basis[:, -rank:]


class Spectrum:
    """Eigenpairs of the scatter matrix of the rows seen so far, and their mean."""

    def __init__(self, dim: int, rank: int, n: int = 0, mean=None, lam=None, basis=None):
        self.rank, self.n = rank, n
        self.mean = np.zeros(dim) if mean is None else np.array(mean, float)
        self.lam = np.zeros(0) if lam is None else np.array(lam, float)
        self.basis = np.zeros((dim, 0)) if basis is None else np.array(basis, float).reshape(dim, len(self.lam))
        self.updates = 0

    def _turn(self, v):
        self.lam, self.basis = rank_one(self.lam, self.basis, v, self.rank)
        self.updates += 1
        if self.updates % 512 == 0:
            self.basis = np.linalg.qr(self.basis)[0]  # no drift from orthogonality

    def add(self, x: np.ndarray) -> None:
        gap = x - self.mean
        self._turn(gap * np.sqrt(self.n / (self.n + 1)))
        self.n += 1
        self.mean = self.mean + gap / self.n

    def merge(self, other: Spectrum) -> None:
        if not other.n:
            return
        for e, u in zip(other.lam, other.basis.T):
            self._turn(u * np.sqrt(e))
        gap, n = other.mean - self.mean, self.n + other.n
        self._turn(gap * np.sqrt(self.n / n * other.n))
        self.mean = self.mean + gap * (other.n / n)
        self.n = n

    def row(self, grp: int) -> pa.RecordBatch:
        flat = pa.array([self.basis.ravel()], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array([grp]), pa.array([self.n]), pa.array([self.mean], pa.list_(pa.float64())),
                                           pa.array([self.lam], pa.list_(pa.float64())), flat], names=["grp", "n", "mean", "lam", "basis"])


def _spectra(dim: int, rank: int, centre: np.ndarray):
    def run(batches):
        from pyspark import TaskContext
        own = Spectrum(dim, rank)
        for b in batches:
            for _, x in vectors(b.column("embedding"), dim).values():
                for v in (x - centre).astype(float):
                    own.add(v)
        if own.n:
            yield own.row(TaskContext.get().partitionId())
    return run


def _merged(dim: int, rank: int):
    def run(key, found):
        rows = sorted(found.to_pylist(), key=lambda r: r["grp"])
        own = Spectrum(dim, rank)
        for r in rows:
            own.merge(Spectrum(dim, rank, r["n"], r["mean"], r["lam"], r["basis"]))
        return pa.Table.from_batches([own.row(int(key[0].as_py()))])
    return run


# --- distributed passes over the centred rows ---------------------------------

def _products(dim: int, centre, rest, basis):
    """Per task: sum of y (y' basis) over its centred rows y, and (place -1) the sum of y'y."""
    def run(batches):
        total, square, some = np.zeros((dim, basis.shape[1])), 0.0, False
        for b in batches:
            for _, x in vectors(b.column("embedding"), dim).values():
                y = (x - centre) - rest
                total += y.T @ (y @ basis)
                square += float((y * y).sum())
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, total.size, dtype=np.int32)), pa.array(np.append(square, total.ravel()))],
                                             names=["pos", "s"])
    return run


def _covariances(dim: int, centre, rest, scaled):
    def run(batches):
        k = scaled.shape[1]
        total, some = np.zeros((k, k)), False
        for b in batches:
            for _, x in vectors(b.column("embedding"), dim).values():
                z = ((x - centre) - rest) @ scaled
                total += z.T @ z
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["pos", "s"])
    return run


def _summed(df: DataFrame, size: int) -> np.ndarray:
    out = np.zeros(size)
    for r in df.groupBy("pos").agg(F.sum("s").alias("s")).collect():
        out[r["pos"]] = r["s"]
    return out


@dataclass
class Whitening:
    """A fitted transform: (x - sums / n) projected on ``components`` (columns), over the root of ``values``."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    passes: int

    @property
    def dim(self) -> int:
        return len(self.sums)

    def centre(self):
        """The mean as a whole number and the rest, so that centring loses no digits."""
        whole = np.array([round(int(s) / self.n) for s in self.sums], np.int64)
        rest = np.array([(int(s) - int(c) * self.n) / self.n for s, c in zip(self.sums, whole)])
        return whole, rest

    def usable(self) -> np.ndarray:
        return self.values > self.dim * EPS * max(float(self.values[0]), 0.0) if len(self.values) else np.zeros(0, bool)


def _orthonormal(a: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns, those that depend on earlier ones left out."""
    out = np.zeros((len(a), 0))
    for v in a.T:
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v = v / size
        for _ in range(2):
            v = v - out @ (out.T @ v)
        left = np.linalg.norm(v)
        if left > 1e-10:
            out = np.column_stack([out, v / left])
    return out


def fit_whitening(df: DataFrame, k: int = COMPONENTS, *, rank: int = RANK, fan_in: int = FAN_IN) -> Whitening | None:
    """The whitening of the ``embedding`` column's ``k`` leading components; None without a usable vector."""
    rows = df.select("embedding")
    sums = written(rows.mapInArrow(_sums, "dim int, pos int, s long").groupBy("dim", "pos").agg(F.sum("s").alias("s")), "embedding-sums")
    widest = sums.filter("pos = -1").orderBy(F.desc("s"), F.desc("dim")).head()
    if widest is None:
        return None
    dim, n = widest["dim"], widest["s"]
    s = {r["pos"]: r["s"] for r in sums.filter((F.col("dim") == dim) & (F.col("pos") >= 0)).collect()}
    k, rank = min(k, dim), max(rank, k + GUARDS)
    model = Whitening(n, np.array([s[i] for i in range(dim)], np.int64), np.zeros((dim, 0)), np.zeros(0), 0.0, 0.0, 0)
    centre, rest = model.centre()

    part = written(rows.mapInArrow(_spectra(dim, rank, centre), SPECTRUM), "spectra")
    while part.count() > 1:
        # tasks are numbered anew so that a round leaves one spectrum of each ``fan_in``
        at = {g: i // fan_in for i, g in enumerate(sorted(r["grp"] for r in part.select("grp").collect()))}
        place = F.create_map(*[F.lit(x) for pair in at.items() for x in pair])
        part = written(part.groupBy(place[F.col("grp")].cast("long").alias("to")).applyInArrow(_merged(dim, rank), SPECTRUM), "spectra")
    r = part.head()
    basis = np.array(r["basis"], float).reshape(dim, len(r["lam"]))[:, ::-1][:, :k + GUARDS]
    basis = _orthonormal(np.column_stack([basis, np.eye(dim)[:, :max(0, min(k, dim) - basis.shape[1])]]))

    before = np.inf
    for model.passes in range(1, PASSES + 1):
        made = _summed(rows.mapInArrow(_products(dim, centre, rest, basis), "pos int, s double"), dim * basis.shape[1] + 1) / n
        model.trace, applied = made[-1], made[:-1].reshape(dim, -1)
        inner = basis.T @ applied
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        turn = turn[:, ::-1]
        ritz, values = basis @ turn, np.maximum(values[::-1], 0.0)
        off = applied @ turn[:, :k] - ritz[:, :k] * values[:k]
        worst = np.linalg.norm(off, axis=0).max() / values[0] if values[0] > 0 else 0.0
        model.components, model.values = ritz[:, :k], values[:k]
        if basis.shape[1] == dim or worst <= 4 * EPS * np.sqrt(dim) or worst > before / 2:
            break
        before = worst
        basis = _orthonormal(np.column_stack([ritz[:, :k + GUARDS], off]))
    top = np.abs(model.components).argmax(0)
    model.components = model.components * np.where(model.components[top, np.arange(model.components.shape[1])] < 0, -1.0, 1.0)

    ok = model.usable()
    if ok.any():
        scaled = model.components[:, ok] / np.sqrt(model.values[ok])
        cov = _summed(rows.mapInArrow(_covariances(dim, centre, rest, scaled), "pos int, s double"), scaled.shape[1] ** 2) / n
        model.identity_error = float(np.abs(cov.reshape(scaled.shape[1], -1) - np.eye(scaled.shape[1])).max())
    return model


def _whitened(model: Whitening):
    centre, rest = model.centre()
    ok, k = model.usable(), len(model.values)
    scaled = model.components / np.sqrt(np.where(ok, model.values, 1.0))
    share = model.values / model.trace if model.trace > 0 else np.zeros(k)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                piece = b.slice(lo, 4096)
                for at, x in vectors(piece.column("embedding"), model.dim).values():
                    y = (x - centre) - rest
                    size = (y * y).sum(1) * float(model.n) ** 2
                    far = x * model.n - model.sums
                    deviation = pa.array(np.where(size < 9.2e18, (far * far).sum(1), 0), mask=size >= 9.2e18)
                    each = np.repeat(np.arange(len(at)), k)
                    z = y @ scaled
                    yield pa.RecordBatch.from_arrays([
                        piece.column("vec_id").take(pa.array(at[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                        pa.array(np.full(len(each), model.n)), deviation.take(pa.array(each)),
                        pa.array(z.ravel(), mask=np.tile(~ok, len(at))), pa.array(np.tile(share, len(at))),
                        pa.array(np.full(len(each), model.identity_error))],
                        names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whiten(df: DataFrame, model: Whitening | None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per usable vector and component."""
    base = df.select("vec_id", "embedding")
    kind = base.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    return base.mapInArrow(_whitened(model), schema)


def query(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return whiten(rows, fit_whitening(rows))

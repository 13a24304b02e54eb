"""Robust covariance: minimum covariance determinant and Tyler's M-estimator.

Both iterate on p x p state held by the driver.  Every iteration is one or more
aggregates over all rows; rows never leave the executors.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from mirrorframe.functions import smallmat
from mirrorframe.functions.rankscan import cell_counts, medians
from mirrorframe.functions.trimscan import closest_moments
from mirrorframe.functions.vectors import Features, pack_blocks, vectorize, width
from mirrorframe.operators.moments import collect_moments, matrix_table, moment_partials

#: The deterministic starts, each a scatter of all rows that outliers move little.
STARTS = ("tanh", "rank", "score", "sign", "half", "pairs")
#: Cells of the distribution functions behind the rank and score starts, over this range of scaled values.
CDF_CELLS, CDF_RANGE = 1024, 16.0
#: Cells of the sums and differences behind the pairwise start, and how many counts a task keeps in one scan.
PAIR_CELLS, PAIR_COUNTS = 512, 1 << 21
#: Reciprocal condition at which the scatter of a subset counts as singular, and to which it is then raised.
SINGULAR, RAISED = 1e-9, 1e-3


@dataclass(frozen=True)
class RobustFit:
    """``ridge`` is 0, or the share of the unit matrix (in units of the features' scales) that a singular subset asked for."""

    n: int
    h: int
    mean: np.ndarray
    location: np.ndarray
    covariance: np.ndarray
    raw_location: np.ndarray
    raw_covariance: np.ndarray
    correction: float
    n_support: int
    log_dets: tuple[float, ...]
    converged: bool
    ridge: float


def default_support(n: int, p: int) -> int:
    return min(n, math.ceil(0.5 * (n + p + 1)))


# -- p x p helpers --------------------------------------------------------------------


def _log_det(s: np.ndarray) -> float:
    sign, value = np.linalg.slogdet(s)
    return float(value) if sign > 0 else -math.inf


def _inverse_root(s: np.ndarray) -> np.ndarray:
    """W with s^-1 = W W^T."""
    lam, q = np.linalg.eigh(s)
    return q / np.sqrt(np.maximum(lam, max(lam[-1], 1e-300) * 1e-14))


def _squared_distance(x: np.ndarray, mu: np.ndarray, root: np.ndarray) -> np.ndarray:
    z = (x - mu) @ root
    return np.einsum("ij,ij->i", z, z)


def _ridge_needed(s: np.ndarray) -> float:
    """Share of the unit matrix that lifts a singular scatter to the reciprocal condition ``RAISED``; 0 for a regular one."""
    lam = np.linalg.eigvalsh(s)
    if lam[0] > SINGULAR * max(lam[-1], 1e-300):
        return 0.0
    short = RAISED * lam[-1] - lam[0]
    return float(short / (short + 1.0 - RAISED)) if short > 0 else 1.0


def _ridged(s: np.ndarray, ridge: float) -> np.ndarray:
    return (1.0 - ridge) * s + ridge * np.eye(len(s)) if ridge else s


# -- the scale of the features ----------------------------------------------------------


@dataclass(frozen=True)
class _Frame:
    """Rows in robust units: centred by medians, scaled, and turned into the directions in which any row varies."""

    centre: np.ndarray
    scale: np.ndarray
    varies: np.ndarray  # positions of features with any variance
    turn: np.ndarray  # directions, as columns
    apart: np.ndarray  # what all rows have in common across these directions

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (x[:, self.varies] - self.centre) / self.scale

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x) @ self.turn

    def location(self, mu: np.ndarray, mean: np.ndarray) -> np.ndarray:
        out = mean.copy()
        out[self.varies] = self.centre + self.scale * (self.turn @ mu + self.apart)
        return out

    def covariance(self, s: np.ndarray, p: int) -> np.ndarray:
        out = np.zeros((p, p))
        out[np.ix_(self.varies, self.varies)] = (self.turn @ s @ self.turn.T) * np.outer(self.scale, self.scale)
        return out


def _frame(blocks: DataFrame, n: int, mean: np.ndarray, cov: np.ndarray) -> _Frame:
    sd = np.sqrt(np.diag(cov))
    varies = np.flatnonzero(sd > 0)
    mean, sd = mean[varies], sd[varies]
    pick = lambda x: x[:, varies]
    centre = medians(blocks, pick, n, mean - 4 * sd, mean + 4 * sd)
    spread = 1.4826 * medians(blocks, lambda x: np.abs(pick(x) - centre), n, np.zeros(len(sd)), 4 * sd)
    scale = np.where(spread > 0, spread, sd)  # over half of the values equal, as in rare indicators
    corr = cov[np.ix_(varies, varies)] / np.outer(sd, sd)
    lam, q = np.linalg.eigh(corr)
    spanned = q[:, lam > len(lam) * 1e-12 * lam[-1]]
    # the directions of the scaled rows that the same combinations span
    turn, _ = np.linalg.qr(spanned * (sd / scale)[:, None])
    z = (mean - centre) / scale
    return _Frame(centre, scale, varies, turn, z - turn @ (turn.T @ z))


# -- steps over all rows ------------------------------------------------------------------


def _c_step(blocks: DataFrame, frame: _Frame, states, h: int, cuts):
    """One C-step for several (mean, scatter) at once; ``cuts`` guess the cuts of squared distance.

    The h closest rows get weight 1.  Rows tied at the cut share what is left of h
    evenly, so the result depends on no order of the rows and the weights always
    add up to h.
    """
    fixed = [(mu, _inverse_root(s)) for mu, s in states]

    def distances(x):
        y = frame.rows(x)
        return y, np.column_stack([_squared_distance(y, mu, root) for mu, root in fixed])

    moved, cut, _ = closest_moments(blocks, distances, states[0][1].shape[0], h, cuts)
    return moved, cut


def _cdf_tables(blocks: DataFrame, frame: _Frame, n: int) -> np.ndarray:
    """Middle of the distribution function in each cell of each scaled feature."""
    counts = cell_counts(blocks, frame.scaled, len(frame.scale), -CDF_RANGE, CDF_RANGE, CDF_CELLS)
    return (np.cumsum(counts, axis=1) - 0.5 * counts) / n


def _cell_spread(counts: np.ndarray, width: float) -> np.ndarray:
    """The MAD of each column from its cells, as a standard deviation; values are spread evenly within a cell."""
    passed = np.concatenate([np.zeros((len(counts), 1)), np.cumsum(counts, axis=1)], axis=1) / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    edges = np.arange(counts.shape[1] + 1) * width
    out = np.empty(len(counts))
    for k, share in enumerate(passed):
        middle = np.interp(0.5, share, edges)
        low, high = 0.0, edges[-1]
        for _ in range(50):
            r = 0.5 * (low + high)
            inside = np.interp(middle + r, edges, share) - np.interp(middle - r, edges, share)
            low, high = (low, r) if inside >= 0.5 else (r, high)
        out[k] = 1.4826 * high
    return out


def _pairwise_scatter(blocks: DataFrame, frame: _Frame) -> np.ndarray:
    """Robust covariance of every pair of features: a quarter of the squared MAD of their sum, less that of their difference.

    The MADs come from ``PAIR_CELLS`` cells of sums and differences, for as many pairs in a scan as
    ``PAIR_COUNTS`` counts allow.
    """
    p = len(frame.scale)
    i, j = np.triu_indices(p, 1)
    step = max(1, PAIR_COUNTS // (2 * PAIR_CELLS))
    out = np.eye(p)
    for at in range(0, len(i), step):
        a, b = i[at : at + step], j[at : at + step]

        def both(x, a=a, b=b):
            z = frame.scaled(x)
            return np.concatenate([z[:, a] + z[:, b], z[:, a] - z[:, b]], axis=1)

        counts = cell_counts(blocks, both, 2 * len(a), -CDF_RANGE, CDF_RANGE, PAIR_CELLS)
        spread = _cell_spread(counts, 2 * CDF_RANGE / PAIR_CELLS) ** 2
        out[a, b] = out[b, a] = 0.25 * (spread[: len(a)] - spread[len(a) :])
    return out


def _start_scatters(blocks: DataFrame, frame: _Frame, n: int, starts: Sequence[str]):
    """The scatter of every start, in the frame's directions."""
    unknown = set(starts) - set(STARTS)
    if unknown or not starts:
        raise ValueError(f"starts are {STARTS}, not {sorted(unknown)}")
    p = len(frame.scale)
    table = _cdf_tables(blocks, frame, n) if {"rank", "score"} & set(starts) else np.zeros((p, CDF_CELLS))
    normal = NormalDist()
    score = np.vectorize(lambda u: normal.inv_cdf(min(max(u, 0.5 / n), 1 - 0.5 / n)))(table) if "score" in starts else table
    length = lambda z: np.sqrt((z * z).sum(axis=1, keepdims=True))
    half = medians(blocks, lambda x: length(frame.scaled(x)), n, [0.0], [4.0 * math.sqrt(p)])[0] if "half" in starts else 0.0

    def rows(x):
        z = frame.scaled(x)
        cell = np.clip((z + CDF_RANGE) * (CDF_CELLS / (2 * CDF_RANGE)), 0, CDF_CELLS - 1).astype(np.int64)
        norm = length(z)
        made = {
            "tanh": lambda: (np.tanh(z), None), "rank": lambda: (table[np.arange(p), cell], None), "score": lambda: (score[np.arange(p), cell], None),
            "sign": lambda: (np.vstack([z / np.where(norm > 0, norm, 1.0), -z / np.where(norm > 0, norm, 1.0)]), None),  # with its mirror image: centred at 0
            "half": lambda: (z, norm[:, 0] <= half),
        }
        return [made[s]() for s in one_scan]

    one_scan = [name for name in starts if name != "pairs"]
    found = collect_moments(moment_partials(blocks, rows)) if one_scan else {}
    out = []
    for name in starts:
        if name == "pairs":
            s = _pairwise_scatter(blocks, frame)
            out.append(frame.turn.T @ s @ frame.turn)
            continue
        n_rows, _, m2 = found[one_scan.index(name)]
        s = m2 / n_rows
        if name in ("tanh", "rank", "score"):
            d = np.sqrt(np.maximum(np.diag(s), 1e-300))
            s = s / np.outer(d, d)
        out.append(frame.turn.T @ s @ frame.turn)
    return out


def _starts(blocks: DataFrame, frame: _Frame, n: int, starts: Sequence[str]):
    """(mean, scatter) of every start: the axes of its scatter, with the median and the MAD of all rows along each."""
    axes = [np.linalg.eigh(s)[1] for s in _start_scatters(blocks, frame, n, starts)]
    along = np.concatenate(axes, axis=1)
    q = axes[0].shape[0]
    project = lambda x: frame.rows(x) @ along
    wide = np.full(along.shape[1], 8.0)
    middle = medians(blocks, project, n, -wide, wide)
    spread = 1.4826 * medians(blocks, lambda x: np.abs(project(x) - middle), n, 0 * wide, wide)
    out = []
    for k, e in enumerate(axes):
        m, lam = middle[k * q:(k + 1) * q], spread[k * q:(k + 1) * q] ** 2
        s = (e * lam) @ e.T
        out.append((e @ m, _ridged(s, _ridge_needed(s))))
    return out


def _finish(blocks, frame, mu, s, ridge, n, h, mean, log_dets, converged) -> RobustFit:
    """Median correction, then one reweighting step with the 97.5% chi-square cut."""
    p, q = len(mean), s.shape[0]
    shape = _ridged(s, ridge)
    root = _inverse_root(shape)
    distance = lambda x: _squared_distance(frame.rows(x), mu, root)
    half = float(medians(blocks, lambda x: distance(x)[:, None], n, [0.0], [4.0 * q])[0])
    correction = half / smallmat.chi2_quantile(0.5, q) if half > 0 else 1.0
    cut = smallmat.chi2_quantile(0.975, q) * correction
    support, m, m2 = collect_moments(moment_partials(blocks, lambda x: [(frame.rows(x), distance(x) <= cut)]))[0]
    final = m2 / support
    ridge = max(ridge, _ridge_needed(final))
    return RobustFit(n, h, mean, frame.location(m, mean), frame.covariance(_ridged(final, ridge), p), frame.location(mu, mean),
                     frame.covariance(shape * correction, p), correction, int(support), tuple(log_dets), converged, ridge)


def _descend(blocks, frame, states, n, h, max_steps, tol):
    """C-steps of all starts; after two the best one alone goes on until its determinant no longer falls."""
    ridge = 0.0
    moved, _ = _c_step(blocks, frame, states, -(-n // 2), [None] * len(states))
    cuts = [None] * len(states)
    log_dets: list[float] = []
    converged = False
    for step in range(max_steps):
        needed = max(_ridge_needed(s) for _, s in moved)
        if needed > ridge:  # the objective changes with the ridge, so the descent starts anew
            ridge, log_dets = needed, []
        moved, cuts = _c_step(blocks, frame, [(mu, _ridged(s, ridge)) for mu, s in moved], h, cuts)
        value = [_log_det(_ridged(s, max(ridge, _ridge_needed(s)))) for _, s in moved]
        if len(moved) > 1 and step >= 1:
            best = int(np.argmin(value))
            moved, cuts, value = [moved[best]], [cuts[best]], [value[best]]
        log_dets.append(min(value))
        if len(moved) == 1 and len(log_dets) > 1 and log_dets[-2] - log_dets[-1] <= tol:
            converged = True
            break
    mu, s = moved[0]
    return mu, s, max(ridge, _ridge_needed(s)), log_dets, converged


def mcd_refine(df: DataFrame, features: Features, mu: np.ndarray, sigma: np.ndarray, steps: int, h: int | None = None) -> RobustFit:
    """A fixed number of C-steps from a given start, then correction and reweighting."""
    blocks = pack_blocks(vectorize(df, features))
    n, p = _rows(blocks), len(mu)
    h = default_support(n, p) if h is None else h
    frame = _Frame(np.zeros(p), np.ones(p), np.arange(p), np.eye(p), np.zeros(p))
    state, cuts, log_dets = (np.asarray(mu, float), sigma), [None], []
    for _ in range(steps):
        (state,), cuts = _c_step(blocks, frame, [state], h, cuts)
        log_dets.append(_log_det(state[1]))
    return _finish(blocks, frame, *state, 0.0, n, h, np.asarray(mu, float), log_dets, False)


def mcd_fit(df: DataFrame, features: Features, support: float | None = None, starts: Sequence[str] = STARTS, max_steps: int = 100, tol: float = 1e-9, persist: bool = True) -> RobustFit:
    """Minimum covariance determinant from deterministic starts (Hubert, Rousseeuw and Verdonck, 2012).

    Nothing is drawn, so the fit is the same for any key, order or layout of the rows;
    it changes with the units of the features as a covariance does.  The starts are the
    published six: correlations of tanh values, of ranks and of normal scores, the
    spatial sign covariance, the covariance of the half closest to the medians, and
    the pairwise covariances of Gnanadesikan and Kettenring.  Ranks come from
    ``CDF_CELLS`` cells, the scales of sums and differences from ``PAIR_CELLS``.

    Linear relations that hold in all rows, as among the indicators of a factor, stay
    relations of the result.  If more than half of the rows fulfil another one (rare
    indicators do), the subset is singular: its scatter gets the share ``ridge`` of the
    unit matrix, as in the regularised estimator of Boudt et al. (2020), and a warning says so.
    ``converged`` tells whether the last step lowered the log-determinant by no more than ``tol``.
    """
    p = width(df, features)
    blocks = pack_blocks(vectorize(df, features))
    if persist:
        blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        total = collect_moments(moment_partials(blocks)).get(0)
        if total is None or total[0] < 2:
            raise ValueError("not enough rows for a covariance")
        n, mean, cov = int(total[0]), total[1], total[2] / total[0]
        if not (np.diag(cov) > 0).any():
            raise ValueError("no feature has any variance")
        frame = _frame(blocks, n, mean, cov)
        h = default_support(n, p) if support is None else int(support * n)
        found = _descend(blocks, frame, _starts(blocks, frame, n, starts), n, h, max_steps, tol)
        mu, s, ridge, log_dets, converged = found
        fit = _finish(blocks, frame, mu, s, ridge, n, h, mean, log_dets, converged)
        if fit.ridge:
            warnings.warn(f"over half of the rows lie in a hyperplane: the scatter was ridged by {fit.ridge:.3g}", stacklevel=2)
        if not converged:
            warnings.warn(f"no convergence in {max_steps} steps", stacklevel=2)
        return fit
    finally:
        if persist:
            blocks.unpersist()


def _rows(blocks: DataFrame) -> int:
    return int(blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0])


def robust_covariance_mcd(df: DataFrame, features: Features, support: float | None = None, starts: Sequence[str] = STARTS) -> DataFrame:
    """The reweighted MCD covariance as ``(i, j, v)``."""
    return matrix_table(df.sparkSession, mcd_fit(df, features, support, starts).covariance)


# -- Tyler's M-estimator -----------------------------------------------------------------


@dataclass(frozen=True)
class TylerFit:
    n: int
    scatter: np.ndarray
    iterations: int
    error: float
    converged: bool


def tyler_fit(df: DataFrame, features: Features, tol: float = 1e-4, maxiter: int = 100, persist: bool = True) -> TylerFit:
    """Fixed point ``S <- (p/n) sum x x^T / (x^T S^-1 x)``; zero rows are left out.

    A term does not change when its row is scaled, so rows need not be brought
    to unit length first.
    """
    blocks = pack_blocks(vectorize(df, features), skip_zero_rows=True)
    if persist:
        blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = _rows(blocks)
        if n == 0:
            raise ValueError("no row with a non-zero feature")
        p = width(df, features)
        scatter, error, steps = np.eye(p), math.inf, 0
        while error > tol and steps < maxiter:
            weigh = _tyler_weights(np.linalg.inv(scatter))
            state = collect_moments(moment_partials(blocks, weigh, centred=False))[0]
            moved = state[2] * (p / n)
            error, scatter, steps = float(np.linalg.norm(scatter - moved)), moved, steps + 1
        if error > tol > 0:
            warnings.warn(f"no convergence in {maxiter} steps: the last one moved the scatter by {error:.3g}", stacklevel=2)
        return TylerFit(n, scatter, steps, error, error <= tol)
    finally:
        if persist:
            blocks.unpersist()


def _tyler_weights(inverse):
    def weigh(x):
        q = np.einsum("ij,ij->i", x @ inverse, x)
        return [np.divide(1.0, q, out=np.zeros_like(q), where=q > 0)]

    return weigh


def tyler_scatter(df: DataFrame, features: Features, tol: float = 1e-4, maxiter: int = 100) -> DataFrame:
    """The scatter matrix as ``(i, j, v)``."""
    return matrix_table(df.sparkSession, tyler_fit(df, features, tol, maxiter).scatter)

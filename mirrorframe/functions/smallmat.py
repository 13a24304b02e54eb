"""NumPy helpers on p x p matrices (p features; never rows of the data)."""

from __future__ import annotations

import math

import numpy as np


#: How far a search from a known solution goes towards it, and the weight of the barrier with which it begins there.
WARM = ((0.99, 5.0**-9), (0.9, 5.0**-8), (0.7, 5.0**-6), (0.5, 5.0**-5), (0.3, 5.0**-4))


def correlation(sigma: np.ndarray) -> np.ndarray:
    constant = np.flatnonzero(np.diag(sigma) <= 0)
    if constant.size:
        raise ValueError(f"features without variance at positions {constant.tolist()}")
    d = np.sqrt(np.diag(sigma))
    return sigma / np.outer(d, d)


def lambda_min(a: np.ndarray) -> float:
    return float(np.linalg.eigvalsh(a)[0])


def indefinite(a: np.ndarray) -> bool:
    """Whether a symmetric matrix has an eigenvalue below zero beyond the rounding of its entries."""
    lam = np.linalg.eigvalsh(a)
    return bool(lam[0] < -len(a) * 64 * np.finfo(float).eps * max(abs(lam[0]), abs(lam[-1])))


def max_sum_s(corr: np.ndarray, tol: float = 0.0, start: np.ndarray | None = None, count: list[int] | None = None) -> np.ndarray:
    """Maximise sum(s) subject to 0 <= s <= 1 and diag(s) + tol*I <= 2*corr.

    ``start`` may be the solution for a similar matrix: the search then begins near it,
    with a weaker barrier, and takes fewer steps.  ``count`` is given the number of Newton steps.

    Log-barrier Newton.  The barrier keeps every iterate strictly feasible; the
    gap to the optimum is below 3*p*mu at the end.  Without any feasible s the
    program is an error; where only s = 0 is feasible that is the result.
    """
    p = corr.shape[0]
    a = 2.0 * corr - tol * np.eye(p)
    floor = lambda_min(a)
    rounding = p * 64 * np.finfo(float).eps
    if floor < -rounding:
        raise ValueError(f"no s is feasible: the smallest eigenvalue of the correlation matrix, {0.5 * (floor + tol):.3g}, is below {0.5 * tol:.3g}; add a ridge")
    if floor <= rounding:
        return np.zeros(p)

    def objective(s, mu):
        if (s <= 0).any() or (s >= 1).any():
            return -np.inf, None
        try:
            low = np.linalg.cholesky(a - np.diag(s))
        except np.linalg.LinAlgError:
            return -np.inf, None
        barrier = 2.0 * np.log(np.diag(low)).sum() + np.log(s).sum() + np.log1p(-s).sum()
        return s.sum() + mu * barrier, low

    inner = np.full(p, 0.5 * min(1.0, floor))
    s, mu, steps, warm = inner, 1.0, 0, False
    if start is not None:
        for near, barrier in WARM:  # inside, as the other solution lies on its own border
            s = near * np.clip(start, 0.0, 1.0) + (1.0 - near) * inner
            if objective(s, 1.0)[1] is not None:
                mu, warm = barrier, True
                break
        else:
            s = inner
    while mu > 1e-11:
        value, low = objective(s, mu)
        for _ in range(50):
            steps += 1
            inv_low = np.linalg.solve(low, np.eye(p))
            m = inv_low.T @ inv_low
            grad = 1.0 + mu * (1.0 / s - 1.0 / (1.0 - s) - np.diag(m))
            hess = mu * (m * m + np.diag(1.0 / s**2 + 1.0 / (1.0 - s) ** 2))
            step = np.linalg.solve(hess, grad)
            decrement = float(grad @ step)
            if decrement < 1e-10:
                break
            t = 1.0
            while t > 1e-12:
                trial, trial_low = objective(s + t * step, mu)
                if trial >= value + 0.25 * t * decrement:
                    break
                t *= 0.5
            else:
                break
            s, value, low = s + t * step, trial, trial_low
        if warm and decrement >= 1e-10:  # the start was too far off for so weak a barrier
            s, mu = inner, 5.0
        warm = False
        mu /= 5.0
    if count is not None:
        count.append(steps)
    # the barrier stops just short of an upper bound that the matrix does not limit
    full = np.where(s > 1.0 - 1e-6, 1.0, s)
    return full if lambda_min(a - np.diag(full)) >= 0.0 else np.clip(s, 0.0, 1.0)


def feasible_scale(corr: np.ndarray, s: np.ndarray, step: float = 0.01) -> float:
    """Largest tested gamma in [0, 1] with 2*corr - gamma*diag(s) positive semidefinite."""
    def feasible(g):
        return lambda_min(2.0 * corr - g * np.diag(s)) >= -1e-10

    if feasible(1.0):
        return 1.0
    low, high = 0.0, 1.0
    while high - low > step:
        mid = 0.5 * (low + high)
        low, high = (mid, high) if feasible(mid) else (low, mid)
    return low


def pairwise_distance(rows: np.ndarray) -> np.ndarray:
    out = np.empty((rows.shape[0], rows.shape[0]))
    for i, r in enumerate(rows):
        out[i] = np.sqrt(((rows - r) ** 2).sum(axis=1))
    return out


def agglomerate(dist: np.ndarray, method: str, n_groups: int | None = None, cut: float | None = None) -> np.ndarray:
    """Hierarchical grouping by the Lance-Williams update; labels 1.. by first member.

    Stops at ``n_groups`` groups or before the first merge above ``cut``.
    Distances of complete and Ward linkage never decrease, so the early stop is
    the same as cutting the finished tree.  Of equally near pairs the first merges, by its
    first member and then by its second.

    Every group keeps its nearest later group, so a merge looks at one number for each
    group; only groups whose nearest was one of the two merged are searched anew, as
    neither linkage brings a merged group nearer than its parts were.
    """
    if method not in ("complete", "ward"):
        raise ValueError(f"unknown linkage: {method}")
    p = dist.shape[0]
    d = dist.astype(float).copy()
    if method == "ward":
        d = d**2
    np.fill_diagonal(d, np.inf)
    size, member = np.ones(p), np.arange(p)
    near, far = np.full(p, p, dtype=np.int64), np.full(p, np.inf)  # nearest later group, and how far it is

    def search(i: int) -> None:
        if i + 1 < p:
            j = i + 1 + int(np.argmin(d[i, i + 1 :]))
            near[i], far[i] = j, d[i, j]

    for i in range(p):
        search(i)
    for _ in range(p - (n_groups or 1)):
        a = int(np.argmin(far))
        b = int(near[a])
        height = math.sqrt(far[a]) if method == "ward" else far[a]
        if not np.isfinite(height) or (cut is not None and height > cut):
            break
        if method == "complete":
            row = np.maximum(d[a], d[b])
        else:
            row = ((size[a] + size) * d[a] + (size[b] + size) * d[b] - size * d[a, b]) / (size[a] + size[b] + size)
        row[[a, b]] = np.inf
        d[a, :], d[:, a] = row, row
        d[b, :], d[:, b] = np.inf, np.inf
        size[a] += size[b]
        member[member == b] = a
        near[b], far[b] = p, np.inf
        stale = (near == a) | (near == b)
        stale[a] = True
        stale[b] = False
        for i in np.flatnonzero(stale).tolist():
            search(i)
        # rounding may bring the merged group nearer by a last digit
        nearer = np.flatnonzero(row[:a] < far[:a])
        near[nearer], far[nearer] = a, row[nearer]
    _, first = np.unique(member, return_index=True)
    order = {member[f]: k + 1 for k, f in enumerate(sorted(first))}
    return np.array([order[m] for m in member], dtype=int)


def chi2_cdf(x: float, df: float) -> float:
    """Chi-square distribution function (regularised lower incomplete gamma)."""
    if x <= 0:
        return 0.0
    a, z = df / 2.0, x / 2.0
    scale = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= z / k
            total += term
        return total * scale
    tiny = 1e-300
    b = z + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return 1.0 - scale * h


def chi2_quantile(prob: float, df: float) -> float:
    low, high = 0.0, df + 10.0
    while chi2_cdf(high, df) < prob:
        high *= 2.0
    for _ in range(200):
        mid = 0.5 * (low + high)
        low, high = (mid, high) if chi2_cdf(mid, df) < prob else (low, mid)
    return 0.5 * (low + high)

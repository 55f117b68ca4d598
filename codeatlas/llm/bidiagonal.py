"""Largest singular values and right singular vectors of a triangle: Householder bidiagonalisation, dqds, twisted factorisations."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
CLOSE = 1e-5
"""Relative gap below which neighbouring values are one cluster, whose vectors are made orthogonal to each other."""


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit v such that (1 - 2 v v') x is (alpha, 0, ...), and alpha; v is zero where there is nothing to do."""
    norm = np.linalg.norm(x)
    if norm == 0 or not np.any(x[1:]):
        return np.zeros_like(x), float(x[0])
    alpha = -norm if x[0] > 0 else norm
    v = x.copy()
    v[0] -= alpha
    return v / np.linalg.norm(v), float(alpha)


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, superdiagonal, right reflectors) of U' R V; the i-th reflector works on the columns from i+1 on."""
    a, n, right = r.astype(float).copy(), r.shape[1], []
    diagonal, above = np.zeros(n), np.zeros(max(0, n - 1))
    for i in range(n):
        v, diagonal[i] = _reflector(a[i:, i])
        a[i:, i:] -= 2 * np.outer(v, v @ a[i:, i:])
        if i < n - 1:
            w, above[i] = _reflector(a[i, i + 1 :])
            a[i:, i + 1 :] -= 2 * np.outer(a[i:, i + 1 :] @ w, w)
            right.append(w)
    return diagonal, above, right


def turn_back(z: np.ndarray, right: list[np.ndarray]) -> np.ndarray:
    """Columns in the coordinates of the bidiagonal matrix, in those of the rows."""
    z = z.copy()
    for i in range(len(right) - 1, -1, -1):
        z[i + 1 :] -= 2 * np.outer(right[i], right[i] @ z[i + 1 :])
    return z


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float]:
    """One dqds transform, and the least of its differences; below zero, the shift was too large."""
    n, d = len(q), q[0] - shift
    least, new_q, new_e = d, [], []
    for i in range(n - 1):
        top = d + e[i]
        if d < 0 or top <= 0:
            return q, e, min(d, -0.0) if d < 0 else -shift
        t = q[i + 1] / top
        new_q.append(top)
        new_e.append(e[i] * t)
        d = d * t - shift
        least = min(least, d)
    return [*new_q, d], new_e, least


def _corner(q: list[float], e: list[float]) -> float:
    """The smaller eigenvalue of the last two rows' product, a good guess of the least one."""
    a, b, c = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
    half = (a - b) / 2
    root = (half * half + c) ** 0.5
    return max(0.0, b - c / (half + root) if half > 0 else (a + b) / 2 - root)


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of all singular values of a bidiagonal matrix, falling.

    Shifted quotient-difference transforms keep every value to high relative accuracy, as nothing is subtracted but the shift; a shift
    that goes below the least value is taken back and made smaller, down to none, which always works.
    """
    found, work = [], [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in above], 0.0)]
    while work:
        q, e, base = work.pop()
        idle = 0
        while q:
            if len(q) == 1:
                found.append(base + q[0])
                break
            tiny = (10 * EPS) ** 2
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= tiny * (base + min(q[i], q[i + 1])) or e[i] <= 1e-300), None)
            if cut is not None:
                work.append((q[cut + 1 :], e[cut + 1 :], base))
                q, e, idle = q[: cut + 1], e[:cut], 0
                continue
            if 1.5 * q[0] < q[-1]:  # the small values belong at the end
                q, e = _reversed(q, e)
            shift = _corner(q, e) * (1 - 8 * EPS) if idle < 40 else 0.0
            while True:
                new_q, new_e, least = _sweep(q, e, shift)
                if least >= 0 or shift == 0:
                    break
                shift = 0.0 if shift <= EPS * max(q[-1], 1e-300) else shift / 4
            q, e, base, idle = [max(x, 0.0) for x in new_q], new_e, base + shift, idle + 1
    return np.array(sorted(found, reverse=True))


def _reversed(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """The same matrix from its other end."""
    return q[::-1], e[::-1]


def _twisted(d: np.ndarray, low: np.ndarray, value: float) -> np.ndarray:
    """Vector of an eigenvalue of L D L' from the factorisations of L D L' - value from both ends, joined where they fit best."""
    n, floor = len(d), EPS * EPS * max(abs(value), 1e-300)
    plus, minus = np.zeros(n - 1), np.zeros(n - 1)
    s, p = np.zeros(n), np.zeros(n)
    s[0] = -value
    for i in range(n - 1):
        pivot = d[i] + s[i]
        pivot = pivot if abs(pivot) > floor else floor
        plus[i] = d[i] * low[i] / pivot
        s[i + 1] = plus[i] * low[i] * s[i] - value
    p[n - 1] = d[n - 1] - value
    for i in range(n - 2, -1, -1):
        pivot = d[i] * low[i] ** 2 + p[i + 1]
        pivot = pivot if abs(pivot) > floor else floor
        t = d[i] / pivot
        minus[i] = low[i] * t
        p[i] = p[i + 1] * t - value
    at = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -plus[i] * z[i + 1]
    for i in range(at, n - 1):
        z[i + 1] = -minus[i] * z[i]
        if abs(z[i + 1]) > 1e150:
            z /= abs(z[i + 1])
    return z / np.linalg.norm(z)


def _solve(diag: np.ndarray, off: np.ndarray, value: float, right: np.ndarray) -> np.ndarray:
    """Solution of (T - value) z = right for a tridiagonal T, by elimination with row exchanges."""
    n = len(diag)
    a, b, c, y = diag - value, np.append(off, 0.0), np.zeros(n), right.copy()
    floor = EPS * max(np.abs(diag).max(), 1e-300)
    below = off.copy()
    for i in range(n - 1):
        if abs(below[i]) > abs(a[i]):
            a[i], below[i] = below[i], a[i]
            b[i], a[i + 1] = a[i + 1], b[i]
            c[i], b[i + 1] = b[i + 1], 0.0
            y[i], y[i + 1] = y[i + 1], y[i]
        a[i] = a[i] if abs(a[i]) > floor else floor
        f = below[i] / a[i]
        a[i + 1] -= f * b[i]
        b[i + 1] -= f * c[i]
        y[i + 1] -= f * y[i]
    a[-1] = a[-1] if abs(a[-1]) > floor else floor
    z = np.zeros(n)
    for i in range(n - 1, -1, -1):
        z[i] = (y[i] - (b[i] * z[i + 1] if i + 1 < n else 0) - (c[i] * z[i + 2] if i + 2 < n else 0)) / a[i]
    return z / np.linalg.norm(z)


def _block_vectors(diagonal: np.ndarray, above: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest `want` eigenvalues of B'B for an unreduced bidiagonal block, with their vectors as columns."""
    n = len(diagonal)
    values = dqds(diagonal, above)[:want]
    if n == 1:
        return values, np.ones((1, len(values)))
    floor = EPS * max(np.abs(diagonal).max(), np.abs(above).max())
    a = np.where(np.abs(diagonal) > floor, diagonal, floor)
    diag, off = a * a, a[:-1] * above
    diag[1:] += above**2
    z = np.zeros((n, len(values)))
    group = 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLOSE * values[k - 1]:
            group = k
        z[:, k] = _twisted(a * a, above / a[:-1], value)
        if k > group:  # in a cluster: what is left beside the vectors before, sharpened by inverse iteration
            rng = np.random.RandomState(k)
            before = z[:, group:k]
            for _ in range(3):
                z[:, k] -= before @ (before.T @ z[:, k])
                if np.linalg.norm(z[:, k]) < 1e-3:
                    z[:, k] = rng.standard_normal(n)
                    z[:, k] -= before @ (before.T @ z[:, k])
                z[:, k] = _solve(diag, off, value, z[:, k])
            for _ in range(2):
                z[:, k] -= before @ (before.T @ z[:, k])
                z[:, k] /= np.linalg.norm(z[:, k])
    return values, z


def leading_directions(r: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest `want` eigenvalues of R'R, falling, and unit vectors as columns; those that are zero for R's size are left out."""
    n = r.shape[1]
    diagonal, above, right = bidiagonalise(np.vstack([r, np.zeros((max(0, n - len(r)), n))]))
    size = max([0.0, *np.abs(diagonal), *np.abs(above)])
    if size == 0:
        return np.zeros(0), np.zeros((n, 0))
    diagonal, above = diagonal / size, above / size
    parts, edges = [], [0, *(np.flatnonzero(np.abs(above) <= EPS) + 1).tolist(), n]
    for begin, end in zip(edges, edges[1:]):
        values, z = _block_vectors(diagonal[begin:end], above[begin : end - 1], min(want, end - begin))
        parts += [(value, begin, z[:, k]) for k, value in enumerate(values)]
    parts = [p for p in sorted(parts, key=lambda p: (-p[0], p[1])) if p[0] > (n * EPS) ** 2][:want]
    z = np.zeros((n, len(parts)))
    for k, (_, begin, part) in enumerate(parts):
        z[begin : begin + len(part), k] = part
    return np.array([p[0] for p in parts]) * size * size, turn_back(z, right)

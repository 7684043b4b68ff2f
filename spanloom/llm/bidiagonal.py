"""Singular values and right vectors of a small triangular matrix.

Householder reflections make it upper bidiagonal; the shifted differential qd algorithm finds the
squared singular values without subtracting entries; twisted factorisations give their vectors.
The matrix is square with as many columns as an embedding has dimensions, never a table.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
TINY = np.finfo(float).tiny
#: eigenvalues closer than this share of their size count as a cluster, whose vectors are made orthogonal
CLUSTER = 1e-3


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """v, tau and beta with (I - tau v v') x = beta e1."""
    scale = np.abs(x).max(initial=0.0)
    if not scale or not x[1:].any():
        return np.zeros_like(x), 0.0, float(x[0])
    y = x / scale
    beta = -np.copysign(np.sqrt(y @ y), y[0])
    v = y.copy()
    v[0] -= beta
    return v, float(2 / (v @ v)), float(beta * scale)


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, V): r = U B V' with diagonal a and upper diagonal b; U is not kept."""
    work = np.array(r, float)
    d = work.shape[1]
    right = np.eye(d)
    a, b = np.zeros(d), np.zeros(max(d - 1, 0))
    for k in range(d):
        v, tau, a[k] = _reflector(work[k:, k])
        if tau and k + 1 < d:
            work[k:, k + 1:] -= np.outer(tau * v, v @ work[k:, k + 1:])
        if k + 1 < d:
            v, tau, b[k] = _reflector(work[k, k + 1:])
            if tau:
                work[k + 1:, k + 1:] -= np.outer(work[k + 1:, k + 1:] @ v, tau * v)
                right[:, k + 1:] -= np.outer(right[:, k + 1:] @ v, tau * v)
    return a, b, right


def blocks(a: np.ndarray, b: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """B'B cut where it falls apart: (first index, q, e, l) of each part, L D L' with D = q and e = q l l.

    Entries below rounding of the largest one are zero. After a zero on the diagonal the entry to
    its right still counts for the next part; it is carried on by sums and products only.
    """
    a, b = a.copy(), b.copy()
    least = EPS * max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    a[np.abs(a) <= least], b[np.abs(b) <= least] = 0.0, 0.0
    out, start, carry = [], 0, 0.0
    q, l = [], []
    for i in range(len(a)):
        q.append(a[i] * a[i] + carry)
        off = a[i] * b[i] if i + 1 < len(a) else 0.0
        if off:
            l.append(off / q[-1])
            carry = b[i] * b[i] * (carry / q[-1])
        else:
            ll = np.array(l)
            out.append((start, np.array(q), np.array(q[:-1]) * ll * ll, ll))
            carry = b[i] * b[i] if i + 1 < len(a) else 0.0
            start, q, l = i + 1, [], []
    return out


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]] | None:
    """One step; None if the shift was above the least eigenvalue. The third list has the step's d."""
    qq, ee, dd = [0.0] * len(q), [0.0] * len(e), [0.0] * len(q)
    d = q[0] - shift
    for i in range(len(e)):
        if d < 0:
            return None
        dd[i] = d
        qq[i] = d + e[i]
        if qq[i] == 0.0:
            ee[i], d = 0.0, q[i + 1] - shift
            continue
        t = q[i + 1] / qq[i]
        ee[i] = e[i] * t
        d = d * t - shift
    if d < 0:
        return None
    dd[-1] = qq[-1] = d
    return qq, ee, dd


def eigenvalues(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Eigenvalues of L D L', falling.

    Steps without a shift alternate with shifted ones. The former give the diagonal of the inverse, 1 / d, so 1 / sum(1 / d)
    is below the least eigenvalue: a shift that cannot fail but for rounding, and converges like Newton's method.
    """
    todo = [(q.tolist(), e.tolist(), 0.0)]
    out: list[float] = []
    tol = (10 * EPS) ** 2
    while todo:
        q_, e_, sigma = todo.pop()
        while q_:
            cut = next((i for i in range(len(e_) - 1, -1, -1) if e_[i] <= tol * (sigma + q_[i]) and e_[i] <= tol * (sigma + q_[i + 1]) or e_[i] < TINY), None)
            if len(q_) == 1:
                out.append(q_[0] + sigma)
                break
            if cut is not None:
                todo.append((q_[:cut + 1], e_[:cut], sigma))
                q_, e_ = q_[cut + 1:], e_[cut + 1:]
                continue
            plain = _dqds(q_, e_, 0.0)
            q_, e_, d = plain
            shift = 0.0 if min(d) <= 0 else 1 / sum(1 / x for x in d)
            while shift > EPS * sigma:
                step = _dqds(q_, e_, shift)
                if step is not None:
                    q_, e_, _ = step
                    sigma += shift
                    break
                shift *= 0.5
    return np.sort(np.array(out))[::-1]


class Twisted:
    """Twisted factorisation of L D L' - lam: from both ends to the place where the last pivot is least."""

    def __init__(self, q: np.ndarray, l: np.ndarray, lam: float) -> None:
        n = len(q)
        ql = q[:-1] * l
        small = EPS * max(lam, TINY / EPS) * EPS
        self.down, self.up = np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0))
        self.plus, self.minus = np.zeros(n), np.zeros(n)
        s, p = np.zeros(n), np.zeros(n)
        s[0] = -lam
        for i in range(n - 1):
            pivot = q[i] + s[i]
            self.plus[i] = pivot if abs(pivot) > small else -small
            self.down[i] = ql[i] / self.plus[i]
            s[i + 1] = self.down[i] * l[i] * s[i] - lam
        p[-1] = q[-1] - lam
        for i in range(n - 2, -1, -1):
            pivot = ql[i] * l[i] + p[i + 1]
            self.minus[i + 1] = pivot if abs(pivot) > small else -small
            self.up[i] = ql[i] / self.minus[i + 1]
            p[i] = p[i + 1] * (q[i] / self.minus[i + 1]) - lam
        gamma = s + p + lam
        self.k = int(np.abs(gamma).argmin())
        self.gamma = gamma[self.k] if abs(gamma[self.k]) > small else -small

    def vector(self) -> np.ndarray:
        """Solution for the right side gamma e_k, of length 1."""
        z = np.zeros(len(self.plus))
        z[self.k] = 1.0
        return self._spread(z)

    def _spread(self, z: np.ndarray) -> np.ndarray:
        for i in range(self.k - 1, -1, -1):
            z[i] -= self.down[i] * z[i + 1]
        for i in range(self.k, len(z) - 1):
            z[i + 1] -= self.up[i] * z[i]
        return z / (np.abs(z).max() or 1.0)

    def solve(self, y: np.ndarray) -> np.ndarray:
        """Direction of the solution for any right side."""
        k, y = self.k, y.copy()
        for i in range(k):
            y[i + 1] -= self.down[i] * y[i]
        for i in range(len(y) - 1, k, -1):
            y[i - 1] -= self.up[i - 1] * y[i]
        pivots = np.concatenate([self.plus[:k], [self.gamma], self.minus[k + 1:]])
        y /= pivots
        return self._spread(y / (np.abs(y).max() or 1.0))


def vectors(q: np.ndarray, l: np.ndarray, lams: np.ndarray) -> np.ndarray:
    """Unit eigenvectors as columns, for falling eigenvalues; those of a cluster are made orthogonal by inverse iteration."""
    out = np.zeros((len(q), len(lams)))
    first = 0
    rng = np.random.default_rng(0)
    for j, lam in enumerate(lams):
        if j and lams[j - 1] - lam > CLUSTER * lams[j - 1]:
            first = j
        fact = Twisted(q, l, lam)
        z = fact.vector()
        z /= np.sqrt(z @ z)
        near = out[:, first:j]
        if j > first:
            for _ in range(4):
                z = z - near @ (near.T @ z)
                if np.sqrt(z @ z) < 0.1:  # the same direction again: start elsewhere
                    z = rng.normal(size=len(q))
                    z -= near @ (near.T @ z)
                z = fact.solve(z / np.sqrt(z @ z))
                z /= np.sqrt(z @ z)
            z -= near @ (near.T @ z)
            z /= np.sqrt(z @ z)
            z -= near @ (near.T @ z)
        out[:, j] = z / np.sqrt(z @ z)
    return out


def right_singular(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values of ``r``, falling, and the right singular vectors as columns."""
    d = r.shape[1]
    if not d:
        return np.zeros(0), np.zeros((0, 0))
    scale = np.abs(r).max(initial=0.0) or 1.0
    a, b, right = bidiagonalise(r / scale)
    values, columns = [], []
    for start, q, e, l in blocks(a, b):
        lams = eigenvalues(q, e)
        z = np.zeros((d, len(q)))
        z[start:start + len(q)] = vectors(q, l, lams)
        values.append(lams)
        columns.append(z)
    value = np.concatenate(values)
    order = np.argsort(-value, kind="stable")
    return value[order] * scale * scale, (right @ np.concatenate(columns, axis=1))[:, order]

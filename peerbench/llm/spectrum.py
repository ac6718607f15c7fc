"""Leading eigenpairs of a symmetric matrix by slicing its spectrum.

By Sylvester's law of inertia the pivots of an LDL' factorisation of ``A - s I`` have as many negative signs
as ``A`` has eigenvalues below ``s``. Bisection on that count shuts each leading eigenvalue into an interval
of its own, Rayleigh quotient iteration then finds it (three times the digits in each step), and counts on
both sides of what was found certify its number. The matrix has the size of one row of the data.
"""

from __future__ import annotations

import numpy as np

_ALPHA = (1 + np.sqrt(17)) / 8


def eigenvalues_below(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of ``a`` are below ``shift``: negative pivots of LDL' with 1 x 1 and 2 x 2 pivots
    (a 2 x 2 pivot is taken only where it is indefinite, so it has one of each sign)."""
    m = np.array(a, float)
    np.fill_diagonal(m, m.diagonal() - shift)
    n, k, below = len(m), 0, 0

    def swap(i: int, j: int) -> None:
        if i != j:
            m[[i, j]] = m[[j, i]]
            m[:, [i, j]] = m[:, [j, i]]

    while k < n:
        step = 1
        off = np.abs(m[k + 1 :, k])
        most = off.max() if len(off) else 0.0
        if most > 0 and abs(m[k, k]) < _ALPHA * most:
            r = k + 1 + int(off.argmax())
            other = np.abs(m[k:, r])
            other[r - k] = 0.0
            widest = other.max()
            if abs(m[k, k]) * widest < _ALPHA * most * most:
                if abs(m[r, r]) >= _ALPHA * widest:
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    step = 2
        if step == 1:
            below += m[k, k] < 0
            if m[k, k] != 0:
                column = m[k + 1 :, k]
                m[k + 1 :, k + 1 :] -= np.outer(column, column / m[k, k])
        else:
            below += 1
            columns = m[k + 2 :, k : k + 2]
            m[k + 2 :, k + 2 :] -= columns @ np.linalg.solve(m[k : k + 2, k : k + 2], columns.T)
        k += step
    return int(below)


def _towards(a: np.ndarray, shift: float, x: np.ndarray, scale: float) -> np.ndarray:
    """One step of inverse iteration; an exact eigenvalue as shift is moved by a rounding."""
    for nudge in (0.0, 1.0, 4.0, 16.0):
        try:
            y = np.linalg.solve(a - (shift + nudge * np.finfo(float).eps * scale) * np.eye(len(a)), x)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(y).all():
            return y
    return x


def leading(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The up to ``most`` largest eigenvalues that rounding cannot have made out of zero, falling, and their
    unit eigenvectors as rows. Equal eigenvalues get orthogonal vectors; a vector's largest entry is positive."""
    d = len(a)
    scale = float(np.abs(a).sum(axis=1).max(initial=0.0))
    values, vectors = [], np.zeros((0, d))
    tiny = 4 * d * np.finfo(float).eps * scale
    above = lambda s: d - eigenvalues_below(a, s)
    draws = np.random.default_rng(1)

    def orthogonal(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - vectors.T @ (vectors @ x)
        return x / np.linalg.norm(x)

    for k in range(1, min(most, d) + 1):
        low, high = tiny, scale * (1 + 1e-12) + tiny
        counts = [above(low), above(high)]
        if scale == 0 or counts[0] < k:
            break
        value = None
        while value is None:
            alone = counts == [k, k - 1]
            narrow = high - low <= tiny
            if alone or narrow:
                x = orthogonal(draws.normal(size=d))
                middle = (low + high) / 2
                for _ in range(3 if alone else 8):
                    x = orthogonal(_towards(a, middle, x, scale))
                at = float(x @ a @ x)
                for _ in range(20 if alone else 0):
                    rest = np.linalg.norm(a @ x - at * x)
                    x = orthogonal(_towards(a, at, x, scale))
                    at = float(x @ a @ x)
                    if rest <= 2 * np.finfo(float).eps * scale:
                        break
                if narrow or low <= at <= high:
                    value = at
                    continue
            middle = (low + high) / 2
            n = above(middle)
            if n >= k:
                low, counts[0] = middle, n
            else:
                high, counts[1] = middle, n
        values.append(value)
        vectors = np.vstack([vectors, x * np.sign(x[np.abs(x).argmax()])])
    for k, value in enumerate(values, 1):
        if above(value + 8 * tiny) >= k or above(value - 8 * tiny) < k:
            raise ArithmeticError(f"eigenvalue {k} is not certified by its counts")
    return np.array(values), vectors

"""Singular values and right singular vectors of a small square matrix by way of a bidiagonal one.

``bidiagonal`` reduces the matrix by Householder reflections, A = U B V'. ``squared_values`` finds the
squares of B's singular values by quotient-difference sweeps with shifts (dqds), which never subtract
and so keep small values accurate to their last digits. ``vectors`` solves for one vector at a time:
B'B - s is factored from the top and from the bottom, both meet at the place where what is left is
least, and the vector follows from there by products alone. Values that lie within ``CLOSE`` of each
other are made orthogonal; where that leaves nothing, inverse iteration within their group does.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
TINY = np.finfo(float).tiny
CLOSE = 1e-3
SWEEPS = 60


def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit u and the first entry y of (1 - 2uu')x = (y, 0, …)."""
    size = float(np.linalg.norm(x))
    if size == 0.0:
        return np.zeros_like(x), 0.0
    first = -size if x[0] >= 0 else size
    u = x.copy()
    u[0] -= first
    return u / np.linalg.norm(u), first


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, upper diagonal, and V with A V = U B."""
    a = np.array(matrix, float)
    n = len(a)
    v = np.eye(n)
    diagonal, upper = np.zeros(n), np.zeros(max(n - 1, 0))
    for k in range(n):
        u, diagonal[k] = reflector(a[k:, k])
        a[k:, k + 1 :] -= 2.0 * np.outer(u, u @ a[k:, k + 1 :])
        if k + 1 < n:
            w, upper[k] = reflector(a[k, k + 1 :])
            a[k + 1 :, k + 1 :] -= 2.0 * np.outer(a[k + 1 :, k + 1 :] @ w, w)
            v[:, k + 1 :] -= 2.0 * np.outer(v[:, k + 1 :] @ w, w)
    return diagonal, upper, v


def safe_shift(q: list[float], e: list[float]) -> float:
    """A lower bound of the least value: the inverse of the trace of the inverse."""
    d, total = q[0], 1.0 / q[0]
    for i in range(len(e)):
        d = d * (q[i + 1] / (d + e[i]))
        if d <= 0.0:
            return 0.0
        total += 1.0 / d
    return (1.0 - 8.0 * EPS * len(q)) / total


def sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One dqds step; None if the shift is above the least value."""
    d = q[0] - shift
    new_q, new_e = [], []
    for i in range(len(e)):
        if d < 0.0:
            return None
        top = d + e[i]
        if top == 0.0:
            return None
        part = q[i + 1] / top
        new_q.append(top)
        new_e.append(e[i] * part)
        d = d * part - shift
    if d < 0.0:
        return None
    return [*new_q, d], new_e


def squared_values(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix without zeros on its diagonal, falling."""
    found: list[float] = []
    small = (10.0 * EPS) ** 2
    stack = [((diagonal**2).tolist(), (upper**2).tolist(), 0.0)]
    while stack:
        q, e, moved = stack.pop()
        sweeps = 0
        while len(q) > 1:
            # Values that many sweeps do not part are equal for all purposes: the limit grows
            limit = small * 16.0 ** (sweeps // (SWEEPS * len(q)))
            cut = next((i for i in range(len(e)) if e[i] <= limit * (moved + min(q[i], q[i + 1]))), None)
            if cut is not None:
                stack.append((q[: cut + 1], e[:cut], moved))
                q, e, sweeps = q[cut + 1 :], e[cut + 1 :], 0
                continue
            if 1.5 * q[0] < q[-1]:  # sweeps bring small values to the end
                q, e = q[::-1], e[::-1]
            shift = safe_shift(q, e)
            done = sweep(q, e, shift)
            while done is None:
                shift = shift * (1.0 - 1e-8) if shift > 1e-300 and sweeps % 2 else 0.0
                done = sweep(q, e, shift) if shift else plain_sweep(q, e)
                sweeps += 1
            q, e = done
            moved += shift
            sweeps += 1
        if q:
            found.append(moved + q[0])
    return np.array(sorted(found, reverse=True))


def plain_sweep(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """A step without shift; nothing in it can turn negative."""
    d = q[0]
    new_q, new_e = [], []
    for i in range(len(e)):
        top = max(d + e[i], TINY)
        part = q[i + 1] / top
        new_q.append(top)
        new_e.append(e[i] * part)
        d *= part
    return [*new_q, d], new_e


def twisted(diagonal: np.ndarray, upper: np.ndarray, value: float) -> np.ndarray:
    """Unit vector of B'B for a value, from the factorisation that is twisted where least is left."""
    n = len(diagonal)
    weight = diagonal**2  # B'B = L D L', L with the entries below on its lower diagonal
    lower = upper / diagonal[:-1]
    for _ in range(3):
        s, p = np.zeros(n), np.zeros(n)
        down, back = np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0))
        s[0] = -value
        for i in range(n - 1):
            pivot = s[i] + weight[i]
            pivot = pivot if abs(pivot) > TINY else TINY
            down[i] = weight[i] * lower[i] / pivot
            s[i + 1] = down[i] * lower[i] * s[i] - value
        p[n - 1] = weight[n - 1] - value
        for i in range(n - 2, -1, -1):
            pivot = weight[i] * lower[i] ** 2 + p[i + 1]
            pivot = pivot if abs(pivot) > TINY else TINY
            part = weight[i] / pivot
            back[i] = lower[i] * part
            p[i] = p[i + 1] * part - value
        left = s + p + value
        left = np.where(np.isfinite(left), left, np.inf)
        at = int(np.argmin(np.abs(left)))
        z = np.zeros(n)
        z[at] = 1.0
        for i in range(at - 1, -1, -1):
            z[i] = -down[i] * z[i + 1]
        for i in range(at, n - 1):
            z[i + 1] = -back[i] * z[i]
        square = float(z @ z)
        step = float(left[at]) / square
        if not np.isfinite(step) or abs(step) <= 4.0 * EPS * abs(value):
            break
        value += step  # a Rayleigh quotient, exact to the square of the vector's error
    return z / np.sqrt(square)


def against(z: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for other in others:
            z = z - (other @ z) * other
    return z


def inverse_iteration(diagonal: np.ndarray, upper: np.ndarray, value: float, others: list[np.ndarray]) -> np.ndarray:
    n = len(diagonal)
    product = np.diag(diagonal) + (np.diag(upper, 1) if n > 1 else 0.0)
    moved = product.T @ product - (value + 4.0 * EPS * max(value, TINY)) * np.eye(n)
    moved[np.diag_indices(n)] += EPS * np.abs(moved).max() * 1e-3
    z = np.random.default_rng(len(others)).standard_normal(n)
    for _ in range(5):
        z = against(z, others)
        z = np.linalg.solve(moved, z / np.linalg.norm(z))
        z = z / np.linalg.norm(z)
    z = against(z, others)
    return z / np.linalg.norm(z)


def blocks(upper: np.ndarray, least: float) -> list[tuple[int, int]]:
    """First and past the last place of parts that no entry above ``least`` joins."""
    cuts = [0, *(np.flatnonzero(np.abs(upper) <= least) + 1).tolist(), len(upper) + 1]
    return list(zip(cuts[:-1], cuts[1:]))


def right_vectors(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The largest squared singular values, their right vectors as columns, and the sum of all squares.

    Vectors have their largest entry positive. Values below the matrix's own rounding are 0 in truth
    or near it; callers leave them out.
    """
    n = len(matrix)
    scale = float(np.abs(matrix).max()) if n else 0.0
    if scale == 0.0:
        return np.zeros(0), np.zeros((n, 0)), 0.0
    diagonal, upper, v = bidiagonal(matrix / scale)
    size = max(np.abs(diagonal).max(), np.abs(upper).max() if n > 1 else 0.0)
    # Zeros on the diagonal become rounding errors, which they cannot be told from.
    floor = EPS * size
    diagonal = np.where(np.abs(diagonal) < floor, np.where(diagonal < 0, -floor, floor), diagonal)
    entries: list[tuple[float, int, int]] = []
    for start, end in blocks(upper, floor):
        entries += [(value, start, end) for value in squared_values(diagonal[start:end], upper[start : end - 1]).tolist()]
    entries.sort(key=lambda x: -x[0])
    chosen = entries[:count]
    out = np.zeros((n, len(chosen)))
    by_block: dict[int, list[tuple[float, np.ndarray]]] = {}
    for column, (value, start, end) in enumerate(chosen):
        a, b = diagonal[start:end], upper[start : end - 1]
        # Values of one block that are near this one, each near the one before
        group: list[np.ndarray] = []
        last = value
        for other, z in reversed(by_block.get(start, [])):
            if other - last > CLOSE * other:
                break
            group.append(z)
            last = other
        z = twisted(a, b, value)
        rest = against(z, group)
        length = float(np.linalg.norm(rest))
        z = rest / length if length > 0.5 else inverse_iteration(a, b, value, group)
        by_block.setdefault(start, []).append((value, z))
        out[start:end, column] = z
    out = v @ out
    out /= np.linalg.norm(out, axis=0)
    largest = np.abs(out).argmax(axis=0)
    out *= np.where(out[largest, np.arange(out.shape[1])] < 0, -1.0, 1.0)
    squares = np.array([value for value, *_ in entries])
    return squares[:count] * scale**2, out, float(squares.sum()) * scale**2

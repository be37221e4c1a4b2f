"""Singular values and right singular vectors of a small square matrix, by bidiagonal form.

Householder reflections bring the matrix to upper bidiagonal form B. Differential quotient-difference
steps with shifts (dqds) find the squares of the singular values of B. Twisted factorisations of
B'B - value then give the vectors, and the reflections carry them back. Plain numpy, for matrices of at
most a few thousand columns.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Vectors of values that are nearer than this (relatively) are made orthogonal to each other.
CLOSE = 1e-3


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, upper diagonal, V) with r = U B V' for some orthogonal U; r is square."""
    a, n = np.array(r, float), len(r)
    v = np.eye(n)
    for k in range(n):
        h, scale = _reflector(a[k:, k])
        a[k:, k:] -= np.outer(scale * h, h @ a[k:, k:])
        if k + 2 < n:
            h, scale = _reflector(a[k, k + 1:])
            a[k:, k + 1:] -= np.outer(a[k:, k + 1:] @ h, scale * h)
            v[:, k + 1:] -= np.outer(v[:, k + 1:] @ h, scale * h)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(h, scale): I - scale h h' turns x into a multiple of the first unit vector."""
    h, norm = x.astype(float).copy(), np.linalg.norm(x)
    if norm == 0:
        return h, 0.0
    h[0] += norm if h[0] >= 0 else -norm
    return h, 2 / (h @ h)


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Squares of the singular values, falling, of the bidiagonal matrix whose squared entries are q and e.

    A step without a shift gives the reciprocal diagonal of the inverse, whose sum bounds the least value
    from below (Newton's bound); the next step takes that bound as its shift, so that none ever fails.
    """
    q, e = [float(x) for x in q], [float(x) for x in e]
    found, shifted = [], 0.0
    floor = max(max(q, default=0.0), max(e, default=0.0)) * 1e-32
    q = [max(x, floor) for x in q]
    while q:
        if len(q) == 1:
            found.append(shifted + q.pop())
            break
        cut = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= EPS * EPS * (shifted + min(q[k], q[k + 1]))), None)
        if cut is not None:
            found += [shifted + x for x in dqds(np.array(q[cut + 1:]), np.array(e[cut + 1:]))] if cut + 1 < len(e) else [shifted + q[-1]]
            q, e = q[: cut + 1], e[:cut]
            continue
        if q[0] < q[-1]:  # small values are found at the end
            q, e = q[::-1], e[::-1]
        q, e, d = _step(q, e, 0.0)
        bound = 1 / sum(1 / x for x in d) if min(d) > 0 else 0.0
        bound *= 1 - 4 * EPS * len(q)
        tried = _step(q, e, bound) if bound > EPS * shifted else None
        if tried is not None and min(tried[2]) >= 0:
            q, e, shifted = tried[0], tried[1], shifted + bound
    return np.sort(np.array(found))[::-1]


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One differential step: new q and e, and the d of each place (negative if the shift was too large)."""
    d, new_q, new_e, ds = q[0] - shift, [], [], []
    for k in range(len(e)):
        ds.append(d)
        total = d + e[k]
        if total <= 0:
            return q, e, [-1.0]
        ratio = q[k + 1] / total
        new_q.append(total)
        new_e.append(e[k] * ratio)
        d = d * ratio - shift
    ds.append(d)
    return [*new_q, max(d, 0.0)], new_e, ds


def twisted(q: np.ndarray, l: np.ndarray, value: float, r: int | None, pick: int = 0) -> tuple[np.ndarray, float, int]:
    """(z, gamma, r): z solves (LDL' - value) z = gamma * unit vector r; without r, that of the ``pick``-th least gamma."""
    n = len(q)
    s, p, down, up = np.empty(n), np.empty(n), np.empty(max(n - 1, 0)), np.empty(max(n - 1, 0))
    tiny = max(abs(value), float(np.max(q))) * EPS * EPS or EPS
    s[0] = -value
    for k in range(n - 1):
        pivot = s[k] + q[k]
        pivot = pivot if abs(pivot) > tiny else tiny
        down[k] = q[k] * l[k] / pivot
        s[k + 1] = down[k] * l[k] * s[k] - value
    p[n - 1] = q[n - 1] - value
    for k in range(n - 2, -1, -1):
        pivot = q[k] * l[k] * l[k] + p[k + 1]
        pivot = pivot if abs(pivot) > tiny else tiny
        ratio = q[k] / pivot
        up[k] = l[k] * ratio
        p[k] = p[k + 1] * ratio - value
    gamma = s + p + value
    r = int(np.argsort(np.abs(gamma), kind="stable")[min(pick, n - 1)]) if r is None else r
    z = np.zeros(n)
    z[r] = 1.0
    for k in range(r - 1, -1, -1):
        z[k] = -down[k] * z[k + 1]
    for k in range(r, n - 1):
        z[k + 1] = -up[k] * z[k]
    return z, float(gamma[r]), r


def _block(d: np.ndarray, f: np.ndarray, count: int) -> list[tuple[float, np.ndarray]]:
    """The ``count`` largest (value, unit vector) of B'B for one unreduced block of B."""
    if len(d) == 1:
        return [(float(d[0] ** 2), np.ones(1))]
    least = 1e-16 * max(np.max(np.abs(d)), np.max(np.abs(f)))
    d = np.where(np.abs(d) < least, least, d)
    q, l = d * d, f / d[:-1]
    out: list[tuple[float, np.ndarray]] = []
    for value in dqds(q, f * f)[:count]:
        near = [z for other, z in out if abs(other - value) <= CLOSE * other]
        best = None
        for pick in range(min(len(q), 1 + 4 * len(near))):
            at = float(value)
            z, gamma, r = twisted(q, l, at, None, pick)
            for _ in range(2):  # the quotient gamma / z'z corrects the value
                change = gamma / (z @ z)
                if near or abs(change) <= EPS * abs(at):
                    break
                at += change
                z, gamma, r = twisted(q, l, at, r)
            z = z / np.linalg.norm(z)
            for _ in range(2):
                for other in near:
                    z = z - (other @ z) * other
            kept = np.linalg.norm(z)
            if kept > (0.0 if best is None else best[0]):
                best = kept, z / kept
            if kept > 0.5:
                break
        out.append((float(value), best[1] if best else np.zeros(len(q))))
    return out


def largest(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(squares of the ``count`` largest singular values of r, falling; their right singular vectors as columns)."""
    d, f, v = bidiagonalise(r)
    cuts = [k + 1 for k in range(len(f)) if abs(f[k]) <= EPS * (abs(d[k]) + abs(d[k + 1])) / 2]
    pairs = []
    for low, high in zip([0, *cuts], [*cuts, len(d)]):
        for value, z in _block(d[low:high], f[low: high - 1], count):
            whole = np.zeros(len(d))
            whole[low:high] = z
            pairs.append((value, whole))
    pairs.sort(key=lambda x: -x[0])
    values = np.array([x[0] for x in pairs[:count]])
    return values, v @ np.array([x[1] for x in pairs[:count]]).T.reshape(len(d), len(values))

"""Leading eigenpairs of a symmetric matrix by slicing its spectrum."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Growth bound of the pivoting of Bunch and Kaufman.
ALPHA = (1 + 17 ** 0.5) / 8


def below(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of symmetric a lie below shift: negative pivots of L D L^T of a - shift I, with pivots of one
    and two rows chosen so that they stay bounded. By Sylvester's law of inertia D has as many of them as a has."""
    a = a - shift * np.eye(len(a))
    count, k, n = 0, 0, len(a)
    while k < n:
        size = 1
        if k < n - 1:
            r = k + 1 + int(np.argmax(np.abs(a[k + 1:, k])))
            most, own = abs(a[r, k]), abs(a[k, k])
            if own < ALPHA * most:
                others = np.abs(a[r, k:])
                others[r - k] = 0
                widest = others.max()
                if own * widest < ALPHA * most * most:
                    size = 1 if abs(a[r, r]) >= ALPHA * widest else 2
                    if r != (to := k + size - 1):
                        a[[to, r]] = a[[r, to]]
                        a[:, [to, r]] = a[:, [r, to]]
        if size == 1:
            d, c = a[k, k], a[k + 1:, k]
            count += d < 0
            if d:
                a[k + 1:, k + 1:] -= np.outer(c, c / d)
        else:
            e, c = a[k:k + 2, k:k + 2], a[k + 2:, k:k + 2]
            count += 1  # the determinant of such a pivot is negative
            a[k + 2:, k + 2:] -= c @ np.linalg.solve(e, c.T)
        k += size
    return int(count)


def slices(a: np.ndarray, top: int, width: float) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues in [low, high)) by falling place: intervals that hold the `top` greatest eigenvalues, one each,
    or several where they are nearer to each other than width. Halved by counts until then."""
    n = len(a)
    reach = np.abs(a).sum(axis=1).max() + width
    todo, out, found = [(-reach, reach, 0, n)], [], 0
    while todo and found < top:
        low, high, under_low, under_high = todo.pop()
        if under_high == under_low:
            continue
        if under_high - under_low == 1 or high - low <= width:
            out.append((low, high, under_high - under_low))
            found += under_high - under_low
            continue
        middle = (low + high) / 2
        under = below(a, middle)
        todo += [(low, middle, under_low, under), (middle, high, under, under_high)]  # the upper half is taken first
    return out


def leading(a: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The min(top, n) greatest eigenvalues of symmetric a, falling, and their unit eigenvectors as columns, each with its
    largest entry (the first of equal ones) positive.

    Counts isolate an eigenvalue; Rayleigh quotient iteration inside its interval converges cubically; an iterate whose
    quotient leaves the interval halves it by another count instead. Counts on both sides of the result then certify that
    it is the eigenvalue of that number; ArithmeticError if not. Eigenvalues that doubles can't tell apart share a
    subspace, of which any orthonormal basis is returned.
    """
    n, top = len(a), min(top, len(a))
    size = float(np.abs(a).sum(axis=1).max(initial=0))
    if not size:
        return np.zeros(top), np.eye(n)[:, :top]
    a, blur = (a + a.T) / (2 * size), 4 * n * EPS  # of norm 1
    values, vectors, rng = [], np.zeros((n, 0)), np.random.default_rng(n)

    def apart(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - vectors @ (vectors.T @ x)
        return x / np.linalg.norm(x)

    def step(x: np.ndarray, shift: float) -> np.ndarray:
        try:
            y = np.linalg.solve(a - shift * np.eye(n), x)
        except np.linalg.LinAlgError:
            y = np.linalg.solve(a - (shift + blur) * np.eye(n), x)
        return apart(y / np.abs(y).max())

    def certain(value: float, first: int, last: int) -> bool:
        """Counts place the eigenvalues numbered first to last from the top at value."""
        return below(a, value - 2 * blur) <= n - last and below(a, value + 2 * blur) > n - first

    for low, high, held in slices(a, top, blur):
        above = len(values)
        for _ in range(min(held, top - above)):
            shift, x = (low + high) / 2, apart(rng.standard_normal(n))
            first, last = (above + 1, above + held) if held > 1 else (len(values) + 1,) * 2
            for turn in range(200):
                x = step(x, shift)
                value = float(x @ a @ x)
                near = np.linalg.norm(a @ x - value * x) <= blur
                if near and turn and certain(value, first, last):
                    break
                if held == 1 and low < value < high and not near:
                    shift = value
                elif held == 1 and high - low > blur:  # back to a shift that is nearer to this eigenvalue than to others
                    middle = (low + high) / 2
                    low, high = (middle, high) if below(a, middle) <= n - first else (low, middle)
                    shift, x = (low + high) / 2, apart(rng.standard_normal(n))
            else:
                raise ArithmeticError(f"eigenvalue {first} was not found where the counts place it")
            x = step(x, value) if held == 1 else apart(x)
            values.append(float(x @ a @ x))
            vectors = np.column_stack([vectors, x])
    order = np.argsort(-np.array(values), kind="stable")
    vectors = vectors[:, order]
    sign = np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(top)])
    return np.array(values)[order] * size, vectors * sign

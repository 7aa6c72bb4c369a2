"""Arithmetic in the prime field of order 2^61 - 1, vectorised and scalar.

numpy has no 128-bit product, so a product is put together from 31-bit halves;
2^61 = 1 in the field makes the reduction a shift and an addition.
"""

from __future__ import annotations

import numpy as np

P = (1 << 61) - 1
_P = np.uint64(P)
_M31 = np.uint64((1 << 31) - 1)
_M30 = np.uint64((1 << 30) - 1)
_1, _30, _31, _61 = (np.uint64(x) for x in (1, 30, 31, 61))


def mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Element-wise product of field elements held as uint64."""
    ah, al, bh, bl = a >> _31, a & _M31, b >> _31, b & _M31
    mid = al * bh + ah * bl
    r = ((ah * bh) << _1) + (mid >> _30) + ((mid & _M30) << _31) + al * bl
    r = (r >> _61) + (r & _P)
    return np.where(r >= _P, r - _P, r)


def sub(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Element-wise difference of field elements held as uint64."""
    return np.where(a >= b, a - b, a + _P - b)


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Element-wise sum of field elements held as uint64."""
    r = a + b
    return np.where(r >= _P, r - _P, r)


def segment_products(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Products of the rows of ``x`` (n, m) over the segments that begin at ``starts``.

    Neighbours are multiplied pairwise, so a segment of length s takes log2(s)
    vectorised steps.
    """
    n = len(x)
    sizes = np.diff(np.append(starts, n))
    while len(x) > len(sizes):
        owner = np.repeat(np.arange(len(sizes)), sizes)
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        rank = np.arange(len(x)) - first
        left = rank % 2 == 0
        has_right = left & (rank + 1 < sizes[owner])
        at = np.flatnonzero(left)
        out = x[at]
        paired = np.flatnonzero(has_right[at])
        out[paired] = mul(out[paired], x[at[paired] + 1])
        x, sizes = out, (sizes + 1) // 2
    return x


def poly_eval(coefficients: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Horner's rule per row: ``coefficients`` (n, d + 1) from the leading one down."""
    r = np.zeros(len(x), dtype=np.uint64)
    for k in range(coefficients.shape[1]):
        r = add(mul(r, x), coefficients[:, k])
    return r


def solve(rows: list[list[int]], unknowns: int) -> list[int] | None:
    """A solution of an augmented linear system over the field, free unknowns 0.

    None if the system is inconsistent.
    """
    rows = [r[:] for r in rows]
    pivots: list[int] = []
    at = 0
    for c in range(unknowns):
        k = next((i for i in range(at, len(rows)) if rows[i][c]), None)
        if k is None:
            continue
        rows[at], rows[k] = rows[k], rows[at]
        inv = pow(rows[at][c], P - 2, P)
        head = rows[at] = [v * inv % P for v in rows[at]]
        for i in range(len(rows)):
            if i != at and (f := rows[i][c]):
                rows[i] = [(v - f * h) % P for v, h in zip(rows[i], head)]
        pivots.append(c)
        at += 1
        if at == len(rows):
            break
    if any(r[unknowns] for r in rows[at:]):
        return None
    out = [0] * unknowns
    for i, c in enumerate(pivots):
        out[c] = rows[i][unknowns]
    return out


def poly_divmod(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Quotient and remainder; coefficients from the leading one down, ``b`` monic."""
    a, q = a[:], []
    while len(a) >= len(b):
        f = a[0]
        q.append(f)
        for i, v in enumerate(b):
            a[i] = (a[i] - f * v) % P
        a.pop(0)
    while a and not a[0]:
        a.pop(0)
    return q, a


def poly_gcd(a: list[int], b: list[int]) -> list[int]:
    """The monic greatest common divisor."""
    while b:
        inv = pow(b[0], P - 2, P)
        b = [v * inv % P for v in b]
        a, b = b, poly_divmod(a, b)[1]
    return a

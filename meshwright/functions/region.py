"""A region: some vertices of a large graph with all their edges, as whole-number arrays."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property

import numpy as np
import pandas as pd

Rows = dict[int, dict[int, int]]


class Region:
    """Vertices are known by their place in ``ids`` (sorted); places from ``n`` on are the rim.

    Edges are the rows (``src``, ``dst``, ``w``) sorted by ``src``: each edge between
    two inner vertices occurs in both directions, an edge to the rim once. Degrees
    are those of the whole graph, for rim vertices too.
    """

    def __init__(self, ids: np.ndarray, degree: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray, rim_ids: np.ndarray, rim_degree: np.ndarray):
        self.ids, self.degree, self.n = ids, degree, len(ids)
        self.src, self.dst, self.w = src, dst, w
        self.rim_ids, self.rim_degree = rim_ids, rim_degree

    @classmethod
    def build(cls, u: np.ndarray, v: np.ndarray, w: np.ndarray, du: np.ndarray, dv: np.ndarray, lone: np.ndarray | None = None, lone_degree: np.ndarray | None = None) -> Region:
        """From edge rows (u, v, w) with both ends' degrees; ``lone`` are vertices without edges."""
        lone = np.zeros(0, np.int64) if lone is None else lone
        every = np.concatenate([u, lone])
        ids, first = np.unique(every, return_index=True)
        degree = np.concatenate([du, np.zeros(len(lone), np.int64) if lone_degree is None else lone_degree])[first]
        order = np.argsort(u, kind="stable")
        u, v, w, dv = u[order], v[order], w[order], dv[order]
        at = np.minimum(np.searchsorted(ids, v), max(len(ids) - 1, 0))
        inner = ids[at] == v if len(ids) else np.zeros(len(v), bool)
        rim_ids, rim_first, rim_at = np.unique(v[~inner], return_index=True, return_inverse=True)
        dst = at.astype(np.int64)
        dst[~inner] = len(ids) + rim_at
        return cls(ids, degree, np.searchsorted(ids, u), dst, w, rim_ids, dv[~inner][rim_first])

    @classmethod
    def read(cls, pdf: pd.DataFrame) -> Region:
        """From rows (u, v, w, du, dv); a vertex without edges has null v."""
        has = pdf["v"].notna().to_numpy()
        e, alone = pdf if has.all() else pdf[has], pdf[~has]
        cols = [e[c].to_numpy(dtype=np.int64) for c in ("u", "v", "w", "du", "dv")]
        return cls.build(*cols, alone["u"].to_numpy(dtype=np.int64), alone["du"].to_numpy(dtype=np.int64))

    @classmethod
    def of(cls, rows: Rows, degree: dict[int, int]) -> Region:
        """From dictionaries of rows and degrees."""
        edges = [(u, v, w, degree[u], degree[v]) for u, r in rows.items() for v, w in r.items()]
        a = np.array(edges, dtype=np.int64).reshape(-1, 5)
        alone = [u for u, r in rows.items() if not r]
        return cls.build(*a.T, np.array(alone, dtype=np.int64), np.array([degree[u] for u in alone], dtype=np.int64))

    def as_rows(self) -> tuple[Rows, dict[int, int]]:
        """(rows, degrees) as dictionaries by vertex; the degrees name rim vertices too."""
        ids = np.concatenate([self.ids, self.rim_ids]).tolist()
        rows: Rows = {u: {} for u in self.ids.tolist()}
        for a, b, w in zip(self.src.tolist(), self.dst.tolist(), self.w.tolist()):
            rows[ids[a]][ids[b]] = w
        return rows, dict(zip(ids, np.concatenate([self.degree, self.rim_degree]).tolist()))

    def place(self, u: int) -> int:
        k = int(np.searchsorted(self.ids, u))
        if k == self.n or self.ids[k] != u:
            raise KeyError(u)
        return k

    @cached_property
    def inner(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(src, dst, w) of the rows between inner vertices."""
        k = self.dst < self.n
        return self.src[k], self.dst[k], self.w[k]

    @cached_property
    def near(self) -> list[list[tuple[int, int]]]:
        """Each inner vertex' (inner neighbour, weight) pairs."""
        out: list[list[tuple[int, int]]] = [[] for _ in range(self.n)]
        for a, b, w in zip(*(x.tolist() for x in self.inner)):
            out[a].append((b, w))
        return out

    @cached_property
    def leaving(self) -> np.ndarray:
        """The weight of each inner vertex' edges to the rim."""
        k = self.dst >= self.n
        return np.bincount(self.src[k], weights=self.w[k], minlength=self.n).astype(np.int64)

    def drawn(self, x: np.ndarray) -> np.ndarray:
        """The weighted sum of heights ``x`` over each inner vertex' inner neighbours."""
        a, b, w = self.inner
        return np.bincount(a, weights=w * x[b], minlength=self.n)

    def spill(self, x: np.ndarray) -> np.ndarray:
        """The same for the rim."""
        k = self.dst >= self.n
        return np.bincount(self.dst[k] - self.n, weights=self.w[k] * x[self.src[k]], minlength=len(self.rim_ids))

    def numbers(self, places: Iterable[int]) -> tuple[int, int]:
        """(volume, cut) of a set of inner vertices."""
        mark = np.zeros(self.n + len(self.rim_ids), dtype=bool)
        mark[list(places)] = True
        cut = int(self.w[mark[self.src] & ~mark[self.dst]].sum())
        return int(self.degree[mark[: self.n]].sum()), cut

    def within(self, places: Iterable[int]) -> Region:
        """The region of some of the inner vertices; the others become rim."""
        mark = np.zeros(self.n, dtype=bool)
        mark[list(places)] = True
        k = mark[self.src]
        ids = np.concatenate([self.ids, self.rim_ids])
        degree = np.concatenate([self.degree, self.rim_degree])
        s, t = self.src[k], self.dst[k]
        has = np.zeros(self.n, dtype=bool)
        has[s] = True
        alone = np.flatnonzero(mark & ~has)
        return Region.build(ids[s], ids[t], self.w[k], degree[s], degree[t], ids[alone], degree[alone])

"""Sequential safe composition on a small graph: one certified merge after another, each judged on the graph so far."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from fractions import Fraction

from meshwright.functions import exact
from meshwright.functions.region import Region, Rows

#: What each mode tries, stage by stage: pairs then blocks by uniform copies, blocks by
#: median copies, blocks by full pairs of members. A stage is left once nothing passes.
MODES = {"S": "S", "D": "D", "SD": "SD", "SW": "SW"}


@dataclass
class Quotient:
    """A graph of groups named by their least vertex; degrees and the volume stay those of all vertices."""

    rows: Rows
    degree: dict[int, int]
    m: int
    members: dict[int, list[int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.rows = {u: {v: w for v, w in r.items() if v != u} for u, r in self.rows.items()}
        self.degree = dict(self.degree)
        self.members = self.members or {u: [u] for u in self.rows}

    def merge(self, block: Iterable[int]) -> set[int]:
        """Unite groups under the least; returns every group whose own row or whose neighbour's degree has changed."""
        block = sorted(block)
        head, touched = block[0], set(block)
        for v in block[1:]:
            row = self.rows.pop(v)
            for x, w in row.items():
                del self.rows[x][v]
                if x != head:
                    self.rows[head][x] = self.rows[x][head] = self.rows[head].get(x, 0) + w
            self.degree[head] += self.degree.pop(v)
            self.members[head] += self.members.pop(v)
        return touched | self.rows[head].keys()

    def block(self, groups: Iterable[int]) -> Region:
        return Region.of({u: self.rows[u] for u in groups}, self.degree)

    def image(self, bank: list[list[int]]) -> list[tuple[int, ...]]:
        """The distinct images of blocks of vertices that span several groups, in lexicographic order."""
        home = {u: g for g, us in self.members.items() for u in us}
        images = {tuple(sorted({home[u] for u in b})) for b in bank}
        return sorted(i for i in images if len(i) > 1)


def _pair(q: Quotient, gamma: Fraction, settled: set[tuple[int, int]]) -> tuple[int, int] | None:
    """The first pair of affinity >= 0, in order of ids, whose best mixture copy loses nothing; failures are noted.

    A pair's verdict depends on its own rows and its neighbours' degrees alone, so
    failures stay valid until one of those changes.
    """
    order = sorted(q.rows)
    for i, u in enumerate(order):
        for v in order[i + 1 :]:
            if (u, v) in settled or not q.degree[u] or not q.degree[v]:
                continue
            if exact.affinity(q.rows, q.degree, q.m, gamma, u, v) >= 0 and exact.pair_copy(q.rows, q.degree, q.m, u, v, gamma)[1] >= 0:
                return u, v
            settled.add((u, v))
    return None


_BLOCK: dict[str, Callable[[Region, int, Fraction], str]] = {
    "S": exact.contrast_certificate,
    "D": exact.block_certificate,
    "W": exact.pairs_certificate,
}


def compose(
    rows: Rows, degree: dict[int, int], m: int, bank: list[list[int]] = (), gamma: Fraction = Fraction(1), mode: str = "S", cap: int | None = None,
    progress: Callable[[dict], None] | None = None,
) -> tuple[list[list[int]], list[dict]]:
    """(groups, operations) after merging one certified pair or block at a time until nothing more is certified.

    Blocks of the bank are mapped onto the present groups and equal images dropped
    before ``cap`` is applied; the first certified one in lexicographic order is
    merged and all is judged anew. Each operation, told to ``progress`` as it happens,
    is a dictionary of stage, block (of groups), size and groups left.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    q, log = Quotient(rows, degree, m), []
    for stage in MODES[mode]:
        pairs: set[tuple[int, int]] = set()
        blocks: dict[tuple[int, ...], bool] = {}
        while True:
            found: tuple[int, ...] | None = _pair(q, gamma, pairs) if stage == "S" else None
            if found is None:
                for image in q.image(list(bank)):
                    if cap is not None and len(image) > cap or min(q.degree[u] for u in image) <= 0:
                        continue
                    if image not in blocks:
                        blocks[image] = _BLOCK[stage](q.block(image), m, gamma).startswith("verified")
                    if blocks[image]:
                        found = image
                        break
            if found is None:
                break
            changed = q.merge(found)
            pairs = {p for p in pairs if not changed & set(p)}
            blocks = {b: ok for b, ok in blocks.items() if not changed & set(b)}
            log.append({"stage": stage, "block": list(found), "size": len(found), "left": len(q.rows)})
            if progress:
                progress(dict(log[-1]))
    return sorted(sorted(g) for g in q.members.values()), log

"""Common neighbours and triangles, found by tasks that read a graph's rows block by block.

Vertices have colours; rows are written once to the shared folder, a block per pair
of colours. A task takes the pairs of two colours and, one third colour after another,
the rows of both ends, so that neither wedges nor copies of the rows are shuffled.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.operators.footers import open_parquet
from meshwright.operators.graph import Graph
from meshwright.session import own_dir

#: Rows that a block holds on average at most; a task has three blocks in memory.
BLOCK = 1 << 20
#: Wedges that a task looks at at a time.
WEDGES = 1 << 20
#: Links a task gathers before it reduces them to a forest.
LINKS = 1 << 20

_Block = tuple[np.ndarray, ...]


def _blocks(rows: DataFrame, colours: int) -> dict[tuple[int, int], list[str]]:
    """The files of each pair of colours, of rows (a, b, ...) of whole numbers."""
    path = f"{own_dir(rows.sparkSession)}/blocks-{uuid.uuid4().hex}"
    colour = [F.pmod(F.xxhash64(k), F.lit(colours)).cast("int").alias(f"c{k}") for k in ("a", "b")]
    rows.select("*", *colour).repartition("ca", "cb").sortWithinPartitions("ca", "cb", "a", "b").write.partitionBy("ca", "cb").parquet(path)
    out: dict[tuple[int, int], list[str]] = {}
    # a file or a few for each pair of colours
    for f in rows.sparkSession.read.schema(", ".join(f"{c} long" for c in rows.columns) + ", ca int, cb int").parquet(path).inputFiles():
        at = re.search(r"/ca=(\d+)/cb=(\d+)/", f)
        out.setdefault((int(at[1]), int(at[2])), []).append(f)
    return out


def _read(files: list[str], names: list[str]) -> _Block:
    """Columns of some files, sorted by the first."""
    parts = []
    for uri in files:
        with open_parquet(uri) as f:
            t = f.read(columns=names)
        parts.append([t[c].to_numpy() for c in names])
    whole = [np.concatenate(x) for x in zip(*parts)]
    order = np.argsort(whole[0], kind="stable")
    return tuple(x[order] for x in whole)


def _met(pairs: _Block, left: _Block, right: _Block) -> Iterator[tuple[np.ndarray, ...]]:
    """(place of the pair, x, wa, wb) of the x that ``left`` has for a pair's a and ``right`` for its b."""
    b_ids, x_ids = np.unique(right[0]), np.unique(right[1])
    at = lambda ids, x: np.minimum(np.searchsorted(ids, x), len(ids) - 1)
    bi, xi = at(b_ids, pairs[1]), at(x_ids, left[1])
    some = np.flatnonzero(b_ids[bi] == pairs[1])
    stay = x_ids[xi] == left[1]
    la, lw, xi = left[0][stay], left[2][stay], xi[stay]
    key = np.searchsorted(b_ids, right[0]) * len(x_ids) + np.searchsorted(x_ids, right[1])
    order = np.argsort(key)
    key, rw = key[order], right[2][order]
    # a table of hashes settles most wedges; the others are looked up
    bits = min(max(10, int(len(key) * 16).bit_length()), 26)
    mixed = lambda q: (q.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    seen = np.zeros(1 << bits, dtype=bool)
    seen[mixed(key)] = True
    begin, end = np.searchsorted(la, pairs[0][some], "left"), np.searchsorted(la, pairs[0][some], "right")
    use = end > begin
    some, begin, n = some[use], begin[use], (end - begin)[use]
    total = np.concatenate([[0], np.cumsum(n)])
    at_pair = 0
    while at_pair < len(some):
        # whole pairs up to the number of wedges, at least one
        stop = max(int(np.searchsorted(total, total[at_pair] + WEDGES, "right")) - 1, at_pair + 1)
        k = n[at_pair:stop]
        own = np.repeat(np.arange(at_pair, stop), k)
        place = np.arange(len(own)) + np.repeat(begin[at_pair:stop] - (total[at_pair:stop] - total[at_pair]), k)
        q = bi[some[own]] * len(x_ids) + xi[place]
        maybe = np.flatnonzero(seen[mixed(q)])
        q, own, place = q[maybe], own[maybe], place[maybe]
        j = np.minimum(np.searchsorted(key, q), len(key) - 1)
        hit = key[j] == q
        if hit.any():
            yield some[own[hit]], x_ids[xi[place[hit]]], lw[place[hit]], rw[j[hit]]
        at_pair = stop


def meetings(pairs: DataFrame, rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b, ..., x, wa, wb): every x that has rows (a, b, w) with both ends of a pair (a, b, ...).

    What else a pair has are whole numbers too. Spark takes the result for a few rows, so
    write it, or join it by merging.
    A pair's rows all come from one task. The cost is that of looking up the rows of
    a, so a should be the end of fewer. ``pairs`` and ``rows`` may be the same table.
    """
    spark, same = pairs.sparkSession, pairs is rows
    n = max(rows.count(), 0 if same else pairs.count())
    colours = max(4, math.ceil(math.sqrt(n / block)))
    there = _blocks(rows, colours)
    ends = there if same else _blocks(pairs, colours)
    own, row = list(pairs.columns), ["a", "b", "w"]
    names = [*own, "x", "wa", "wb"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                i, j = divmod(t, colours)
                if (i, j) not in ends:
                    continue
                p = _read(ends[i, j], own)
                for k in range(colours):
                    if (i, k) in there and (j, k) in there:
                        for at, x, wa, wb in _met(p, _read(there[i, k], row), _read(there[j, k], row)):
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*(c[at] for c in p), x, wa, wb)], names=names)

    tasks = spark.range(0, colours * colours, 1, colours * colours)
    return tasks.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def neighbours(g: Graph) -> DataFrame:
    """(u, k): how many neighbours each vertex has."""
    return g.adj.groupBy("u").agg(F.count("*").alias("k"))


def _oriented(g: Graph, pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v, ...) with (a, b): the ends by rising number of neighbours, then id."""
    k = neighbours(g)
    e = pairs.join(k, "u", "left").join(k.select(F.col("u").alias("v"), F.col("k").alias("kv")), "v", "left")
    x, y = F.coalesce("k", F.lit(0)), F.coalesce("kv", F.lit(0))
    up = (x < y) | ((x == y) & (F.col("u") < F.col("v")))
    return e.select(*pairs.columns, F.when(up, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("b"))


def triangles(g: Graph, block: int = BLOCK) -> DataFrame:
    """(a, b, x, ab, ax, bx): every triangle once with its weights, by rising number of neighbours."""
    a = _oriented(g, g.edges).select("a", "b", "w")
    return meetings(a, a, block).select("a", "b", "x", F.col("w").alias("ab"), F.col("wa").alias("ax"), F.col("wb").alias("bx"))


def common(g: Graph, pairs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(u, v, ..., x, wu, wv): the common neighbours of distinct pairs (u, v, ...) with both weights; see ``meetings``."""
    more = [c for c in pairs.columns if c not in ("u", "v")]
    p = _oriented(g, pairs).select("a", "b", *more, (F.col("a") != F.col("u")).cast("bigint").alias("turned"))
    m = meetings(p, g.adj.select(F.col("u").alias("a"), F.col("v").alias("b"), "w"), block)
    kept = F.col("turned") == 0
    pick = lambda x, y, name: F.when(kept, F.col(x)).otherwise(F.col(y)).alias(name)
    return m.select(pick("a", "b", "u"), pick("b", "a", "v"), *more, "x", pick("wa", "wb", "wu"), pick("wb", "wa", "wv"))


#: Neighbours that a task of egos holds on average at most.
HELD = 1 << 22


def _edges(files: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(u, v) of the rows of some files, by row groups."""
    for uri in files:
        with open_parquet(uri) as f:
            for batch in f.iter_batches(batch_size=WEDGES, columns=["u", "v"]):
                yield batch.column(0).to_numpy(), batch.column(1).to_numpy()


def _colour(ids: np.ndarray, colours: int) -> np.ndarray:
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(colours)).astype(np.int32)


class _Places:
    """Places of ids in a sorted array of distinct ones, -1 for others: a table where ids are dense enough, else a search."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.table = ids, None
        if len(ids) and int(ids[-1]) - int(ids[0]) < 16 * len(ids) + 1000:
            self.table = np.full(int(ids[-1]) - int(ids[0]) + 1, -1, dtype=np.int32)
            self.table[ids - ids[0]] = np.arange(len(ids), dtype=np.int32)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not len(self.ids):
            return np.full(len(x), -1)
        if self.table is None:
            at = np.minimum(np.searchsorted(self.ids, x), len(self.ids) - 1)
            return np.where(self.ids[at] == x, at, -1)
        at = x - self.ids[0]
        ok = (at >= 0) & (at < len(self.table))
        return np.where(ok, self.table[np.where(ok, at, 0)], -1)


def _unite(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The least place of each place's component, after links (p, q) are added to those that ``label`` stands for."""
    while True:
        lp, lq = label[p], label[q]
        apart = lp != lq
        if not apart.any():
            return label
        p, q, lp, lq = p[apart], q[apart], lp[apart], lq[apart]
        np.minimum.at(label, np.maximum(lp, lq), np.minimum(lp, lq))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _ego_parts(files: list[str], colour: int, colours: int) -> tuple[np.ndarray, ...]:
    """(ego, x, c): for the egos of one colour, the least vertex c of each neighbour's component among the ego's neighbours.

    Rows (x, ego) are sorted, so that a link between two neighbours of an ego is one of
    two places, and the least place of a component has its least vertex.
    """
    some = []
    for u, v in _edges(files):
        for e, x in ((u, v), (v, u)):
            own = np.flatnonzero(_colour(e, colours) == colour)
            some.append((e[own], x[own]))
    if not some:
        return (np.zeros(0, np.int64),) * 3
    egos, e = np.unique(np.concatenate([s[0] for s in some]), return_inverse=True)
    ids, x = np.unique(np.concatenate([s[1] for s in some]), return_inverse=True)
    some.clear()
    key = x * len(egos) + e
    del x, e
    key.sort()
    who = (key % max(len(egos), 1)).astype(np.int32)
    begin = np.searchsorted(key, np.arange(len(ids) + 1) * len(egos))
    # a table of hashes settles most wedges; the others are looked up
    bits = min(max(10, int(len(key) * 8).bit_length()), 26)
    mixed = lambda q: (q.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    seen = np.zeros(1 << bits, dtype=bool)
    seen[mixed(key)] = True
    place, label = _Places(ids), np.arange(len(key), dtype=np.int32 if len(key) < 1 << 31 else np.int64)
    links, n_links = [], 0
    for u, v in _edges(files):
        a, b = place(u), place(v)
        both = np.flatnonzero((a >= 0) & (b >= 0))
        a, b = a[both].astype(np.int64), b[both].astype(np.int64)
        na, nb = begin[a + 1] - begin[a], begin[b + 1] - begin[b]
        a, b, n = np.where(na <= nb, a, b), np.where(na <= nb, b, a), np.minimum(na, nb)
        total, at = np.concatenate([[0], np.cumsum(n)]), 0
        while at < len(a):
            stop = max(int(np.searchsorted(total, total[at] + WEDGES, "right")) - 1, at + 1)
            k = n[at:stop]
            p = np.arange(total[stop] - total[at]) + np.repeat(begin[a[at:stop]] - (total[at:stop] - total[at]), k)
            q = np.repeat(b[at:stop] * len(egos), k) + who[p]
            maybe = np.flatnonzero(seen[mixed(q)])
            p, q = p[maybe], q[maybe]
            j = np.minimum(np.searchsorted(key, q), len(key) - 1)
            hit = key[j] == q
            links.append((p[hit], j[hit]))
            n_links += len(links[-1][0])
            if n_links >= max(LINKS, len(key) // 2):
                label = _unite(label, *(np.concatenate(c) for c in zip(*links)))
                links, n_links = [], 0
            at = stop
    if links:
        label = _unite(label, *(np.concatenate(c) for c in zip(*links)))
    x = ids[key // max(len(egos), 1)]
    return egos[who], x, x[label]


def ego_parts(g: Graph, heads: bool = False, held: int = HELD) -> DataFrame:
    """(ego, u, c): the least vertex of each neighbour's component in its ego's neighbourhood; of ``heads`` only the rows of c itself.

    A task takes the egos of one colour with all their neighbours and reads the edges
    twice, so that neither triangles nor links are shuffled or written: the edges are
    read 2 (1 + 2 edges / held) times.
    """
    files, spark = g.edge_files(), g.spark
    colours = max(spark.sparkContext.defaultParallelism, math.ceil(2 * g.edges.count() / held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                ego, u, c = _ego_parts(files, t, colours)
                if heads:
                    own = u == c
                    ego, u, c = ego[own], u[own], c[own]
                for k in range(0, len(ego), WEDGES):
                    yield pa.RecordBatch.from_arrays([pa.array(x[k : k + WEDGES]) for x in (ego, u, c)], names=["ego", "u", "c"])

    return spark.range(0, colours, 1, colours).mapInArrow(run, "ego long, u long, c long")

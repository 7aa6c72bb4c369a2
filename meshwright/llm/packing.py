"""Filling containers of fixed capacity, with a lower bound that certifies each part.

Items are hashed into parts of bounded size; each part is packed best fit decreasing
and compared with a lower bound from dual feasible functions. A part that reaches its
bound can't use fewer containers. The others give up the containers that aren't full,
whose items meet those of other parts in new parts of the next round, of the same
bounded size, for as long as that saves containers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.session import materialize

#: Items packed by one task at a time. Parts are filled to nine tenths on average, so
#: that none of them exceeds it (by hashing, a part varies by some 200 items).
PART_ITEMS = 40_000
#: A round that saves less than this share of the containers it packs anew is the last.
LEAST_GAIN = 0.0005
_PACKED = "container_class string, capacity int, doc_id long, piece int, tokens int, part int, bin int, load int, bins int, bound int"


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No packing of these items uses fewer containers; ``counts[s]`` items have size s <= capacity.

    The greatest bound of two families of dual feasible functions: f(x) = C above
    C - a, x from a on, else 0, for every a <= C / 2; and u(x) = x where (k + 1) x / C
    is whole, else floor((k + 1) x / C) C / k, for k up to 30.
    """
    n = np.asarray(counts, dtype=np.int64)
    if n[1:].sum() == 0:
        return int(n.sum() > 0)
    size = np.arange(capacity + 1, dtype=np.int64)
    many, mass = np.cumsum(n), np.cumsum(n * size)
    a = np.arange(0, capacity // 2 + 1)
    big = many[capacity] - many[capacity - a]
    low = np.where(a > 0, mass[np.maximum(a - 1, 0)], 0)
    best = int((big + -(-(mass[capacity - a] - low) // capacity)).max())
    for k in range(1, 31):
        whole = (k + 1) * size % capacity == 0
        scaled = np.where(whole, k * size, (k + 1) * size // capacity * capacity)
        best = max(best, int(-(-int((n * scaled).sum()) // (k * capacity))))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of each item, the largest items first, each into the fullest that holds it.

    Open containers are kept by the room they have left, and a bit set of the rooms
    finds the best one. Items of size 0 go to container 0.
    """
    order = np.argsort(-sizes, kind="stable")
    where = np.zeros(len(sizes), dtype=np.int32)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, used = 0, 0
    for i, s in zip(order.tolist(), sizes[order].tolist()):
        if s == 0:
            used = max(used, 1)
            break
        fit = mask >> s
        if fit:
            room = s + (fit & -fit).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
            room -= s
        else:
            b, used, room = used, used + 1, capacity - s
        where[i] = b
        if room:
            if not rooms[room]:
                mask |= 1 << room
            rooms[room].append(b)
    return where


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "piece"], kind="stable")
    capacity, sizes = int(pdf["capacity"].iloc[0]), pdf["tokens"].to_numpy(dtype=np.int64)
    where = best_fit_decreasing(sizes, capacity)
    load = np.bincount(where, weights=sizes).astype(np.int64)
    bound = lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
    return pdf.assign(bin=where, load=load[where], bins=len(load), bound=bound)[[x.split()[0] for x in _PACKED.split(", ")]]


def items(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_class, capacity, doc_id, piece, tokens): each document per class, cut only if too large.

    A document larger than the capacity gives pieces of the capacity and one of
    the rest; any other, an empty one too, is piece 0. Null counts are 0. Classes
    of null or no capacity are left out; ``containers`` is a table of a few rows.
    """
    classes = [(r["container_class"], int(r["capacity_tokens"])) for r in containers.select("container_class", "capacity_tokens").distinct().collect() if (r["capacity_tokens"] or 0) > 0]
    kinds = F.array(*(F.struct(F.lit(c).alias("container_class"), F.lit(k).alias("capacity")) for c, k in sorted(classes, key=lambda x: (x[1], str(x[0])))))
    each = sizes.select("doc_id", F.coalesce(F.col("tokens"), F.lit(0)).alias("n"), F.inline(kinds))
    last = F.greatest(F.ceil(F.col("n") / F.col("capacity")) - 1, F.lit(0)).cast("int")
    each = each.select("container_class", "capacity", "doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    return each.select("container_class", "capacity", "doc_id", "piece", F.least(F.col("n") - F.col("piece").cast("long") * F.col("capacity"), F.col("capacity").cast("long")).cast("int").alias("tokens"))


def _per_class(values: dict[str | None, int], default: int) -> Column:
    """A number by container class; classes are a table of a few rows."""
    out = F.lit(default)
    for c, v in values.items():
        out = F.when(F.col("container_class").eqNullSafe(F.lit(c)), v).otherwise(out)
    return out


def pack(sizes: DataFrame, containers: DataFrame, part_items: int = PART_ITEMS, least_gain: float = LEAST_GAIN) -> DataFrame:
    """(container_class, doc_id, piece, container, tokens) of every document in every class.

    Pieces of the whole capacity have a container each. The other items are packed in
    rounds. After each, what is certified stays as it is: parts at their bound, and
    full containers of the others. The rest is hashed anew into as many parts as its
    number asks for, never more than ``part_items`` items in one. A class is finished
    when all is certified, when its rest was packed as one part, or when a round saved
    less than ``least_gain`` of the containers packed anew; ``report`` gives the gap
    that is left. No table rows, no containers.
    """
    todo = materialize(items(sizes, containers), "items")
    name = F.concat_ws("/", "container_class", F.lit("full"), F.col("doc_id"), F.col("piece"))
    done = [todo.where(F.col("tokens") == F.col("capacity")).select("container_class", "doc_id", "piece", name.alias("container"), "tokens")]
    todo = todo.where(F.col("tokens") < F.col("capacity"))
    counts = {r["container_class"]: r["n"] for r in todo.groupBy("container_class").agg(F.count("*").alias("n")).collect()}
    held: dict[str | None, int] = {}  # containers of the items to be packed anew
    before: DataFrame | None = None  # those items as they were packed
    fill, turn = max(1, part_items * 9 // 10), 0
    while counts:
        parts = {c: 1 if n <= part_items else -(-n // fill) for c, n in counts.items()}
        part = F.pmod(F.xxhash64(F.lit(turn), "doc_id", "piece"), _per_class(parts, 1)).cast("int")
        packed = todo.select("container_class", "capacity", "doc_id", "piece", "tokens", part.alias("part"))
        packed = materialize(packed.groupBy("container_class", "part").applyInPandas(_pack, _PACKED), "packed")
        open_ = (F.col("bins") > F.col("bound")) & (F.col("load") < F.col("capacity"))
        # one row per part is enough to count containers; a class has few numbers
        per = packed.groupBy("container_class", "part").agg(F.max("bins").alias("bins"), F.count_if(open_).alias("left"), F.count_distinct(F.when(open_, F.col("bin"))).alias("left_bins"))
        seen = {r["container_class"]: r for r in per.groupBy("container_class").agg(F.sum("bins").alias("bins"), F.sum("left").alias("left"), F.sum("left_bins").alias("left_bins")).collect()}
        settled = {c for c, r in seen.items() if parts[c] == 1 or not r["left"] or (c in held and held[c] - r["bins"] < least_gain * held[c])}
        last = _per_class({c: 1 for c in settled}, 0) == 1
        # a class whose new packing is worse keeps the one before
        worse = _per_class({c: 1 for c in seen if c in held and seen[c]["bins"] > held[c]}, 0) == 1
        named = packed.withColumn("container", F.concat_ws("/", "container_class", F.lit(f"r{turn}"), F.col("part"), F.col("bin")))
        done.append(named.where((~open_ | last) & ~worse).select("container_class", "doc_id", "piece", "container", "tokens"))
        if before is not None:
            done.append(before.where(worse).select("container_class", "doc_id", "piece", "container", "tokens"))
        before = named.where(open_ & ~last)
        todo = before.select("container_class", "capacity", "doc_id", "piece", "tokens")
        counts = {c: r["left"] for c, r in seen.items() if c not in settled}
        held = {c: seen[c]["left_bins"] for c in counts}
        turn += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _class_bound(pdf: pd.DataFrame) -> pd.DataFrame:
    capacity = int(pdf["capacity"].iloc[0])
    counts = np.zeros(capacity + 1, dtype=np.int64)
    counts[pdf["tokens"].to_numpy()] = pdf["n"].to_numpy()
    return pd.DataFrame({"container_class": [pdf["container_class"].iloc[0]], "lower_bound": [lower_bound(counts, capacity)]})


def report(packed: DataFrame, sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_class, containers, lower_bound, gap, tokens) of each class; the bound is over all its items.

    ``gap`` is the share of containers that the bound doesn't show to be needed.

    The bound needs only how many items have each size, at most one row a size.
    """
    histogram = items(sizes, containers).groupBy("container_class", "capacity", "tokens").agg(F.count("*").alias("n"))
    bounds = histogram.groupBy("container_class").applyInPandas(_class_bound, "container_class string, lower_bound long")
    used = packed.groupBy("container_class").agg(F.count_distinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    gap = (F.col("containers") - F.col("lower_bound")) / F.col("containers")
    return used.join(bounds, "container_class").select("container_class", "containers", "lower_bound", gap.alias("gap"), "tokens")

"""Per-key profiles of Parquet columns, chunk by chunk.

A task takes one row group. Its footer settles a column chunk that is all null, or
that holds one whole number and no null; such chunks aren't read. String chunks are
read as dictionary and codes, and only codes are counted. Other chunks are scanned.
What leaves a task is counts: of all values (``exact``), or bounds (see ``bounds``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, FloatType, IntegralType, StringType, TimestampType

from meshwright.operators.footers import file_list, open_parquet

#: Rows of a row group that are held in memory at a time.
BATCH = 1 << 20
#: Bytes of Parquet files that a task is to profile.
TASK_BYTES = 64 << 20
#: Buckets per unit of ln(1 + |x|) of the bounds' histograms.
COARSE = 64


def readable(kind: DataType) -> bool:
    """Whether columns of this type are profiled here: whole numbers, floats, booleans, texts, instants."""
    return isinstance(kind, (IntegralType, FloatType, DoubleType, BooleanType, StringType, TimestampType))


@dataclass(frozen=True)
class Column:
    """A column and which of its values are valid: numbers from ``low`` to ``high``, or texts of ``words`` (any if there are none)."""

    name: str
    numeric: bool
    low: float = -math.inf
    high: float = math.inf
    words: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Settled:
    """A column chunk the footer describes: ``value`` in every row, null if None."""

    value: int | None


def plan(group: pq.RowGroupMetaData, names: list[str]) -> dict[str, Settled | None]:
    """What the footer says about each named top-level column of a row group; None where it has to be read.

    Extrema settle a chunk only for whole numbers: a float's don't show NaN, a text's may be cut short.
    """
    out: dict[str, Settled | None] = dict.fromkeys(names)
    for i in range(group.num_columns):
        c = group.column(i)
        s = c.statistics
        if c.path_in_schema not in out or s is None or not s.has_null_count:
            continue
        if s.null_count == group.num_rows:
            out[c.path_in_schema] = Settled(None)
        elif not s.null_count and c.physical_type in ("INT32", "INT64") and s.has_min_max and isinstance(s.min, int) and s.min == s.max:
            out[c.path_in_schema] = Settled(s.min)
    return out


@dataclass
class _Part:
    """Some rows of one column: their key's place, which are there, and their values or (codes, dictionary)."""

    key: np.ndarray
    there: np.ndarray
    values: np.ndarray
    words: list[str] | None = None


def _plain(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(there, values) of a column of numbers, booleans or instants (in microseconds)."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    there = ~a.is_null().to_numpy(zero_copy_only=False)
    if pa.types.is_timestamp(a.type):
        a = a.cast(pa.timestamp("us", a.type.tz), safe=False).cast(pa.int64())
    elif pa.types.is_boolean(a.type):
        a = a.cast(pa.int8())
    return there, a.fill_null(0).to_numpy(zero_copy_only=False)


def _as_double(values: np.ndarray, instant: bool) -> np.ndarray:
    x = values.astype(np.float64)
    return x / 1e6 if instant else x


def _runs(key: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): rows in order of key and value, and where each distinct pair starts; NaNs are one value."""
    order = np.lexsort((values, key))
    k, v = key[order], values[order]
    new = np.ones(len(order), dtype=bool)
    same = v[1:] == v[:-1]
    if v.dtype.kind == "f":
        same |= np.isnan(v[1:]) & np.isnan(v[:-1])
    new[1:] = (k[1:] != k[:-1]) | ~same
    return order, np.flatnonzero(new)


def _codes(part: _Part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key place, code, count) of each text that occurs with a key."""
    n = max(len(part.words), 1)
    both, count = np.unique(part.key[part.there].astype(np.int64) * n + part.values[part.there], return_counts=True)
    return both // n, both % n, count


def _exact(keys: np.ndarray, at: int, c: Column, part: _Part, instant: bool) -> Iterator[dict]:
    """Rows (key, at, number, text, n) of each value; nulls have neither number nor text."""
    nulls = np.bincount(part.key[~part.there], minlength=len(keys))
    k = np.flatnonzero(nulls)
    if len(k):
        yield {"key": keys[k], "at": at, "number": None, "text": None, "n": nulls[k]}
    if c.numeric:
        key, values = part.key[part.there], part.values[part.there]
        order, starts = _runs(key, values)
        if len(order):
            v = values[order][starts]
            beyond = v.dtype.kind in "iu" and not instant and bool((np.abs(v.astype(np.float64)) >= 2.0**53).any())
            text = [str(x) if abs(x) > 2**53 else None for x in v.tolist()] if beyond else None
            yield {"key": keys[key[order][starts]], "at": at, "number": _as_double(v, instant), "text": text, "n": np.diff(np.append(starts, len(order)))}
    else:
        key, code, n = _codes(part)
        if len(n):
            yield {"key": keys[key], "at": at, "number": None, "text": [part.words[x] for x in code.tolist()], "n": n}


def coarse_bucket(x: np.ndarray) -> np.ndarray:
    """An integer that never falls as ``x`` grows, about relative width 1 / COARSE."""
    return np.clip(np.sign(x) * np.floor(np.log1p(np.abs(x)) * COARSE), -(2.0**40), 2.0**40).astype(np.int64)


def _bounds(keys: np.ndarray, at: int, c: Column, part: _Part, instant: bool) -> Iterator[dict]:
    """One row of totals per key, and rows (bucket, n) or (text, n) of the values that are neither null nor NaN."""
    size = len(keys)
    total, nulls = np.bincount(part.key, minlength=size), np.bincount(part.key[~part.there], minlength=size)
    nan, invalid = np.zeros(size, np.int64), np.zeros(size, np.int64)
    if c.numeric:
        key, values = part.key[part.there], part.values[part.there]
        order, starts = _runs(key, values)
        distinct = np.bincount(key[order][starts], minlength=size)
        x = _as_double(values, instant)
        bad = np.isnan(x)
        nan = np.bincount(key[bad], minlength=size)
        invalid = np.bincount(key[bad | ~((x >= c.low) & (x <= c.high))], minlength=size)
        bucket = coarse_bucket(x[~bad])
        order, starts = _runs(key[~bad], bucket)
        if len(order):
            yield {"key": keys[key[~bad][order][starts]], "at": at, "bucket": bucket[order][starts], "n": np.diff(np.append(starts, len(order)))}
    else:
        key, code, n = _codes(part)
        distinct = np.bincount(key, minlength=size)
        if c.words:
            ok = np.array([w in c.words for w in part.words], dtype=bool)
            invalid = np.bincount(key, weights=n * ~ok[code], minlength=size).astype(np.int64) if len(n) else invalid
        if len(n):
            yield {"key": keys[key], "at": at, "text": [part.words[x] for x in code.tolist()], "n": n}
    k = np.flatnonzero(total)
    yield {"key": keys[k], "at": at, "n": total[k], "nulls": nulls[k], "nan": nan[k], "invalid": invalid[k], "distinct": distinct[k]}


_EXACT = pa.schema([("key", pa.int64()), ("at", pa.int32()), ("number", pa.float64()), ("text", pa.string()), ("n", pa.int64())])
_BOUNDS = pa.schema([("key", pa.int64()), ("at", pa.int32()), ("bucket", pa.int64()), ("text", pa.string()), ("n", pa.int64()), ("nulls", pa.int64()), ("nan", pa.int64()), ("invalid", pa.int64()), ("distinct", pa.int64())])
_SQL = {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", pa.string(): "string"}


def _batch(rows: dict, schema: pa.Schema) -> pa.RecordBatch:
    n = len(rows["key"])
    out = []
    for f in schema:
        v = rows.get(f.name)
        out.append(pa.nulls(n, f.type) if v is None else pa.array(np.full(n, v, np.int32) if f.name == "at" else v, f.type))
    return pa.RecordBatch.from_arrays(out, schema=schema)


def profile_group(f: pq.ParquetFile, g: int, key: str, columns: list[Column], count: Callable, keep: np.ndarray | None = None) -> Iterator[dict]:
    """The counts of one row group; ``keep`` are the only keys wanted. Rows with a null key are left out.

    Columns that the footer settles are not read, nor is the key where it is settled.
    """
    names = [c.name for c in columns]
    known = plan(f.metadata.row_group(g), [*names, key])
    own = known[key]
    if own is not None and (own.value is None or (keep is not None and own.value not in keep)):
        return
    read = [n for n in dict.fromkeys([key, *names]) if known[n] is None]
    texts = [c.name for c in columns if not c.numeric and known[c.name] is None]
    rows = f.metadata.row_group(g).num_rows
    pieces = f.iter_batches(batch_size=BATCH, row_groups=[g], columns=read) if read else iter([None])
    for piece in pieces:
        n = rows if piece is None else piece.num_rows
        if own is None:
            has, raw = _plain(piece.column(piece.schema.get_field_index(key)))
            if keep is not None:
                has &= np.isin(raw, keep)
        else:
            has, raw = np.ones(n, bool), np.full(n, own.value, np.int64)
        if not has.any():
            continue
        keys, place = np.unique(raw[has], return_inverse=True)
        for at, c in enumerate(columns):
            instant = False
            if known[c.name] is not None:
                v = known[c.name].value
                part = _Part(place, np.full(len(place), v is not None), np.full(len(place), v or 0, np.int64), [])
            else:
                a = piece.column(piece.schema.get_field_index(c.name))
                if c.name in texts:
                    d = a if pa.types.is_dictionary(a.type) else a.dictionary_encode()
                    there = ~d.indices.is_null().to_numpy(zero_copy_only=False)
                    part = _Part(place, there[has], d.indices.fill_null(0).to_numpy(zero_copy_only=False)[has], d.dictionary.to_pylist())
                else:
                    instant = pa.types.is_timestamp(a.type)
                    there, values = _plain(a)
                    part = _Part(place, there[has], values[has])
            yield from count(keys.astype(np.int64), at, c, part, instant)


def _profile(spark: SparkSession, path: str, key: str, columns: list[Column], schema: pa.Schema, count: Callable, keep: list[int] | None) -> DataFrame:
    wanted = None if keep is None else np.array(sorted(keep), dtype=np.int64)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uris = b.column(0).to_pylist()
            for uri in uris:
                with open_parquet(uri) as f:
                    n = f.metadata.num_row_groups
                yield pa.RecordBatch.from_pydict({"path": [uri] * n, "g": pa.array(range(n), pa.int32())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [c.name for c in columns if not c.numeric]
        for b in batches:
            for uri, g in zip(*(c.to_pylist() for c in b.columns)):
                with open_parquet(uri, texts) as f:
                    for rows in profile_group(f, g, key, columns, count, wanted):
                        yield _batch(rows, schema)

    files = file_list(spark, path)
    size = int(files.agg(F.sum("length")).first()[0] or 0)
    # a stated number, since rows that only name row groups would be gathered into one task
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    each = files.select("path").mapInArrow(groups, "path string, g int").repartition(tasks, F.col("path"), F.col("g"))
    return each.mapInArrow(run, ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema))


def exact(spark: SparkSession, path: str, key: str, columns: list[Column], keep: list[int] | None = None) -> DataFrame:
    """(key, at, number, text, n): how often each value of column number ``at`` occurs per key.

    Whole numbers that doubles don't tell apart have their digits as text too; null
    cells have neither. ``keep`` are keys: a bounded list, see the caller.
    """
    rows = _profile(spark, path, key, columns, _EXACT, _exact, keep)
    return rows.groupBy("key", "at", "number", "text").agg(F.sum("n").alias("n"))


def bounds(spark: SparkSession, path: str, key: str, columns: list[Column]) -> DataFrame:
    """(key, at, bucket, text, n, nulls, nan, invalid, low, high).

    Rows without bucket and text are totals: n rows, nulls, NaNs, invalid values and
    bounds ``low`` and ``high`` on the number of distinct values (NaN is one), since a
    value may occur in several parts. The others count values per bucket or text.
    """
    rows = _profile(spark, path, key, columns, _BOUNDS, _bounds, None)
    return rows.groupBy("key", "at", "bucket", "text").agg(
        *(F.sum(c).alias(c) for c in ("n", "nulls", "nan", "invalid")), F.max("distinct").alias("low"), F.sum("distinct").alias("high")
    )

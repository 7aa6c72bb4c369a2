"""Schemas that drift between the files of a stream.

Each file's fields are profiled (types, counts, value sketches); consecutive
files are compared; a field that ends and one that begins are taken for a rename
when the records standing in both files say so, decided by a bipartite matching
weighted by agreement, name and sketch similarity. Renames chained over a stream
give each field one name, under which all files are read into one table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwright.functions.assign import assign
from meshwright.session import materialize

_KINDS = ("array", "boolean", "number", "string")
_KIND = {k[0]: k for k in _KINDS}
_SKETCH = 8
_FIELD = "file_id long, rec string, path string, kind string, value long"


def read_object(text: Any) -> dict | None:
    """The JSON object of a line, or None if the line isn't a readable record."""
    if not isinstance(text, str):
        return None
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def leaves(record: dict, prefix: str = "") -> Iterator[tuple[str, Any]]:
    """(dotted path, value) of every value that isn't an object and isn't null; a list is one value."""
    for key, value in record.items():
        path = f"{prefix}.{key}" if prefix else key
        if isinstance(value, dict):
            yield from leaves(value, path)
        elif value is not None:
            yield path, value


def kind_of(value: Any) -> str:
    if isinstance(value, bool):
        return "boolean"
    return "number" if isinstance(value, (int, float)) else "string" if isinstance(value, str) else "array"


def canonical(value: Any) -> str:
    """A text in which equal values of one type are equal; 3 and 3.0 are one number."""
    if isinstance(value, str):
        return "s" + value
    if isinstance(value, float):
        return f"n{int(value)}" if value.is_integer() else f"n{value!r}"
    if isinstance(value, bool):
        return "b1" if value else "b0"
    return f"n{value}" if isinstance(value, int) else "a" + json.dumps(value, sort_keys=True)


def _fields(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        files, recs, sizes, paths, kinds, values = [], [], [], [], [], []
        for file_id, payload in zip(pdf["file_id"].tolist(), pdf["payload"].tolist()):
            record = read_object(payload)
            if record is None:
                continue
            rec = record.get("record_id")
            before = len(paths)
            for path, value in leaves(record):
                text = canonical(value)
                paths.append(path)
                kinds.append(_KIND[text[0]])
                values.append(xxhash.xxh64_intdigest(text))
            files.append(file_id)
            recs.append(None if rec is None or isinstance(rec, (dict, list)) else canonical(rec))
            sizes.append(len(paths) - before)
        if paths:
            each = np.repeat(np.arange(len(sizes)), sizes)
            hashes = np.array(values, dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"file_id": np.array(files, dtype=np.int64)[each], "rec": np.array(recs, dtype=object)[each], "path": paths, "kind": kinds, "value": hashes})


def field_values(lines: DataFrame) -> DataFrame:
    """(file_id, rec, path, kind, value hash) of every field of every readable record."""
    return lines.where(F.col("file_id").isNotNull()).select("file_id", "payload").mapInPandas(_fields, _FIELD)


def profiles(values: DataFrame) -> DataFrame:
    """(file_id, path, kind, n, sketch): the commonest type and a min-wise sketch of the values.

    Types that are equally common rank in the order array, boolean, number, string.
    """
    counts = [F.count_if(F.col("kind") == k).alias(f"_{k}") for k in _KINDS]
    sketch = [F.min(F.xxhash64(F.lit(i), "value")).alias(f"_s{i}") for i in range(_SKETCH)]
    most = F.greatest(*(f"_{k}" for k in _KINDS))
    kind = F.coalesce(*(F.when(F.col(f"_{k}") == most, F.lit(k)) for k in _KINDS))
    grouped = values.groupBy("file_id", "path").agg(F.count("*").alias("n"), *counts, *sketch)
    return grouped.select("file_id", "path", kind.alias("kind"), "n", F.array(*(f"_s{i}" for i in range(_SKETCH))).alias("sketch"))


def ordered(files: DataFrame) -> DataFrame:
    """(file_id, stream, seq_no, prev_id): each file with the one of the preceding seq_no in its stream."""
    w = Window.partitionBy("stream").orderBy("seq_no", "file_id")
    return files.select("file_id", "stream", "seq_no").withColumn("prev_id", F.lag("file_id").over(w))


def plain(path: Column) -> Column:
    """A path without letter case and separators."""
    return F.regexp_replace(F.lower(path), "[^a-z0-9]", "")


@lru_cache(100_000)
def _alike(a: str, b: str) -> float:
    """How alike two names are; streams of files meet the same names again and again."""
    return SequenceMatcher(None, a, b).ratio()


def _match(pdf: pd.DataFrame) -> pd.DataFrame:
    """The renames of one file: an assignment of the fields that end to those that begin."""
    old, new = sorted(set(pdf["old_path"])), sorted(set(pdf["new_path"]))
    w = np.zeros((len(old), len(new)))
    for o, n, agree, so, sn in zip(pdf["old_path"], pdf["new_path"], pdf["agree"], pdf["old_sketch"], pdf["new_sketch"]):
        name = _alike(o.lower(), n.lower())
        alike = float(np.mean(np.asarray(so) == np.asarray(sn)))
        w[old.index(o), new.index(n)] = 4 + min(int(agree), 8) / 4 + name + alike / 2
    pairs = [(pdf["file_id"].iloc[0], old[i], new[j]) for i, j in assign(w)]
    return pd.DataFrame(pairs, columns=["file_id", "old_path", "new_path"])


def changes(files: DataFrame, lines: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """(file_id, change, old_path, new_path) of each file against the one before in its stream.

    A pair is a rename candidate if some record of both files has equal values in
    it and no record has different ones; pairs without any such record need equal
    names but for case and separators, and equal types. Streams' first files have
    no changes; a file without a readable record has lost every field. Only files
    named in ``files`` count.
    """
    values = materialize(field_values(lines), "fields") if values is None else values
    order = ordered(files)
    profile = materialize(profiles(values), "profiles")
    now = profile.join(order.where(F.col("prev_id").isNotNull()).select("file_id", "prev_id"), "file_id")
    nxt = order.where(F.col("prev_id").isNotNull()).select(F.col("prev_id").alias("at_id"), F.col("file_id").alias("next_id"))
    before = profile.withColumnRenamed("file_id", "at_id").join(nxt, "at_id")
    now = now.select("file_id", "path", F.col("kind").alias("new_kind"), F.col("sketch").alias("new_sketch"))
    before = before.select(F.col("next_id").alias("file_id"), "path", "at_id", F.col("kind").alias("old_kind"), F.col("sketch").alias("old_sketch"))
    steps = materialize(before.join(now, ["file_id", "path"], "full_outer").where(~F.col("old_kind").eqNullSafe(F.col("new_kind"))), "steps")
    ended = steps.where(F.col("new_kind").isNull()).select("file_id", F.col("path").alias("old_path"), "at_id", "old_kind", "old_sketch")
    began = steps.where(F.col("old_kind").isNull()).select("file_id", F.col("path").alias("new_path"), "new_kind", "new_sketch")

    known = values.where(F.col("rec").isNotNull())
    was = known.select(F.col("file_id").alias("at_id"), "rec", F.col("path").alias("old_path"), "value").join(ended.select("at_id", "file_id", "old_path"), ["at_id", "old_path"])
    was = was.select("file_id", "rec", "old_path", "value").distinct()
    now_is = known.withColumnRenamed("path", "new_path").join(began.select("file_id", "new_path"), ["file_id", "new_path"])
    now_is = now_is.select("file_id", "rec", "new_path", "value").distinct()
    pair = ["file_id", "old_path", "new_path"]
    agree = was.join(now_is, ["file_id", "rec", "value"]).groupBy(*pair).agg(F.count_distinct("rec").alias("agree"))
    named = ended.withColumn("_p", plain(F.col("old_path"))).join(began.withColumn("_p", plain(F.col("new_path"))), ["file_id", "_p"])
    named = named.where(F.col("old_kind") == F.col("new_kind")).select(*pair)
    candidates = agree.select(*pair).union(named).distinct()
    stand = candidates.join(was.select("file_id", "rec", "old_path").distinct(), ["file_id", "old_path"])
    stand = stand.join(now_is.select("file_id", "rec", "new_path").distinct(), ["file_id", "rec", "new_path"]).groupBy(*pair).agg(F.count("*").alias("both"))
    weighed = candidates.join(agree, pair, "left").join(stand, pair, "left").fillna(0, ["agree", "both"]).where(F.col("agree") == F.col("both"))
    weighed = weighed.join(ended.select("file_id", "old_path", "old_sketch"), ["file_id", "old_path"]).join(began.select("file_id", "new_path", "new_sketch"), ["file_id", "new_path"])
    # a stated number of partitions, since few rows would be gathered into one task
    weighed = weighed.repartition(2 * files.sparkSession.sparkContext.defaultParallelism, "file_id")
    renamed = materialize(weighed.groupBy("file_id").applyInPandas(_match, "file_id long, old_path string, new_path string"), "renames")

    none = F.lit("")
    removed = ended.select("file_id", "old_path").join(renamed.select("file_id", "old_path"), ["file_id", "old_path"], "left_anti")
    added = began.select("file_id", "new_path").join(renamed.select("file_id", "new_path"), ["file_id", "new_path"], "left_anti")
    retyped = steps.where(F.col("old_kind").isNotNull() & F.col("new_kind").isNotNull())
    return (
        renamed.select("file_id", F.lit("renamed").alias("change"), "old_path", "new_path")
        .unionByName(removed.select("file_id", F.lit("removed").alias("change"), "old_path", none.alias("new_path")))
        .unionByName(added.select("file_id", F.lit("added").alias("change"), none.alias("old_path"), "new_path"))
        .unionByName(retyped.select("file_id", F.lit("retyped").alias("change"), F.col("path").alias("old_path"), F.col("path").alias("new_path")))
    )


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per file of one stream, the first name of each field that has been renamed so far."""
    pdf = pdf.sort_values("seq_no", kind="stable")
    first: dict[str, str] = {}
    out = []
    for file_id, renames in zip(pdf["file_id"], pdf["renames"]):
        moved = {r["new_path"]: first.get(r["old_path"], r["old_path"]) for r in (renames if renames is not None else [])}
        for r in renames if renames is not None else []:
            first.pop(r["old_path"], None)
        first |= moved
        out.append((file_id, [{"path": k, "name": v} for k, v in first.items() if k != v]))
    return pd.DataFrame(out, columns=["file_id", "names"])


def field_names(files: DataFrame, found: DataFrame) -> DataFrame:
    """(file_id, names): the renamed paths of each file with the name the field had first in the stream."""
    step = found.where(F.col("change") == "renamed").groupBy("file_id").agg(F.collect_list(F.struct("old_path", "new_path")).alias("renames"))
    rows = files.select("file_id", "stream", "seq_no").join(step, "file_id", "left")
    return rows.groupBy("stream").applyInPandas(_chain, "file_id long, names array<struct<path:string,name:string>>")


def _unify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for file_id, line_no, payload, names in zip(pdf["file_id"], pdf["line_no"], pdf["payload"], pdf["names"]):
            record = read_object(payload)
            if record is None:
                continue
            to = {} if names is None else {n["path"]: n["name"] for n in names}
            got = {to.get(p, p): v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for p, v in leaves(record)}
            out.append((file_id, line_no, got.get("record_id"), got.get("job_id"), got))
        if out:
            yield pd.DataFrame(out, columns=["file_id", "line_no", "record_id", "job_id", "fields"])


def unified(files: DataFrame, lines: DataFrame, found: DataFrame) -> DataFrame:
    """All readable records of all files in one table, each field under its first name.

    (file_id, line_no, record_id, job_id, fields): ``fields`` maps names to values
    as text, whatever type they had; absent and null fields have no entry.
    """
    named = lines.select("file_id", "line_no", "payload").join(field_names(files, found), "file_id", "left")
    return named.mapInPandas(_unify, "file_id long, line_no int, record_id string, job_id string, fields map<string,string>")

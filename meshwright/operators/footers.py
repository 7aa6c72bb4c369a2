"""What Parquet footers and dictionary pages say without a scan of the values.

Footers are read by tasks, one file each; a statistic counts only where it is
exact, so a profile can take null counts and extrema from here and scan only the
files whose statistics don't settle the question.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import date, datetime
from decimal import Decimal
from urllib.parse import unquote

import pandas as pd
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHUNK = (
    "file string, row_group int, column string, physical string, num_rows long, nulls long, "
    "low string, high string, low_num double, high_num double, exact boolean, dictionary boolean"
)


def _locate(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + unquote(uri[5:]).lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def open_parquet(uri: str, dictionaries: list[str] | None = None) -> pq.ParquetFile:
    """A Parquet file by its address; ``dictionaries`` are columns to be read as dictionary and codes."""
    fs, path = _locate(uri)
    return pq.ParquetFile(fs.open_input_file(path), read_dictionary=dictionaries or None)


def _text(value: object) -> str | None:
    if value is None:
        return None
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)


def _number(value: object) -> float | None:
    return float(value) if isinstance(value, (int, float, Decimal)) and not isinstance(value, bool) and math.isfinite(value) else None


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for uri in pdf["path"]:
            with open_parquet(uri) as f:
                meta = f.metadata
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for i in range(group.num_columns):
                        c = group.column(i)
                        s = c.statistics
                        nulls = s.null_count if s is not None and s.has_null_count else None
                        low, high = (s.min, s.max) if s is not None and s.has_min_max else (None, None)
                        # a float's extrema don't tell whether it has NaN, a string's may be cut short
                        exact = c.physical_type in ("INT32", "INT64", "BOOLEAN") and low is not None
                        encodings = set(c.encodings)
                        out.append(
                            (uri, g, c.path_in_schema, c.physical_type, group.num_rows, nulls, _text(low), _text(high), _number(low), _number(high), exact,
                             c.has_dictionary_page and "PLAIN_DICTIONARY" not in encodings and bool(encodings & {"RLE_DICTIONARY"}))
                        )
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _CHUNK.split(", ")])


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the Parquet files of a table; their content isn't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return found.select("path", "length")


def chunk_statistics(spark: SparkSession, path: str) -> DataFrame:
    """One row per column chunk: rows, nulls, extrema and whether those are exact.

    A table without files gives no rows.
    """
    return file_list(spark, path).select("path").mapInPandas(_chunks, _CHUNK)


def _dictionaries(column: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: set[str] = set()
            for uri in pdf["path"]:
                with open_parquet(uri, [column]) as f:
                    for g in range(f.metadata.num_row_groups):
                        for part in f.read_row_group(g, columns=[column]).column(0).chunks:
                            out.update(v for v in part.dictionary.to_pylist() if v is not None)
            if out:
                yield pd.DataFrame({"value": sorted(out)})

    return run


def dictionary_values(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(value): the distinct values of a string column, from the dictionaries of its chunks.

    Entries are taken from the dictionaries, not row by row; a chunk that fell back
    to plain pages is encoded when read. Each task hands on each value once.
    """
    return file_list(spark, path).select("path").mapInPandas(_dictionaries(column), "value string").distinct()

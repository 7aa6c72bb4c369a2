"""Release manifests of two systems, brought into one form and compared."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshwright.operators.reconcile import differences, latest


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column) -> Column:
    """``c`` in Unicode NFC; only texts beyond ASCII leave the JVM."""
    wide = F.when(c.rlike(r"[^\x00-\x7f]"), c)
    return F.coalesce(_nfc(wide), c)


_BLANK = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff\u200b]+"


def clean_path(c: Column) -> Column:
    """A path relative to the release root.

    Outer blanks go, ``\\`` becomes ``/``, and empty, ``.`` and resolvable ``..``
    parts are left out; a ``..`` that would leave the root stays. The text is then
    brought to NFC. Letter case stays.
    """
    c = F.regexp_replace(c, rf"^{_BLANK}|{_BLANK}$", "")
    parts = F.filter(F.split(F.translate(c, "\\", "/"), "/", -1), lambda x: ~x.isin("", "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when((x == "..") & (F.size(acc) > 0) & ~F.try_element_at(acc, F.lit(-1)).eqNullSafe(".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(x))),
    )
    plain = F.array_join(F.when(F.array_contains(parts, ".."), folded).otherwise(parts), "/")
    return nfc(plain)


def clean_digest(c: Column) -> Column:
    """The hex digits of a digest in lower case, without blanks and label; none at all is null."""
    digits = F.regexp_replace(F.lower(F.regexp_replace(c, rf"{_BLANK}", "")), r"^.*[:=}]", "")
    digits = F.regexp_replace(digits, r"^(sha-?256|0x)[-_]?", "")
    return F.when(digits != "", digits)


def manifest(df: DataFrame) -> DataFrame:
    """One row (release_id, path, bytes, sha256) per file: its latest, in the common form.

    Other columns of ``df`` are not looked at. Null release_id or path are values
    of their own.
    """
    rows = df.select("release_id", clean_path(F.col("path")).alias("path"), "bytes", clean_digest(F.col("sha256")).alias("sha256"), "recorded_at")
    return latest(rows, ["release_id", "path"], "recorded_at", ["bytes", "sha256"])


def manifest_differences(primary: DataFrame, mirror: DataFrame, **how) -> DataFrame:
    """(release_id, path, difference) of every file that the two systems don't have alike."""
    rows = max(primary.count(), mirror.count())
    return differences(manifest(primary), manifest(mirror), ["release_id", "path"], ["bytes", "sha256"], rows, ("primary", "mirror"), **how)

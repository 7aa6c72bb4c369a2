"""Deeply nested records turned into flat tables that keep parent-child links.

One depth-first visit of each record emits rows (entity, position, parent,
payload); a typed table per entity is then a projection of the tagged rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ITEM = "array<struct<entity:string,position:string,parent:string,payload:string>>"


def decode(text: Any) -> Any:
    """The value of a JSON text, through as many layers of quoting as there are; None if unreadable."""
    while isinstance(text, str):
        try:
            text = json.loads(text)
        except (ValueError, RecursionError):
            return None
    return text


def places(value: Any) -> Iterator[tuple[int, dict]]:
    """(place, object) of a list, in whichever way it is written.

    A list may be a JSON array, an object whose keys are places, one object that
    stands for a list of one, or a text of any of these. Nulls and other elements
    that aren't objects keep their place and yield nothing; an empty object is an
    empty list.
    """
    value = decode(value)
    if isinstance(value, dict):
        if not value:
            return
        if all(k.isascii() and k.isdigit() for k in value):
            pairs: Any = sorted((int(k), v) for k, v in value.items()) if len({int(k) for k in value}) == len(value) else enumerate(value.values())
        else:
            pairs = [(0, value)]
    elif isinstance(value, list):
        pairs = enumerate(value)
    else:
        return
    for place, item in pairs:
        item = decode(item) if isinstance(item, str) else item
        if isinstance(item, dict):
            yield place, item


def _part(parent: Any, key: str) -> Any:
    parent = decode(parent) if isinstance(parent, str) else parent
    return parent.get(key) if isinstance(parent, dict) else None


def visit(record: dict) -> Iterator[tuple[str, str, str | None, dict]]:
    """(entity, position, parent position, fields) of a record, depth first.

    ``fields`` holds what isn't a list that is emitted itself.
    """
    own = {k: v for k, v in record.items() if k not in ("attempts", "metadata")}
    metadata = decode(record["metadata"]) if isinstance(record.get("metadata"), str) else record.get("metadata")
    if isinstance(metadata, dict):
        own |= {f"metadata.{k}": v for k, v in metadata.items() if k != "selection"}
        selection = metadata.get("selection")
        opened = decode(selection) if isinstance(selection, str) else selection
        own["metadata.selection"] = opened.get("rule") if isinstance(opened, dict) else selection
    yield "record", "", None, own
    for i, candidate in places(_part(_part(metadata, "selection"), "candidates")):
        yield "candidate", str(i), "", candidate
    for i, attempt in places(record.get("attempts")):
        diagnosis = attempt.get("diagnosis")
        diagnosis = decode(diagnosis) if isinstance(diagnosis, str) else diagnosis
        fields = {k: v for k, v in attempt.items() if k not in ("stage_seconds", "diagnosis")}
        if isinstance(diagnosis, dict):
            fields |= {f"diagnosis.{k}": v for k, v in diagnosis.items() if k != "margins"}
        yield "attempt", str(i), "", fields
        stack = [(f"{i}/{k}", str(i), s) for k, s in places(attempt.get("stage_seconds"))][::-1]
        while stack:
            position, parent, stage = stack.pop()
            yield "stage", position, parent, {k: v for k, v in stage.items() if k != "parts"}
            stack += [(f"{position}/{k}", position, s) for k, s in places(stage.get("parts"))][::-1]
        for k, margin in places(_part(diagnosis, "margins")):
            yield "margin", f"{i}/{k}", str(i), margin | {"diagnosis.failure_class": _part(diagnosis, "failure_class")}


def _open(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keep, items = [], []
        for n, payload in enumerate(pdf["payload"]):
            record = decode(payload)
            if isinstance(record, dict):
                keep.append(n)
                items.append([dict(entity=e, position=p, parent=q, payload=json.dumps(f, ensure_ascii=False)) for e, p, q, f in visit(record)])
        out = pdf.iloc[keep][["record_id", "delivered_at"]].copy()
        out["items"] = items
        if keep:
            yield out


def flatten(records: DataFrame) -> DataFrame:
    """(record_id, entity, position, parent, payload) of each record's last readable delivery.

    ``records`` has record_id, delivered_at and payload; other columns aren't read.
    A payload that is null, not JSON, or not an object is unreadable; a record with
    no readable delivery yields nothing. A null delivered_at is the earliest; of
    deliveries at the same time the one with the greatest rows is taken. Each
    payload is parsed once; deliveries of one record combine on the map side.
    """
    # ids travel as text: a null among them would turn a batch's ids into floats
    rows = records.select(F.col("record_id").cast("string").alias("record_id"), "delivered_at", "payload")
    opened = rows.mapInPandas(_open, f"record_id string, delivered_at timestamp, items {_ITEM}")
    last = opened.groupBy("record_id").agg(F.max(F.struct("delivered_at", "items")).alias("last"))
    return last.select(F.col("record_id").cast("bigint").alias("record_id"), F.inline("last.items"))


#: Typed columns of each entity: name -> (key in the payload, type).
SCHEMAS = {
    "record": {"job_id": ("job_id", "string"), "case_id": ("case_id", "string"), "compatibility_patch": ("metadata.compatibility_patch", "string"), "selection": ("metadata.selection", "string")},
    "attempt": {"status": ("status", "string"), "peak_tree_rss_bytes": ("peak_tree_rss_bytes", "bigint"), "schema_version": ("diagnosis.schema_version", "int"), "failure_class": ("diagnosis.failure_class", "string")},
    "stage": {"stage": ("stage", "string"), "elapsed": ("elapsed", "double")},
    "margin": {"operation": ("operation", "string"), "vertex": ("vertex", "bigint"), "margin_exact": ("margin_exact", "string"), "failure_class": ("diagnosis.failure_class", "string")},
    "candidate": {"epoch": ("epoch", "int"), "loss": ("loss", "double"), "groups": ("cover.groups", "bigint"), "uncovered": ("cover.uncovered", "bigint")},
}


def entity_table(flat: DataFrame, entity: str) -> DataFrame:
    """The typed table of one entity of ``flat``; values that don't fit their type are null."""

    def column(key: str, kind: str):
        outer, _, inner = key.partition(".")
        path = f"$.{outer}.{inner}" if outer == "cover" else f"$['{key}']"
        return F.get_json_object("payload", path).try_cast(kind)

    columns = [column(key, kind).alias(name) for name, (key, kind) in SCHEMAS[entity].items()]
    return flat.where(F.col("entity") == entity).select("record_id", "position", "parent", *columns)


def write_entities(flat: DataFrame, path: str) -> None:
    """All entities in one write, partitioned by tag; read one back with ``entity_table``."""
    flat.write.partitionBy("entity").mode("errorifexists").parquet(path)

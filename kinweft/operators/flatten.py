"""Deeply nested JSON documents into related flat tables.

Method: single-pass tagged emission. One depth-first visitor walks each document once and emits
rows (tag, pk, parent_id, pos, payload) in the order of writing; the rows are written partitioned
by tag, and each table is read back from its own partition under its own schema. There is no
shuffle: a document is visited where it is read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweft.scratch import Scratch

#: Members that wrap a document, in any depth.
ENVELOPES = ("document", "data", "atlas", "payload", "body", "result")
#: Columns of the tagged rows.
TAGGED = "doc_key bigint, doc_id string, tag string, pk string, parent_id string, pos int, payload string"
#: The schema of the payload of each table.
TABLES = {
    "animal": "id string, taxon string, sex string, status string, name struct<canonical:string,language:string>, external_ids array<struct<namespace:string,value:string>>",
    "alias": "value string, language string, source_ids array<string>",
    "event": "id string, type string, institution_id string",
    "date": "precision string, value string, start string, end string, notes string, written string",
}
MAX_WRAPS = 8


def read_document(text: str | None) -> dict | None:
    """The document in a payload: envelopes and repeated encodings are taken off; None if unreadable."""
    if text is None:
        return None
    try:
        doc = json.loads(text.lstrip("﻿"))
        for _ in range(MAX_WRAPS):
            if isinstance(doc, str):
                doc = json.loads(doc.lstrip("﻿"))
                continue
            if not isinstance(doc, dict):
                return None
            if "animals" in doc or "events" in doc:
                return doc
            inner = next((doc[k] for k in ENVELOPES if isinstance(doc.get(k), (dict, str))), None)
            if inner is None:
                return doc
            doc = inner
    except (ValueError, RecursionError):
        return None
    return doc if isinstance(doc, dict) else None


def members(thing, is_member) -> Iterator[tuple[int, str | None, object]]:
    """(pos, key, member) of a list, of an object in place of a list, or of a lone thing.

    Positions run from 0 through all of it in order of writing, lists under the keys of an object
    included; empty members count but are not given.
    """
    if thing is None:
        return
    if isinstance(thing, dict) and not is_member(thing):
        pos = 0
        for key, inner in thing.items():
            for x in inner if isinstance(inner, list) else [inner]:
                if x not in (None, "", {}, []):
                    yield pos, key, x
                pos += 1
        return
    for pos, x in enumerate(thing if isinstance(thing, list) else [thing]):
        if x not in (None, "", {}, []):
            yield pos, None, x


def date_written(date) -> str | None:
    """A date as written: one value, or ``start/end``; None where none is given."""
    if isinstance(date, (str, int)) and not isinstance(date, bool):
        return str(date) if str(date).strip() else None
    if isinstance(date, list):
        parts = [str(x) for x in date if x not in (None, "")]
        return "/".join(parts[:1] + parts[-1:] * (len(parts) > 1)) if parts else None
    if isinstance(date, dict):
        if date.get("value") not in (None, ""):
            return str(date["value"])
        start, end = date.get("start"), date.get("end")
        if start not in (None, "") or end not in (None, ""):
            return f"{start or ''}/{end or ''}"
    return None


def visit(doc: dict, doc_id: str | None) -> Iterator[tuple]:
    """(tag, pk, parent_id, pos, payload) of each thing of a document, depth first."""

    def event(pos: int, e, owner: str | None) -> Iterator[tuple]:
        if not isinstance(e, dict):
            return
        eid = _text(e.get("id"))
        yield "event", eid, owner, pos, {k: e.get(k) for k in ("id", "type", "institution_id")}
        written = date_written(e.get("date"))
        if written is not None:
            d = e["date"] if isinstance(e["date"], dict) else {"value": written}
            yield "date", written, eid, 0, d | {"written": written}

    listed = lambda d: "id" in d
    for pos, key, a in members(doc.get("animals"), listed):
        if not isinstance(a, dict):
            continue
        aid = _text(a.get("id", key))
        yield "animal", aid, doc_id, pos, a | {"id": aid}
        for at, lang, x in members(a.get("aliases"), lambda d: "value" in d and not isinstance(d["value"], list)):
            v = x.get("value") if isinstance(x, dict) else x
            if v in (None, "") or isinstance(v, (dict, list)):
                continue
            given = x if isinstance(x, dict) else {"value": _text(v), "language": lang}
            yield "alias", _text(v), aid, at, given
        for at, eid, e in members(a.get("events"), listed):
            yield from event(at, _with_id(e, eid), aid)
    for pos, eid, e in members(doc.get("events"), listed):
        if isinstance(e, dict):
            yield from event(pos, _with_id(e, eid), _text(e.get("animal_id")))


def flatten(payloads: DataFrame, key: str = "payload_id", doc_id: str = "atlas_id", payload: str = "payload") -> DataFrame:
    """Tagged rows (doc_key, doc_id, tag, pk, parent_id, pos, payload) of all documents.

    Unreadable, null and empty payloads give no rows, nor does a document without animals and
    events; a repeated payload gives its rows again. Null keys and ids are kept as null. Other
    columns are ignored, whatever their names. A document is held in memory one at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for k, d, p in zip(b["k"], b["d"], b["p"]):
                doc = read_document(p)
                if doc is None:
                    continue
                k, d = (None if pd.isna(k) else int(k)), (None if d is None or d != d else d)
                rows += [(k, d, tag, pk, parent, pos, json.dumps(x, ensure_ascii=False)) for tag, pk, parent, pos, x in visit(doc, d)]
                if len(rows) > 20_000:
                    yield _frame(rows)
                    rows = []
            yield _frame(rows)

    return payloads.select(F.col(key).cast("bigint").alias("k"), F.col(doc_id).alias("d"), F.col(payload).alias("p")).mapInPandas(run, TAGGED)


def related_tables(payloads: DataFrame, key: str = "payload_id", doc_id: str = "atlas_id", payload: str = "payload") -> dict[str, DataFrame]:
    """The flat tables by tag, each with doc_key, doc_id, pk, parent_id, pos and its own fields.

    The tagged rows are written once, partitioned by tag, to the shared folder.
    """
    store = Scratch(payloads.sparkSession, "flatten")
    out = store.write(flatten(payloads, key, doc_id, payload), "tagged", partition_by="tag")
    return {
        tag: out.where(F.col("tag") == tag).select("doc_key", "doc_id", "pk", "parent_id", "pos", F.from_json("payload", schema).alias("x"))
        for tag, schema in TABLES.items()
    }


def _text(x) -> str | None:
    return None if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def _with_id(e, key: str | None):
    return e | {"id": key} if isinstance(e, dict) and "id" not in e and key is not None else e


def _frame(rows: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=["doc_key", "doc_id", "tag", "pk", "parent_id", "pos", "payload"], dtype=object)
    return df.assign(doc_key=df["doc_key"].astype("Int64"), pos=df["pos"].astype("Int32"))

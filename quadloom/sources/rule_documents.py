"""Rule-set documents to rule tables.

A document is one row of text. Spark distributes the documents; a small parser on the standard XML
library turns each into one nested record, and the rule tables are projections of those records.
Entities are read in the striped form: node elements holding property elements, with
``rdf:about``, ``rdf:resource``, ``rdf:nodeID``, ``rdf:datatype`` and ``xml:lang``.
Both header layouts are read, child elements as well as attributes of the root.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession, functions as F

from quadloom import vocab as V
from quadloom.sources.rule_tables import PARAM_DDL, SLOT_DDL

_XML_LANG = "{http://www.w3.org/XML/1998/namespace}lang"
_RDF = "{" + V.RDF + "}"

RECORD_DDL = (
    "struct<name:string,version:string,source_onto:string,target_onto:string,creator:string,description:string,"
    "error:string,steps:array<struct<ordinal:int,order_attr:int,cell_id:string>>,"
    "cells:array<struct<cell_id:string,ordinal:int,relation:string,error:string,"
    f"patterns:array<struct<side:int,s:{SLOT_DDL},p:string,o:{SLOT_DDL}>>,"
    "typings:array<struct<var:string,datatype:string>>,filters:array<struct<var:string,datatype:string>>,"
    f"functions:array<struct<ordinal:int,fname:string,ret:string,params:array<{PARAM_DDL}>>>>>>"
)


class EntityError(ValueError):
    """Entity markup outside the supported subset."""


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _uri(tag: str) -> str:
    return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag


def _attr(el: ET.Element, name: str) -> str | None:
    """Attribute by local name, whatever its prefix."""
    return next((v for k, v in el.attrib.items() if _local(k) == name), None)


def _kids(el: ET.Element | None, name: str) -> list[ET.Element]:
    return [c for c in el if _local(c.tag) == name] if el is not None else []


def _kid(el: ET.Element | None, name: str) -> ET.Element | None:
    return next(iter(_kids(el, name)), None)


def _ref(value: str) -> str:
    return V.SRIPAS + value.lstrip("#") if ":" not in value else value


def _constant(kind: str, value: str, dt: str = "", lang: str = "") -> dict:
    return {"is_var": False, "term": {"kind": kind, "value": value, "dt": dt, "lang": lang}}


class _Entity:
    """Triples of one entity, in document order."""

    def __init__(self, side: int):
        self.side, self.blanks, self.out = side, 0, []

    def add(self, s: dict, p: str, o: dict) -> None:
        self.out.append({"side": self.side, "s": s, "p": p, "o": o})

    def fresh(self) -> dict:
        self.blanks += 1
        return _constant("bnode", f"e{self.side}b{self.blanks}")

    def node(self, el: ET.Element) -> dict:
        about, node_id = el.get(_RDF + "about"), el.get(_RDF + "nodeID")
        if about is not None:
            me = _constant("iri", _ref(about))
        else:
            me = _constant("bnode", "id-" + node_id) if node_id else self.fresh()
        if el.tag != _RDF + "Description":
            self.add(me, V.RDF_TYPE, _constant("iri", _uri(el.tag)))
        for k, v in el.attrib.items():
            if not k.startswith(_RDF) and k != _XML_LANG:
                self.add(me, _uri(k), _constant("lit", v, V.STRING))
        for prop in el:
            self.property(me, prop)
        return me

    def property(self, me: dict, el: ET.Element) -> None:
        p = _uri(el.tag)
        if el.tag.startswith(_RDF) and el.tag != _RDF + "type":
            raise EntityError(f"unsupported property element {el.tag}")
        resource, node_id = el.get(_RDF + "resource"), el.get(_RDF + "nodeID")
        mode = el.get(_RDF + "parseType")
        if resource is not None:
            self.add(me, p, _constant("iri", _ref(resource)))
        elif node_id is not None:
            self.add(me, p, _constant("bnode", "id-" + node_id))
        elif mode == "Resource":
            inner = self.fresh()
            self.add(me, p, inner)
            for child in el:
                self.property(inner, child)
        elif mode is not None:
            raise EntityError(f"unsupported parseType {mode}")
        elif len(el):
            for child in el:
                self.add(me, p, self.node(child))
        else:
            lang, dt = el.get(_XML_LANG), el.get(_RDF + "datatype")
            kind = V.LANG_STRING if lang else dt or V.STRING
            self.add(me, p, _constant("lit", el.text or "", kind, (lang or "").lower()))


def _pairs(parent: ET.Element | None, name: str) -> list[dict]:
    found = parent.iter() if parent is not None else ()
    return [{"var": _attr(e, "about"), "datatype": _attr(e, "datatype")} for e in found if _local(e.tag) == name]


def _functions(parent: ET.Element | None) -> list[dict]:
    out = []
    for i, fn in enumerate(e for e in (parent.iter() if parent is not None else ()) if _local(e.tag) == "function"):
        params = []
        for prm in _kids(fn, "param"):
            order, about, val = _attr(prm, "order"), _attr(prm, "about"), _attr(prm, "val")
            if order is None or (about is None and val is None):
                continue
            if not order.strip().isdecimal():
                raise EntityError(f"the order of a parameter is no number: {order}")
            params.append({
                "pos": int(order), "var": about, "val": None if about is not None else val,
                "datatype": None if about is not None else _attr(prm, "datatype"),
            })
        ret = _kid(fn, "return")
        params.sort(key=lambda q: q["pos"])
        out.append({
            "ordinal": i, "fname": _attr(fn, "about") or "", "params": params,
            "ret": (_attr(ret, "about") or "") if ret is not None else "",
        })
    return out


def _cell(el: ET.Element, ordinal: int, turtle: bool) -> dict:
    patterns, error = [], None
    for side in (1, 2):
        entity = _kid(el, f"entity{side}")
        if entity is None:
            continue
        try:
            if turtle and (entity.text or "").strip():
                raise EntityError("entities in turtle are not read; supply their pattern rows")
            reader = _Entity(side)
            for child in entity:
                reader.node(child)
            patterns += reader.out
        except EntityError as exc:
            error = str(exc)
    functions = []
    try:
        functions = _functions(_kid(el, "transformation"))
    except EntityError as exc:
        error = str(exc)
    if error:  # half a rule would delete or insert what the whole one does not
        patterns = []
    relation = _kid(el, "relation")
    return {
        "cell_id": _attr(el, "about") or _attr(el, "id") or "", "ordinal": ordinal,
        "relation": (relation.text or "").strip() if relation is not None else None,
        "error": error, "patterns": patterns, "typings": _pairs(_kid(el, "typings"), "typing"),
        "filters": _pairs(_kid(el, "filters"), "filter"), "functions": functions,
    }


def parse_document(source: str | None) -> dict:
    """One document as a record; a document that is not XML has only ``error``."""
    blank = {k: "" for k in ("name", "version", "source_onto", "target_onto", "creator", "description")}
    try:
        root = ET.fromstring(source or "")
    except ET.ParseError as exc:
        return {**blank, "error": str(exc), "steps": [], "cells": []}
    al = root if _local(root.tag) == "Alignment" else _kid(root, "Alignment")

    def header(tag: str, attr: str) -> str:
        el = _kid(al, tag)
        return (el.text or "") if el is not None else (_attr(al, attr) or "") if al is not None else ""

    def onto(tag: str) -> str:
        el = _kid(_kid(al, tag), "Ontology")
        return (_attr(el, "about") or "") if el is not None else ""

    form = _kid(_kid(al, "cellFormat"), "DataFormat")
    turtle = form is not None and _attr(form, "about") == V.CELL_FORMAT_TURTLE
    steps = []
    for i, st in enumerate(_kids(_kid(al, "steps"), "step")):
        order = _attr(st, "order")
        steps.append({"ordinal": i, "order_attr": int(order) if (order or "").isdigit() else None, "cell_id": _attr(st, "cell") or ""})
    maps = _kids(al, "map")
    cells = [c for m in maps for c in _kids(m, "Cell")]
    return {
        "name": header("title", "name"), "version": header("version", "version"),
        "source_onto": onto("onto1"), "target_onto": onto("onto2"),
        "creator": header("creator", "creator"), "description": header("description", "description"),
        "error": None if al is not None else "no alignment element",
        "steps": steps, "cells": [_cell(c, i, turtle) for i, c in enumerate(cells)],
    }


def parse_documents(df: DataFrame, column: str = "source_text") -> DataFrame:
    """Records of documents held in a text column."""
    # Not repeated below a filter or a generator, each of which would parse every document once more.
    parse = F.udf(parse_document, RECORD_DDL, useArrow=True).asNondeterministic()
    return df.withColumn("_doc", parse(column)).select(*df.columns, "_doc.*")


def rule_tables(records: DataFrame, created: str | None = None) -> dict[str, DataFrame]:
    """Rule tables of parsed documents. Persist ``records`` to parse only once."""
    stamp = F.lit(created).cast("timestamp") if created else F.current_timestamp()
    cells = records.select("name", "version", F.inline("cells"))

    def part(column: str) -> DataFrame:
        return cells.select("name", "version", "cell_id", F.inline(column))

    text = F.col("source_text") if "source_text" in records.columns else F.lit("")
    return {
        "alignment": records.where("error is null").select(
            "name", "version", "source_onto", "target_onto", "creator", "description",
            stamp.alias("created"), text.alias("source_text"),
        ),
        "alignment_step": records.select("name", "version", F.inline("steps")),
        "cell": cells.select("name", "version", "cell_id", "ordinal", "relation", "error"),
        "cell_pattern": part("patterns"),
        "cell_typing": part("typings"),
        "cell_filter": part("filters"),
        "cell_function": part("functions").select("name", "version", "cell_id", "ordinal", "fname", "ret", "params"),
    }


def unread_documents(records: DataFrame) -> DataFrame:
    """Documents that gave no rule set, and cells that cannot run, with the reason."""
    cells = records.where("error is null").select("name", "version", F.inline("cells")).where("error is not null")
    whole = records.where("error is not null").select("name", "version", F.lit(None).cast("string").alias("cell_id"), "error")
    return whole.unionByName(cells.select("name", "version", "cell_id", "error"))


def load_alignments(spark: SparkSession, path: str, strict: bool = False) -> dict[str, DataFrame]:
    """Rule tables of a folder of documents, one document per file. ``strict`` raises if a document or
    a cell cannot be read; else :func:`unread_documents` tells which."""
    files = spark.read.text(path, wholetext=True).withColumnRenamed("value", "source_text")
    records = parse_documents(files)
    if strict and (found := unread_documents(records).limit(10).collect()):
        raise ValueError("; ".join(f"{r['name']} {r['cell_id'] or ''}: {r['error']}" for r in found))
    return rule_tables(records)


def convert_layout(
    tables: dict[str, DataFrame],
    name: str = "new alignment",
    version: str = "1.0",
    creator: str = "automated converter",
    description: str = "automatically converted rule set",
) -> dict[str, DataFrame]:
    """Rule tables of the old layout in the conventions of the new one: header defaults for empty
    fields, and local cell ids expanded to full IRIs in cells and steps."""

    def default(col: str, value: str):
        return F.coalesce(F.nullif(F.col(col), F.lit("")), F.lit(value))

    def full(col: str):
        return F.when(F.col(col).contains(":"), F.col(col)).otherwise(F.concat(F.lit(V.SRIPAS), F.col(col)))

    out = {}
    for table, df in tables.items():
        df = df.withColumn("name", default("name", name)).withColumn("version", default("version", version))
        if table == "alignment":
            df = df.withColumn("creator", default("creator", creator))
            df = df.withColumn("description", default("description", description))
        if "cell_id" in df.columns:
            df = df.withColumn("cell_id", full("cell_id"))
        out[table] = df
    return out


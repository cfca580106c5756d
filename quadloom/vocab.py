"""Namespaces and IRIs shared by every module."""

from __future__ import annotations

# Prefix table and IRIs of the message and rule-set formats.
# Stored rule sets and messages use these exact strings, so they are kept as they are.
PREFIXES: dict[str, str] = {
    "sripas": "http://www.inter-iot.eu/sripas#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "ont1": "http://www.example.org/ontology1#",
    "ont2": "http://www.example.org/ontology2#",
    "ont3": "http://www.example.org/ontology3#",
    "ont4": "http://www.example.org/ontology4#",
    "ont5": "http://www.example.org/ontology5#",
    "ont6": "http://www.example.org/ontology6#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "iot-lite": "http://purl.oclc.org/NET/UNIS/fiware/iot-lite#",
    "ns": "http://creativecommons.org/ns#",
    "georss": "http://www.georss.org/georss/",
    "OrientDB": "http://www.dewi.org/WDA.owl#OrientDB",
    "ACS": "http://www.dewi.org/ACS.owl#",
    "WDA": "http://www.dewi.org/WDA.owl#",
    "terms": "http://purl.org/dc/terms/",
    "xml": "http://www.w3.org/XML/1998/namespace#",
    "wgs84_pos": "http://www.w3.org/2003/01/geo/wgs84_pos#",
    "DUL": "http://www.loa-cnr.it/ontologies/DUL.owl#",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "dc": "http://purl.org/dc/elements/1.1/",
    "my_port": "http://example.sripas.org/ontologies/port.owl#",
    "exmo": "http://exmo.inrialpes.fr/align/ext/1.0/#",
    "align": "http://knowledgeweb.semanticweb.org/heterogeneity/alignment#",
    "iiot": "http://inter-iot.eu/GOIoTP#",
    "iiotex": "http://inter-iot.eu/GOIoTPex#",
    "InterIoTMsg": "http://inter-iot.eu/message/",
}
PAYLOAD_GRAPH = PREFIXES["InterIoTMsg"] + "payload"
CELL_FORMAT_RDFXML = "http://inter-iot.eu/sripas#rdfxml"
CELL_FORMAT_TURTLE = "http://inter-iot.eu/sripas#turtle"

RDF = PREFIXES["rdf"]
XSD = PREFIXES["xsd"]
ALIGN = PREFIXES["align"]
SRIPAS = PREFIXES["sripas"]
RDF_TYPE = RDF + "type"
LANG_STRING = RDF + "langString"
STRING = XSD + "string"
INTEGER = XSD + "integer"
DECIMAL = XSD + "decimal"
FLOAT = XSD + "float"
DOUBLE = XSD + "double"
BOOLEAN = XSD + "boolean"
DATETIME = XSD + "dateTime"
DAY_TIME_DURATION = XSD + "dayTimeDuration"

#: Default graph of a message.
DEFAULT_GRAPH = ""

#: Datatypes that take part in arithmetic as whole numbers.
INTEGER_TYPES = tuple(
    XSD + n
    for n in (
        "integer", "long", "int", "short", "byte",
        "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger",
        "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte",
    )
)


def set_prefix(prefix: str, namespace: str) -> None:
    """Add or replace a prefix for plans built from now on."""
    PREFIXES[prefix] = namespace


def expand(name: str) -> str:
    """Expand ``prefix:local`` with the prefix table; anything else is returned unchanged."""
    prefix, sep, local = name.partition(":")
    if sep and not local.startswith("//") and prefix in PREFIXES:
        return PREFIXES[prefix] + local
    return name

"""SQL side of the catalog, written from the meaning of each rule, not from its plan."""

from __future__ import annotations

S = "http://example.org/src#"
D = "http://example.org/dst#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
# Fixed values of the message format.
PAYLOAD = "http://inter-iot.eu/message/payload"
MESSAGE = "http://inter-iot.eu/message/"
MARK = "http://www.inter-iot.eu/sripas#"
TYPE = RDF + "type"
STR, INT, DEC, BOOL, DBL = (XSD + x for x in ("string", "integer", "decimal", "boolean", "double"))
LANG = RDF + "langString"

ORACLES: dict[str, str] = {}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def money(c: str) -> str:
    return f"CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR)"


def dec(x: str) -> str:
    return f"regexp_replace(regexp_replace(CAST(CAST({x} AS DECIMAL(38,12)) AS VARCHAR), '0+$', ''), '\\.$', '.0')"


EV = f"""ev AS (
  SELECT CAST(event_id AS VARCHAR) AS m, event_id, '{S}event/' || event_id AS e, event_type AS et,
    '{S}user/' || user_id AS u, {money('value')} AS v, CAST(value AS DECIMAL(18,2)) AS vd,
    regexp_extract(props, '"k"\\s*:\\s*(\\d+)', 1) AS k,
    CAST(regexp_extract(props, '"k"\\s*:\\s*(\\d+)', 1) AS INT) % 2 = 0 AS even,
    CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS ep, ts
  FROM events)"""
KDT = f"CASE WHEN even THEN '{INT}' ELSE '{STR}' END"

LI = f"""li AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS m, '{S}order/' || l_orderkey AS o,
    'l' || md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
      {money('l_quantity')}, {money('l_extendedprice')}, {money('l_discount')}, {money('l_tax')},
      l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d'))) AS l,
    {money('l_quantity')} AS qty, {money('l_extendedprice')} AS price, {money('l_discount')} AS disc,
    '{S}part/' || l_partkey AS part, *
  FROM lineitem)"""
OD = f"""od AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS m, '{S}order/' || o_orderkey AS o, '{S}customer/' || o_custkey AS c, o_orderstatus AS st FROM orders)"""


def tr(src: str, sk: str, sv: str, p: str, ok: str, ov: str, od: str = "''", where: str = "true", m: str = "m", extra: str = "") -> str:
    """One triple per row of ``src``; ``p`` and the kinds are plain text, the others SQL."""
    return (
        f"SELECT {m} AS msg_id{extra}, {q(sk)} AS s_kind, {sv} AS s_value, {p if p.startswith('(') else q(p)} AS p,"
        f" {q(ok)} AS o_kind, {ov} AS o_value, {od} AS o_dt, '' AS o_lang FROM {src} WHERE {where}"
    )


def union(*parts: str) -> str:
    return "\nUNION ALL\n".join(parts)


def event(where="true", drop=(), m="m", extra="", src="ev") -> list[str]:
    """Payload triples of an event, without the named ones."""
    all_ = {
        "type": tr(src, "iri", "e", TYPE, "iri", f"'{S}' || et", where=where, m=m, extra=extra),
        "user": tr(src, "iri", "e", S + "user", "iri", "u", where=where, m=m, extra=extra),
        "obs": tr(src, "iri", "e", S + "observation", "bnode", "'o'", where=where, m=m, extra=extra),
        "value": tr(src, "bnode", "'o'", S + "value", "lit", "v", q(DEC), where=where, m=m, extra=extra),
        "k": tr(src, "bnode", "'o'", S + "k", "lit", "k", KDT, where=where, m=m, extra=extra),
    }
    return [t for n, t in all_.items() if n not in drop]


def fresh(label: str, variables: list[tuple[str, str, str]], pos=0, step=0, m="m") -> str:
    """Blank node of a solution: hash over message, position, label and all variables by name."""
    parts = [m, q(str(pos)), q(str(step)), q(label)]
    for kind, value, dt in variables:
        parts += [q(kind), value, dt, "''"]
    return f"'b' || md5(concat_ws(chr(1), {', '.join(parts)}))"


def reading_node(pos=0, step=0, m="m") -> str:
    return fresh("r", [("iri", "e", "''"), ("lit", "k", q(INT)), ("bnode", "'o'", "''"), ("lit", "v", q(DEC))], pos, step, m)


def reading(where="true", pos=0, step=0, m="m", extra="", src="ev") -> list[str]:
    """What the reading rule leaves of an event with a whole-number k, beside class and user."""
    r, w = reading_node(pos, step, m), f"even AND {where}"
    return [
        tr(src, "iri", "e", D + "reading", "bnode", r, where=w, m=m, extra=extra),
        tr(src, "bnode", r, D + "scaled", "lit", dec("vd * 1.5"), q(DEC), where=w, m=m, extra=extra),
        tr(src, "bnode", r, D + "k", "lit", "k", q(INT), where=w, m=m, extra=extra),
    ]


def add(names: str, body: str, *ctes: str) -> None:
    for n in names.split():
        ORACLES[n] = (f"WITH {', '.join(ctes)}\n" if ctes else "") + body


# --- one cell on events ------------------------------------------------------------------------

add("cell_reading_relational cell_reading_nested",
    union(*event(drop=("obs", "value", "k")), *event("NOT even", drop=("type", "user")), *reading()), EV)
add("cell_unconditional_insert cell_unconditional_insert_nested",
    union(*event(), tr("ev", "iri", q(D + "batch"), D + "kind", "lit", "'events'", q(STR)),
          tr("ev", "bnode", fresh("n", []), D + "by", "iri", q(D + "batch"))), EV)
add("cell_delete_only cell_delete_only_nested", union(*event(drop=("user", "obs"))), EV)
add("cell_typing cell_typing_nested",
    union(*event(drop=("k",)), tr("ev", "bnode", "'o'", D + "k", "lit", "k", q(INT)),
          tr("ev", "bnode", "'o'", D + "next", "lit", "CAST(CAST(k AS BIGINT) + 1 AS VARCHAR)", q(INT))), EV)
add("cell_marker_class cell_marker_class_nested",
    union(*event(drop=("obs", "value")), tr("ev", "iri", "e", D + "value", "lit", "v", q(DEC))), EV)
add("cell_delete_and_reinsert cell_delete_and_reinsert_nested",
    union(*event(), tr("ev", "iri", "u", D + "did", "iri", "e")), EV)
add("predicate_variable",
    union(*event(drop=("obs", "value", "k")), tr("ev", "iri", "e", S + "value", "lit", "v", q(DEC)),
          tr("ev", "iri", "e", S + "k", "lit", "k", KDT)), EV)
add("graph_pattern_datatype_filter", "SELECT m AS msg_id, e, k FROM ev WHERE even", EV)
add("bindings_retype", f"SELECT m AS msg_id, k, '{DBL}' AS dt, true AS blank_is_error FROM ev", EV)
add("effect_report", "SELECT m AS msg_id, 3 AS deleted, 3 AS inserted FROM ev WHERE even", EV)
add("effect_report_by_step", """
SELECT m AS msg_id, 0 AS step, 'reading' AS cell_id, 3 AS deleted, 3 AS inserted FROM ev WHERE even
UNION ALL SELECT m, 1, 'user', 1, 1 FROM ev
UNION ALL SELECT m, 2, 'mark', 1, 1 FROM ev WHERE even""", EV)

# --- one cell on orders ------------------------------------------------------------------------

BOTH = "m IN (SELECT m FROM od) AND m IN (SELECT m FROM li)"


def order(drop=(), where="true", m="m", extra="") -> list[str]:
    all_ = {
        "customer": tr("od", "iri", "o", S + "customer", "iri", "c", where=where, m=m, extra=extra),
        "status": tr("od", "iri", "o", S + "status", "lit", "st", q(STR), where=where, m=m, extra=extra),
        "line": tr("li", "iri", "o", S + "line", "bnode", "l", where=where, m=m, extra=extra),
        "quantity": tr("li", "bnode", "l", S + "quantity", "lit", "qty", q(DEC), where=where, m=m, extra=extra),
        "price": tr("li", "bnode", "l", S + "price", "lit", "price", q(DEC), where=where, m=m, extra=extra),
        "discount": tr("li", "bnode", "l", S + "discount", "lit", "disc", q(DEC), where=where, m=m, extra=extra),
        "part": tr("li", "bnode", "l", S + "part", "iri", "part", where=where, m=m, extra=extra),
    }
    return [t for n, t in all_.items() if n not in drop]


def only(*names: str, **kw) -> list[str]:
    every = ("customer", "status", "line", "quantity", "price", "discount", "part")
    return order(drop=tuple(n for n in every if n not in names), **kw)


add("cell_cross_part_insert",
    union(*order(drop=("status",)), *only("status", where=f"NOT ({BOTH})"),
          "SELECT li.m AS msg_id, 'bnode' AS s_kind, l AS s_value, " + q(D + "status") + " AS p, 'lit' AS o_kind, st AS o_value, "
          + q(STR) + " AS o_dt, '' AS o_lang FROM li JOIN od ON li.m = od.m"), LI, OD)
add("cell_independent_parts",
    union(*order(drop=("status", "part")), *only("status", "part", where=f"NOT ({BOTH})"),
          tr("od", "iri", "o", D + "state", "lit", "st", q(STR), where=BOTH),
          tr("li", "bnode", "l", D + "item", "iri", "part", where=BOTH)), LI, OD)
add("cell_literal_constant",
    union(*order(drop=("status", "customer")), *only("status", "customer", where="st <> 'F'") ,
          tr("od", "iri", "o", D + "closed_for", "iri", "c", where="st = 'F'")), LI, OD)
_line_vars = [("bnode", "l", "''"), ("iri", "o", "''"), ("lit", "qty", q(DEC))]
add("cell_fresh_nodes",
    union(*order(drop=("line", "quantity")), tr("li", "iri", "o", D + "line", "bnode", fresh("n", _line_vars)),
          tr("li", "bnode", fresh("n", _line_vars), D + "amount", "bnode", fresh("m", _line_vars)),
          tr("li", "bnode", fresh("m", _line_vars), D + "number", "lit", "qty", q(DEC))), LI, OD)
add("cell_unbound_insert",
    union(*order(drop=("price", "discount")), tr("li", "bnode", "l", D + "price", "lit", "price", q(DEC))), LI, OD)
add("graph_union_and_difference", union(*order(drop=("line",))), LI, OD)
add("graph_pattern_match", "SELECT m AS msg_id, l, o, part AS p, qty AS q FROM li", LI)
add("cell_repeated_variable", f"""
SELECT m AS msg_id, 'iri' AS s_kind, a AS s_value,
  CASE WHEN a = b THEN '{D}loop' ELSE '{S}pairs' END AS p, CASE WHEN a = b THEN 'lit' ELSE 'iri' END AS o_kind,
  CASE WHEN a = b THEN 'true' ELSE b END AS o_value, CASE WHEN a = b THEN '{BOOL}' ELSE '' END AS o_dt, '' AS o_lang
FROM (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS m, '{S}item/' || (l_partkey % 50) AS a, '{S}item/' || (l_suppkey % 50) AS b FROM lineitem)""")

# --- functions ---------------------------------------------------------------------------------


def values(src: str, key: str, ctes=(), distinct=False, **cols: tuple[str, str]) -> str:
    """``name=(value, datatype)``, both SQL; the datatype is unknown where the value is."""
    out = [f"{key} AS key"]
    for name, (value, dt) in cols.items():
        out += [f"{value} AS {name}", f"CASE WHEN ({value}) IS NOT NULL THEN {dt} END AS {name}_dt"]
    return f"SELECT {'DISTINCT ' if distinct else ''}{', '.join(out)} FROM {src}"


def s_(x):
    return (x, q(STR))


def i_(x):
    return (f"CAST({x} AS VARCHAR)", q(INT))


def d_(x):
    return (dec(x), q(DEC))


def x_(x):
    """A decimal with all the digits of its SQL type."""
    return (f"regexp_replace(regexp_replace(CAST({x} AS VARCHAR), '0+$', ''), '\\.$', '.0')", q(DEC))


def b_(x):
    return (f"CAST({x} AS VARCHAR)", q(BOOL))


NONE = ("CAST(NULL AS VARCHAR)", "''")

add("functions_string", values(
    "documents", "doc_id",
    concat=s_("text || '|' || lang"), strlen=i_("length(text)"), substr=s_("substring(text, 3, 5)"), tail=s_("substring(text, 4)"),
    ucase=s_("upper(source)"), lcase=s_("lower(source)"), starts=b_("starts_with(text, 'The')"), ends=b_("ends_with(text, '.')"),
    contains=b_("contains(text, 'the')"),
    before=s_("CASE WHEN strpos(text, ' ') = 0 THEN '' ELSE substring(text, 1, strpos(text, ' ') - 1) END"),
    after=s_("CASE WHEN strpos(text, '. ') = 0 THEN '' ELSE substring(text, strpos(text, '. ') + 2) END"),
    replace=s_("regexp_replace(text, '[aeiou]+', '_', 'g')"), regex=b_("regexp_matches(text, '(?i)(th|he) ')"),
    uri=s_("url_encode(text)")))
_q, _p, _n = "CAST(l_quantity AS DECIMAL(18,2))", "CAST(l_extendedprice AS DECIMAL(18,2))", "l_linenumber"
add("functions_arithmetic", values(
    "li", "l", distinct=True,
    add=d_(f"{_q} + {_p}"), add_int=i_("l_linenumber + l_partkey"), sub=d_(f"{_p} - {_q} - {_n}"), mul=d_(f"{_q} * {_p}"),
    mul_int=i_("l_linenumber * l_partkey"), div=d_(f"{_p} * 0.125"), div_zero=NONE, untyped=NONE,
    dbl=(f"CAST(CAST(2 * {_n} AS DOUBLE) AS VARCHAR) || 'e0'", q(DBL))), LI)
_d, _x = "CAST(l_discount AS DECIMAL(4,2))", "CAST(l_tax AS DECIMAL(4,2))"
_m, _e = "CAST(l_extendedprice AS DECIMAL(12,2))", "CAST('0.00000001' AS DECIMAL(8,8))"
_big = "CAST(l_orderkey || '99999999999999999999.5' AS DECIMAL(36,2))"
add("functions_exact_decimals", values(
    "li", "l", distinct=True,
    mul=x_(f"{_m} * {_d} * {_x}"), mul_tiny=x_(f"{_m} * {_d} * {_x} * {_e}"), add_tiny=x_(f"CAST({_m} AS DECIMAL(20,8)) + {_e}"),
    sub_tiny=x_(f"{_e} - CAST({_d} AS DECIMAL(12,8))"), add_large=x_(f"{_big} + {_d}"), abs_tiny=x_(f"abs({_e} - CAST({_m} AS DECIMAL(20,8)))"),
    floor_large=d_(f"floor({_big})"), cast_tiny=x_(f"{_x} * {_e}")), LI)
_b = "CAST(c_acctbal AS DECIMAL(18,2))"
add("functions_numeric", values(
    "customer", "c_custkey", abs=d_(f"abs({_b})"), ceil=d_(f"ceil({_b})"), floor=d_(f"floor({_b})"), round=d_(f"floor({_b} + 0.5)"),
    abs_int=i_("c_custkey"), round_int=i_("c_custkey"), numeric=b_("true"), not_numeric=b_("false")))
_zone = "event_id % 3"
add("functions_date", values(
    "events", "event_id", year=i_("year(ts)"), month=i_("month(ts)"), day=i_("day(ts)"), hours=i_("hour(ts)"), minutes=i_("minute(ts)"),
    seconds=("regexp_replace(regexp_replace(CAST(CAST(strftime(ts, '%S.%g') AS DECIMAL(18,6)) AS VARCHAR), '0+$', ''), '\\.$', '')", q(DEC)),
    tz=s_(f"CASE {_zone} WHEN 0 THEN 'Z' WHEN 1 THEN '-05:30' ELSE '' END"),
    timezone=(f"CASE {_zone} WHEN 0 THEN 'PT0S' WHEN 1 THEN '-PT5H30M' END", q(XSD + "dayTimeDuration")),
    utc=s_("strftime(ts, '%Y:%m:%d %H:%M:%S')"), utc_bad=NONE))
add("functions_hash", values("documents", "doc_id", md5=s_("md5(text)"), sha1=s_("sha1(text)"), sha256=s_("sha256(text)")))
_node = f"'{S}customer/' || c_custkey"
add("functions_term", values(
    "customer", "c_custkey", str=s_(_node), iri=(f"'{S}' || c_mktsegment", "''"), strdt=("c_name", _node), strlang=("c_name", q(LANG)),
    lang=s_("'en-gb'"), datatype=(q(LANG), "''"), langmatches=b_("true"), isiri=b_("true"), isblank=b_("false"), isliteral=b_("true"),
    same=b_("false"), bnode=("'b' || md5(c_name)", "''")))
_bal = money("c_acctbal")
add("functions_condition", values(
    "customer", "c_custkey",
    if_=(f"CASE WHEN c_mktsegment = 'BUILDING' THEN {_bal} ELSE 'no' END", f"CASE WHEN c_mktsegment = 'BUILDING' THEN '{DEC}' ELSE '{STR}' END"),
    if_error=NONE, coalesce=(_bal, q(DEC)), bound=b_("false")))
add("functions_cast", values(
    "customer", "c_custkey", to_int=i_(f"CAST(trunc({_b}) AS BIGINT)"), to_dec=d_("c_custkey"), to_bool=b_("c_custkey <> 0"), to_str=s_(_bal),
    bad=NONE, bool_int=i_("1"), dt=NONE))

# --- composition -------------------------------------------------------------------------------


def meta() -> str:
    return tr("ev", "iri", "e", S + "epoch", "lit", "CAST(ep AS VARCHAR)", q(INT), extra=", '' AS g")


G = f", '{PAYLOAD}' AS g"


def marked(where="true", m="m", extra=G, src="ev") -> list[str]:
    """After the reading, user and mark rules, beside the class."""
    r, w = reading_node(m=m), f"even AND {where}"
    kw = dict(m=m, extra=extra)
    return [
        tr(src, "iri", "e", D + "actor", "iri", "u", where=where, **kw),
        tr(src, "iri", "e", D + "reading", "bnode", r, where=w, **kw),
        tr(src, "bnode", r, D + "amount", "lit", dec("vd * 1.5 + 10"), q(DEC), where=w, **kw),
        tr(src, "bnode", r, D + "k", "lit", "k", q(INT), where=w, **kw),
        *event(f"NOT even AND {where}", drop=("type", "user"), src=src, **kw),
    ]


_class = tr("ev", "iri", "e", TYPE, "iri", f"'{S}' || et", extra=G)
_steps = union(meta(), _class, *marked())
add("alignment_steps_relational alignment_steps_nested alignment_from_rule_tables", _steps, EV)
add("alignment_chain", union(meta(), *marked(), tr("ev", "iri", "e", D + "label", "lit", "upper(et)", q(STR), extra=G)), EV)
_lift = union(meta(), *event(extra=G))
add("alignment_identity jsonld_read jsonld_round_trip", _lift, EV)
add("alignment_steps_by_size", union(meta(), _class, *marked(), *order(m="'order/' || m", extra=", '' AS g")), EV, LI, OD)
_x = ", 'malformed' AS cell_id"
add("alignment_malformed_cell",
    union(*event(drop=("user", "obs", "value", "k"), extra=_x), tr("ev", "iri", "e", D + "actor", "iri", "u", extra=_x),
          *event("NOT even", drop=("type", "user"), extra=_x), *reading(step=2, extra=_x)), EV)
CH = """ch AS (
  SELECT n_nationkey + 1 AS id, ['click', 'view', 'purchase', 'signup', 'error'][n_nationkey % 5 + 1] AS topic,
    n_nationkey % 3 <> 0 AS inp, n_nationkey % 2 = 0 AS outp, 'out/' || n_name AS sink FROM nation),
rt AS (SELECT ev.*, ch.id || '/' || ev.m AS rm, inp, outp, sink FROM ev JOIN ch ON ev.et = ch.topic)"""
_k = dict(m="rm", extra=", sink", src="rt")
add("channel_routing stream_channels batch_channels_from_text",
    union(*event("NOT inp", **_k), *marked("inp", **_k),
          tr("rt", "iri", "e", TYPE, "iri", f"'{S}' || et", where="inp AND NOT outp", m="rm", extra=", sink"),
          tr("rt", "iri", "e", D + "label", "lit", "upper(et)", q(STR), where="inp AND outp", m="rm", extra=", sink")), EV, CH)
_k = dict(m="m", src="rt", extra=f", rm, sink, '{PAYLOAD}' AS g")
_chains = union(
    tr("rt", "iri", "e", S + "epoch", "lit", "CAST(ep AS VARCHAR)", q(INT), extra=", rm, sink, '' AS g"),
    *event("NOT inp", **_k), *marked("inp", **_k),
    tr("rt", "iri", "e", TYPE, "iri", f"'{S}' || et", where="inp AND NOT outp", m="m", extra=_k["extra"]),
    tr("rt", "iri", "e", D + "label", "lit", "upper(et)", q(STR), where="inp AND outp", m="m", extra=_k["extra"]))
add("channel_chains", f"SELECT rm AS msg_id, g, sink, s_kind, s_value, p, o_kind, o_value, o_dt, o_lang FROM ({_chains})", EV, CH)
add("channel_chain_counts", """SELECT et AS topic, count(*) * any_value(n) AS n_translations, count(*) AS n_messages
FROM ev JOIN (SELECT topic, count(DISTINCT (inp, outp)) AS n FROM ch GROUP BY topic) ON et = topic GROUP BY et""", EV, CH)
add("channel_empty_payload", "SELECT m AS msg_id, 0 AS n_triples, 1 AS n_meta FROM ev", EV)

# --- messages ----------------------------------------------------------------------------------

_om = dict(m="'order/' || m", extra=", '' AS g")
add("payload_selection", union(*event(extra=G), *order(**_om)), EV, LI, OD)
add("payload_replacement",
    union(meta(), *event(extra=G), *order(drop=("status", "part"), **_om), *only("status", "part", where=f"NOT ({BOTH})", **_om),
          tr("od", "iri", "o", D + "state", "lit", "st", q(STR), where=BOTH, **_om),
          tr("li", "bnode", "l", D + "item", "iri", "part", where=BOTH, **_om)), EV, LI, OD)
_kj = "CASE WHEN even THEN k ELSE '\"' || k || '\"' END"


def raw(prefix: str = "") -> str:
    return (
        f"""'{{"@context":{{{prefix}"src":"{S}","value":{{"@id":"src:value","@type":"{DEC}"}}}},"@graph":[{{"@id":"src:event/' || event_id || '","src:epoch":' || ep ||"""
        f""" '}},{{"@id":"InterIoTMsg:payload","@graph":[{{"@id":"src:event/' || event_id || '","@type":"src:' || et || '","src:user":{{"@id":"src:' || substr(u, {len(S) + 1}) ||"""
        f""" '"}},"src:observation":{{"@id":"_:o","value":"' || v || '","src:k":' || {_kj} || '}}}}]}}]}}'"""
    )


add("jsonld_context_patch", f"SELECT m AS msg_id, {raw(f'''\"InterIoTMsg\":\"{MESSAGE}\",''')} AS raw FROM ev", EV)
_kdt = f"CASE WHEN even THEN '\"@type\":\"{INT}\",' ELSE '' END"
_nodes = (
    f"""'{{"@id":"_:o","{S}k":[{{' || {_kdt} || '"@value":"' || k || '"}}],"{S}value":[{{"@type":"{DEC}","@value":"' || v || '"}}]}},"""
    f"""{{"@id":"' || e || '","{S}observation":[{{"@id":"_:o"}}],"{S}user":[{{"@id":"' || u || '"}}],"{TYPE}":[{{"@id":"{S}' || et || '"}}]}}'"""
)
add("jsonld_write_payload", f"""SELECT m AS msg_id, '{{"@graph":[' || {_nodes} || ']}}' AS doc FROM ev""", EV)
add("jsonld_write_quads jsonld_segments", f"""SELECT m AS msg_id, '{{"@graph":[{{"@graph":[' || {_nodes} || '],"@id":"{PAYLOAD}"}}]}}' AS raw FROM ev""", EV)
add("jsonld_large_message", f"""SELECT m AS msg_id, row_number() OVER (PARTITION BY m ORDER BY part) - 1 AS piece, raw FROM (
  SELECT m, part, string_agg(frag, '' ORDER BY rn) AS raw FROM (
    SELECT m, rn, frag, coalesce(sum(strlen(frag)) OVER (PARTITION BY m ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 65536 AS part FROM (
      SELECT m, rn, CASE WHEN rn = 1 THEN '{{"@graph":[' WHEN p = 'priority' THEN ']}},' ELSE '],' END || CASE WHEN p = 'priority' THEN '{{"@id":"' || s || '",' ELSE '' END
          || '"{S}' || p || '":[{{"@value":"' || v || '"}}' || CASE WHEN rn = count(*) OVER (PARTITION BY m) THEN ']}}]}}' ELSE '' END AS frag FROM (
        SELECT *, row_number() OVER (PARTITION BY m ORDER BY s, p) AS rn FROM (
          SELECT o_orderstatus AS m, '{S}order/' || o_orderkey AS s, 'priority' AS p, o_orderpriority AS v FROM orders
          UNION ALL SELECT o_orderstatus, '{S}order/' || o_orderkey, 'status', o_orderstatus FROM orders)))) GROUP BY m, part)""")
add("stream_rejected_messages", "SELECT CAST(doc_id AS VARCHAR) AS msg_id, 'not json' AS bad, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents")
add("message_size_limit", "SELECT CAST(doc_id AS VARCHAR) AS msg_id, strlen(text) <= 1024 AS fits FROM documents")
add("bad_messages", "SELECT 'd' || doc_id AS msg_id, 'not json' AS bad FROM documents")

_CELL = f"CASE WHEN l_linenumber % 2 = 1 THEN '{MARK}' ELSE '' END || 'c' || l_linenumber"
_HAS = "SELECT 'A' || o_orderkey AS name, count(*) AS h, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS low FROM orders GROUP BY 1"
_LINES = "SELECT 'A' || l_orderkey AS name, count(*) AS n FROM lineitem GROUP BY 1"
_CELLS = f"""SELECT 'A' || l_orderkey AS name, {_CELL} AS cell_id, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'N') AS rel,
  count(*) FILTER (WHERE l_tax = 0.08) AS lit, count(*) FILTER (WHERE l_discount = 0.1) AS pred FROM lineitem GROUP BY 1, 2"""
_OWN = f"(SELECT name, coalesce(h, 0) AS h, coalesce(low, 0) AS low, coalesce(n, 0) AS n FROM ({_HAS}) FULL JOIN ({_LINES}) USING (name))"
add("quality_constraints", " UNION ALL ".join(
    f"SELECT name, '1' AS version, {cell} AS cell_id, '{rule}' AS rule, CAST({n} AS BIGINT) AS n FROM {src} WHERE {cond}"
    for cell, rule, n, src, cond in [
        ("CAST(NULL AS VARCHAR)", "one header", "h", _OWN, "h <> 1"), ("NULL", "source ontology", "low", _OWN, "low > 0"),
        ("NULL", "steps", "n", _OWN, "n = 0"), ("NULL", "cells", "n", _OWN, "n = 0"),
        ("cell_id", "one cell of an id", "n", f"({_CELLS})", "n > 1"), ("cell_id", "relation", "rel", f"({_CELLS})", "rel > 0"),
        ("cell_id", "subject is a node", "lit", f"({_CELLS})", "lit > 0"), ("cell_id", "predicate is an IRI", "pred", f"({_CELLS})", "pred > 0")]))

# --- sinks -------------------------------------------------------------------------------------

add("sink_rows", f"SELECT 'out/' || et AS topic, md5({raw()}) AS value FROM ev", EV)
add("sink_topic_log", f"SELECT 'out/' || et AS topic, {raw()} AS value, md5(et) AS channel_uuid FROM ev", EV)
add("sink_log_retained", f"""SELECT topic, value FROM (
  SELECT 'out/' || et AS topic, {raw()} AS value, row_number() OVER (PARTITION BY et ORDER BY event_id % 4 DESC, event_id DESC) AS rn FROM ev) WHERE rn = 1""", EV)
add("sink_retained_message", f"""SELECT sink, msg_id, md5(raw) AS raw FROM (
  SELECT 'out/' || et AS sink, m AS msg_id, {raw()} AS raw, row_number() OVER (PARTITION BY et ORDER BY ts DESC, event_id % 4 DESC, event_id DESC) AS rn FROM ev) WHERE rn = 1""", EV)
add("monitoring_latency", "SELECT 'mon-' || md5(et) AS topic, (ep * 1000) || ';' || (ep * 1000 + event_id % 97) AS value FROM ev", EV)
add("monitoring_rollup", """SELECT md5(et) AS channel_uuid, CAST((ep * 1000 + event_id % 97) // 3600000 * 3600000 AS BIGINT) AS from_ms,
  count(*) AS n, max(event_id % 97) AS max_ms, CAST(sum(event_id % 97) AS BIGINT) AS sum_ms FROM ev GROUP BY 1, 2""", EV)

# --- registry ----------------------------------------------------------------------------------

SA = f"""sa AS (SELECT CAST(s_suppkey + 1 AS INT) AS id, s_name AS name, 'v' || (s_nationkey % 3) AS version, '<doc> ' || s_suppkey || ' </doc>' AS source_text FROM supplier),
cu AS (SELECT c_name AS name, 'v1' AS version, '<doc>' || c_mktsegment || '</doc>' AS source_text FROM customer)"""
SC = """sc AS (SELECT CAST(c_custkey + 1 AS INT) AS id,
  CASE WHEN c_custkey % 10 = 9 THEN 'XX' WHEN c_custkey % 2 = 0 THEN 'KK' ELSE 'MM' END AS chan_type, 'in/' || c_nationkey AS source,
  'Supplier#' || lpad(CAST(c_nationkey AS VARCHAR), 9, '0') AS inp_name, 'v' || (c_custkey % 3) AS inp_version,
  CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE 'Supplier#' || lpad(CAST(c_custkey % 20 AS VARCHAR), 9, '0') END AS out_name,
  CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE 'v1' END AS out_version, 'out/' || c_custkey AS sink, '' AS consumer_group,
  CAST(c_custkey % 4 AS INT) AS parallelism, md5(c_name) AS uuid, c_custkey FROM customer)"""
RQ = """rq AS (SELECT md5('o' || o_orderkey) AS uuid, 'out/' || (o_orderkey * 7 % 5000) AS sink,
  o_orderstatus = 'F' AS kk, CASE WHEN o_orderpriority = '5-LOW' THEN 'mine' END AS cg, CASE WHEN o_orderpriority = '1-URGENT' THEN 4 ELSE 1 END AS par FROM orders),
refused AS (SELECT uuid, sink FROM rq WHERE sink IN (SELECT sink FROM sc) OR uuid > (SELECT min(uuid) FROM rq r WHERE r.sink = rq.sink))"""
_key = "md5(md5(name) || ':' || md5(version))"
add("registry_key_hash", f"SELECT name, version, {_key} AS key FROM sa", SA)
add("registry_add_verdicts", """SELECT name, version, CASE WHEN id % 2 = 0 THEN 'already' ELSE 'conflict' END AS verdict FROM sa
UNION ALL SELECT name, version, 'created' FROM cu""", SA)
add("registry_add_alignments", f"""SELECT id, name, version, source_text FROM sa
UNION ALL SELECT CAST((SELECT max(id) FROM sa) + row_number() OVER (ORDER BY {_key}) AS INT), name, version, source_text FROM cu""", SA)
add("registry_delete_alignments", """SELECT name, version, CASE WHEN used THEN 'blocked' WHEN known THEN 'deleted' ELSE 'missing' END AS verdict,
  (SELECT count(*) FROM sa WHERE (name, version) IN (SELECT * FROM refs)) AS n_left
FROM (SELECT name, version, true AS known, (name, version) IN (SELECT * FROM refs) AS used FROM sa
  UNION ALL SELECT name, version, false, (name, version) IN (SELECT * FROM refs) FROM cu)""",
    SA, SC, "refs AS (SELECT inp_name, inp_version FROM sc UNION SELECT out_name, out_version FROM sc)")
add("registry_channel_counts", """SELECT name, version, count(DISTINCT id) AS n_channels FROM (
  SELECT inp_name AS name, inp_version AS version, id FROM sc UNION ALL SELECT out_name, out_version, id FROM sc) GROUP BY 1, 2""", SC)
add("registry_sink_conflicts", "SELECT uuid, sink FROM refused", SC, RQ)
add("registry_add_channels", """SELECT id, sink, consumer_group, parallelism, uuid FROM sc
UNION ALL SELECT CAST((SELECT max(id) FROM sc) + row_number() OVER (ORDER BY md5(uuid)) AS INT), sink,
  CASE WHEN kk THEN coalesce(cg, uuid) ELSE '' END, par, uuid FROM rq WHERE uuid NOT IN (SELECT uuid FROM refused)""", SC, RQ)
add("registry_delete_channels", "SELECT id, sink FROM sc WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')", SC)
add("registry_alignment_info", f"""SELECT id, name, version, '{S}' AS source_onto, '{D}' AS target_onto, 'c' AS creator, 'd' AS description,
  '[' || name || '] [' || version || '] : {S} -> {D}' AS desc_id FROM sa""", SA)
add("registry_channel_info", """SELECT id, source || ' ⇛ ⟪ {' || inp_name || '}:' || inp_version || ' ⇒ ' ||
  CASE WHEN out_name = '' THEN '{identity}' ELSE '{' || out_name || '}:' || out_version END || ' ⟫ ⇛ ' || sink AS desc_id FROM sc""", SC)
add("registry_find", "SELECT id, name FROM sa WHERE name = 'Supplier#000000003' AND version = 'v1' UNION ALL SELECT id, source FROM sc WHERE id = 7", SA, SC)

# --- quality -----------------------------------------------------------------------------------

RC = f"""rc AS (SELECT 'A' || l_orderkey AS name, '1' AS version,
  CASE WHEN l_linenumber % 2 = 1 THEN '{MARK}c' ELSE 'c' END || l_linenumber AS cell_id, 'c' || l_linenumber AS cid, *,
  'c' || (l_linenumber + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS step_cell, CAST(l_suppkey % 7 AS INT) AS attr FROM lineitem),
al AS (SELECT 'A' || o_orderkey AS name, '1' AS version, o_orderpriority = '5-LOW' AS no_onto FROM orders)"""
CHECKS = {
    "duplicate_cells": "SELECT name, version, cid AS cell_id, 'cell id not unique' AS rule, CAST(count(*) AS VARCHAR) AS detail FROM rc GROUP BY name, version, cid HAVING count(*) > 1",
    "missing_step_cells": "SELECT name, version, step_cell AS cell_id, 'step names a missing cell' AS rule, CAST(l_linenumber AS VARCHAR) AS detail FROM rc WHERE (name, step_cell) NOT IN (SELECT name, cid FROM rc)",
    "unbound_entity2": "SELECT DISTINCT name, version, cell_id, 'unbound variable in entity 2' AS rule, 'node_c' AS detail FROM rc WHERE l_quantity > 45",
    "unbound_params": "SELECT DISTINCT name, version, cell_id, 'unbound function parameter' AS rule, 'node_z' AS detail FROM rc WHERE l_discount > 0.08",
    "malformed_entities": "SELECT name, version, cell_id, 'malformed entity' AS rule, 'literal subject' AS detail FROM rc WHERE l_tax = 0.08"
    " UNION ALL SELECT name, version, cell_id, 'malformed entity', 'predicate is not an IRI' FROM rc WHERE l_discount = 0.1",
    "structure": "SELECT name, version, '' AS cell_id, 'structure' AS rule, 'no source ontology' AS detail FROM al WHERE no_onto"
    " UNION ALL SELECT name, version, '', 'structure', x FROM al, (SELECT unnest(['no steps', 'no cells']) AS x) WHERE name NOT IN (SELECT name FROM rc)"
    " UNION ALL SELECT DISTINCT name, version, '', 'structure', 'no header' FROM rc WHERE name NOT IN (SELECT name FROM al)"
    " UNION ALL SELECT name, version, cell_id, 'structure', 'no relation' FROM rc WHERE l_returnflag = 'N'",
}
for _n, _sql in CHECKS.items():
    add(f"quality_{_n}", _sql, RC)
_order = "'order attribute disagrees with document order' AS rule, CAST(b.{a} AS VARCHAR) AS detail"
_steps_check = f"SELECT b.name, b.version, b.step_cell AS cell_id, {_order.format(a='attr')} FROM rc a JOIN rc b ON a.name = b.name AND a.l_linenumber + 1 = b.l_linenumber WHERE b.attr < a.attr"
_report = union(*CHECKS.values(), _steps_check)
add("quality_report", _report, RC)
add("quality_valid_alignments", f"SELECT name, version FROM al WHERE name NOT IN (SELECT name FROM ({_report}))", RC)
add("quality_step_order", f"""SELECT b.name, b.version, b.cell_id, {_order.format(a='attr')} FROM cv a JOIN cv b ON a.name = b.name AND a.turn + 1 = b.turn WHERE b.attr < a.attr""",
    "cv AS (SELECT CAST(conv_id AS VARCHAR) AS name, '1' AS version, turn, CAST(length(text) % 10 AS INT) AS attr, 'c' || turn AS cell_id FROM conversations)")
add("quality_channels", """SELECT id, 'unknown alignment' AS rule, inp_name || ':' || inp_version AS detail FROM sc WHERE (inp_name, inp_version) NOT IN (SELECT name, version FROM sa)
UNION ALL SELECT id, 'unknown alignment', out_name || ':' || out_version FROM sc WHERE out_name <> '' AND (out_name, out_version) NOT IN (SELECT name, version FROM sa)
UNION ALL SELECT id, 'channel type', chan_type FROM sc WHERE chan_type = 'XX'
UNION ALL SELECT id, 'parallelism', CAST(parallelism AS VARCHAR) FROM sc WHERE parallelism < 1""", SA, SC)

# --- rule documents ----------------------------------------------------------------------------

_pk = "p_name AS name, CAST(p_partkey AS VARCHAR) AS version"
add("rule_document_headers", f"SELECT {_pk}, '{S}' AS source_onto, '{D}' AS target_onto, p_brand AS creator, p_type AS description FROM part")
add("rule_document_steps", f"SELECT {_pk}, o - 1 AS ordinal, o AS order_attr, '{MARK}c' || (3 - o) AS cell_id FROM part, (SELECT unnest([1, 2]) AS o)")


def _pattern(cell, side, sk, sv, p, ok, ov, od="''"):
    return (f"SELECT {_pk}, '{MARK}{cell}' AS cell_id, {side} AS side, '{sk}' AS s_kind, '{sv}' AS s_value, '' AS s_dt, '{p}' AS p,"
            f" '{ok}' AS o_kind, {ov} AS o_value, {od} AS o_dt FROM part")


add("rule_document_patterns", union(
    _pattern("c1", 1, "bnode", "e1b1", TYPE, "iri", q(MARK + "node_a")),
    _pattern("c1", 1, "bnode", "e1b1", S + "size", "lit", "CAST(p_size AS VARCHAR)", q(INT)),
    _pattern("c1", 2, "iri", MARK + "node_a", D + "size", "iri", q(MARK + "node_w")),
    _pattern("c2", 1, "bnode", "e1b1", TYPE, "iri", q(S + "part")),
    _pattern("c2", 1, "bnode", "e1b1", S + "brand", "lit", "p_brand", q(STR))))
add("rule_document_functions", f"""SELECT {_pk}, '{MARK}c1' AS cell_id, '*' AS fname, '{MARK}node_w' AS ret, o AS pos, CASE WHEN o = 1 THEN '{MARK}node_a' END AS var,
  CASE WHEN o = 2 THEN CAST(p_size AS VARCHAR) END AS val, CASE WHEN o = 2 THEN '{INT}' END AS datatype FROM part, (SELECT unnest([1, 2]) AS o)""")
add("rule_document_typings", f"""SELECT {_pk}, '{MARK}c1' AS cell_id, '{MARK}node_a' AS var, '{INT}' AS datatype, 'typing' AS what FROM part
UNION ALL SELECT {_pk}, '{MARK}c1', '{MARK}node_a', '{STR}', 'filter' FROM part""")
_name = "CASE WHEN ends_with(name, '0') THEN 'new alignment' ELSE name END AS name"
add("rule_layout_conversion", f"SELECT {_name}, version, '{MARK}' || cid AS cell_id FROM rc UNION ALL SELECT {_name}, version, '{MARK}' || step_cell FROM rc", RC)

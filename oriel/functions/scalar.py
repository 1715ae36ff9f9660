"""Scalar and aggregate functions: how each Oracle call is written in Spark SQL.

``SAME`` are written as they stand, ``RENAMED`` differ in name only, ``TEMPLATES`` are
filled with the arguments, and ``WRITERS`` build their text from the call.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from ..sql import tree as t
from ..sql.formats import TRUNC_UNITS, date_pattern, is_number_format
from ..sql.lexer import UnsupportedSyntax
from . import xml

SAME = frozenset(
    """ABS ACOS ASIN ATAN ATAN2 AVG CEIL COALESCE CORR COS COSH COUNT COVAR_POP COVAR_SAMP CUME_DIST CURRENT_DATE DENSE_RANK EXP FLOOR
    FIRST_VALUE GREATEST GROUPING GROUPING_ID INITCAP LAG LAST_DAY LAST_VALUE LEAD LEAST LENGTH LN LOWER LPAD MAX MEDIAN MIN NTH_VALUE
    NTILE NULLIF NVL2 PERCENT_RANK PERCENTILE_CONT PERCENTILE_DISC POWER RANK REGR_AVGX REGR_AVGY REGR_COUNT REGR_INTERCEPT REGR_R2
    REGR_SLOPE REGR_SXX REGR_SXY REGR_SYY REVERSE ROUND ROW_NUMBER RPAD SIGN SIN SINH SOUNDEX SQRT STDDEV STDDEV_POP STDDEV_SAMP SUM TAN
    TANH UPPER VARIANCE VAR_POP VAR_SAMP BIT_AND_AGG ANY_VALUE DECODE MOD""".split()
)
RENAMED = {
    "NVL": "coalesce", "LENGTHB": "octet_length", "ASCII": "ascii", "CARDINALITY": "size", "RAWTOHEX": "hex", "HEXTORAW": "unhex",
    "APPROX_COUNT_DISTINCT": "approx_count_distinct", "STANDARD_HASH": "sha1", "LENGTHC": "length", "NEXT_DAY": "next_day",
}
TEMPLATES = {
    "SYSDATE": "localtimestamp()", "SYSTIMESTAMP": "current_timestamp()", "CURRENT_TIMESTAMP": "current_timestamp()", "LOCALTIMESTAMP": "localtimestamp()",
    "USER": "current_user()", "SESSION_USER": "session_user()", "CURRENT_USER": "current_user()",
    # Spark has no user numbers: one made from the name, the same in every session
    "UID": "abs(hash(current_user()))",
    "SESSIONTIMEZONE": "current_timezone()", "SYS_GUID": "upper(replace(uuid(), '-', ''))",
    "TO_BINARY_DOUBLE": "cast({0} AS DOUBLE)", "TO_BINARY_FLOAT": "cast({0} AS FLOAT)", "TO_CLOB": "cast({0} AS STRING)", "TO_NCHAR": "cast({0} AS STRING)",
    "ADD_MONTHS": "CASE WHEN to_date({0}) = last_day({0}) THEN last_day(add_months({0}, cast({1} AS INT))) ELSE add_months({0}, cast({1} AS INT)) END",
    "MONTHS_BETWEEN": "months_between({0}, {1})",
    "TO_DSINTERVAL": "cast({0} AS INTERVAL DAY TO SECOND)", "TO_YMINTERVAL": "cast({0} AS INTERVAL YEAR TO MONTH)",
    "REGEXP_LIKE": "({0} RLIKE {1})", "REGEXP_COUNT": "regexp_count({0}, {1})", "LOG": "log({0}, {1})", "REMAINDER": "({0} - {1} * rint({0} / {1}))",
    "LNNVL": "coalesce(NOT ({0}), true)", "NANVL": "nanvl({0}, {1})", "BITAND": "({0} & {1})", "CHR": "char({0})", "TO_LOB": "cast({0} AS STRING)",
    "CONCAT": "concat(coalesce(cast({0} AS STRING), ''), coalesce(cast({1} AS STRING), ''))", "SYS_EXTRACT_UTC": "to_utc_timestamp({0}, current_timezone())",
    "JSON_SERIALIZE": "cast({0} AS STRING)", "JSON_EXISTS": "(get_json_object({0}, {1}) IS NOT NULL)",
    "WM_CONCAT": "listagg({0}, ',')", "COLLECT": "sort_array(collect_list({0}))",
}
AGGREGATES = frozenset(
    "COUNT SUM AVG MIN MAX MEDIAN STDDEV STDDEV_POP STDDEV_SAMP VARIANCE VAR_POP VAR_SAMP CORR COVAR_POP COVAR_SAMP LISTAGG COLLECT WM_CONCAT JSON_ARRAYAGG JSON_OBJECTAGG XMLAGG PERCENTILE_CONT PERCENTILE_DISC ANY_VALUE REGR_AVGX REGR_AVGY REGR_COUNT REGR_INTERCEPT REGR_R2 REGR_SLOPE REGR_SXX REGR_SXY REGR_SYY APPROX_COUNT_DISTINCT".split()
)
DATES = frozenset("SYSDATE SYSTIMESTAMP CURRENT_DATE CURRENT_TIMESTAMP LOCALTIMESTAMP TO_DATE TO_TIMESTAMP TO_TIMESTAMP_TZ ADD_MONTHS LAST_DAY NEXT_DAY".split())


def text_of(e: Any) -> str | None:
    return e.value if isinstance(e, t.Lit) and e.kind == "string" else None


def _format(call: t.Call, at: int) -> str | None:
    if len(call.args) <= at:
        return None
    if (fmt := text_of(call.args[at])) is None:
        raise UnsupportedSyntax(f"{call.parts[-1]} needs a literal format")
    return fmt


def _to_char(w, call: t.Call) -> str:
    x, fmt = w.expr(call.args[0]), _format(call, 1)
    if fmt is None:
        return f"cast({x} AS STRING)"
    if not is_number_format(fmt):
        return f"date_format({x}, {w.string(date_pattern(fmt))})"
    bare = fmt.upper().removeprefix("FM")
    digits = sum(c in "09" for c in bare)
    point = max(bare.find("D"), bare.find("."))
    scale = sum(c in "09" for c in bare[point:]) if point >= 0 else 0
    sign = bare.replace("S", "").replace("MI", "").replace("PR", "")
    number = f"trim(to_char(cast(abs({x}) AS DECIMAL({max(digits, scale + 1)}, {scale})), {w.string(sign)}))"
    signed = f"concat(CASE WHEN {x} < 0 THEN '-' ELSE '' END, {number})"
    return signed if fmt.upper().startswith("FM") else f"lpad({signed}, {len(sign) + 1}, ' ')"


def _to_number(w, call: t.Call) -> str:
    x, fmt = w.expr(call.args[0]), _format(call, 1)
    kind = "DECIMAL(38, 10)"
    out = f"cast({x} AS {kind})" if fmt is None else f"to_number({x}, {w.string(fmt.upper())})"
    if "default" in call.named:
        tried = f"try_cast({x} AS {kind})" if fmt is None else f"try_to_number({x}, {w.string(fmt.upper())})"
        return f"coalesce({tried}, cast({w.expr(call.named['default'])} AS {kind}))"
    return out


def _to_date(kind: str):
    def write(w, call: t.Call) -> str:
        x, fmt = w.expr(call.args[0]), _format(call, 1)
        return f"{kind}({x})" if fmt is None else f"{kind}({x}, {w.string(date_pattern(fmt))})"

    return write


def _trunc(w, call: t.Call) -> str:
    x = w.expr(call.args[0])
    if w.is_date(call.args[0]) or (len(call.args) > 1 and text_of(call.args[1]) is not None):
        unit = (_format(call, 1) or "DD").upper()
        if unit not in TRUNC_UNITS:
            raise UnsupportedSyntax(f"TRUNC to {unit}")
        return f"cast(date_trunc('{TRUNC_UNITS[unit]}', {x}) AS TIMESTAMP_NTZ)"
    n = w.expr(call.args[1]) if len(call.args) > 1 else "0"
    return f"(sign({x}) * floor(abs({x}) * pow(10, {n})) / pow(10, {n}) + 0D)"


def _round(w, call: t.Call) -> str:
    x = w.expr(call.args[0])
    if w.is_date(call.args[0]):
        unit = TRUNC_UNITS.get((_format(call, 1) or "DD").upper())
        half = {"YEAR": "INTERVAL '6' MONTH", "DAY": "INTERVAL '12' HOUR", "HOUR": "INTERVAL '30' MINUTE", "MINUTE": "INTERVAL '30' SECOND", "MONTH": "INTERVAL '16' DAY"}.get(unit or "")
        if half is None:
            raise UnsupportedSyntax("ROUND of a date to that unit")
        return f"cast(date_trunc('{unit}', {x} + {half}) AS TIMESTAMP_NTZ)" if unit != "MONTH" else f"cast(date_trunc('MONTH', CASE WHEN day({x}) >= 16 THEN add_months({x}, 1) ELSE {x} END) AS TIMESTAMP_NTZ)"
    return f"round({', '.join(w.expr(a) for a in call.args)})"


def _substr(w, call: t.Call) -> str:
    a = [w.expr(x) for x in call.args]
    return f"substr({a[0]}, cast({a[1]} AS INT)" + (f", cast({a[2]} AS INT))" if len(a) > 2 else ")")


def _instr(w, call: t.Call) -> str:
    a = [w.expr(x) for x in call.args]
    if len(a) == 2:
        return f"instr({a[0]}, {a[1]})"
    s, x, p, n = a[0], a[1], a[2], a[3] if len(a) > 3 else "1"
    last = f"(length({s}) - length({x}) + 1)"
    forward = f"filter(sequence({p}, greatest({last}, {p})), i -> substr({s}, i, length({x})) = {x})"
    # a negative place counts from the end and searches backwards
    start = f"least({last}, length({s}) + ({p}) + 1)"
    backward = f"filter(reverse(sequence(1, greatest({start}, 1))), i -> substr({s}, i, length({x})) = {x})"
    found = f"CASE WHEN {p} > 0 THEN {forward} ELSE {backward} END" if not p.lstrip("(").startswith("-") else backward
    found = forward if p.isdigit() else found
    return f"(CASE WHEN {s} IS NULL OR {x} IS NULL THEN NULL WHEN {last} < 1 THEN 0 ELSE coalesce(try_element_at({found}, cast({n} AS INT)), 0) END)"


def _trim(w, call: t.Call) -> str:
    x = w.expr(call.args[0])
    way = call.named.get("way", "BOTH")
    return f"trim({way} {w.expr(call.args[1])} FROM {x})" if len(call.args) > 1 else f"{ {'BOTH': 'trim', 'LEADING': 'ltrim', 'TRAILING': 'rtrim'}[way]}({x})"


def _side_trim(name: str, way: str):
    def write(w, call: t.Call) -> str:
        x = w.expr(call.args[0])
        return f"trim({way} {w.expr(call.args[1])} FROM {x})" if len(call.args) > 1 else f"{name}({x})"

    return write


def _replace(w, call: t.Call) -> str:
    a = [w.expr(x) for x in call.args] + (["''"] if len(call.args) == 2 else [])
    return f"replace({', '.join(a)})"


def _translate(w, call: t.Call) -> str:
    return f"translate({', '.join(w.expr(x) for x in call.args)})"


def _extract(w, call: t.Call) -> str:
    return f"extract({text_of(call.args[0])} FROM {w.expr(call.args[1])})"


def _validate(w, call: t.Call) -> str:
    kind = w.type_text(text_of(call.args[1]))
    x = w.expr(call.args[0])
    if len(call.args) > 2:
        return f"CASE WHEN {x} IS NULL OR try_to_timestamp({x}, {w.string(date_pattern(_format(call, 2)))}) IS NOT NULL THEN 1 ELSE 0 END"
    return f"CASE WHEN {x} IS NULL OR try_cast({x} AS {kind}) IS NOT NULL THEN 1 ELSE 0 END"


def _json_value(w, call: t.Call) -> str:
    out = f"get_json_object({w.expr(call.args[0])}, {w.expr(call.args[1])})"
    if "returning" in call.named:
        out = f"{'cast' if call.named.get('strict') else 'try_cast'}({out} AS {w.type_text(call.named['returning'])})"
    return f"coalesce({out}, {w.expr(call.named['default'])})" if "default" in call.named else out


def _json_query(w, call: t.Call) -> str:
    out = f"get_json_object({w.expr(call.args[0])}, {w.expr(call.args[1])})"
    return f"concat('[', {out}, ']')" if call.named.get("wrapper") else out


def _json_object(w, call: t.Call) -> str:
    a = call.args
    pairs = ", ".join(f"{w.string(text_of(a[i]) or '') if text_of(a[i]) is not None else w.expr(a[i])}, {w.expr(a[i + 1])}" for i in range(0, len(a), 2))
    options = "" if call.named.get("absent") else ", map('ignoreNullFields', 'false')"
    return f"to_json(named_struct({pairs}){options})"


def _json_array(w, call: t.Call) -> str:
    return f"concat('[', array_join(array({', '.join(w.json_scalar(a, call.named.get('absent', True)) for a in call.args)}), ','), ']')"


def _json_arrayagg(w, call: t.Call) -> str:
    x = w.expr(call.args[0])
    if not call.order:
        return w.windowed(f"to_json(collect_list({x}))", call)
    keys = ", ".join(f"'k{i}', {w.expr(o.expr)}" for i, o in enumerate(call.order))
    down = "false" if call.order[0].desc else "true"
    return f"to_json(transform(sort_array(collect_list(named_struct({keys}, 'x', {x})), {down}), s -> s.x))"


def _json_objectagg(w, call: t.Call) -> str:
    return f"to_json(map_from_entries(sort_array(collect_list(struct({w.expr(call.args[0])}, {w.expr(call.args[1])})))))"


def _listagg(w, call: t.Call) -> str:
    x = w.expr(call.args[0])
    sep = w.expr(call.args[1]) if len(call.args) > 1 else "''"
    if call.over is not None:
        keys = ", ".join(f"'k{i}', {w.expr(o.expr)}" for i, o in enumerate(call.order)) or "'k0', 0"
        down = "false" if call.order and call.order[0].desc else "true"
        rows = f"collect_list(CASE WHEN {x} IS NOT NULL THEN named_struct({keys}, 'x', {x}) END) OVER ({w.over(call.over)})"
        return f"nullif(array_join(transform(sort_array({rows}, {down}), s -> cast(s.x AS STRING)), {sep}), '')"
    within = f" WITHIN GROUP (ORDER BY {w.orders(call.order)})" if call.order else ""
    return f"listagg({'DISTINCT ' if call.distinct else ''}cast({x} AS STRING), {sep}){within}"


def _ratio(w, call: t.Call) -> str:
    x = w.expr(call.args[0])
    return f"({x} / sum({x}) OVER ({w.over(call.over)}))"


def _regexp_substr(w, call: t.Call) -> str:
    a = [w.expr(x) for x in call.args]
    if len(a) < 3:
        return f"regexp_substr({a[0]}, {a[1]})"
    return f"try_element_at(regexp_extract_all(substr({a[0]}, {a[2]}), {a[1]}, 0), {a[3] if len(a) > 3 else 1})"


def _regexp_replace(w, call: t.Call) -> str:
    a = [w.expr(x) for x in call.args] + (["''"] if len(call.args) == 2 else [])
    return f"regexp_replace({', '.join(a[:4])})"


def _regexp_instr(w, call: t.Call) -> str:
    return f"regexp_instr({w.expr(call.args[0])}, {w.expr(call.args[1])})"


def _lag_diff(w, call: t.Call) -> str:
    x = w.expr(call.args[0])
    lag = f"lag({x}) OVER ({w.over(call.over)})"
    return f"({x} - {lag})" if call.parts[-1].upper() == "LAG_DIFF" else f"(({x} - {lag}) / {lag})"


def _to_timestamp_tz(w, call: t.Call) -> str:
    return _to_date("to_timestamp")(w, call)


def _unistr(w, call: t.Call) -> str:
    text = text_of(call.args[0])
    if text is None:
        raise UnsupportedSyntax("UNISTR needs a literal")
    return w.string(re.sub(r"\\(\\|[0-9A-Fa-f]{4})", lambda m: "\\" if m[1] == "\\" else chr(int(m[1], 16)), text))


# fixed values: parameters of the session's context
CONTEXT = {"CURRENT_USER": "current_user()", "SESSION_USER": "session_user()", "CURRENT_SCHEMA": "'{schema}'", "DB_NAME": "current_catalog()"}


def _sys_context(w, call: t.Call) -> str:
    space, name = ((text_of(a) or "").upper() for a in call.args[:2])
    if space != "USERENV" or name not in CONTEXT:
        raise UnsupportedSyntax(f"SYS_CONTEXT of {space}.{name}")
    return CONTEXT[name].format(schema=w.catalog.schema)


def _xml_name(text: str | None) -> str:
    if not text or not re.fullmatch(xml.NAME, text):
        raise UnsupportedSyntax("an XML element or attribute needs a name")
    return text


def _xml_text(w, e: Any, attribute: bool = False) -> str:
    """Markup as it is, anything else escaped; null stays null."""
    text = f"cast({w.expr(e)} AS STRING)"
    if isinstance(e, t.Call) and e.parts[-1].upper().startswith("XML"):
        return text
    text = f"replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return f"replace({text}, '\"', '&quot;')" if attribute else text


def _xmlelement(w, call: t.Call) -> str:
    """An element named by the first argument; the others are attributes and content, markup or text that is escaped."""
    name = _xml_name(call.args[0].parts[-1] if isinstance(call.args[0], t.Name) else text_of(call.args[0]))
    marks, content = [], []
    for a in call.args[1:]:
        if isinstance(a, t.Call) and a.parts[-1].upper() == "XMLATTRIBUTES":
            marks += [f"coalesce(concat({w.string(f' {_xml_name(n)}=' + chr(34))}, {_xml_text(w, v, True)}, '\"'), '')" for n, v in zip(a.named["names"], a.args)]
        else:
            content.append(f"coalesce({_xml_text(w, a)}, '')")
    return f"concat({', '.join([w.string(f'<{name}'), *marks, w.string('>'), *content, w.string(f'</{name}>')])})"


def _xmlforest(w, call: t.Call) -> str:
    """An element for each value that is not null."""
    parts = [f"coalesce(concat({w.string(f'<{_xml_name(n)}>')}, {_xml_text(w, v)}, {w.string(f'</{n}>')}), '')" for n, v in zip(call.named["names"], call.args)]
    return f"concat({', '.join(parts)})"


def _xmlagg(w, call: t.Call) -> str:
    """Markup of a group's rows in the order asked for, else in that of the markup itself; nulls are left out, and of nothing else comes null."""
    x = f"cast({w.expr(call.args[0])} AS STRING)"
    return f"listagg({x}, '') WITHIN GROUP (ORDER BY {w.orders(call.order) if call.order else x})"


def _xmlexists(w, call: t.Call) -> str:
    return f"xpath_boolean({w.expr(call.args[1])}, {w.string(f'boolean({text_of(call.args[0])})')})"


def _xmlquery(w, call: t.Call) -> str:
    """Text and attributes at a path, in document order."""
    path = text_of(call.args[0]) or ""
    if not re.search(r"(/text\(\)|@[\w.:-]+)$", path):
        raise UnsupportedSyntax("XMLQUERY gives text() and attributes, not nodes")
    return f"array_join(xpath({w.expr(call.args[1])}, {w.string(path)}), ' ')"


WRITERS: dict[str, Callable[[Any, t.Call], str]] = {
    "TO_CHAR": _to_char, "TO_NUMBER": _to_number, "TO_DATE": _to_date("to_timestamp_ntz"), "TO_TIMESTAMP": _to_date("to_timestamp_ntz"),
    "TO_TIMESTAMP_TZ": _to_timestamp_tz, "TRUNC": _trunc, "ROUND": _round, "SUBSTR": _substr, "INSTR": _instr, "TRIM": _trim,
    "LTRIM": _side_trim("ltrim", "LEADING"), "RTRIM": _side_trim("rtrim", "TRAILING"), "REPLACE": _replace, "TRANSLATE": _translate,
    "EXTRACT": _extract, "VALIDATE_CONVERSION": _validate, "JSON_VALUE": _json_value, "JSON_QUERY": _json_query, "JSON_OBJECT": _json_object,
    "JSON_ARRAY": _json_array, "JSON_ARRAYAGG": _json_arrayagg, "JSON_OBJECTAGG": _json_objectagg, "LISTAGG": _listagg,
    "RATIO_TO_REPORT": _ratio, "REGEXP_SUBSTR": _regexp_substr, "REGEXP_REPLACE": _regexp_replace, "REGEXP_INSTR": _regexp_instr,
    "UNISTR": _unistr, "SYS_CONTEXT": _sys_context, "XMLELEMENT": _xmlelement, "XMLFOREST": _xmlforest, "XMLAGG": _xmlagg, "XMLEXISTS": _xmlexists, "XMLQUERY": _xmlquery, "LAG_DIFF": _lag_diff, "LAG_DIFF_PERCENT": _lag_diff,
}

#: Every name that is a function and not an indexed collection.
KNOWN = SAME | RENAMED.keys() | TEMPLATES.keys() | WRITERS.keys()

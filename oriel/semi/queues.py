"""Queue types: JMS text messages, signature properties and recipient lists.

Each has a converter from structs to one JSON shape, and accessors on that JSON
as column functions.  The accessors never parse in Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RECIPIENT = "array<struct<address:string,name:string,delivery_status:string,routing_info:string,priority:int,index:int>>"


def _get(path: str) -> Callable[[Column], Column]:
    return lambda j: F.get_json_object(j, path)


def _millis(path: str) -> Callable[[Column], Column]:
    return lambda j: F.timestamp_millis(F.get_json_object(j, path).cast("long"))


def _stamp(path: str) -> Callable[[Column], Column]:
    return lambda j: F.try_to_timestamp(F.get_json_object(j, path))


def _keys(path: str) -> Callable[[Column], Column]:
    return lambda j: F.json_object_keys(F.get_json_object(j, path))


# JMS text messages


def jms_message(text: list[Column], headers: dict[str, Column], properties: Column | None = None) -> Column:
    """A message as JSON; its text is the first of the given columns, of three at most, that is not blank."""
    body = F.coalesce(*[F.when(F.trim(t) != "", t) for t in text[:3]])
    head = F.struct(*[v.alias(f"jms_{k}") for k, v in headers.items()])
    meta = F.struct(F.lit("AQ$_JMS_TEXT_MESSAGE").alias("original_type"))
    fields = [F.lit("JMS_TEXT").alias("message_type"), body.alias("text_content"), head.alias("headers"), (properties if properties is not None else F.create_map()).alias("properties"), meta.alias("metadata")]
    return F.to_json(F.struct(*fields))


JMS: dict[str, Callable[..., Column]] = {
    "get_text_content": _get("$.text_content"),
    "get_message_id": _get("$.headers.jms_message_id"),
    "get_timestamp": lambda j: F.get_json_object(j, "$.headers.jms_timestamp").cast("long"),
    "get_timestamp_pg": _millis("$.headers.jms_timestamp"),
    "get_correlation_id": _get("$.headers.jms_correlation_id"),
    "get_delivery_mode": lambda j: F.get_json_object(j, "$.headers.jms_delivery_mode").cast("int"),
    "get_property": lambda j, k: F.get_json_object(j, f"$.properties.{k}"),
    "has_property": lambda j, k: F.coalesce(F.array_contains(_keys("$.properties")(j), k), F.lit(False)),
    "get_property_names": _keys("$.properties"),
    "get_message_type": _get("$.message_type"),
    "is_valid_message": lambda j: F.coalesce(_get("$.message_type")(j).isNotNull() & _get("$.headers")(j).isNotNull(), F.lit(False)),
    "get_message_size": lambda j: F.length(_get("$.text_content")(j)),
    "text_contains": lambda j, s: _get("$.text_content")(j).ilike(f"%{s}%"),
    "get_metadata": _get("$.metadata"),
    "get_conversion_timestamp": _stamp("$.metadata.conversion_timestamp"),
}


# signatures


def signature(algorithm: Column, digest: Column, value: Column, signer: Column, status: Column, at: Column) -> Column:
    props = F.struct(algorithm.alias("algorithm"), digest.alias("digest"), value.alias("signature"))
    meta = F.struct(at.cast("string").alias("timestamp"), signer.alias("signer"), status.alias("validation_status"))
    tech = F.struct(F.lit("AQ$_SIG_PROP").alias("original_type"))
    return F.to_json(F.struct(F.lit("AQ_SIGNATURE").alias("signature_type"), props.alias("signature_properties"), meta.alias("metadata"), tech.alias("technical_info")))


_status = _get("$.metadata.validation_status")
SIGNATURE: dict[str, Callable[..., Column]] = {
    "get_algorithm": _get("$.signature_properties.algorithm"),
    "get_digest": _get("$.signature_properties.digest"),
    "get_signature": _get("$.signature_properties.signature"),
    "get_validation_status": _status,
    "get_signer": _get("$.metadata.signer"),
    "get_timestamp": _get("$.metadata.timestamp"),
    "get_timestamp_pg": _stamp("$.metadata.timestamp"),
    "get_type": _get("$.signature_type"),
    "get_property": lambda j, k: F.get_json_object(j, f"$.signature_properties.{k}"),
    "has_property": lambda j, k: F.coalesce(F.array_contains(_keys("$.signature_properties")(j), k), F.lit(False)),
    "get_property_names": _keys("$.signature_properties"),
    "is_valid_signature": lambda j: F.coalesce(_get("$.signature_type")(j).isNotNull() & _get("$.signature_properties")(j).isNotNull(), F.lit(False)),
    "is_signature_valid": lambda j: F.coalesce(F.upper(_status(j)) == "VALID", F.lit(False)),
    "is_signature_invalid": lambda j: F.coalesce(F.upper(_status(j)) == "INVALID", F.lit(False)),
    "uses_algorithm": lambda j, a: F.coalesce(F.upper(_get("$.signature_properties.algorithm")(j)) == a.upper(), F.lit(False)),
    "get_metadata": _get("$.metadata"),
    "get_all_properties": _get("$.signature_properties"),
    "get_technical_info": _get("$.technical_info"),
    "get_conversion_timestamp": _stamp("$.technical_info.conversion_timestamp"),
    "get_original_type": _get("$.technical_info.original_type"),
    "has_digest": lambda j: _get("$.signature_properties.digest")(j).isNotNull(),
    "has_signature_value": lambda j: _get("$.signature_properties.signature")(j).isNotNull(),
}


# recipients


def parse_recipient(text: Column) -> Column:
    """One recipient: an e-mail address, ``key=value`` pairs, or a bare name."""
    pairs = F.str_to_map(text, F.lit(r"\s*[;,]\s*"), F.lit("="))
    mail, keyed = text.rlike(r"^[^@\s=]+@[^@\s]+$"), text.rlike(r"^\s*\w+\s*=")
    pick = lambda k: F.when(keyed, F.try_element_at(pairs, F.lit(k)))
    return F.struct(
        F.when(mail, text).otherwise(pick("address")).alias("address"),
        F.when(mail, F.substring_index(text, "@", 1)).when(keyed, pick("name")).otherwise(text).alias("name"),
        F.coalesce(pick("status"), F.lit("PENDING")).alias("delivery_status"),
        pick("routing").alias("routing_info"),
        F.coalesce(pick("priority").cast("int"), F.lit(1)).alias("priority"),
    )


def recipients(texts: Column, mode: str = "BROADCAST", most: int | None = None) -> Column:
    """A list of recipient texts as JSON; where a limit is asked for, as many are kept and all are counted."""
    rows = F.transform(texts if most is None else F.slice(texts, 1, most), lambda x, i: parse_recipient(x).withField("index", i + 1))
    meta = F.struct(F.size(texts).alias("total_count"), F.lit(mode).alias("delivery_mode"))
    tech = F.struct(F.lit("AQ$_RECIPIENTS").alias("original_type"))
    return F.to_json(F.struct(F.lit("AQ_RECIPIENTS").alias("recipients_type"), rows.alias("recipients"), meta.alias("metadata"), tech.alias("technical_info")))


def _rows(j: Column) -> Column:
    return F.from_json(F.get_json_object(j, "$.recipients"), RECIPIENT)


def _where(test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda j: F.filter(_rows(j), lambda r: F.coalesce(test(r), F.lit(False)))


def _same(field: str, value: str) -> Callable[[Column], Column]:
    return _where(lambda r: F.upper(r[field]) == value.upper())


def _domain(j: Column, d: str) -> Column:
    return _where(lambda r: F.lower(r["address"]).endswith("@" + d.lower()))(j)


RECIPIENTS: dict[str, Callable[..., Column]] = {
    "get_addresses": lambda j: F.transform(_rows(j), lambda r: r["address"]),
    "count": lambda j: F.coalesce(F.size(_rows(j)), F.lit(0)),
    "count_by_status": lambda j, s: F.size(_same("delivery_status", s)(j)),
    "get_by_status": lambda j, s: _same("delivery_status", s)(j),
    "has_pending": lambda j: F.size(_same("delivery_status", "PENDING")(j)) > 0,
    "all_delivered": lambda j: (F.size(_rows(j)) > 0) & F.forall(_rows(j), lambda r: F.coalesce(F.upper(r["delivery_status"]) == "DELIVERED", F.lit(False))),
    "get_by_address": lambda j, a: F.get(_same("address", a)(j), F.lit(0)),
    "get_by_name": lambda j, n: F.get(_same("name", n)(j), F.lit(0)),
    "get_delivery_mode": _get("$.metadata.delivery_mode"),
    "get_priority_level": _get("$.metadata.priority_level"),
    "get_timestamp_pg": _stamp("$.metadata.timestamp"),
    "get_timestamp": _get("$.metadata.timestamp"),
    "get_type": _get("$.recipients_type"),
    "is_valid": lambda j: F.coalesce(_get("$.recipients_type")(j).isNotNull() & _rows(j).isNotNull(), F.lit(False)),
    "get_names": lambda j: F.transform(_rows(j), lambda r: r["name"]),
    "get_by_routing": lambda j, x: _same("routing_info", x)(j),
    "contains_address": lambda j, a: F.size(_same("address", a)(j)) > 0,
    "get_high_priority": lambda j, least=2: _where(lambda r: r["priority"] >= least)(j),
    "get_first": lambda j: F.get(_rows(j), F.lit(0)),
    "get_first_address": lambda j: F.get(_rows(j), F.lit(0))["address"],
    "is_broadcast": lambda j: F.coalesce(F.upper(_get("$.metadata.delivery_mode")(j)) == "BROADCAST", F.lit(False)),
    "get_metadata": _get("$.metadata"),
    "get_technical_info": _get("$.technical_info"),
    "get_conversion_timestamp": _stamp("$.technical_info.conversion_timestamp"),
    "get_original_type": _get("$.technical_info.original_type"),
    "get_by_domain": _domain,
    "count_by_domain": lambda j, d: F.size(_domain(j, d)),
    "get_delivery_stats": lambda j: F.to_json(
        F.struct(
            F.size(_rows(j)).alias("total"),
            *[F.size(_same("delivery_status", s)(j)).alias(s.lower()) for s in ("PENDING", "DELIVERED", "FAILED")],
        )
    ),
}

"""Bodies of public JSON services: their rows, whatever they are wrapped in, and what their error codes mean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeloom.functions.text import integer

# Keys under which rows and totals stand, in the order in which they are tried, and error codes.
LIST_KEYS, OBJECT_KEYS = ("dsList", "data", "items"), ("data", "item", "items", "posts", "dsList")
TOTALS = ("totalCount", "ALL_CNT", "total_count")
CAUSES = {
    "01": "service", "02": "database", "03": "no_data", "04": "connection", "05": "timeout", "10": "parameter", "11": "parameter", "12": "no_service", "20": "access", "21": "key_suspended", "22": "quota",
    "30": "key_unknown", "31": "key_expired", "32": "address",
}
ALIASES = {
    "SERVICE_KEY_IS_NOT_REGISTERED_ERROR": "30", "SERVICE_ACCESS_DENIED_ERROR": "20", "DEADLINE_HAS_EXPIRED_ERROR": "31", "LIMITED_NUMBER_OF_SERVICE_REQUESTS_EXCEEDS_ERROR": "22", "UNREGISTERED_IP_ERROR": "32",
}
SUCCESS = ("0", "00", "000", "200", "Y", "SUCCESS")
RETRIED = (429, 500, 502, 503, 504)


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _text(v: Column, *paths: str) -> Column:
    return F.coalesce(*[F.try_variant_get(v, p, "string") for p in paths])


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _objects(v: Column) -> Column:
    """The objects of a variant array as JSON, in order."""
    each = F.from_json(F.to_json(v), "array<string>")
    return F.filter(each, lambda x: x.startswith("{"))


def body_rows(body: Column, *keys: str) -> Column:
    """struct<rows: array<string>, total: bigint> of a body's JSON text: the objects under the first key that has a list.

    Objects: within response and body where these are there; rows may be one object, or be wrapped in item or items.
    Lists: the first of their objects that has a key; the total stands in one named CMN. Other texts have no rows.
    """
    v = F.try_parse_json(body)
    node = F.coalesce(_get(v, "$.response"), v)
    node = F.coalesce(_get(node, "$.body"), node)
    none = F.expr("cast(array() as array<string>)")

    def one(key: str) -> Column:
        own = _get(node, f"$.{key}")
        inner = F.when(_is(own, "OBJECT"), F.coalesce(_get(own, "$.item"), _get(own, "$.items"), own)).otherwise(own)
        return F.when(_is(inner, "OBJECT"), F.array(F.to_json(inner))).when(_is(inner, "ARRAY"), _objects(inner))

    listed = _objects(v)

    def under(key: str) -> Column:
        own = lambda x: _get(F.try_parse_json(x), f"$.{key}")
        found = F.transform(F.filter(listed, lambda x: _is(own(x), "ARRAY")), lambda x: _objects(own(x)))
        return F.try_element_at(found, F.lit(1))

    of_list = F.coalesce(*[under(k) for k in keys or LIST_KEYS], none)
    totals = F.array_compact(F.transform(listed, lambda x: F.coalesce(*[F.get_json_object(x, f"$.CMN.{t}") for t in ("TOTAL_CNT", "ALL_CNT")])))
    is_list, is_object = _is(v, "ARRAY"), _is(node, "OBJECT")
    rows = F.when(is_list, of_list).when(is_object, F.coalesce(*[one(k) for k in keys or OBJECT_KEYS], none)).otherwise(none)
    total = F.when(is_list, F.try_element_at(totals, F.lit(-1))).when(is_object, _text(node, *[f"$.{t}" for t in TOTALS]))
    return F.struct(rows.alias("rows"), integer(total).alias("total"))


def result_code(raw: Column) -> Column:
    """A service's code: aliases by name, digits to two places, success words as they are; other texts are null."""
    plain = F.upper(F.trim(raw))
    named = F.element_at(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv]), plain)
    return F.coalesce(named, F.when(plain.rlike(r"^\d{1,3}$"), F.when(F.length(plain) < 2, F.lpad(plain, 2, "0")).otherwise(plain)), F.when(plain.isin(*SUCCESS), plain))


def error_of(raw: Column, http_status: Column) -> Column:
    """struct<code, cause, retryable> of a code (any text) and an HTTP status, or null where they tell of no error.

    Codes that aren't known are `unknown`; without a code the status tells: access, quota, no_service, service or parameter.
    """
    code = result_code(raw)
    retry = F.coalesce(http_status.isin(*RETRIED), F.lit(False))
    known = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CAUSES.items() for x in kv]), code), F.lit("unknown"))
    by_status = F.when(http_status.isin(401, 403), "access").when(http_status == 429, "quota").when(http_status == 404, "no_service").when(http_status >= 500, "service").when(http_status >= 400, "parameter")
    cause = F.when(raw.isNotNull(), F.when(~F.coalesce(code.isin(*SUCCESS), F.lit(False)), known)).otherwise(by_status)
    return F.when(cause.isNotNull(), F.struct(code.alias("code"), cause.alias("cause"), retry.alias("retryable")))


def body_error(body: Column, http_status: Column) -> Column:
    """error_of the code that a body's JSON text tells: of a service response, a header, or an error object."""
    v = F.try_parse_json(body)
    code = _text(
        v, "$.OpenAPI_ServiceResponse.cmmMsgHeader.returnReasonCode", "$.OpenAPI_ServiceResponse.cmmMsgHeader.returnAuthMsg", "$.header.resultCode", "$.header.result_code",
        "$.response.header.resultCode", "$.response.header.result_code", "$.error.code", "$.error.resultCode", "$[0].CMN.CODE", "$[0].CMN.SS_CODE",
    )
    return F.when(v.isNull(), F.coalesce(error_of(code, http_status), F.struct(F.lit(None).cast("string").alias("code"), F.lit("format").alias("cause"), F.lit(False).alias("retryable")))).otherwise(error_of(code, http_status))

"""String, number and key functions of notices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = ("", "null", "None", "-")
RESULTS = {"1순위해당지역마감(청약접수종료)": "local_first_closed", "1순위마감(청약접수종료)": "first_closed", "청약접수중": "open"}


def compact(text: Column) -> Column:
    """Without any white space, Unicode's included."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def normal(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clipped(text: Column, limit: int) -> Column:
    """Trimmed and cut to limit; empty is null."""
    return F.nullif(F.substring(F.trim(text), 1, limit), F.lit(""))


def first_usable(*columns: Column) -> Column:
    """The first column that isn't null or a stand-in for it."""
    return F.coalesce(*[F.when(~F.trim(c).isin(*BLANKS), F.trim(c)) for c in columns])


def unit_key(text: Column) -> Column:
    """Units are the same without dots and spaces, in capitals."""
    return F.upper(F.regexp_replace(text, r"(?U)[.\s]", ""))


def canonical_unit(text: Column) -> Column:
    """84.9500A -> 084.9500A; null where no such unit is in the text."""
    part = lambda i: F.regexp_extract(text, r"(\d{2,3})\.(\d{4})([A-Z]?)", i)
    return F.when(part(1) != "", F.concat(F.lpad(part(1), 3, "0"), F.lit("."), part(2), part(3)))


def yes_no(text: Column) -> Column:
    """Y true, N false, else unknown."""
    letter = F.upper(F.trim(text))
    return F.when(letter == "Y", True).when(letter == "N", False)


def decimal_number(text: Column) -> Column:
    """Feeds' grammar: commas anywhere, not negative; else null."""
    plain = F.replace(F.trim(text), F.lit(","), F.lit(""))
    return F.when(plain.rlike(r"^\d+(\.\d+)?$"), plain.try_cast("decimal(38,6)"))


def integer(text: Column) -> Column:
    """A decimal_number that is whole, as long."""
    value = decimal_number(text)
    plain = F.replace(text, F.lit(","), F.lit(""))
    return F.when(plain.rlike(r"^\d{1,18}\z"), plain.try_cast("long")).otherwise(F.when(value == F.floor(value), value.try_cast("long")))  # most are digits alone


def manwon_to_krw(text: Column) -> Column:
    """Ten thousands of won as won, whole or null."""
    won = decimal_number(text) * F.lit(10000)
    return F.when(won == F.floor(won), won.try_cast("long"))


def profile_number(text: Column) -> Column:
    """Profiles' grammar: commas only between groups of three; safe integers; else null."""
    plain = F.replace(text, F.lit(","), F.lit(""))
    value = F.when(text.rlike(r"^(?:\d+|\d{1,3}(?:,\d{3})+)$"), plain.try_cast("decimal(38,0)"))
    return F.when(value <= (1 << 53) - 1, value.cast("long"))


def fingerprint(title: Column, address: Column, day: Column) -> Column:
    """SHA-256 of what identifies a notice in every source; null where a part is empty."""
    plain = [F.regexp_replace(F.lower(x), "[^0-9a-z가-힣]", "") for x in (title, address)]
    parts = [*plain, day.cast("string")]
    whole = F.concat_ws("|", *parts)
    known = plain[0].isNotNull() & (plain[0] != "") & plain[1].isNotNull() & (plain[1] != "") & day.isNotNull()
    return F.when(known, F.sha2(whole, 256))


def base_title(title: Column) -> Column:
    """A board title without the mark of a correction."""
    return F.trim(F.regexp_replace(title, r"(?i)^\s*[\[(](?:정정|수정)(?:공고)?[\])]\s*", ""))


def result_status(text: Column) -> Column:
    """Exact wordings of competition results; a high rate alone closes nothing."""
    known = F.create_map(*[F.lit(x) for pair in RESULTS.items() for x in pair])  # the text is read once
    return F.coalesce(F.element_at(known, compact(F.coalesce(text, F.lit("")))), F.lit("unknown"))


def rate_label(rate: Column) -> Column:
    """No rate or '-' as undisclosed, a number after a triangle as so many units short, else the rate as published."""
    raw = F.coalesce(F.nullif(F.trim(rate), F.lit("")), F.lit("-"))
    short = F.regexp_extract(raw, r"^\(?\s*[△▲]\s*([\d,]+)\s*\)?$", 1)
    return F.when(raw == "-", "미공개").when(short != "", F.concat(F.lit("미달 "), short, F.lit("세대"))).otherwise(raw)


def won_label(won: Column) -> Column:
    """Won in 억 and 만, rounded to 만; less than that in won."""
    man = F.floor(won / F.lit(10_000) + F.lit(0.5)).cast("long")
    eok, rest = F.floor(man / F.lit(10_000)).cast("long"), man % 10_000
    return (
        F.when(won.isNull(), "가격 미공개").when((eok > 0) & (rest > 0), F.concat(eok.cast("string"), F.lit("억 "), F.format_number(rest, 0), F.lit("만원")))
        .when(eok > 0, F.concat(eok.cast("string"), F.lit("억원"))).when(rest > 0, F.concat(F.format_number(rest, 0), F.lit("만원")))
        .otherwise(F.concat(F.format_number(won, 0), F.lit("원")))
    )


def url_host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def trusted_url(url: Column, hosts: tuple[str, ...]) -> Column:
    """http(s) URLs of the hosts or of hosts below them."""
    host = url_host(url)
    match = F.lit(False)
    for name in hosts:
        match = match | (host == name) | host.endswith("." + name)
    return F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")).isin("http", "https") & match, F.lit(False))


def public_url(url: Column) -> Column:
    """A trimmed http(s) URL with a host, else null."""
    plain = F.trim(url)
    return F.when(plain.rlike(r"(?i)^https?://[^/?#\s]+"), plain)


def url_id(url: Column) -> Column:
    """A short id of a page without one."""
    return F.substring(F.sha2(url, 256), 1, 32)


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and without blanks, for identity; null where it isn't JSON."""
    return F.to_json(F.try_parse_json(text))

"""URL and text helpers as Catalyst expressions; they take attack strings that URL parsers reject."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)(?:\?([^#]*))?"


def uri_path(uri: Column) -> Column:
    bare = uri.rlike("^[^/?]+=") & ~uri.contains("/") & ~uri.contains("?")
    return F.when(bare, F.lit(None).cast("string")).otherwise(F.nullif(F.regexp_extract(F.regexp_replace(uri, "[\t\r\n]", ""), _URL, 1), F.lit("")))


def uri_query(uri: Column) -> Column:
    bare = uri.rlike("^[^/?]+=") & ~uri.contains("/") & ~uri.contains("?")
    return F.when(bare, uri).otherwise(F.nullif(F.regexp_extract(F.regexp_replace(uri, "[\t\r\n]", ""), _URL, 2), F.lit("")))


def host(url: Column) -> Column:
    """Lower-case host of a URL with a scheme, without user, port and brackets; null without one."""
    authority = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.nullif(F.lower(F.regexp_extract(authority, r"^(?:.*@)?\[?([^\[\]:]*(?::[^\[\]]*(?=\]))?)", 1)), F.lit(""))


def unquote(text: Column) -> Column:
    """Percent-decoding that keeps `+` and malformed escapes."""
    safe = F.regexp_replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.coalesce(F.try_url_decode(safe), text)


def filled(c: Column) -> Column:
    """Whether a string is neither null nor empty."""
    return F.coalesce(c != "", F.lit(False))


def percent(x: Column) -> Column:
    """A share as whole percent, half to even."""
    return F.concat(F.bround(x * 100, 0).cast("bigint").cast("string"), F.lit("%"))

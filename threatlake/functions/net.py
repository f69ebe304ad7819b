"""Address predicates and normalization as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUAD = r"^(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$"

# The networks of each class.
INTERNAL = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16"]
PRIVATE = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
]
SHARED = ["100.64.0.0/10"]
PUBLIC_WITHIN_PRIVATE = ["192.0.0.9/32", "192.0.0.10/32"]


def cidr(network: str) -> tuple[int, int]:
    """First and last address as numbers."""
    address, _, bits = network.partition("/")
    first = 0
    for octet in address.split("."):
        first = first * 256 + int(octet)
    return first, first + (1 << (32 - int(bits))) - 1


def ip_number(ip: Column) -> Column:
    """A dotted quad as BIGINT; anything else is null."""
    parts = F.split(ip, r"\.")
    number = sum((parts[i].cast("bigint") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0).cast("bigint"))
    return F.when(ip.rlike(QUAD), number)


def in_networks(number: Column, networks: list[str]) -> Column:
    """Whether the number lies in one of the networks; null is in none."""
    out = F.lit(False)
    for n in networks:
        out = out | number.between(*cidr(n))
    return F.coalesce(out, F.lit(False))


def is_internal(ip: Column) -> Column:
    return in_networks(ip_number(ip), INTERNAL) | F.coalesce(ip.rlike("^(::1$|f[cd]|fe[89ab])"), F.lit(False))


def is_private(ip: Column) -> Column:
    n = ip_number(ip)
    return (in_networks(n, PRIVATE) & ~in_networks(n, PUBLIC_WITHIN_PRIVATE)) | F.coalesce(v6_class(ip) == "private", F.lit(False))


def is_global(ip: Column) -> Column:
    """A parsable address that is neither private nor shared address space."""
    n = ip_number(ip)
    return (n.isNotNull() & ~(in_networks(n, PRIVATE) & ~in_networks(n, PUBLIC_WITHIN_PRIVATE)) & ~in_networks(n, SHARED)) | F.coalesce(v6_class(ip) == "global", F.lit(False))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once; used as a plain column it would be copied to each place."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _undotted(t: Column) -> Column:
    """An address whose dotted end is written as two groups; null if that is no dotted quad."""

    def ended(dotted: Column) -> Column:
        octet = lambda i: F.split(dotted, r"\.")[i].cast("int")
        two = lambda i: F.lower(F.conv((octet(i) * 256 + octet(i + 1)).cast("string"), 10, 16))
        return F.when(~dotted.contains("."), t).when(dotted.rlike(QUAD), F.concat(F.regexp_replace(t, r"[0-9.]+$", ""), two(0), F.lit(":"), two(2)))

    return _let(F.regexp_extract(t, r":([0-9.]+)$", 1), ended)


def _eight(halves: Column) -> Column:
    """The eight groups of an address that is split at `::`; null if there are more or fewer."""
    none = F.array().cast("array<string>")
    groups = lambda h: F.when(h.isNull() | (h == ""), none).otherwise(F.split(h, ":"))

    def filled(x: Column) -> Column:
        left, right, known = x["left"], x["right"], F.size(x["left"]) + F.size(x["right"])
        whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - known, F.lit(0))), right)
        return F.when(((x["n"] == 1) & (known == 8)) | ((x["n"] == 2) & (known <= 7)), whole)

    return _let(F.struct(groups(F.get(halves, F.lit(0))).alias("left"), groups(F.get(halves, F.lit(1))).alias("right"), F.size(halves).alias("n")), filled)


def _shortened(plain: Column) -> Column:
    """Eight groups without leading zeros, with the first longest run of zeros as `::`; mapped addresses dotted."""
    runs = [rf"^(.*?)(?:^|:)0(?::0){{{n - 1}}}(?:$|:)(.*)$" for n in range(8, 1, -1)]
    short = F.coalesce(*(F.when(plain.rlike(p), F.regexp_replace(plain, p, "$1::$2")) for p in runs), plain)

    def quad(mapped: Column) -> Column:
        half = lambda i: F.conv(F.split(mapped, ":")[i], 16, 10).cast("int")
        return F.when(mapped != "", F.concat_ws(".", *(x.cast("string") for i in (0, 1) for x in (F.floor(half(i) / 256), half(i) % 256)))).otherwise(short)

    return _let(F.regexp_extract(plain, "^0:0:0:0:0:ffff:([0-9a-f]+:[0-9a-f]+)$", 1), quad)


def canonical_v6(raw: Column) -> Column:
    """The canonical text of an IPv6 address, without brackets and zone; null for what isn't one."""
    bare = F.split(F.regexp_replace(F.trim(raw), r"^[\[\]]+|[\[\]]+$", ""), "%")[0]
    t = F.lower(F.regexp_replace(bare, "[\u212a\u0130]", "?"))  # characters whose lower case is ASCII
    plain = lambda g: F.when(F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(g, lambda x: F.regexp_replace(x, "^0+(?=.)", "")), ":"))
    return _let(_let(_let(_let(t, _undotted), lambda u: _eight(F.split(u, "::"))), plain), _shortened)


def v6_class(ip: Column) -> Column:
    """`private` or `global` of a canonical IPv6 address, by its first hexadecimal digits; null for anything else."""
    closed = ip.rlike("^(::1?$|f[cd]|fe[89ab]|ff|100::|2001:db8:|64:ff9b:1:)")
    return F.when(ip.contains(":"), F.when(closed, "private").otherwise("global"))


def normalize_ip(raw: Column) -> Column:
    """The address of a raw field: a dotted quad, trimmed, without the mapped prefix, or an IPv6 address in canonical form,
    or the first dotted quad inside; null if there is none. Nothing leaves the JVM."""
    text = F.regexp_replace(F.trim(raw), "(?i)^::ffff:(?=[0-9]+[.])", "")
    inner = F.regexp_extract(text, r"(?:^|[^0-9.])((?:[0-9]{1,3}\.){3}[0-9]{1,3})(?:[^0-9.]|$)", 1)
    return F.when(text.rlike(QUAD), text).when(F.length(text) - F.length(F.replace(text, F.lit(":"))) >= 2, canonical_v6(text)).otherwise(F.when(inner.rlike(QUAD), inner))

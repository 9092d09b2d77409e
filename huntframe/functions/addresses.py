"""IPv4 and IPv6 addresses and networks as numbers: 128 bits in two signed 64-bit halves.

An IPv4 address a.b.c.d counts as the IPv6 address ::ffff:a.b.c.d, so both kinds compare and join alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from huntframe.functions.let import let
from huntframe.functions.predicates import Field, text
from huntframe.functions.scalars import _OCTET, parse_ipv4

V4_BITS = 96
_V4_HIGH = 0xFFFF << 32


_TAIL = rf"^.*:(?={_OCTET}(?:\.{_OCTET}){{3}}$)"  # what comes before a dotted tail
_WHOLE = "^[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}$"


def _struct(high: Column, low: Column) -> Column:
    return F.struct(high.alias("high"), low.alias("low"))


def _dotted_as_hex(octets: Column) -> Column:
    """Two hexadecimal groups for the four numbers of a dotted tail."""
    def group(i: int) -> Column:
        return F.hex(F.get(octets, F.lit(i)) * 256 + F.get(octets, F.lit(i + 1)))

    return F.lower(F.concat(group(0), F.lit(":"), group(2)))


def _hexed(plain: Column) -> Column:
    octets = F.split(F.substring_index(plain, ":", -1), r"\.").cast("array<int>")
    head = F.left(plain, F.length(plain) - F.length(F.substring_index(plain, ":", -1)))
    return F.when(~plain.contains("."), plain).when(plain.rlike(_TAIL), F.concat(head, let(octets, _dotted_as_hex)))


def _filled(plain: Column) -> Column:
    """Eight groups in place of fewer and ``::``."""
    colons = F.length(plain) - F.length(F.replace(plain, F.lit(":"), F.lit("")))
    at_edges = plain.startswith("::").cast("int") + plain.endswith("::").cast("int")
    zeros = F.repeat(F.lit("0:"), 8 - colons + at_edges)
    whole = F.replace(plain, F.lit("::"), F.concat(F.lit(":"), zeros))
    whole = F.when(plain.startswith("::"), F.substring(whole, F.lit(2), F.length(whole))).otherwise(whole)
    whole = F.when(plain.endswith("::"), F.left(whole, F.length(whole) - 1)).otherwise(whole)
    # one group at least must be missing
    return F.when(plain.contains("::"), F.when(colons - at_edges < 8, whole)).otherwise(plain)


def _number(groups: Column) -> Column:
    halves = [F.conv(F.concat(*[F.lpad(F.get(groups, F.lit(i)), 4, "0") for i in range(first, first + 4)]), 16, -10).cast("long")
              for first in (0, 4)]
    return _struct(*halves)


def _parse_ipv6(ip: Column) -> Column:
    """Any spelling: shortened by ``::``, capitals, a dotted tail, a zone after ``%``."""
    plain = let(F.lower(F.substring_index(ip, "%", 1)), _hexed)
    return let(let(plain, _filled), lambda whole: F.when(whole.rlike(_WHOLE), let(F.split(whole, ":"), _number)))


def parse_ip(x: Field) -> Column:
    """An address of either kind as a struct of ``high`` and ``low``, null for text that is none."""
    def read(ip: Column) -> Column:
        v4 = let(parse_ipv4(ip), lambda n: F.when(n.isNotNull(), _struct(F.lit(0).cast("long"), n + F.lit(_V4_HIGH))))
        return F.when(ip.contains(":"), _parse_ipv6(ip)).otherwise(v4)

    return let(F.trim(text(x)), read)


def masked(address: Column, bits: Column) -> Column:
    """The address with all but its first ``bits`` (0 to 128) bits cleared."""
    ones = F.lit(-1).cast("long")

    def keep(n: Column) -> Column:  # the first n of 64 bits
        return F.when(n <= 0, F.lit(0).cast("long")).when(n >= 64, ones).otherwise(
            F.call_function("shiftleft", ones, F.lit(64) - n))

    return let(address, lambda a: let(bits.cast("int"), lambda n: F.when(a.isNotNull() & n.isNotNull(), _struct(
        a["high"].bitwiseAND(keep(n)), a["low"].bitwiseAND(keep(n - 64))))))


def parse_network(x: Field) -> Column:
    """A network ``address/bits`` of either kind as its first address (``high``, ``low``) and ``bits`` of 128.

    Without ``/bits`` it is one address; bits that the length does not cover are cleared. Null for other text.
    """
    def read(parts: Column) -> Column:
        first, given = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        v4 = ~first.contains(":")
        most = F.when(v4, F.lit(32)).otherwise(F.lit(128))
        own = F.when(F.size(parts) == 1, most).when(
            (F.size(parts) == 2) & given.rlike(r"^\d{1,3}$"), given.try_cast("int"))
        bits = let(own, lambda n: F.when(n <= most, n + F.when(v4, F.lit(V4_BITS)).otherwise(F.lit(0))))
        return let(bits, lambda n: let(masked(parse_ip(first), n), lambda m: F.when(m.isNotNull(), F.struct(
            m["high"].alias("high"), m["low"].alias("low"), n.alias("bits")))))

    return let(F.split(F.trim(text(x)), "/"), read)


def ipv6_is_match(x: Field, y: Field, prefix: int = 128) -> Column:
    """Whether two addresses of any spelling agree in their first ``prefix`` bits; null if one is no address.
    IPv4 addresses take part as ::ffff:a.b.c.d."""
    bits = F.lit(prefix)
    return masked(parse_ip(x), bits) == masked(parse_ip(y), bits)


def ip_is_in_range(x: Field, network: Field) -> Column:
    """Whether an address lies in a network; both may be columns. Null if either cannot be read."""
    return let(parse_network(network), lambda n: F.when(n.isNotNull(), let(
        masked(parse_ip(x), n["bits"]), lambda m: F.when(m.isNotNull(), (m["high"] == n["high"]) & (m["low"] == n["low"])))))


# IPv6 networks that are no public addresses.
LOCAL_IPV6 = ("::1/128", "::/128", "::ffff:0:0/96", "100::/64", "2001:db8::/32", "fc00::/7", "fe80::/10")

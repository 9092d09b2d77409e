"""Scalar functions whose meaning differs from the bare Spark call of the same name."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from huntframe.functions.durations import (
    MICROS, duration_micros, floor_div, from_micros, micros_of, time_bin, time_literal,
)
from huntframe.functions.predicates import Field, col_of, text

# --- casts and conditionals ------------------------------------------------------------------


def tostring(x: Field) -> Column:
    return text(x)


def todouble(x: Field) -> Column:
    return col_of(x).try_cast("double")


def tolong(x: Field) -> Column:
    """Whole number, cut toward zero; text such as ``3.9`` is read as a number first."""
    number = todouble(x)
    return F.when(F.isnan(number), F.lit(None)).otherwise(number).try_cast("long")


def toint(x: Field) -> Column:
    return tolong(x).try_cast("int")


def iff(condition: Column, yes, no) -> Column:
    """``yes`` where the condition holds, otherwise (false or null) ``no``."""
    return F.when(condition, yes).otherwise(no)


def case(*branches) -> Column:
    """``case(test1, value1, test2, value2, ..., default)``."""
    *pairs, default = branches
    chain = F.when(pairs[0], pairs[1])
    for i in range(2, len(pairs), 2):
        chain = chain.when(pairs[i], pairs[i + 1])
    return chain.otherwise(default)


def coalesce(*values: Field) -> Column:
    """First value that is neither null nor, for text, empty."""
    return F.coalesce(*[F.when(v.cast("string") != "", v) for v in map(col_of, values)])


# --- arithmetic ------------------------------------------------------------------------------

def divide(a: Field, b: Field) -> Column:
    """True division; a zero divisor gives null instead of an error."""
    return F.try_divide(col_of(a).cast("double"), col_of(b).cast("double"))


def bin_number(x: Field, width: int | float) -> Column:
    col = col_of(x)
    if isinstance(width, int):
        return F.when(col.isNotNull(), F.floor(col / F.lit(width)) * F.lit(width))
    return F.floor(col / F.lit(width)) * F.lit(width)


def max_of(*values: Field) -> Column:
    return F.greatest(*map(col_of, values))


def min_of(*values: Field) -> Column:
    return F.least(*map(col_of, values))


# --- text ------------------------------------------------------------------------------------

def strcat(*parts) -> Column:
    """Concatenation with nulls read as empty; plain Python values are literals."""
    return F.concat(*[text(p if isinstance(p, Column) else F.lit(p)) for p in parts])


def strcat_array(arr: Field, sep: str) -> Column:
    return F.array_join(col_of(arr).cast("array<string>"), sep, "")


def split(x: Field, sep: str, index: int | None = None) -> Column:
    """Split on a literal separator; with an index, a one-element array (empty array when out of range)."""
    pieces = F.split(text(x), "\\Q" + sep + "\\E")
    return pieces if index is None else F.slice(pieces, index + 1, 1)


def substring(x: Field, start: int, length: int | None = None) -> Column:
    """Zero-based substring; a negative start counts from the end."""
    source = text(x)
    begin = F.lit(start + 1) if start >= 0 else F.greatest(F.length(source) + start + 1, F.lit(1))
    return F.substring(source, begin, F.length(source) if length is None else F.lit(length))


def replace(x: Field, pattern: str, rewrite: str) -> Column:
    r"""Regex replacement; ``\1`` refers to a group."""
    escaped = rewrite.replace("$", "\\$")
    return F.regexp_replace(text(x), pattern, re.sub(r"\\(\d)", r"$\1", escaped))


def trim(pattern: str, x: Field) -> Column:
    """Remove every match of the pattern at either end."""
    return F.regexp_replace(text(x), f"^(?:{pattern})+|(?:{pattern})+$", "")


def tolower(x: Field) -> Column:
    return F.lower(col_of(x))


def toupper(x: Field) -> Column:
    return F.upper(col_of(x))


def extract(pattern: str, group: int, x: Field) -> Column:
    """Group of the first match, null when there is none."""
    return F.when(text(x).rlike(pattern), F.regexp_extract(text(x), pattern, group))


def extract_all(pattern: str, x: Field, group: int = 1) -> Column:
    """Group of every match, null when there is none."""
    found = F.regexp_extract_all(text(x), F.lit(pattern), F.lit(group))
    return F.when(F.size(found) > 0, found)


# --- structured text -------------------------------------------------------------------------

def parse_json(x: Field) -> Column:
    """Text to a variant; malformed text gives null. Read members with ``variant_get``."""
    return F.try_parse_json(text(x))


todynamic = parse_json


def parse_url(x: Field) -> Column:
    """Scheme, Host, Port, Path, Username, Password, Query and Fragment of a URL."""
    url = text(x)

    def part(name: str) -> Column:
        return F.coalesce(F.try_parse_url(url, F.lit(name)), F.lit(""))

    user = F.split(part("USERINFO"), ":")
    port = F.regexp_extract(part("AUTHORITY"), r":(\d+)$", 1)
    return F.struct(
        part("PROTOCOL").alias("Scheme"), part("HOST").alias("Host"), port.alias("Port"),
        part("PATH").alias("Path"), F.element_at(user, 1).alias("Username"),
        F.coalesce(F.get(user, F.lit(1)), F.lit("")).alias("Password"),
        parse_urlquery(part("QUERY")).alias("Query"), part("REF").alias("Fragment"),
    )


def parse_urlquery(x: Field) -> Column:
    """Query string to a map; of a repeated key the last value stays."""
    pairs = F.filter(F.split(text(x), "&"), lambda p: F.length(p) > 0)
    entries = F.transform(pairs, lambda p: F.struct(
        F.substring_index(p, "=", 1).alias("key"),
        F.when(F.instr(p, "=") > 0, F.substring(p, F.instr(p, "=") + 1, F.length(p)))
        .otherwise(F.lit("")).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(
        F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))),
        lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def parse_csv(x: Field) -> Column:
    """One CSV record to an array; quoted values may hold commas and doubled quotes."""
    cells = F.regexp_extract_all(text(x), F.lit(r'(^|,)("(?:[^"]|"")*"|[^,]*)'), F.lit(2))
    return F.transform(cells, lambda c: F.when(
        c.startswith('"'),
        F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))


def parse_path(x: Field) -> Column:
    """Scheme, RootPath, DirectoryPath, DirectoryName, Filename, Extension and stream of a path."""
    path = text(x)
    scheme = F.regexp_extract(path, r"^([A-Za-z][A-Za-z0-9+.\-]+)://", 1)
    bare = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.\-]+://", "")
    stream = F.regexp_extract(bare, r"[^\\/:]+:([^\\/:]+)$", 1)
    plain = F.when(stream != "", F.regexp_replace(bare, r":[^\\/:]+$", "")).otherwise(bare)
    name = F.regexp_extract(plain, r"([^\\/]*)$", 1)
    folder = F.regexp_replace(plain, r"[\\/]?[^\\/]*$", "")
    return F.struct(
        scheme.alias("Scheme"),
        F.regexp_extract(plain, r"^([A-Za-z]:|[^\\/]+(?=/)|/)", 1).alias("RootPath"),
        folder.alias("DirectoryPath"),
        F.regexp_extract(folder, r"([^\\/]*)$", 1).alias("DirectoryName"),
        name.alias("Filename"),
        F.regexp_extract(name, r"[^.]\.([^.]+)$", 1).alias("Extension"),
        stream.alias("AlternateDataStreamName"),
    )


# --- time ------------------------------------------------------------------------------------

def now(as_of: datetime) -> Column:
    """The caller's reference instant, so that a re-run gives the same rows."""
    return time_literal(as_of)


def ago(as_of: datetime, duration: str | timedelta) -> Column:
    return time_literal(as_of - timedelta(microseconds=duration_micros(duration)))


def datetime_diff(unit: str, end: Field, start: Field, boundaries: bool = False) -> Column:
    """``end - start`` in seconds, minutes, hours or days, with its fraction.

    ``boundaries=True`` counts the unit boundaries crossed instead, a whole number.
    """
    width = MICROS[unit]
    late, early = micros_of(col_of(end)), micros_of(col_of(start))
    if boundaries:
        return floor_div(late, width) - floor_div(early, width)
    return (late - early) / F.lit(float(width))


def datetime_add(unit: str, amount: int, moment: Field) -> Column:
    col = col_of(moment)
    if unit in MICROS:
        return col + F.expr(f"INTERVAL '{amount}' {unit.upper()}")
    months = {"month": 1, "quarter": 3, "year": 12}
    if unit in months:
        return col + F.expr(f"INTERVAL '{amount * months[unit]}' MONTH")
    return col + F.expr(f"INTERVAL '{amount * 7}' DAY")


_CALENDAR = {"day": "1 DAY", "week": "7 DAY", "month": "1 MONTH", "year": "1 YEAR"}


def start_of(period: str, moment: Field, offset: int = 0) -> Column:
    """Start of the day, week (Sunday), month or year, ``offset`` periods later."""
    col = col_of(moment)
    if period == "week":
        day = F.expr("INTERVAL '1' DAY")
        start = F.date_trunc("week", col + day).cast("timestamp") - day
    else:
        start = F.date_trunc(period, col).cast("timestamp")
    return start + _times(period, offset) if offset else start


def _times(period: str, n: int) -> Column:
    size, unit = _CALENDAR[period].split()
    return F.expr(f"INTERVAL '{int(size) * n}' {unit}")


def end_of(period: str, moment: Field, offset: int = 0) -> Column:
    """Last microsecond of the period."""
    return start_of(period, moment, offset + 1) - F.expr("INTERVAL '0.000001' SECOND")


def startofday(x: Field, offset: int = 0) -> Column:
    return start_of("day", x, offset)


def startofweek(x: Field, offset: int = 0) -> Column:
    return start_of("week", x, offset)


def startofmonth(x: Field, offset: int = 0) -> Column:
    return start_of("month", x, offset)


def startofyear(x: Field, offset: int = 0) -> Column:
    return start_of("year", x, offset)


def endofday(x: Field, offset: int = 0) -> Column:
    return end_of("day", x, offset)


def endofweek(x: Field, offset: int = 0) -> Column:
    return end_of("week", x, offset)


def endofmonth(x: Field, offset: int = 0) -> Column:
    return end_of("month", x, offset)


def endofyear(x: Field, offset: int = 0) -> Column:
    return end_of("year", x, offset)


def format_datetime(x: Field, pattern: str) -> Column:
    """Formatting with ``y M d H h m s f tt`` letters; ``f`` is a fraction digit."""
    return F.date_format(col_of(x).cast("timestamp"), pattern.replace("tt", "a").replace("f", "S"))


def bin_time(x: Field, width: str | timedelta, origin: datetime | None = None,
             kind: str = "timestamp") -> Column:
    return time_bin(col_of(x), width, origin, kind)


def micros_to_time(x: Field, kind: str = "timestamp") -> Column:
    return from_micros(col_of(x), kind)


# --- arrays ----------------------------------------------------------------------------------

def array_length(x: Field) -> Column:
    col = col_of(x)
    return F.when(col.isNotNull(), F.size(col))


def array_slice(x: Field, start: int, end: int) -> Column:
    """Elements ``start..end``, both inclusive and zero-based; negative positions count from the end."""
    col = col_of(x)
    n = F.size(col)

    def place(i: int) -> Column:
        return F.lit(i) if i >= 0 else n + i

    first = F.greatest(place(start), F.lit(0))
    last = F.least(place(end), n - 1)
    return F.when(col.isNotNull(), F.slice(col, first + 1, F.greatest(last - first + 1, F.lit(0))))


# --- IP addresses ----------------------------------------------------------------------------

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"


def parse_ipv4(x: Field) -> Column:
    """Dotted quad as a number, null when the text is not one."""
    ip = text(x)
    parts = F.split(ip, r"\.")
    number = sum((F.try_element_at(parts, F.lit(i + 1)).try_cast("long") * F.lit(256 ** (3 - i))
                  for i in range(4)), F.lit(0).cast("long"))
    return F.when(ip.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), number)


def _network(cidr: str) -> tuple[int, int]:
    address, _, bits = cidr.partition("/")
    value = 0
    for part in address.split("."):
        value = value * 256 + int(part)
    return value, int(bits or 32)


def _in_network(number: Column, cidr: str) -> Column:
    base, bits = _network(cidr)
    size = 1 << (32 - bits)
    low = base - base % size
    return (number >= F.lit(low)) & (number < F.lit(low + size))


def parse_ipv4_mask(x: Field, prefix: int) -> Column:
    """The address with all but its first ``prefix`` bits cleared, as a number."""
    number = parse_ipv4(x)
    return number - F.pmod(number, F.lit(1 << (32 - prefix)))


def ipv4_is_in_range(x: Field, cidr: str) -> Column:
    """True or false for an address, null for text that is not one."""
    return _in_network(parse_ipv4(x), cidr)


def ipv4_is_match(x: Field, y: Field, prefix: int = 32) -> Column:
    """Whether two addresses agree in their first ``prefix`` bits."""
    return parse_ipv4_mask(x, prefix) == parse_ipv4_mask(y, prefix)


# The wider set of special-purpose networks, and the forms of local IPv6 addresses.
SPECIAL_NETWORKS = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24",
    "240.0.0.0/4",
)
SPECIAL_IPV6 = r"^(::1?|::ffff:.+|100::.*|2001:0?db8:.*|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*)$"


def ipv4_is_private(x: Field, scope: str = "private") -> Column:
    """Whether the address is private (10/8, 172.16/12, 192.168/16); text that is no address is not.

    ``scope="wide"`` also counts loopback, link-local, documentation and local IPv6 addresses.
    """
    if scope == "private":
        o = _OCTET
        return text(x).rlike(rf"^(?:10\.{o}|172\.(?:1[6-9]|2\d|3[01])|192\.168)\.{o}\.{o}$")
    # The number is worked out once, then held against every network.
    inside = F.aggregate(F.array(parse_ipv4(x)), F.lit(False), lambda _, n: F.coalesce(
        reduce(lambda a, b: a | b, [_in_network(n, cidr) for cidr in SPECIAL_NETWORKS]), F.lit(False)))
    return inside | F.lower(text(x)).rlike(SPECIAL_IPV6)


# --- hashes ----------------------------------------------------------------------------------

def hash_long(x: Field, modulo: int | None = None) -> Column:
    """64-bit hash, optionally reduced to ``0 .. modulo-1``."""
    value = F.xxhash64(col_of(x))
    return value if modulo is None else F.pmod(value, F.lit(modulo))


def hash_sha256(x: Field) -> Column:
    return F.sha2(text(x), 256)

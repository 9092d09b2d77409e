"""The 31 comparison operators as Column builders.

Every builder returns a Column that is never null, so negation and OR behave row by row: a missing
text compares as the empty string, which makes the negated forms true on null. Exact-case forms on
a literal are written so that Spark can hand them to the parquet scan.

A value may be a literal or another Column (column-to-column comparison).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from huntframe.functions.durations import time_literal
from huntframe.functions.let import let

Field = str | Column
Value = str | int | float | bool | datetime | Column


def col_of(field: Field) -> Column:
    return F.col(field) if isinstance(field, str) else field


def text(field: Field) -> Column:
    """The column as text, null read as the empty string."""
    return F.coalesce(col_of(field).cast("string"), F.lit(""))


def _literal(value: Value) -> Column:
    return time_literal(value) if isinstance(value, datetime) else F.lit(value)


def _present(field: Field, test: Column) -> Column:
    # isNotNull AND test: false, not null, on a missing value, and still a pushable conjunction.
    return col_of(field).isNotNull() & test


# --- equality and membership ---------------------------------------------------------------

_WHOLE = ("tinyint", "smallint", "int", "bigint")
_FLOATING = ("float", "double")
_TIMES = ("date", "timestamp", "timestamp_ntz")


def _is(field: Field, kinds: tuple[str, ...], decimals: bool = False) -> Column:
    """Whether a column is of one of these types; known to the planner, so only one branch remains."""
    kind = F.typeof(col_of(field))
    return kind.isin(*kinds) | kind.startswith("decimal") if decimals else kind.isin(*kinds)


def _same(a: Field, b: Field) -> Column:
    """Two columns are equal: as numbers or times if both are such, else as text with null as empty."""
    numbers = _is(a, _WHOLE + _FLOATING, True) & _is(b, _WHOLE + _FLOATING, True)
    whole = _is(a, _WHOLE) & _is(b, _WHOLE)
    times = _is(a, _TIMES) & _is(b, _TIMES)
    left, right = col_of(a).cast("string"), col_of(b).cast("string")
    return (F.when(numbers & ~whole, left.try_cast("double").eqNullSafe(right.try_cast("double")))
            .when(times, left.try_cast("timestamp_ntz").eqNullSafe(right.try_cast("timestamp_ntz")))
            .otherwise(text(a) == text(b)))


def eq(field: Field, value: Value) -> Column:
    if isinstance(value, Column):
        return _same(field, value)
    if value == "" and isinstance(value, str):
        return text(field) == ""
    return col_of(field).eqNullSafe(_literal(value))


def ne(field: Field, value: Value) -> Column:
    return ~eq(field, value)


def eq_ci(field: Field, value: Value) -> Column:
    if isinstance(value, Column):
        return F.lower(text(field)) == F.lower(text(value))
    return F.lower(text(field)) == str(value).lower()


def ne_ci(field: Field, value: Value) -> Column:
    return ~eq_ci(field, value)


def in_(field: Field, values: Iterable[Value]) -> Column:
    columns = [v for v in values if isinstance(v, Column)]
    values = [v for v in values if not isinstance(v, Column)]
    found = [_present(field, col_of(field).isin(*[v for v in values if v != ""]))]
    if "" in values:
        found.append(text(field) == "")
    return any_of(*found, *[_same(field, c) for c in columns])


def not_in(field: Field, values: Iterable[Value]) -> Column:
    return ~in_(field, values)


def in_ci(field: Field, values: Iterable[Value]) -> Column:
    return F.lower(text(field)).isin(*[F.lower(text(v)) if isinstance(v, Column) else str(v).lower() for v in values])


def not_in_ci(field: Field, values: Iterable[Value]) -> Column:
    return ~in_ci(field, values)


# --- substrings ------------------------------------------------------------------------------

def _cs(method: str) -> Callable[[Field, Value], Column]:
    def build(field: Field, value: Value) -> Column:
        if isinstance(value, Column):
            return getattr(text(field), method)(text(value))
        if value == "":
            return F.lit(True)
        return _present(field, getattr(col_of(field).cast("string"), method)(str(value)))

    return build


def _ci(method: str) -> Callable[[Field, Value], Column]:
    def build(field: Field, value: Value) -> Column:
        needle = F.lower(text(value)) if isinstance(value, Column) else F.lit(str(value).lower())
        return getattr(F.lower(text(field)), method)(needle)

    return build


def _negated(test: Callable[[Field, Value], Column]) -> Callable[[Field, Value], Column]:
    return lambda field, value: ~test(field, value)


contains, contains_cs = _ci("contains"), _cs("contains")
startswith, startswith_cs = _ci("startswith"), _cs("startswith")
endswith, endswith_cs = _ci("endswith"), _cs("endswith")
not_contains, not_contains_cs = _negated(contains), _negated(contains_cs)
not_startswith, not_startswith_cs = _negated(startswith), _negated(startswith_cs)
not_endswith, not_endswith_cs = _negated(endswith), _negated(endswith_cs)


# --- whole terms -----------------------------------------------------------------------------
#
# A boundary is only asked for on a side whose own edge character is part of a word: ``.tmp`` is
# found in ``cache.tmp``.

_NO_WORD_BEFORE = "(?<![A-Za-z0-9_]{})"
_NO_WORD_AFTER = "(?![A-Za-z0-9_])"


def _wordlike(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


def _quoted(term: str) -> str:
    return "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _has_literal(subject: Column, term: str) -> Column:
    """Whether the subject holds the term; the cheap substring test spares most rows the regex."""
    found = subject.contains(term)
    quoted = _quoted(term)
    # The term comes first and the look behind reaches over it, so that the search can skip ahead.
    before = _NO_WORD_BEFORE.format(quoted) if _wordlike(term[0]) else ""
    after = _NO_WORD_AFTER if _wordlike(term[-1]) else ""
    return found & subject.rlike(quoted + before + after) if before or after else found


def _has_column(subject: Column, term: Column) -> Column:
    word = r"[\p{L}\p{N}_]"
    quoted = F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    before = F.when(term.rlike("^" + word), F.lit(_NO_WORD_BEFORE.format(""))).otherwise("")
    after = F.when(term.rlike(word + "$"), F.lit(_NO_WORD_AFTER)).otherwise("")
    return (term != "") & F.rlike(subject, F.concat(before, quoted, after))


def has(field: Field, value: Value) -> Column:
    if isinstance(value, Column):
        return _has_column(F.lower(text(field)), F.lower(text(value)))
    term = str(value).lower()
    return _present(field, _has_literal(F.lower(col_of(field).cast("string")), term)) if term else F.lit(False)


def not_has(field: Field, value: Value) -> Column:
    return ~has(field, value)


def has_cs(field: Field, value: Value) -> Column:
    if isinstance(value, Column):
        return _has_column(text(field), text(value))
    term = str(value)
    return _present(field, _has_literal(col_of(field).cast("string"), term)) if term else F.lit(False)


def not_has_cs(field: Field, value: Value) -> Column:
    return ~has_cs(field, value)


def has_any(field: Field, values: Iterable[str]) -> Column:
    terms = [str(v).lower() for v in values]
    return _present(field, let(F.lower(col_of(field).cast("string")), lambda subject: any_of(
        *[_has_literal(subject, t) for t in terms if t])))


def has_all(field: Field, values: Iterable[str]) -> Column:
    return all_of(*[has(field, v) for v in values])


def matches_regex(field: Field, value: Value) -> Column:
    if isinstance(value, Column):
        return F.rlike(text(field), text(value))
    return text(field).rlike(str(value))


# --- order -----------------------------------------------------------------------------------

def _ordered(compare: Callable[[Column, Column], Column]) -> Callable[[Field, Value], Column]:
    def build(field: Field, value: Value) -> Column:
        if isinstance(value, Column):
            # Typed comparison of two columns; either side missing is false.
            left = col_of(field)
            return left.isNotNull() & value.isNotNull() & compare(left, value)
        if isinstance(value, datetime):
            return _present(field, compare(col_of(field), time_literal(value)))
        try:
            bound = float(value)
        except ValueError:
            moment = col_of(field).try_cast("timestamp")
            limit = F.lit(value).try_cast("timestamp")
            return moment.isNotNull() & limit.isNotNull() & compare(moment, limit)
        if bound != bound:
            return F.lit(False)
        own, number = col_of(field), col_of(field).try_cast("double")
        exact = F.lit(int(bound)) if bound.is_integer() and abs(bound) < 1 << 53 else F.lit(bound)
        # NaN sorts above every number in Spark; a comparison with it must be false.
        typed = F.when(_is(field, _WHOLE, True), compare(own, exact)).when(
            _is(field, _FLOATING), ~F.isnan(own) & compare(own, F.lit(bound))).otherwise(
            number.isNotNull() & ~F.isnan(number) & compare(number, F.lit(bound)))
        return own.isNotNull() & typed

    return build


gt = _ordered(lambda a, b: a > b)
lt = _ordered(lambda a, b: a < b)
ge = _ordered(lambda a, b: a >= b)
le = _ordered(lambda a, b: a <= b)


# --- grouping --------------------------------------------------------------------------------

def all_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def any_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


BY_TOKEN: dict[str, Callable[..., Column]] = {
    "==": eq, "!=": ne, "=~": eq_ci, "!~": ne_ci,
    "contains": contains, "!contains": not_contains,
    "contains_cs": contains_cs, "!contains_cs": not_contains_cs,
    "startswith": startswith, "!startswith": not_startswith,
    "startswith_cs": startswith_cs, "!startswith_cs": not_startswith_cs,
    "endswith": endswith, "!endswith": not_endswith,
    "endswith_cs": endswith_cs, "!endswith_cs": not_endswith_cs,
    "in": in_, "!in": not_in, "in~": in_ci, "!in~": not_in_ci,
    "has": has, "!has": not_has, "has_any": has_any, "has_all": has_all,
    "has_cs": has_cs, "!has_cs": not_has_cs, "matches regex": matches_regex,
    ">": gt, "<": lt, ">=": ge, "<=": le,
}


def compare(field: Field, token: str, value) -> Column:
    """One comparison chosen by its operator token, e.g. ``compare("Url", "has_any", [...])``."""
    return BY_TOKEN[token](field, value)

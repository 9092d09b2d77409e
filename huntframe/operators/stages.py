"""Row-wise and set operators: where, project, extend, parse, mv_expand, top, union."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huntframe.functions.predicates import all_of, text


def where(df: DataFrame, *tests: Column) -> DataFrame:
    """Rows for which every test holds; combine alternatives with ``any_of``."""
    return df.filter(all_of(*tests))


def project(df: DataFrame, *fields: str) -> DataFrame:
    return df.select(*fields)


def extend(df: DataFrame, **computed: Column) -> DataFrame:
    """Add columns in order; a later one may use an earlier one."""
    return reduce(lambda d, item: d.withColumn(*item), computed.items(), df)


@dataclass(frozen=True)
class Capture:
    """Part of a ``parse`` template that becomes a column."""

    name: str


ANY = object()  # part of a ``parse`` template that matches anything and is dropped


def parse_pattern(template: tuple) -> str:
    """One anchored regex for a template of literals, captures and ``ANY``."""

    def piece(part) -> str:
        if part is ANY:
            return ".*?"
        return "(.*?)" if isinstance(part, Capture) else re.escape(part)

    # s: dot spans lines; d: only a line feed counts as a line end for the final anchor.
    return "(?sd)^" + "".join(map(piece, template)) + "$"


def parse(df: DataFrame, source: str, *template) -> DataFrame:
    """Cut columns out of text by position, e.g. ``parse(df, "Msg", ANY, "(", Capture("Name"), ")", ANY)``.

    No row is dropped: where the template does not fit, the new columns are null.
    """
    pattern, subject = parse_pattern(template), text(source)
    fits = subject.rlike(pattern)
    names = [p.name for p in template if isinstance(p, Capture)]
    return df.withColumns({
        name: F.when(fits, F.regexp_extract(subject, pattern, i + 1)) for i, name in enumerate(names)
    })


def mv_expand(df: DataFrame, *fields: str, to: str | None = None) -> DataFrame:
    """One row per array element.

    A single field keeps rows with an empty or missing array (value null) and may be cast with
    ``to``; one that is no array counts as an array of one. Several fields move in lockstep up to the shortest array; an empty one drops the row.
    """
    if len(fields) == 1:
        name = fields[0]
        single = not isinstance(df.schema[name].dataType, (T.ArrayType, T.MapType))
        item = F.explode_outer(F.array(name) if single else F.col(name))
        wide = df.select(*[item.alias(name) if c == name else F.col(c) for c in df.columns])
        return wide.withColumn(name, F.col(name).cast(to)) if to else wide

    def as_array(name: str) -> Column:
        kind = df.schema[name].dataType
        if not isinstance(kind, T.ArrayType):
            return F.array(F.col(name))
        return F.coalesce(F.col(name), F.array(F.lit(None).cast(kind.elementType)))

    arrays = {name: as_array(name) for name in fields}
    shortest = F.least(*[F.size(a) for a in arrays.values()])
    rows = F.arrays_zip(*[F.slice(a, 1, shortest).alias(name) for name, a in arrays.items()])
    keep = [c for c in df.columns if c not in fields]
    return df.select(*keep, F.inline(rows).alias(*fields)).select(*df.columns)


def top(df: DataFrame, n: int, by: str, desc: bool = True, tiebreak: tuple[str, ...] = ()) -> DataFrame:
    """The first ``n`` rows by a column; nulls come last either way."""
    col = F.col(by)
    order = col.desc_nulls_last() if desc else col.asc_nulls_last()
    return df.orderBy(order, *[F.col(t).asc_nulls_last() for t in tiebreak]).limit(n)


def union(*frames: DataFrame) -> DataFrame:
    """All rows of all frames; a column missing on one side is null there."""
    if not frames:
        raise ValueError("union needs at least one table")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_tables(spark: SparkSession, *tables: str, fuzzy: bool = False) -> DataFrame:
    """Union of named tables; ``fuzzy`` skips names that do not exist."""
    names = [t for t in tables if spark.catalog.tableExists(t)] if fuzzy else tables
    return union(*[spark.table(t) for t in names])


def flatten_struct(df: DataFrame, field: str) -> DataFrame:
    """Replace a struct column by its members (several results of one function)."""
    rest = [c for c in df.columns if c != field]
    return df.select(*rest, f"{field}.*")


def fires(df: DataFrame) -> bool:
    """Whether any row is left; stops at the first one."""
    return not df.isEmpty()

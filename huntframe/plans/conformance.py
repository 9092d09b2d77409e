"""Field reference of the event types, and checking tables against it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def field_reference(rows: DataFrame, documents: dict[str, str], common: str,
                    includes: dict[str, str] | None = None) -> DataFrame:
    """One row per event type with its sorted field names.

    ``rows`` holds (document, field); every type has the common document's fields, its own, and
    those of a type it includes.
    """
    parts = []
    for kind, own in documents.items():
        sources = [common, own]
        if includes and kind in includes:
            sources.append(documents[includes[kind]])
        parts.append(F.when(F.col("document").isin(sources), F.lit(kind)))
    typed = rows.select("field", F.explode(F.array_compact(F.array(*parts))).alias("event_type"))
    # Field names of a schema: a few hundred per type.
    return typed.groupBy("event_type").agg(F.sort_array(F.collect_set("field")).alias("fields"))


def conform(df: DataFrame, schema: T.StructType, keep_unknown: bool = False) -> DataFrame:
    """The table under a declared schema: columns cast, missing ones null, unknown ones dropped.

    With ``keep_unknown`` the columns that are not declared follow as they are.
    """
    declared = [
        F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) if f.name in df.columns
        else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    unknown = [F.col(f"`{c}`") for c in df.columns if c not in schema.fieldNames()] if keep_unknown else []
    return df.select(*declared, *unknown)


def conformance_report(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Per column its status (``ok``, ``missing``, ``unknown``) and how many rows hold a value."""
    declared = [f.name for f in schema.fields]
    status = {c: "ok" if c in declared else "unknown" for c in df.columns}
    status |= {c: "missing" for c in declared if c not in df.columns}
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(
        F.lit(c).alias("column"), F.lit(s).alias("status"),
        (F.col(c) if c in df.columns else F.lit(0).cast("long")).alias("filled"))
        for c, s in status.items()])
    return counts.select(F.inline(rows))

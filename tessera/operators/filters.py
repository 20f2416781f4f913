"""The one predicate set that both roads share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = {"public": 0, "internal": 1, "secret": 2}


def level(permission: Column) -> Column:
    """Rank of a permission; an unknown one counts as internal."""
    return F.when(permission == "public", 0).when(permission == "secret", 2).otherwise(1)


def visible(user_permission: Column, permission: Column) -> Column:
    return permission.isin(list(LEVELS)) & (level(permission) <= level(user_permission))


def current(effective_time: Column, now: Column) -> Column:
    """0 is for ever; the last second counts."""
    return (effective_time == 0) | (effective_time >= now)


def validity(effective_time: Column, now: Column) -> Column:
    return F.when((effective_time != 0) & (effective_time < now), "expired").otherwise("valid")


def predicate(chunk: DataFrame, spec: DataFrame) -> Column:
    """Rows of chunk that a row of spec allows. spec: tenant_id, user_permission, now, include_expired, years, category, department; the last three null where they don't filter, an empty category neither."""
    parts = [
        chunk["is_valid"],
        chunk["tenant_id"] == spec["tenant_id"],
        visible(spec["user_permission"], chunk["permission"]),
        spec["include_expired"] | current(chunk["effective_time"], spec["now"]),
        spec["years"].isNull() | F.array_contains(spec["years"], chunk["doc_year"]),
        F.coalesce(spec["category"], F.lit("")).isin("") | (chunk["category"] == spec["category"]),
        spec["department"].isNull() | (chunk["department"] == spec["department"]),
    ]
    return reduce(lambda a, b: a & b, parts)


def eligible(chunks: DataFrame, specs: DataFrame) -> DataFrame:
    """sig and chunk columns for each filter signature; specs: a row for each different signature, few by nature, met by tenant."""
    return chunks.join(specs, predicate(chunks, specs)).select(specs["sig"], *[chunks[c] for c in chunks.columns])

"""Identity, hashing, JSON text and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def event_id(source: Column, external_id: Column) -> Column:
    """Deterministic UUID-shaped id of the natural key: replays and retries agree on it."""
    h = F.sha2(F.concat_ws("|", source, external_id), 256)
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.substring(h, 13, 4),
        F.substring(h, 17, 4),
        F.substring(h, 21, 12),
    )


def content_hash(**content: Column) -> Column:
    """sha256 of the JSON text of the named values, keys sorted.

    Only equality between polls matters. NULL members drop out of the text, as they do in attrs.
    """
    ordered = F.struct(*[content[k].alias(k) for k in sorted(content)])
    return F.sha2(F.to_json(ordered), 256)


def attr(attrs: Column, name: str) -> Column:
    return F.get_json_object(attrs, f"$.{name}")


def attr_double(attrs: Column, name: str) -> Column:
    return attr(attrs, name).try_cast("double")


def finite(value: Column) -> Column:
    """Neither NULL, NaN nor infinite. NaN compares above every number in Spark."""
    bound = F.lit(1.7976931348623157e308)
    return F.coalesce(value.between(-bound, bound), F.lit(False))


def phenomenon_code(phenomenon: Column) -> Column:
    return F.split_part(phenomenon, F.lit(";"), F.lit(1))


def madrid_to_utc(text: Column) -> Column:
    """dd/MM/yyyy H:mm:ss in mainland official time to an instant."""
    local = F.try_to_timestamp(text, F.lit("dd/MM/yyyy H:mm:ss"))
    return F.to_utc_timestamp(local, "Europe/Madrid")


def utc_moment(text: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss read as UTC (the session zone); NULL when malformed."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))


def iso_moment(text: Column) -> Column:
    """ISO-8601 with an offset to an instant; NULL when malformed."""
    return text.try_cast("timestamp")


def instant_end(source: Column, kind: Column, starts_at: Column, expires: Column) -> Column:
    """End of validity: point events end as they start, burnt areas stay open, warnings expire."""
    return (
        F.when(source == "ign", starts_at)
        .when((source == "effis") & (kind == "hotspot"), starts_at)
        .when(source == "aemet", expires)
    )

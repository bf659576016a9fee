"""From scored hits to triageable events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import category, flow_endpoints, sid
from .gates import locate


def classify_event(crossed: Column, detection: Column, observing: Column) -> Column:
    """found, noted or sighting below the threshold; banish, alert or sighted at a crossing, which replaces the routine event."""
    return (
        F.when(detection, F.when(crossed, "sighted").otherwise("sighting"))
        .when(observing, F.when(crossed, "alert").otherwise("noted"))
        .otherwise(F.when(crossed, "banish").otherwise("found"))
    )


def effective_severity(*layers: Column) -> Column:
    return F.coalesce(*layers)


def scored_events(hits: DataFrame, scores: DataFrame, detection: Column, observing: Column) -> DataFrame:
    """Add score, crossed, event_type and the threshold that the score races to hits (bucket, key, us, ord), from ``event_scores``."""
    out = hits.join(scores, ["bucket", "key", "us", "ord"])
    return out.withColumn("event_type", classify_event(F.col("crossed"), detection, observing))


def enrich_country(events: DataFrame, ranges: DataFrame, ip: str = "ip", ranges6: DataFrame | None = None) -> DataFrame:
    """The banned address's country, null for networks and unlocated addresses."""
    return locate(events, ip, ranges, "country", ranges6)


def triage(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule metadata (rule, classtype, severity; a small table) joined, with category and signature id."""
    out = events.join(rules, "rule", "left")
    return out.withColumns({"category": category(F.col("classtype")), "sid": sid(F.col("rule"))})


def event_record(found: str = "found", src: str | None = "SRC", dest: str | None = "DEST") -> list[Column]:
    """Envelope columns: src_ip and dest_ip are always there."""
    ends = flow_endpoints(F.col(found), src, dest)
    return [ends["src_ip"].alias("src_ip"), ends["dest_ip"].alias("dest_ip")]

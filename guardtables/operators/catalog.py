"""Tool catalogs of servers: pins, drift, conflicting copies, allow-lists, hostile descriptions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonx import explode_leaves, is_object, parsed
from .inspect import InspectPolicy, detect


def definition_hash(tool: Column, description: Column, schema: Column) -> Column:
    """Hash of the name, description and schema with sorted keys."""
    parts = F.concat(
        F.lit("["), F.to_json(F.array(tool, F.coalesce(description, F.lit("")))), F.lit(","),
        F.to_json(parsed(schema)), F.lit("]"),
    )
    return F.sha2(parts, 256)


def pin_catalog(listings: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Add pin, changed and blocked: the first definition seen, drift from it, and drift so far.

    ``listings``: server, tool, observed_at, listing_pos, def_hash. A tool that changed once
    stays blocked, even when it changes back. The pin and the moment of the first drift are
    aggregates, so a server with very many listings is combined before the shuffle.
    """
    on = key or ["server", "tool"]
    at = F.struct("observed_at", "listing_pos")
    pins = listings.groupBy(*on).agg(F.min_by("def_hash", at).alias("pin"))
    pinned = listings.join(pins, on).withColumn("changed", F.col("def_hash") != F.col("pin"))
    drift = pinned.where("changed").groupBy(*on).agg(F.min(at).alias("_drift"))
    return (
        pinned.join(drift, on, "left")
        .withColumn("blocked", F.coalesce(at >= F.col("_drift"), F.lit(False)))
        .drop("_drift")
    )


def conflicting_copies(pinned: DataFrame, listing: list[str] | None = None) -> DataFrame:
    """Rows left when every copy of a tool that drifted inside the same listing is dropped."""
    on = listing or ["server", "listing_id", "tool"]
    return pinned.where(~F.col("blocked")).join(
        pinned.where(F.col("changed")).select(*on).distinct(), on, "left_anti"
    )


def check_definitions(listings: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Add reject: 'malformed', 'not allowed' or NULL."""
    bad = (
        (F.coalesce("tool", F.lit("")) == "")
        | ~is_object(F.col("input_schema"))
    )
    checked = listings.withColumn("reject", F.when(bad, "malformed"))
    if allowed is None:
        return checked
    known = allowed.select("tool", F.lit(True).alias("_ok")).distinct()
    return (
        checked.join(known, "tool", "left")
        .withColumn("reject", F.coalesce("reject", F.when(F.col("_ok").isNull(), "not allowed")))
        .drop("_ok")
    )


def hostile_definitions(listings: DataFrame, policy: InspectPolicy, key: str = "def_id") -> DataFrame:
    """Definitions whose description or schema holds something the detectors block."""
    named = listings.withColumn(
        "_json",
        F.to_json(F.struct(F.col("tool").alias("name"), F.coalesce("description", F.lit("")).alias("description"))),
    )
    texts = explode_leaves(named, "_json", "texts", key).unionByName(
        explode_leaves(named, "input_schema", "texts", key)
    )
    found = detect(texts.select(key, "text"), policy, text="text")
    return found.where(F.exists("findings", lambda f: f["action"] == "block")).select(key).distinct()

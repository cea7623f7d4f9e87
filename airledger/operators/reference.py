"""Vocabularies, what the registry holds of them, statistics and verification."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.parameters import QueryError
from .build import Registry
from .textsearch import folded

TOPICS = {
    "radio_services": codes.RADIO_SERVICES,
    "license_statuses": codes.LICENSE_STATUSES,
    "location_types": codes.LOCATION_TYPES,
    "location_classes": codes.LOCATION_CLASSES,
    "antenna_types": codes.ANTENNA_TYPES,
    "applicant_types": codes.APPLICANT_TYPES,
    "operator_classes": codes.OPERATOR_CLASSES,
    "states": codes.USPS_STATES,
}
FILTERED = ("radio_services", "station_classes")


def plain(text: str) -> str:
    """Lower case without accents, other characters than letters and digits as blanks."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    return "".join(c if c.isalnum() else " " for c in bare)


def _plain(value) -> Column:
    return F.regexp_replace(folded(value), r"[^\p{L}\p{N}]", " ")


def vocabulary(spark: SparkSession, topic: str, station_classes: DataFrame | None = None) -> DataFrame:
    """code and label of a topic; station classes come from the caller's table of them."""
    if topic == "station_classes" and station_classes is not None:
        return station_classes.select("code", "label")
    if topic not in TOPICS:
        raise QueryError("unknown_topic", topic)
    return spark.createDataFrame(list(TOPICS[topic].items()), "code string, label string")


def filtered(entries: DataFrame, text: str | None) -> DataFrame:
    """Entries whose code and label have every word of a filter somewhere, whatever accents and punctuation."""
    tokens = plain(text or "").split()
    if not tokens:
        return entries
    hay = entries.withColumn("__hay", _plain(F.concat_ws(" ", "code", "label")))
    for t in tokens:
        hay = hay.where(F.contains("__hay", F.lit(t)))
    return hay.drop("__hay")


def list_reference(spark: SparkSession, topic: str, text: str | None = None, registry: Registry | None = None, station_classes: DataFrame | None = None) -> DataFrame:
    """A topic's entries by code; radio services also say how many records the registry has, with codes beyond the table."""
    if text is not None and topic not in FILTERED:
        raise QueryError("invalid_filter", topic)
    entries = vocabulary(spark, topic, station_classes)
    if topic == "radio_services" and registry is not None:
        entries = services_with_counts(entries, registry)
    return filtered(entries, text).orderBy("code")


def service_counts(licences: DataFrame) -> DataFrame:
    """radio_service_code and its records."""
    return licences.groupBy("radio_service_code").agg(F.count("*").alias("record_count"))


def services_with_counts(entries: DataFrame, registry: Registry) -> DataFrame:
    """Entries with record_count, 0 for services without records, and the registry's codes that the table lacks."""
    counted = service_counts(registry.licenses.where("radio_service_code IS NOT NULL")).withColumnRenamed("radio_service_code", "code")
    known = entries.join(counted, "code", "left")
    unknown = counted.join(entries, "code", "left_anti").withColumn("label", F.col("code"))
    return known.unionByName(unknown).withColumn("record_count", F.coalesce("record_count", F.lit(0)))


def classify_service(code: str, indexed: set[str]) -> str:
    """indexed, not_indexed (a known service without records) or unknown."""
    return "indexed" if code in indexed else "not_indexed" if code in codes.RADIO_SERVICES else "unknown"


def require_service(code: str, indexed: set[str]) -> str:
    """The code if the registry has records of it; raises unknown_radio_service or service_not_indexed."""
    found = classify_service(code, indexed)
    if found != "indexed":
        raise QueryError({"unknown": "unknown_radio_service"}.get(found, "service_not_indexed"), code)
    return code


def require_indexed(registry: Registry, code: str | None) -> None:
    """Raises unknown_radio_service or service_not_indexed unless the registry has a record of a service; None passes."""
    if code is not None:
        held = registry.licenses.where(F.col("radio_service_code") == code).head(1)
        require_service(code, {code} if held else set())


def group_statistics(registry: Registry) -> DataFrame:
    """service_group: records, sites and frequency rows. Technical rows are counted by usi before they are joined."""
    per = lambda df, name: df.groupBy("usi").agg(F.count("*").alias(name))
    rows = registry.licenses.select("usi", "service_group").join(per(registry.locations, "s"), "usi", "left").join(per(registry.frequencies, "f"), "usi", "left")
    return rows.groupBy("service_group").agg(F.count("*").alias("records"), F.coalesce(F.sum("s"), F.lit(0)).alias("sites"), F.coalesce(F.sum("f"), F.lit(0)).alias("frequencies"))


def widest_bands(registry: Registry) -> DataFrame:
    """One row: widest occupied site band and widest market block, in MHz."""
    site = registry.frequencies.agg(F.max(F.col("occ_high") - F.col("occ_low"))).scalar()
    market = registry.market_blocks.where("lower > 0").agg(F.max(F.coalesce("upper", "lower") - F.col("lower"))).scalar()
    return registry.frequencies.sparkSession.range(1).select(site.alias("widest_site_mhz"), market.alias("widest_market_mhz"))


def verify(upstream: DataFrame, statistics: DataFrame) -> DataFrame:
    """record_type: upstream and read lines, and whether they agree; a type missing on one side doesn't."""
    joined = upstream.join(statistics, "record_type", "full_outer")
    return joined.select("record_type", "upstream_lines", "lines_read", "lines_rejected", F.coalesce(F.col("upstream_lines") == F.col("lines_read"), F.lit(False)).alias("agrees"))


def table_counts(registry: Registry) -> DataFrame:
    """Rows of each table of the registry."""
    parts = [getattr(registry, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("row_count")) for t in Registry.tables()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

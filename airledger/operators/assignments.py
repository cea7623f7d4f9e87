"""Assignments kept beside the tables, with their licences, and counts of their edges: pages and totals without joins.

A row is a market block, or what one licence files at one location number for one frequency, upper edge and occupied
band. Sorted by class of width and frequency, a page's range of frequencies reaches the scan. Counts by bins of a quarter
MHz tell how far a page reaches and, with the rows of two bins, how many assignments meet a band.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import bands
from ..functions.codes import LIVE_STATUSES

HEAD = ["usi", "callsign", "license_status", "radio_service_code", "licensee_name", "frn", "market_code", "is_individual"]
#: What rows are one result, and how the rows are kept.
KEY = ["kind_order", "frequency_mhz", "usi", "location_number", "upper_mhz"]
KEPT = ["band_class", "frequency_mhz", "usi"]
#: Width of a bin in MHz: bins have exact edges, and 300 GHz have 1.2 million at most, however many rows there are.
BIN = 0.25
COUNTS_SCHEMA = "kind_order int, license_status string, edge string, bin long, n long"
#: What a row is for counts: another band of a result that is counted by a wider one, a result's widest band, and such a
#: band that doesn't hold its own frequency, which bins can't count.
OTHER, WIDEST, ODD = 0, 1, 2


@dataclass
class SpectrumIndex:
    """Assignments of live licences, and the counts of their edges by bin."""

    entries: DataFrame
    counts: DataFrame


#: What a site of its own at a location number tells.
SITE = ("city", "county", "site_state", "lat", "lon")


def entries(licences: DataFrame, frequencies: DataFrame, locations: DataFrame, blocks: DataFrame) -> DataFrame:
    """The rows of an index: frequencies with their number's sites as in spectrum.site_summary, collapsed market blocks.

    Bands of one frequency and upper edge lie in each other, as they differ by bandwidth alone; so where any meets a band
    that is asked, the widest does, and counts need no other. Rows without a frequency, and blocks that are no more than a
    channel width, are in no search and are left out. Frequency rows and sites are dealt by licence once, together: what
    groups, orders and joins them afterwards all has the licence among its keys.
    """
    keys = ["usi", "location_number", "frequency_mhz", "upper_mhz", "occ_low", "occ_high"]
    shown = [c for c in SITE if c in locations.columns]
    filed = frequencies.where("frequency_mhz IS NOT NULL").select(*keys, "bandwidth_mhz", "erp_w", "class_station", "emissions")
    both = filed.unionByName(locations.select("usi", "location_number", *shown), allowMissingColumns=True).repartition("usi")
    # Sites are the rows without a frequency, so those of one number are one group.
    own = both.groupBy(*keys).agg(
        F.max("bandwidth_mhz").alias("bandwidth_mhz"),
        F.max("erp_w").alias("erp_w"),
        F.array_sort(F.collect_set("class_station")).alias("class_stations"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("emissions")))).alias("emissions"),
        F.count("*").alias("site_count"),
        *[F.when(F.count("*") == 1, F.first(c)).alias(c) for c in shown],
    )
    # As many rows as a frequency has bandwidths at one location number.
    place = F.row_number().over(W.partitionBy("usi", "location_number", "frequency_mhz", "upper_mhz").orderBy("occ_low", F.desc("occ_high")))
    site = F.when(F.col("frequency_mhz").isNull() & F.col("location_number").isNotNull(), F.struct("site_count", *shown))
    spread = own.withColumn("widest", place == 1).withColumn("__site", F.max(site).over(W.partitionBy("usi", "location_number"))).where("frequency_mhz IS NOT NULL")
    fields = {"site_count": F.coalesce("__site.site_count", F.lit(0).cast("long"))} | {c: F.col(f"__site.{c}") for c in shown}
    sites = spread.withColumns(fields).drop("__site").withColumn("kind_order", F.lit(1))
    block = blocks.where("lower > 0").select("usi", F.col("lower").alias("frequency_mhz"), F.col("upper").alias("upper_mhz"), "partition_areas", F.col("lower").alias("occ_low"), F.coalesce("upper", "lower").alias("occ_high"), F.lit(0).alias("kind_order"), F.lit(True).alias("widest"))
    holds = (F.col("occ_low") <= F.col("frequency_mhz")) & (F.col("frequency_mhz") <= F.col("occ_high"))
    live = licences.where(F.col("license_status").isin(*LIVE_STATUSES)).select(*HEAD)
    # Each side is joined as it is dealt: their union would be dealt again.
    made = sites.join(live, "usi").unionByName(block.join(live, "usi"), allowMissingColumns=True)
    return made.withColumns({"role": F.when(~F.col("widest"), OTHER).when(holds, WIDEST).otherwise(ODD), "band_class": bands.band_class(F.col("occ_low"), F.col("occ_high"))}).drop("widest")


def counted(rows: DataFrame, *by: str) -> DataFrame:
    """How many results have their frequency, and the edges of their widest band, in each bin, by kind and status."""
    edges = F.array(*[F.struct(F.lit(e).alias("edge"), F.floor(F.col(c) / BIN).cast("long").alias("bin")) for e, c in (("frequency", "frequency_mhz"), ("low", "occ_low"), ("high", "occ_high"))])
    each = rows.where(F.col("role") == WIDEST).select(*by, "kind_order", "license_status", F.inline(edges))
    return each.groupBy(*by, "kind_order", "license_status", "edge", "bin").agg(F.count("*").alias("n"))


def _asked(rows: DataFrame, search) -> DataFrame:
    """Rows of the kinds and the status of a search; both are columns of entries and of counts."""
    if search.kind != "both":
        rows = rows.where(F.col("kind_order") == (1 if search.kind == "site" else 0))
    return rows if search.status == "any" else rows.where(F.col("license_status") == search.status)


def narrowed(search) -> list[Column]:
    """A search's filters that counts don't know."""
    asked = {"radio_service_code": search.radio_service, "frn": search.frn, "market_code": search.market_code}
    return [F.col(c) == v for c, v in asked.items() if v is not None]


def found(index: SpectrumIndex, search, start: float | None = None, end: float | None = None) -> DataFrame:
    """The results of a normalised search of neither state nor licensee, of frequencies from start and below end.

    As in a search without an index, values of a result are of its rows whose own band is met.
    """
    rows = _asked(index.entries, search).where(bands.overlaps(F.col("occ_low"), F.col("occ_high"), (search.low, search.high)))
    limits = ([F.col("frequency_mhz") >= start] if start is not None else []) + ([F.col("frequency_mhz") < end] if end is not None else [])
    for f in [*narrowed(search), *limits]:
        rows = rows.where(f)
    own = [c for c in rows.columns if c not in {*KEY, "occ_low", "occ_high", "role", "band_class"}]
    merged = {"bandwidth_mhz": F.max("bandwidth_mhz"), "erp_w": F.max("erp_w")} | {c: F.when(F.col("kind_order") == 1, F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))) for c in ("class_stations", "emissions")}
    out = rows.groupBy(*KEY).agg(*[merged.get(c, F.first(c)).alias(c) for c in own])
    return out.withColumns({"kind": F.when(F.col("kind_order") == 1, "site").otherwise("market"), "location_key": F.coalesce("location_number", F.lit(0)).cast("long"), "upper_key": F.coalesce("upper_mhz", F.lit(0.0))})


def page_end(index: SpectrumIndex, search, start: float | None, limit: int) -> float | None:
    """A frequency below which a page from start surely ends, another row following; None where counts can't tell.

    A frequency in the band is met, so whole bins within it hold at least what they count. As many bins are read as a page
    has rows, at most.
    """
    if narrowed(search):
        return None
    first = max(search.low, search.low if start is None else start)
    # The bin that start lies in may hold rows that precede the cursor, and the last bin rows beyond the band.
    bins = _asked(index.counts, search).where((F.col("edge") == "frequency") & (F.col("bin") > int(first // BIN)) & (F.col("bin") < int(search.high // BIN)))
    seen = 0
    for r in bins.groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").limit(limit + 1).collect():
        seen += r.n
        if seen > limit:
            return (r.bin + 1) * BIN
    return None


def total(index: SpectrumIndex, search) -> int:
    """How many results a normalised search of neither state nor licensee has, exactly.

    Those that begin by the band's end less those that end before it begins: whole bins from the counts, and the rows of
    the two bins in which the band's edges lie. With filters that counts don't know, results are counted one by one.
    """
    low, high = search.low - bands.TOLERANCE, search.high + bands.TOLERANCE
    rows = _asked(index.entries, search)
    if narrowed(search):
        met = reduce(lambda a, b: a & b, [bands.overlaps(F.col("occ_low"), F.col("occ_high"), (search.low, search.high)), *narrowed(search)])
        return rows.where(met & (F.col("role") != OTHER)).count()
    begun, ended = int(high // BIN), int(low // BIN)
    widest = F.col("role") == WIDEST
    begins = widest & (F.col("occ_low") >= begun * BIN) & (F.col("occ_low") <= high)
    ends = widest & (F.col("occ_high") >= ended * BIN) & (F.col("occ_high") < low)
    odd = (F.col("role") == ODD) & (F.col("occ_low") <= high) & (F.col("occ_high") >= low)
    near = rows.where(begins | ends | odd).agg((F.count_if(begins | odd) - F.count_if(ends)).alias("n"))
    edge, at = F.col("edge"), F.col("bin")
    whole = _asked(index.counts, search).agg(F.coalesce(F.sum(F.when((edge == "low") & (at < begun), F.col("n")).when((edge == "high") & (at < ended), -F.col("n"))), F.lit(0)).alias("n"))
    return near.unionByName(whole).agg(F.sum("n")).first()[0]

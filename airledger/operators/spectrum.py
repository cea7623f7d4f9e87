"""Spectrum search over site assignments and market blocks."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bands, codes, parameters
from ..functions import columns as C
from . import assignments, paging, reference, textsearch
from .assignments import HEAD
from .build import Registry
from .licences import equality_filters
from .redact import redact


@dataclass(frozen=True)
class SpectrumSearch:
    """A band, or one frequency, and what licences must meet; kind is site, market or both."""

    low: float
    high: float | None = None
    kind: str = "both"
    state: str | None = None
    radio_service: str | None = None
    licensee: str | None = None
    frn: str | None = None
    market_code: str | None = None
    status: str = "A"
    unit: str = "MHz"

    def normalised(self) -> SpectrumSearch:
        """The same search in MHz, with every value in the form that records use.

        Raises invalid_frequency_range, invalid_kind or invalid_status.
        """
        found = parameters.band(self.low, self.high, parameters.unit(self.unit))
        if found is None:
            raise parameters.QueryError("invalid_frequency_range", "no_frequency")
        if self.kind not in ("site", "market", "both"):
            raise parameters.QueryError("invalid_kind", self.kind)
        made = {"low": found[0], "high": found[1], "unit": "MHz", "status": parameters.live_status(self.status)}
        for name, f in (("state", parameters.state), ("frn", parameters.frn), ("market_code", parameters.market_code), ("radio_service", lambda c: c.strip().upper()), ("licensee", parameters.folded_name)):
            if getattr(self, name) is not None:
                made[name] = f(getattr(self, name))
        return replace(self, **made)


def _heads(registry: Registry, search: SpectrumSearch, redaction: bool) -> DataFrame:
    heads = registry.licenses
    for f in equality_filters(search, {"radio_service": "radio_service_code", "frn": "frn", "market_code": "market_code"}):
        heads = heads.where(f)
    heads = heads.where(F.col("license_status").isin(*codes.LIVE_STATUSES) if search.status == "any" else F.col("license_status") == search.status)
    if search.licensee is not None:
        phrases = parameters.name_phrases(search.licensee)
        found = textsearch.rank(registry.licenses, "usi", "licensee_name", phrases) if phrases else None
        heads = heads.where(F.lit(False)) if found is None else heads.join(found.select("usi"), "usi", "left_semi")
        if redaction:
            heads = heads.where(~F.col("is_individual"))
    return heads


def site_assignments(registry: Registry, search: SpectrumSearch, redaction: bool = True) -> DataFrame:
    """One row for each (frequency, usi, location number, upper edge) whose occupied band meets the search's.

    Widest bandwidth, greatest ERP, distinct station classes and emissions; a site's fields only if the number has one
    site. The band filter reaches the scan, rows collapse before they are joined, and sites are summed by number first,
    so a number with many sites multiplies nothing.
    """
    search = search.normalised()
    band = (search.low, search.high)
    hit = registry.frequencies.where(F.col("frequency_mhz").isNotNull() & bands.overlaps(F.col("occ_low"), F.col("occ_high"), band))
    rows = hit.groupBy("frequency_mhz", "usi", "location_number", "upper_mhz").agg(
        F.max("bandwidth_mhz").alias("bandwidth_mhz"),
        F.max("erp_w").alias("erp_w"),
        F.array_sort(F.collect_set("class_station")).alias("class_stations"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("emissions")))).alias("emissions"),
    )
    heads = _heads(registry, search, redaction).select(*HEAD)
    numbers = site_summary(registry.locations)
    if search.state is not None:
        in_state = registry.locations.where(F.col("site_state") == search.state).select("usi", "location_number").distinct()
        rows = rows.join(in_state, ["usi", "location_number"], "left_semi")
    return rows.join(heads, "usi").join(numbers, ["usi", "location_number"], "left").withColumn("site_count", F.coalesce("site_count", F.lit(0)))


def site_summary(locations: DataFrame) -> DataFrame:
    """(usi, location_number): site_count, and the fields of the site where there is exactly one."""
    one = lambda c: F.when(F.count("*") == 1, F.first(c)).alias(c)
    return locations.groupBy("usi", "location_number").agg(F.count("*").alias("site_count"), *[one(c) for c in assignments.SITE if c in locations.columns])


def nationwide(market_code: Column) -> Column:
    """Whether a market is the whole nation, of which no state is asked."""
    return F.coalesce(market_code.startswith("NW"), F.lit(False))


def state_rule(licences: DataFrame, locations: DataFrame, state: str, area_states: DataFrame | None = None, county_prefix: str | None = None) -> DataFrame:
    """Licences whose market is in a state: by the area table, a county code, the market's name, or a site of its own.

    area_states: market_code, state (null for an area that lies in no state, as at sea); county_prefix: the two digits
    that the state's county codes begin with. Nationwide markets and those in no state are never in one, whatever sites
    they have.
    """
    own = locations.where(F.col("site_state") == state).select("usi").distinct().withColumn("__site", F.lit(True))
    found = licences.where(~nationwide(F.col("market_code")))
    if area_states is not None:
        found = found.join(area_states.where("state IS NULL").select("market_code").distinct(), "market_code", "left_anti")
    found = found.join(own, "usi", "left")
    tests = F.coalesce(F.array_contains("market_states", state), F.lit(False)) | F.col("__site").isNotNull()
    if county_prefix is not None:
        tests = tests | F.coalesce(F.col("market_code").rlike(f"^[CD]{county_prefix}[0-9]{{3}}$"), F.lit(False))
    if area_states is not None:
        areas = area_states.where(F.col("state") == state).select("market_code").distinct().withColumn("__area", F.lit(True))
        found = found.join(areas, "market_code", "left")
        tests = tests | F.col("__area").isNotNull()
    return found.where(tests).select(*licences.columns)


def collapse_blocks(blocks: DataFrame) -> DataFrame:
    """One row for each (usi, lower, upper), with its distinct partition areas other than 0, ascending; null if none."""
    areas = F.array_sort(F.collect_set(F.when(F.col("partition_area_id") != 0, F.col("partition_area_id"))))
    return blocks.groupBy("usi", "lower", "upper").agg(F.when(F.size(areas) > 0, areas).alias("partition_areas"))


def block_edges(blocks: DataFrame) -> DataFrame:
    """Adds low_mhz and high_mhz of blocks with edges, else channel_width_mhz."""
    edged = F.col("lower") > 0
    return blocks.withColumns({"low_mhz": F.when(edged, F.col("lower")), "high_mhz": F.when(edged, F.coalesce("upper", "lower")), "channel_width_mhz": F.when(~edged, F.col("upper"))})


def market_assignments(registry: Registry, search: SpectrumSearch, redaction: bool = True, area_states: DataFrame | None = None, county_prefix: str | None = None) -> DataFrame:
    """Market blocks that meet the band, collapsed, with their licence."""
    search = search.normalised()
    hit = registry.market_blocks.where(bands.block_overlaps(F.col("lower"), F.col("upper"), (search.low, search.high)))
    heads = _heads(registry, search, redaction)
    if search.state is not None:
        heads = state_rule(heads, registry.locations, search.state, area_states, county_prefix)
    return collapse_blocks(hit).join(heads.select(*HEAD), "usi")


ORDER = [paging.Key("frequency_mhz"), paging.Key("kind_order"), paging.Key("usi"), paging.Key("location_key"), paging.Key("upper_key")]


def search_frequencies(registry: Registry, search: SpectrumSearch, redaction: bool = True, area_states: DataFrame | None = None, county_prefix: str | None = None) -> DataFrame:
    """Both sides as one frame with the ordering columns; at an equal frequency a market block comes first.

    area_states and county_prefix are those of state_rule, for searches with a state. Raises what normalised does, and
    unknown_radio_service or service_not_indexed.
    """
    search = search.normalised()
    reference.require_indexed(registry, search.radio_service)
    sides = []
    if search.kind in ("site", "both"):
        site = site_assignments(registry, search, redaction).withColumns({"kind": F.lit("site"), "kind_order": F.lit(1)})
        sides.append(site.withColumns({"location_key": F.coalesce("location_number", F.lit(0)).cast("long"), "upper_key": F.coalesce("upper_mhz", F.lit(0.0))}))
    if search.kind in ("market", "both"):
        market = market_assignments(registry, search, redaction, area_states, county_prefix).withColumns({"kind": F.lit("market"), "kind_order": F.lit(0), "location_key": F.lit(0).cast("long"), "upper_key": F.coalesce("upper", F.lit(0.0))})
        sides.append(market.withColumnRenamed("lower", "frequency_mhz").withColumnRenamed("upper", "upper_mhz"))
    out = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1], allowMissingColumns=True)
    return redact(out.withColumn("service_label", C.label(F.col("radio_service_code"), codes.RADIO_SERVICES)), redaction)


def page_binding(search: SpectrumSearch, generation: str = "", county_prefix: str | None = None) -> tuple:
    """What a cursor of a search is bound to: spellings of one search share it."""
    asked = asdict(search.normalised())
    return generation, "f", paging.digest(asked if county_prefix is None else asked | {"county_prefix": county_prefix})


def entries(registry: Registry) -> DataFrame:
    """The rows of an index of a registry's assignments."""
    return assignments.entries(registry.licenses, registry.frequencies, registry.locations, collapse_blocks(registry.market_blocks))


def frequency_page(registry: Registry, search: SpectrumSearch, limit: int = 50, cursor: str | None = None, generation: str = "", redaction: bool = True, area_states: DataFrame | None = None, county_prefix: str | None = None) -> paging.Page:
    """A page of search_frequencies with an exact total.

    With an index, a search of neither state nor licensee reads no more than the page's range of frequencies, and its
    total the rows of two bins.
    """
    binding, limit = page_binding(search, generation, county_prefix), parameters.clamp(limit, 200)
    asked, index = search.normalised(), registry.spectrum
    if index is None or asked.state is not None or asked.licensee is not None:
        return paging.page(search_frequencies(registry, search, redaction, area_states, county_prefix), ORDER, limit, binding, cursor)
    reference.require_indexed(registry, asked.radio_service)
    start = paging.decode(binding, cursor, len(ORDER))[0] if cursor else None
    if not isinstance(start, int | float | None):
        raise parameters.QueryError("invalid_cursor")
    rows = assignments.found(index, asked, start, assignments.page_end(index, asked, start, limit))
    made = paging.page(redact(rows.withColumn("service_label", C.label(F.col("radio_service_code"), codes.RADIO_SERVICES)), redaction), ORDER, limit, binding, cursor)
    made.counted = lambda: assignments.total(index, asked)
    return made

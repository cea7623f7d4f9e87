"""Radius search over licensed sites, with each site's frequencies."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bands, codes, geo, parameters
from ..functions import columns as C
from . import paging, reference
from .build import Registry
from .redact import redact


#: Radii in km that may be asked for (fixed values).
RADII = (0.1, 230.0)


@dataclass(frozen=True)
class RadiusSearch:
    """A point, a radius in km, and what sites, licences and their frequencies must meet.

    Coordinates are decimal degrees, or text in degrees, minutes and seconds. band: edges in unit, the upper one None
    for a single frequency.
    """

    lat: float | str
    lon: float | str
    radius_km: float = 5.0
    band: tuple[float, float | None] | None = None
    radio_service: str | None = None
    location_type: str | None = None
    location_class: str | None = None
    status: str = "A"
    unit: str = "MHz"

    def normalised(self) -> RadiusSearch:
        """The same search in degrees and MHz, with every value in the form that records use.

        Raises invalid_coordinate, invalid_radius, invalid_frequency_range or invalid_status.
        """
        if not RADII[0] <= self.radius_km <= RADII[1]:
            raise parameters.QueryError("invalid_radius", str(self.radius_km))
        made = {"lat": parameters.degrees(self.lat, "latitude"), "lon": parameters.degrees(self.lon, "longitude"), "status": parameters.live_status(self.status), "unit": "MHz"}
        if self.band is not None:
            made["band"] = parameters.band(*self.band, parameters.unit(self.unit))
        for name in ("radio_service", "location_type", "location_class"):
            if getattr(self, name) is not None:
                made[name] = getattr(self, name).strip().upper()
        return replace(self, **made)


def frequency_rows(frequencies: DataFrame) -> DataFrame:
    """One row for each (usi, location number, frequency, upper edge): widest, strongest, distinct classes and emissions."""
    return frequencies.where("frequency_mhz IS NOT NULL").groupBy("usi", "location_number", "frequency_mhz", "upper_mhz").agg(
        F.max("bandwidth_mhz").alias("bandwidth_mhz"),
        F.max("erp_w").alias("erp_w"),
        F.max("eirp_dbm").alias("eirp_dbm"),
        F.array_sort(F.collect_set("class_station")).alias("class_stations"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("emissions")))).alias("emissions"),
    )


#: Degrees of a cell of sites that are counted: a million cells at most, however many sites there are.
CELL = 0.25


def sites_by_cell(locations: DataFrame, licences: DataFrame, *by: str) -> DataFrame:
    """y, x, license_status and n: how many sites of live licences lie in each cell of a quarter degree."""
    live = licences.where(F.col("license_status").isin(*codes.LIVE_STATUSES)).select("usi", "license_status")
    cells = {c: F.floor(F.col(at) / CELL).cast("int") for c, at in (("y", "lat"), ("x", "lon"))}
    each = locations.where("lat IS NOT NULL AND lon IS NOT NULL").join(live, "usi").withColumns(cells)
    return each.groupBy(*by, "y", "x", "license_status").agg(F.count("*").alias("n"))


def ring(cells: DataFrame, search: RadiusSearch, limit: int, start: float = 0.0) -> float | None:
    """A radius within which more than limit sites lie at a distance of start or more; None where counts can't tell.

    No point of a cell is farther from its centre than its farthest corner, so a cell lies whole between two circles. Cells
    are taken by the outer one, as many as there are rows on a page at most.
    """
    if search.band is not None or any((search.radio_service, search.location_type, search.location_class)):
        return None
    (south, north), sides = geo.box(search.lat, search.lon, search.radius_km)
    near = F.col("y").between(math.floor(south / CELL), math.floor(north / CELL))
    near = near & reduce(lambda a, b: a | b, [F.col("x").between(math.floor(w / CELL), math.floor(e / CELL)) for w, e in sides])
    held = cells.where(near if search.status == "any" else near & (F.col("license_status") == search.status)).groupBy("y", "x").agg(F.sum("n").alias("n"))
    corner, centre = (lambda c, by: (F.col(c) + by) * CELL), lambda c: (F.col(c) + 0.5) * CELL
    reach = F.greatest(*[geo.distance_km(corner("y", i), corner("x", 0), centre("y"), centre("x")) for i in (0, 1)]) * (1 + 1e-9)
    away = geo.distance_km(centre("y"), centre("x"), search.lat, search.lon)
    whole = held.select("n", (away + reach).alias("outer"), (away - reach).alias("inner")).where((F.col("inner") >= start) | F.lit(start <= 0)).where(F.col("outer") <= search.radius_km)
    seen = 0
    for r in whole.orderBy("outer").limit(limit + 1).collect():
        seen += r.n
        if seen > limit:
            return r.outer * (1 + 1e-9)
    return None


def sites_in_radius(registry: Registry, search: RadiusSearch, within: float | None = None) -> DataFrame:
    """Sites within the radius with their licence's head and distance_km (unrounded), before any page.

    The bounding box is plain ranges, which reach the scan; the exact distance is computed for what is left. With a
    band, a site stays if its location number has an overlapping frequency: a semi-join, so nothing is multiplied.
    within: a lesser radius in km, beyond which nothing is needed. Raises what normalised does, and unknown_radio_service or service_not_indexed.
    """
    search = search.normalised()
    reference.require_indexed(registry, search.radio_service)
    radius = search.radius_km if within is None else min(within, search.radius_km)
    where = geo.in_box(F.col("lat"), F.col("lon"), search.lat, search.lon, radius)
    sites = registry.locations.where(where)
    for column, value in (("location_type", search.location_type), ("location_class", search.location_class)):
        if value is not None:
            sites = sites.where(F.col(column) == value)
    sites = sites.withColumn("distance_km", geo.distance_km(F.col("lat"), F.col("lon"), search.lat, search.lon)).where(F.col("distance_km") <= radius)
    if search.band is not None:
        hit = registry.frequencies.where(F.col("frequency_mhz").isNotNull() & bands.overlaps(F.col("occ_low"), F.col("occ_high"), search.band))
        sites = sites.join(hit.select("usi", "location_number"), ["usi", "location_number"], "left_semi")
    heads = registry.licenses.where(F.col("license_status").isin(*codes.LIVE_STATUSES) if search.status == "any" else F.col("license_status") == search.status)
    if search.radio_service is not None:
        heads = heads.where(F.col("radio_service_code") == search.radio_service)
    return sites.join(heads.select("usi", "callsign", "license_status", "radio_service_code", "licensee_name", "is_individual"), "usi")


ORDER = [paging.Key("distance_km"), paging.Key("usi"), paging.Key("location_number"), paging.Key("site_seq")]


def with_frequencies(sites: DataFrame, frequencies: DataFrame, per_site: int = 10, band: tuple[float, float] | None = None) -> DataFrame:
    """Adds frequency_count and frequencies, the first per_site by frequency and upper edge, to one page of sites."""
    rows = frequencies if band is None else frequencies.where(bands.overlaps(F.col("occ_low"), F.col("occ_high"), band))
    rows = frequency_rows(rows.join(F.broadcast(sites.select("usi", "location_number").distinct()), ["usi", "location_number"], "left_semi"))
    listed = rows.groupBy("usi", "location_number").agg(
        F.count("*").alias("frequency_count"),
        F.array_sort(F.collect_list(F.struct("frequency_mhz", F.coalesce("upper_mhz", F.lit(0.0)).alias("upper_key"), "upper_mhz", "bandwidth_mhz", "erp_w", "eirp_dbm", "class_stations", "emissions"))).alias("frequencies"),
    )
    out = sites.join(listed, ["usi", "location_number"], "left").withColumn("frequencies", F.slice("frequencies", 1, per_site))
    return out.withColumn("frequency_count", F.coalesce("frequency_count", F.lit(0)))


def find_transmitters(registry: Registry, search: RadiusSearch, limit: int = 25, per_site: int = 10, cursor: str | None = None, generation: str = "", redaction: bool = True) -> paging.Page:
    """A page of sites by distance; shown distances are rounded to metres, the order is that of unrounded ones.

    With counts of sites by cell, a search without further filters reads the ring that holds the page, whatever radius is
    asked; the total is that of the whole radius.
    """
    search, limit = search.normalised(), parameters.clamp(limit, 100)
    binding = generation, "t", paging.digest(asdict(search))
    start = paging.decode(binding, cursor, len(ORDER))[0] if cursor else 0.0
    if not isinstance(start, int | float):
        raise parameters.QueryError("invalid_cursor")
    within = ring(registry.site_cells, search, limit, start) if registry.site_cells is not None else None
    sites = sites_in_radius(registry, search, within)
    made = paging.page(sites, ORDER, limit, binding, cursor)
    if within is not None:
        made.counted = lambda: sites_in_radius(registry, search).count()
    shown = with_frequencies(made.rows, registry.frequencies, parameters.clamp(per_site, 50), search.band).orderBy(*[k.order() for k in ORDER])
    made.rows = redact(shown.withColumns({"distance_km": F.round("distance_km", 3), "asr_number": C.asr_number(F.col("asr_number")) if "asr_number" in sites.columns else F.lit(None).cast("string"), "service_label": C.label(F.col("radio_service_code"), codes.RADIO_SERVICES)}), redaction)
    return made

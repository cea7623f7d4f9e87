"""From decoded records to the registry: first rows, joined licences, derived bands, site numbers and states."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bands
from ..functions import columns as C
from ..functions.codes import LIVE_STATUSES
from .areas import StateCells
from .assignments import SpectrumIndex
from .textsearch import NameIndex


@dataclass
class Registry:
    """The seven tables that queries read, and where there are some, indexes of names and assignments and counts of sites by cell."""

    licenses: DataFrame
    lease_links: DataFrame
    locations: DataFrame
    antennas: DataFrame
    frequencies: DataFrame
    market_blocks: DataFrame
    paths: DataFrame
    names: NameIndex | None = None
    spectrum: SpectrumIndex | None = None
    site_cells: DataFrame | None = None

    @classmethod
    def tables(cls) -> list[str]:
        """The names of the seven tables."""
        return [f for f in cls.__dataclass_fields__ if f not in ("names", "spectrum", "site_cells")]


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in filing order, by a grouped minimum: a key that repeats is no hot task."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("__row")).select("__row.*")


def heads(hd: DataFrame) -> DataFrame:
    """The first HD row of each usi that has a status and a service."""
    return first_rows(hd.where("license_status IS NOT NULL AND radio_service_code IS NOT NULL"), ["usi"], ["_seq"])


def join_licences(hd: DataFrame, en: DataFrame, am: DataFrame, mk: DataFrame, service_group: Column | None = None) -> DataFrame:
    """Licences: first HD row of each usi with status and service, with its licensee, amateur and market records.

    Their service group is that of the HD row, which decode keeps of read_bulk's lines, unless another is given.
    """
    head = heads(hd)
    who = first_rows(en.where("entity_type = 'L'"), ["usi"], ["_seq"]).select("usi", F.col("entity_name").alias("licensee_name"), F.col("city").alias("licensee_city"), F.col("state").alias("licensee_state"), "frn", "applicant_type", "has_name_parts")
    amateur = first_rows(am, ["usi"], ["_seq"]).drop("_seq")
    market = first_rows(mk, ["usi"], ["_seq"]).drop("_seq")
    joined = head.join(who, "usi", "left").join(amateur, "usi", "left").join(market, "usi", "left")
    return joined.withColumns(
        {
            "market_states": C.market_states(F.col("market_name")),
            "service_group": service_group if service_group is not None else F.col("service_group") if "service_group" in hd.columns else F.lit(None).cast("string"),
            "is_individual": C.is_individual(F.col("applicant_type"), F.col("radio_service_code"), F.col("has_name_parts"), F.col("licensee_name")),
            "is_lease": C.is_lease(F.col("callsign")),
        }
    ).drop("has_name_parts")


def live_only(technical: DataFrame, licences: DataFrame) -> DataFrame:
    """Technical rows of live licences only."""
    return technical.join(licences.where(F.col("license_status").isin(*LIVE_STATUSES)).select("usi"), "usi", "left_semi")


def with_site_numbers(locations: DataFrame) -> DataFrame:
    """Adds site_seq: the place of a site among those filed under one location number of a licence."""
    return locations.withColumn("site_seq", F.row_number().over(Window.partitionBy("usi", "location_number").orderBy("_seq")).cast("int"))


def with_emissions(fr: DataFrame, em: DataFrame) -> DataFrame:
    """FR rows with their emissions (sorted, distinct), plausible bandwidth, occupied band and band class.

    Emissions join on all four keys. They are grouped by the FR row, as plausibility depends on its frequency; equal
    emissions of a key are counted once before the join, so a repeated key does not multiply rows.
    """
    keys = ["usi", "location_number", "antenna_number", "freq_seq_id"]
    codes = em.select(*keys, "emission_code").distinct().withColumn("mhz", C.emission_mhz(F.col("emission_code")))
    filed = codes.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("emission_code", "mhz"))).alias("__em"))
    joined = fr.join(filed, keys, "left")
    frequency = F.col("frequency_mhz")
    widest = F.array_max(F.transform(F.filter("__em", lambda e: e["mhz"] < F.lit(bands.MAX_SHARE) * frequency), lambda e: e["mhz"]))
    joined = joined.withColumn("emissions", F.transform("__em", lambda e: e["emission_code"])).withColumn("bandwidth_mhz", widest).drop("__em")
    return with_band(joined)


def with_band(frequencies: DataFrame) -> DataFrame:
    """Adds occ_low, occ_high and band_class to rows with frequency_mhz, upper_mhz and bandwidth_mhz."""
    low, high = bands.occupied(F.col("frequency_mhz"), F.col("upper_mhz"), F.col("bandwidth_mhz"))
    return frequencies.withColumns({"occ_low": low, "occ_high": high}).withColumn("band_class", bands.band_class(F.col("occ_low"), F.col("occ_high")))


def orphan_emissions(em: DataFrame, fr: DataFrame) -> DataFrame:
    """Emissions whose keys no frequency row has."""
    return em.join(fr, ["usi", "location_number", "antenna_number", "freq_seq_id"], "left_anti")


def with_site_state(locations: DataFrame, state_at: Column | StateCells) -> DataFrame:
    """Adds site_state (as filed in upper case, else that of its coordinates) and state_derived.

    state_at: an expression of lat and lon, or an index of cells, in which sites that file a state aren't looked up.
    """
    filed = F.upper("state")
    if isinstance(state_at, StateCells):
        found = state_at.locate(locations, "__at", where=filed.isNull())
        return found.withColumns({"site_state": F.coalesce(filed, "__at"), "state_derived": filed.isNull() & F.col("__at").isNotNull()}).drop("__at")
    return locations.withColumns({"site_state": F.coalesce(filed, state_at), "state_derived": filed.isNull() & state_at.isNotNull()})


def market_block_rows(mf: DataFrame) -> DataFrame:
    """Market blocks: a blank partition is 0; class of the block's width."""
    own = mf.withColumn("partition_area_id", F.coalesce("partition_area_id", F.lit(0)))
    return own.withColumn("band_class", F.when(F.col("lower") > 0, bands.band_class(F.col("lower"), F.coalesce("upper", "lower"))))


def build(records: dict[str, DataFrame], state_at: Column | StateCells | None = None) -> Registry:
    """A registry of decoded records by type (all eleven types)."""
    licences = join_licences(records["HD"], records["EN"], records["AM"], records["MK"])
    head = heads(records["HD"]).select("usi", "license_status")  # technical rows need no more of a licence
    live = {t: live_only(records[t], head) for t in ("LO", "AN", "FR", "EM", "MF", "PA")}
    return Registry(
        licences,
        records["LL"].join(head.select(F.col("usi").alias("lease_usi")), "lease_usi", "left_semi"),
        with_site_state(with_site_numbers(live["LO"]), F.lit(None).cast("string") if state_at is None else state_at),
        live["AN"],
        with_emissions(live["FR"], live["EM"]),
        market_block_rows(live["MF"]),
        live["PA"],
    )

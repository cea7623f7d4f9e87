"""Licence search and callsign resolution."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes, parameters
from ..functions import columns as C
from . import paging, reference, textsearch
from .build import Registry
from .redact import redact


@dataclass(frozen=True)
class LicenceSearch:
    """Criteria of a licence search; unset ones don't count, and at least one must be set besides the status."""

    callsign: str | None = None
    licensee: str | None = None
    frn: str | None = None
    market_code: str | None = None
    radio_service: str | None = None
    status: str = "A"
    state: str | None = None
    expires_after: str | None = None
    expires_before: str | None = None
    granted_after: str | None = None
    granted_before: str | None = None

    def normalised(self) -> LicenceSearch:
        """The same search with every value in the form that records use; raises no_criteria or invalid_date_range."""
        made = {k: v for k, v in asdict(self).items() if v is not None}
        for name, f in (("callsign", parameters.callsign), ("frn", parameters.frn), ("market_code", parameters.market_code), ("state", parameters.state), ("status", parameters.status), ("radio_service", lambda c: c.strip().upper()), ("licensee", parameters.folded_name)):
            if name in made:
                made[name] = f(made[name])
        if not made.keys() - {"status"}:
            raise parameters.QueryError("no_criteria")
        for a, b in (("expires_after", "expires_before"), ("granted_after", "granted_before")):
            if made.get(a) and made.get(b) and made[a] > made[b]:
                raise parameters.QueryError("invalid_date_range")
        return LicenceSearch(**made)


def equality_filters(search, columns: dict[str, str]) -> list[Column]:
    """Equalities of the criteria that are set, by name of criterion and column."""
    return [F.col(column) == F.lit(getattr(search, name)) for name, column in columns.items() if getattr(search, name) is not None]


def matching(registry: Registry, search: LicenceSearch, redaction: bool = True) -> DataFrame:
    """Licences that meet every criterion; with a name search, score too. Individuals' names aren't searched."""
    found = registry.licenses
    filters = equality_filters(search, {"callsign": "callsign", "frn": "frn", "market_code": "market_code", "radio_service": "radio_service_code", "state": "licensee_state"})
    if search.status != "any":
        filters.append(F.col("license_status") == search.status)
    for value, column, low in ((search.expires_after, "expired_date", True), (search.expires_before, "expired_date", False), (search.granted_after, "grant_date", True), (search.granted_before, "grant_date", False)):
        if value is not None:
            filters.append(F.col(column) >= value if low else F.col(column) <= value)
    for f in filters:
        found = found.where(f)
    if search.licensee is not None:
        phrases = parameters.name_phrases(search.licensee)
        if not phrases:
            return found.where(F.lit(False)).withColumn("score", F.lit(0.0))
        if redaction:
            found = found.where(~F.col("is_individual"))
        ranked = textsearch.rank(registry.licenses, "usi", "licensee_name", phrases) if registry.names is None else textsearch.rank_by_index(registry.names, "usi", phrases)
        found = found.join(ranked, "usi")
    return found


def summaries(registry: Registry, licences: DataFrame, redaction: bool = True) -> DataFrame:
    """Licences with labels, counts of sites and of rows with a frequency, and personal data withheld."""
    wanted = licences.select("usi")
    sites = registry.locations.join(wanted, "usi", "left_semi").groupBy("usi").agg(F.count("*").alias("site_count"))
    rows = registry.frequencies.where("frequency_mhz IS NOT NULL").join(wanted, "usi", "left_semi").groupBy("usi").agg(F.count("*").alias("frequency_count"))
    shown = licences.join(sites, "usi", "left").join(rows, "usi", "left").fillna(0, ["site_count", "frequency_count"])
    labelled = shown.withColumns(
        {
            "status_label": C.label(F.col("license_status"), codes.LICENSE_STATUSES),
            "service_label": C.label(F.col("radio_service_code"), codes.RADIO_SERVICES),
            "applicant_label": C.label(F.col("applicant_type"), codes.APPLICANT_TYPES, keep_unknown=False),
        }
    )
    return redact(labelled, redaction)


CALLSIGN_ORDER = [paging.Key("callsign"), paging.Key("usi")]
RANK_ORDER = [paging.Key("score"), paging.Key("usi")]


def search_licences(registry: Registry, search: LicenceSearch, limit: int = 25, cursor: str | None = None, generation: str = "", redaction: bool = True, refreshed: str = "") -> paging.Page:
    """A page of licence summaries by callsign (blank ones first), or by rank with a name search.

    generation names the build and refreshed the state of its refreshes (generations.cursor_names). Ranks depend on all
    names, so a refresh ends cursors by rank, while those by callsign go on. Raises what normalised does, and
    unknown_radio_service or service_not_indexed.
    """
    own = search.normalised()
    reference.require_indexed(registry, own.radio_service)
    ranked = own.licensee is not None
    found = matching(registry, own, redaction)
    keys = RANK_ORDER if ranked else CALLSIGN_ORDER
    made = paging.page(found, keys, parameters.clamp(limit, 100), (f"{generation}+{refreshed}" if ranked else generation, "r" if ranked else "c", paging.digest(asdict(own))), cursor)
    made.rows = summaries(registry, made.rows, redaction).orderBy(*[k.order() for k in keys])
    return made


def resolve_callsigns(licences: DataFrame) -> DataFrame:
    """Licences with callsign_rank: 1 is the record that a callsign stands for, others are its older records.

    Active ones first, then by the latest of last action, effective or grant date as filed, then by usi.
    """
    latest = F.coalesce("last_action_date", "effective_date", "grant_date", F.lit(""))
    order = Window.partitionBy("callsign").orderBy(F.desc(F.coalesce(F.col("license_status") == "A", F.lit(False))), F.desc(latest), F.desc("usi"))
    return licences.where("callsign IS NOT NULL").withColumn("callsign_rank", F.row_number().over(order))


def prefix_candidates(licences: DataFrame, prefix: str, limit: int = 5) -> DataFrame:
    """The first licences whose callsign begins with a prefix: what a missing callsign may have meant."""
    return licences.where(F.col("callsign").startswith(prefix)).orderBy("callsign", "usi").limit(limit).select("callsign", "usi", "license_status", "radio_service_code")

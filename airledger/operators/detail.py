"""A licence's detail: whole-location windows, sites, antennas, frequencies, paths, leases and market blocks.

Every function works for many licences at once: `targets` (usi, and first location and caps where they differ) is what a
request is about, and a batch is planned like a single one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes, parameters
from ..functions import columns as C
from ..sources import scratch
from .build import Registry
from .licences import prefix_candidates, resolve_callsigns
from .redact import redact
from .spectrum import block_edges, collapse_blocks

#: What a window may list: sites, antennas and paths (fixed values).
SITES, ANTENNAS, PATHS = 50, 100, 100


def location_summary(registry: Registry, parts: int | None = None) -> DataFrame:
    """(usi, location_number): sites, antennas, frequency rows and paths of each number that any of the tables has.

    Antennas are the distinct numbers in antenna, frequency and path rows, plus each unnumbered antenna row. Narrow rows of
    all tables meet in one shuffle by licence, by which windows and counts over a licence's numbers are dealt too: what a
    task holds are the groups of its own licences. parts is into how many tasks licences are dealt, as many as shuffles have
    by default; they aren't merged by bytes, as groups in memory are twenty times as large as their rows in a shuffle. With
    no parts (0) rows are dealt by licence as they come.
    """
    if parts is None:
        parts = int(registry.locations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = ("sites", "unnumbered", "frequencies", "paths")

    def narrow(df: DataFrame, what: str, antenna: Column) -> DataFrame:
        made = {"sites": F.lit(what == "sites"), "unnumbered": antenna.isNull() & (what == "antennas"), "frequencies": F.lit(what == "frequencies"), "paths": F.lit(what == "paths")}
        return df.select("usi", F.col("location_number").cast("long").alias("location_number"), antenna.cast("long").alias("antenna"), *[made[c].cast("int").alias(c) for c in counts])

    every = narrow(registry.locations, "sites", F.lit(None))
    for what in ("antennas", "frequencies", "paths"):
        every = every.unionByName(narrow(getattr(registry, what), what, F.col("antenna_number")))
    keys = ["usi", "location_number"]
    each = (every.repartition(parts, "usi") if parts else every).groupBy(*keys, "antenna").agg(*[F.sum(c).alias(c) for c in counts])
    return each.groupBy(*keys).agg(F.sum("sites").alias("sites"), (F.count("antenna") + F.sum("unnumbered")).alias("antennas"), F.sum("frequencies").alias("frequencies"), F.sum("paths").alias("paths"))


def _placed(summary: DataFrame, offset: int, max_frequencies: int, budgets: tuple[int, int, int]) -> DataFrame:
    """summary from an offset on with position, listed, cut, and __before, the frequency rows of listed numbers before."""
    by = Window.partitionBy("usi").orderBy("location_number")
    run = by.rowsBetween(Window.unboundedPreceding, 0)
    placed = summary.withColumn("position", F.row_number().over(by) - 1).where(F.col("position") >= offset)
    sums = placed.withColumns({f"__{c}": F.sum(c).over(run) for c in ("sites", "antennas", "paths", "frequencies")})
    fits = (F.col("__sites") <= budgets[0]) & (F.col("__antennas") <= budgets[1]) & (F.col("__paths") <= budgets[2])
    before = F.col("__frequencies") - F.col("frequencies")
    cut = (F.col("__frequencies") > max_frequencies) & (before <= max_frequencies)
    return sums.withColumns({"listed": fits | (F.col("position") == offset), "cut": cut, "__before": before}).drop("__sites", "__antennas", "__paths", "__frequencies")


def location_windows(summary: DataFrame, offset: int = 0, max_frequencies: int = 100, budgets: tuple[int, int, int] = (SITES, ANTENNAS, PATHS)) -> DataFrame:
    """The locations that a page lists: from an offset, as many whole ones as keep sites, antennas and paths in budget.

    The first is always listed. position counts from 0 over all of a licence's numbers; cut marks the first location of
    which not every frequency row can be listed. A licence's numbers are what is ordered, some thousands at most.
    """
    return _placed(summary, offset, max_frequencies, budgets).where("listed").drop("listed", "__before")


def first_pages(summary: DataFrame, max_frequencies: int = 100) -> DataFrame:
    """usi, what location_windows lists of it at offset 0 as a range first to last, and counts: a row for each licence.

    Running sums never fall, so what is listed is a range of numbers, and so is what has a frequency row listed: first to
    last_frequency. location_count is of all numbers, __listed of those listed.
    """
    at, listed = F.col("location_number"), F.col("listed")
    ends = [F.min(F.when(listed, at)).alias("first"), F.max(F.when(listed, at)).alias("last"), F.max(F.when(listed & (F.col("__before") < max_frequencies), at)).alias("last_frequency")]
    counts = [F.count("*").alias("location_count"), F.count_if("listed").alias("__listed"), F.max(F.when(listed, F.col("cut"))).alias("__cut")]
    return _placed(summary, 0, max_frequencies, (SITES, ANTENNAS, PATHS)).groupBy("usi").agg(*ends, *counts)


def offset_of(summary: DataFrame, location_number: int) -> DataFrame:
    """usi and the offset at which a window begins with a location number."""
    return summary.groupBy("usi").agg(F.count_if(F.col("location_number") < location_number).alias("offset"))


def sites(registry: Registry, window: DataFrame, redaction: bool = True) -> DataFrame:
    """Sites of listed locations, with labels, a valid ASR number only, and personal data withheld."""
    rows = registry.locations.join(window.select("usi", "location_number"), ["usi", "location_number"], "left_semi")
    return _shown_sites(rows.join(registry.licenses.select("usi", "is_individual"), "usi"), redaction)


def _shown_sites(rows: DataFrame, redaction: bool) -> DataFrame:
    shown = {"location_type_label": C.label(F.col("location_type"), codes.LOCATION_TYPES, False), "location_class_label": C.label(F.col("location_class"), codes.LOCATION_CLASSES, False)}
    if "asr_number" in rows.columns:
        shown["asr_number"] = C.asr_number(F.col("asr_number"))
    return redact(rows.withColumns(shown), redaction).drop("is_individual")


def agreed(antennas: DataFrame, fields: list[str]) -> DataFrame:
    """Numbered antennas as one row for each number: a field is shown only if every record agrees, null included.

    record_count is given where more than one record was filed. Unnumbered records each stay a row.
    """
    keys = ["usi", "location_number", "antenna_number"]

    def agree(c: str) -> Column:
        return F.when((F.min(c) == F.max(c)) & (F.count(c) == F.count("*")), F.max(c)).alias(c)

    numbered = antennas.where("antenna_number IS NOT NULL").groupBy(*keys).agg(*[agree(c) for c in fields], F.when(F.count("*") > 1, F.count("*")).alias("record_count"))
    alone = antennas.where("antenna_number IS NULL").select(*keys, *fields, F.lit(None).cast("long").alias("record_count"))
    return numbered.unionByName(alone)


def frequencies_capped(registry: Registry, window: DataFrame, max_frequencies: int = 100) -> DataFrame:
    """The first max_frequencies rows of each licence's window by location, antenna and sequence number.

    Locations beyond the one that is cut can't have any, so they leave before the rows are numbered.
    """
    by = Window.partitionBy("usi").orderBy("location_number").rowsBetween(Window.unboundedPreceding, -1)
    before = window.withColumn("__before", F.coalesce(F.sum("frequencies").over(by), F.lit(0))).where(F.col("__before") < max_frequencies)
    return _first_frequencies(registry.frequencies.join(before.select("usi", "location_number"), ["usi", "location_number"], "left_semi"), max_frequencies)


def _first_frequencies(rows: DataFrame, max_frequencies: int) -> DataFrame:
    order = Window.partitionBy("usi").orderBy("location_number", "antenna_number", "freq_seq_id", "_seq")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max_frequencies)


def paths(registry: Registry, window: DataFrame | None = None) -> DataFrame:
    """Paths with their receive end: how many own sites have the number, its coordinates if one, and its antenna.

    receive_sites is null unless it differs from 1; receive_antenna_filed is false if the licence files no antenna of
    that number there. Ends meet paths in groups within a licence, not in joins: rows are dealt once, and not at all
    where they lie by licence.
    """
    rows = registry.paths if window is None else registry.paths.join(window.select("usi", "location_number"), ["usi", "location_number"], "left_semi")
    to = ["usi", "receive_location_number", "receive_antenna_number"]
    number, antenna = (F.col(c).try_cast(rows.schema[k].dataType).alias(k) for c, k in zip(("location_number", "antenna_number"), to[1:], strict=True))
    ends = registry.locations.where("usi IS NOT NULL AND location_number IS NOT NULL").groupBy("usi", number).agg(F.count("*").alias("__n"), F.max("lat").alias("__lat"), F.max("lon").alias("__lon"))
    filed = registry.antennas.where("usi IS NOT NULL AND location_number IS NOT NULL AND antenna_number IS NOT NULL").select("usi", number, antenna, F.lit(True).alias("__filed")).distinct()
    met = rows.select(*to, *[c for c in rows.columns if c not in to], F.lit(True).alias("__path"))
    for df in (ends, filed):
        met = met.unionByName(df, allowMissingColumns=True)
    met = met.withColumn("__filed", F.max("__filed").over(Window.partitionBy(*to)))  # the narrower first: one sort is for both
    joined = met.withColumns({c: F.max(c).over(Window.partitionBy(*to[:2])) for c in ("__n", "__lat", "__lon")}).where("__path")
    one = (F.col("__n") == 1) & F.col("__lat").isNotNull() & F.col("__lon").isNotNull()
    n = F.coalesce("__n", F.lit(0))
    return joined.withColumns(
        {
            "receive_lat": F.when(one, F.col("__lat")),
            "receive_lon": F.when(one, F.col("__lon")),
            "receive_sites": F.when(n != 1, n),
            "receive_antenna_filed": F.when(F.col("receive_antenna_number").isNotNull() & F.col("__filed").isNull(), F.lit(False)),
        }
    ).drop("__path", "__n", "__lat", "__lon", "__filed")


def leases_held(registry: Registry, redaction: bool = True) -> DataFrame:
    """Leases with their parent licence; a parent that isn't in the registry leaves its fields empty, not redacted.

    parent_callsign is the one that was filed with the lease, or else the parent's own.
    """
    parent = registry.licenses.select(F.col("usi").alias("parent_usi"), F.col("callsign").alias("__callsign"), F.col("licensee_name").alias("parent_name"), F.col("license_status").alias("parent_status"), F.col("is_individual").alias("__person"))
    joined = registry.lease_links.join(parent, "parent_usi", "left")
    hidden = F.col("__person") if redaction else F.lit(False)
    filed = F.col("parent_callsign") if "parent_callsign" in registry.lease_links.columns else F.lit(None).cast("string")
    joined = joined.withColumn("parent_callsign", F.coalesce(filed, "__callsign")).drop("__callsign")
    return joined.withColumns({"parent_redacted": F.when(F.col("__person").isNotNull(), hidden), "parent_name": F.when(~hidden, F.col("parent_name"))}).drop("__person")


def leases_granted(registry: Registry, offset: int = 0, limit: int = 100, redaction: bool = True) -> DataFrame:
    """Each parent's leases from an offset, in order of lease callsign and usi, with the lessee's head."""
    lease = registry.licenses.select(F.col("usi").alias("lease_usi"), F.col("callsign").alias("lease_callsign"), "licensee_name", F.col("license_status").alias("lease_status"), "is_individual")
    joined = registry.lease_links.join(lease, "lease_usi")
    order = Window.partitionBy("parent_usi").orderBy(F.asc_nulls_first("lease_callsign"), "lease_usi", "lease_id")
    placed = joined.withColumn("place", F.row_number().over(order)).where((F.col("place") > offset) & (F.col("place") <= offset + limit))
    return redact(placed, redaction).drop("is_individual")


def market_blocks(registry: Registry) -> DataFrame:
    """Collapsed market blocks with their edges, or their channel width."""
    return block_edges(collapse_blocks(registry.market_blocks))


def lease_counts(registry: Registry) -> DataFrame:
    """usi and lease_count, the leases that each licence has granted."""
    return registry.lease_links.groupBy(F.col("parent_usi").alias("usi")).agg(F.count("*").alias("lease_count"))


#: Says in a document that it is not all (fixed wording of this engine).
NOTICE = "First page only: ask for the detail with a location or lease offset for the rest."


def documents(registry: Registry, targets: DataFrame, redaction: bool = True, dealt: bool = False) -> DataFrame:
    """usi and document, the first page of each target's detail as one nested JSON text without null fields.

    It has the head with its labels, and lists of sites, antennas, frequencies, paths, market blocks, leases held and
    leases granted; location_count and lease_count say how many there are in all, and notice that some are not listed.
    What each licence's page lists is written once as ranges of numbers; rows of all parts, as structs, then meet in one
    grouping by licence, so a list is made once and joined with nothing. dealt: technical rows and licences lie in buckets
    of the licence, as many as shuffles have parts. Then joins by hash with a bucket's licences and groups by licence take
    them as they lie, and of rows that are listed none is shuffled; it is for many licences, as a few are broadcast.
    """
    here = lambda df: df.hint("shuffle_hash") if dealt else df
    only = lambda df, key="usi": df.join(here(targets.select(F.col("usi").alias(key))), key, "left_semi")
    own = Registry(*[only(getattr(registry, t)) if "usi" in getattr(registry, t).columns else getattr(registry, t) for t in Registry.tables()])
    made = here(own.licenses.select("usi", "is_individual").distinct()).join(first_pages(location_summary(own, 0 if dealt else None)), "usi")
    pages = scratch.dealt(made, "usi", "pages")
    at = F.col("location_number")

    def listed(df: DataFrame, last: str, *more: str) -> DataFrame:
        """Rows of the listed locations, with further columns of their licence."""
        ranges = pages.select("usi", *more, F.col("first").alias("__first"), F.col(last).alias("__last"))
        return df.join(here(ranges), "usi").where(at.between(F.col("__first"), F.col("__last"))).drop("__first", "__last")

    def rows(df: DataFrame, name: str, *order: str) -> DataFrame:
        # A union keeps how its sides are dealt where all deal by the column of its own; a key of another name is one.
        return df.select(F.col("usi").alias("__usi"), F.struct(*order, *[c for c in df.columns if c not in ("usi", *order)]).alias(name))

    fields = [c for c in own.antennas.columns if c not in ("usi", "location_number", "antenna_number", "_seq")]
    links = registry.lease_links
    held = Registry(here(registry.licenses), only(links, "lease_usi"), *[None] * 5)
    granted = Registry(here(registry.licenses), only(links, "parent_usi"), *[None] * 5)
    ends = Registry(None, None, own.locations, own.antennas, None, None, listed(registry.paths, "last"))
    labels = {"status_label": C.label(F.col("license_status"), codes.LICENSE_STATUSES), "service_label": C.label(F.col("radio_service_code"), codes.RADIO_SERVICES)}
    head = redact(own.licenses.withColumns(labels), redaction)
    parts = [
        rows(head, "head"),
        rows(pages.select("usi", "location_count", "__listed", "__cut"), "page"),
        rows(lease_counts(granted), "granted"),
        rows(agreed(listed(registry.antennas, "last"), fields), "antennas", "location_number", "antenna_number"),
        rows(leases_held(held, redaction).withColumnRenamed("lease_usi", "usi"), "leases_held", "parent_usi"),
        rows(leases_granted(granted, redaction=redaction).withColumnRenamed("parent_usi", "usi"), "leases_granted", "place"),
        rows(_shown_sites(listed(registry.locations, "last", "is_individual"), redaction).drop("_seq"), "sites", "location_number", "site_seq"),
        rows(_first_frequencies(listed(registry.frequencies, "last_frequency"), 100).drop("_seq", "place"), "frequencies", "location_number", "antenna_number", "freq_seq_id"),
        rows(paths(ends).drop("_seq"), "paths", "location_number", "path_number"),
        rows(market_blocks(own), "market_blocks", "lower", "upper"),
    ]
    if dealt:  # leases, which are few, meet the others where those lie
        few = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = [p.repartition(few, "__usi") if p.columns[1] in ("granted", "leases_held", "leases_granted") else p for p in parts]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    every = every if dealt else every.repartition("__usi")
    lists = ["antennas", "leases_held", "leases_granted", "sites", "frequencies", "paths", "market_blocks"]
    whole = every.groupBy(F.col("__usi").alias("usi")).agg(F.collect_list("head").alias("head"), *[F.max(c).alias(c) for c in ("page", "granted")], *[F.array_sort(F.collect_list(c)).alias(c) for c in lists])
    whole = whole.select("usi", F.explode("head").alias("head"), "page.*", "granted.*", *[F.when(F.size(c) > 0, F.col(c)).alias(c) for c in lists])
    more = (F.col("location_count") > F.col("__listed")) | F.col("__cut") | (F.col("lease_count") > F.size("leases_granted"))
    fields = ["usi", *[f"head.{c}" for c in head.columns if c != "usi"], "location_count", "lease_count", *lists]
    return whole.select("usi", F.to_json(F.struct(*fields, F.when(more, F.lit(NOTICE)).alias("notice")), {"ignoreNullFields": "true"}).alias("document"))


def get_licence(registry: Registry, callsign: str | None = None, usi: int | None = None, location_offset: int | None = None, location_number: int | None = None, max_frequencies: int = 100, redaction: bool = True, lease_offset: int = 0) -> dict[str, DataFrame]:
    """Parts of one licence's detail by name, each lazy; a miss has only `candidates`.

    `leases_granted` begins at lease_offset, `lease_count` says how many there are; amateur and market fields are those
    of the head.

    Exactly one of callsign and usi is asked by, and at most one of the two starts of the window is given; otherwise
    identifier_required or location_start_conflict is raised. A callsign stands for its first-ranked record; others of
    the same callsign are `other_records`. Technical parts are there for live licences only, as the registry holds no others.
    """
    if (callsign is None) == (usi is None):
        raise parameters.QueryError("identifier_required")
    if location_offset is not None and location_number is not None:
        raise parameters.QueryError("location_start_conflict")
    if callsign is not None:
        ranked = resolve_callsigns(registry.licenses.where(F.col("callsign") == parameters.callsign(callsign)))
        head, others = ranked.where("callsign_rank = 1").drop("callsign_rank"), ranked.where("callsign_rank > 1")
    else:
        head, others = registry.licenses.where(F.col("usi") == usi), registry.licenses.limit(0)
    found = head.select("usi").first()
    if found is None:
        return {"candidates": prefix_candidates(registry.licenses, parameters.callsign(callsign or "")[:3] or "?")}
    key = F.col("usi") == found["usi"]
    own = Registry(
        *[getattr(registry, t).where(key) if t in ("locations", "antennas", "frequencies", "market_blocks", "paths") else getattr(registry, t) for t in Registry.tables()]
    )
    summary = location_summary(own, 1)
    if location_number is not None:
        start = offset_of(summary, location_number).first()
        location_offset = start["offset"] if start else 0
    most = parameters.clamp(max_frequencies, 1000)
    window = location_windows(summary, location_offset or 0, most)
    return {
        "licence": redact(head.withColumn("status_label", C.label(F.col("license_status"), codes.LICENSE_STATUSES)), redaction),
        "other_records": others.select("usi", "license_status", "radio_service_code"),
        "locations": window,
        "sites": sites(own, window, redaction),
        "antennas": agreed(own.antennas.join(window.select("usi", "location_number"), ["usi", "location_number"], "left_semi"), [c for c in own.antennas.columns if c not in ("usi", "location_number", "antenna_number", "_seq")]),
        "frequencies": frequencies_capped(own, window, most),
        "paths": paths(own, window),
        "market_blocks": market_blocks(own),
        "leases_held": leases_held(Registry(registry.licenses, registry.lease_links.where(F.col("lease_usi") == found["usi"]), *[None] * 5), redaction),
        "leases_granted": leases_granted(Registry(registry.licenses, registry.lease_links.where(F.col("parent_usi") == found["usi"]), *[None] * 5), lease_offset, redaction=redaction),
        "lease_count": lease_counts(registry).where(key),
    }


def licence_document(registry: Registry, callsign: str, redaction: bool = True) -> DataFrame:
    """The nested JSON document of the record that a callsign stands for; raises license_not_found."""
    ranked = resolve_callsigns(registry.licenses.where(F.col("callsign") == parameters.callsign(callsign))).where("callsign_rank = 1")
    if ranked.first() is None:
        raise parameters.QueryError("license_not_found", callsign)
    return documents(registry, ranked.select("usi"), redaction)

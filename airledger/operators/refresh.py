"""Daily refresh: what is pending, whether the feed is complete, and replacement of records by key."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import LIVE_STATUSES
from ..functions.parameters import QueryError, eastern_date
from .build import Registry, first_rows


@dataclass(frozen=True)
class Daily:
    """A daily file: code, day it covers, when it was last modified, and its group (None if the code has none)."""

    path: str
    code: str
    day: dt.date
    modified: dt.datetime
    group: str | None


def pending(files: list[Daily], held_groups: set[str], checkpoint: dt.datetime, applied: dict[str, dt.datetime]) -> list[Daily]:
    """Files to apply, oldest first: of held groups, newer than the checkpoint, not applied at the same time stamp."""
    new = [f for f in files if f.group in held_groups and f.modified > checkpoint and applied.get(f.path) != f.modified]
    return sorted(new, key=lambda f: (f.modified, f.path))


def check_complete(files: list[Daily], known_codes: set[str], checkpoint: dt.datetime, window_days: int = 7) -> None:
    """Raises stale_checkpoint unless the files cover every Eastern day after the checkpoint.

    The newest day of each code less the window must come before the checkpoint's day, known codes need each day up to
    their newest, and other codes each day from the first one seen.
    """
    since = eastern_date(checkpoint)
    by: dict[str, set[dt.date]] = {}
    for f in files:
        by.setdefault(f.code, set()).add(f.day)
    for code, days in by.items():
        newest = max(days)
        if newest - dt.timedelta(days=window_days) >= since:
            raise QueryError("stale_checkpoint", code)
        first = since + dt.timedelta(days=1) if code in known_codes else max(since + dt.timedelta(days=1), min(days))
        if any(first + dt.timedelta(days=i) not in days for i in range((newest - first).days + 1)):
            raise QueryError("stale_checkpoint", code)


def refresh_or_rebuild(refresh, rebuild) -> str:
    """Refreshes; if the feed no longer reaches back to the checkpoint, rebuilds and refreshes once more.

    rebuild returns False if it was not possible, in which case the first failure is raised. Returns what was done.
    """
    try:
        refresh()
    except QueryError as e:
        if e.reason != "stale_checkpoint" or not rebuild():
            raise
        refresh()
        return "rebuilt"
    return "refreshed"


def coverage_gaps(covered: DataFrame, key: str, day: str) -> DataFrame:
    """key and missing day: days without rows between each key's first and last, as a frame for many keys."""
    spans = covered.groupBy(key).agg(F.min(day).alias("__a"), F.max(day).alias("__b"))
    every = spans.select(key, F.explode(F.sequence("__a", "__b", F.expr("interval 1 day"))).alias(day))
    return every.join(covered.select(key, day), [key, day], "left_anti")


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str], touched: DataFrame | None = None) -> DataFrame:
    """old without the rows of touched keys (those of new by default), with the rows of new."""
    gone = (new if touched is None else touched).select(*keys).distinct()
    return old.join(gone, keys, "left_anti").unionByName(new.select(*old.columns))


def latest_by_key(feed: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by a grouped maximum."""
    row = F.struct(*[F.col(c) for c in feed.columns])
    return feed.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("__row")).select("__row.*")


def applicable(daily_heads: DataFrame, licences: DataFrame, service_groups: DataFrame) -> DataFrame:
    """Daily heads to apply with their group: of a licence that is held, or of a service that some group has."""
    held = licences.select("usi", F.col("service_group").alias("__held"), F.lit(True).alias("__known"))
    services = service_groups.select(F.col("code").alias("radio_service_code"), F.col("service_group").alias("__service"))
    joined = daily_heads.join(held, "usi", "left").join(services, "radio_service_code", "left")
    kept = joined.where(F.col("__known").isNotNull() | F.col("__service").isNotNull())
    return kept.withColumn("service_group", F.coalesce("__held", "__service")).drop("__held", "__service", "__known")


def head_moves(heads: DataFrame) -> DataFrame:
    """usi, place and radio_service_code of the first head with a status and a service that each file (place) has of a usi."""
    usable = heads.where("license_status IS NOT NULL AND radio_service_code IS NOT NULL")
    return first_rows(usable.select("usi", "place", "_seq", "radio_service_code"), ["usi", "place"], ["_seq"]).drop("_seq")


def applied_last(moves: DataFrame, services: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """(usi, place of the last file that applies to it, service_group), and the services known afterwards.

    moves: usi, place, radio_service_code, and for licences that are held already is_held and held, their group. Files
    apply in the order of their places, each to licences that are held by then and to those of services known by then; a
    head that applies makes its service known, with its licence's group, to the files after it, and a service keeps the
    group that it had first. What one file makes known can let another's licences in, so this goes round until no service
    is known any earlier; rounds and what is collected are as many as there are service codes at most.
    """
    spark, known = moves.sparkSession, {s: (-1, g) for s, g in services.items()}
    held = moves.where("is_held").select("usi", "place", "radio_service_code", F.col("held").alias("service_group"))
    others = moves.where("is_held IS NULL").select("usi", "place", "radio_service_code")
    while True:
        since = spark.createDataFrame([(s, p, g) for s, (p, g) in known.items()], "radio_service_code string, since int, service_group string")
        entered = others.join(F.broadcast(since), "radio_service_code").where("since < place").groupBy("usi").agg(F.min("place").alias("entered"), F.min_by("service_group", "place").alias("service_group"))
        applied = held.unionByName(others.join(entered, "usi").where("place >= entered").select("usi", "place", "radio_service_code", "service_group"))
        earlier = {}
        for r in applied.groupBy("radio_service_code").agg(F.min(F.struct("place", "service_group")).alias("first")).collect():
            if r.radio_service_code not in known or r.first.place < known[r.radio_service_code][0]:
                earlier[r.radio_service_code] = (r.first.place, r.first.service_group)
        if not earlier:
            break
        known |= earlier
    last = applied.groupBy("usi").agg(F.max("place").alias("place"), F.min("service_group").alias("service_group"))
    return last, {s: g for s, (_, g) in known.items()}


def apply_daily(held: Registry, daily: Registry) -> Registry:
    """The registry with every licence of a daily one replaced in all tables.

    A replaced licence that is no longer live has no technical rows; lease links are replaced by the lease's key.
    """
    touched = daily.licenses.select("usi")
    live = daily.licenses.where(F.col("license_status").isin(*LIVE_STATUSES)).select("usi")
    out = {"licenses": replace_by_key(held.licenses, daily.licenses, ["usi"])}
    out["lease_links"] = replace_by_key(held.lease_links, daily.lease_links, ["lease_usi"], touched.withColumnRenamed("usi", "lease_usi"))
    for t in ("locations", "antennas", "frequencies", "market_blocks", "paths"):
        out[t] = replace_by_key(getattr(held, t), getattr(daily, t).join(live, "usi", "left_semi"), ["usi"], touched)
    return Registry(**out)


def chained_changes(feed: DataFrame, key: str, order: list[str], column: str) -> DataFrame:
    """Rows of a feed at which a key's value changes, with the value before: a feed's history for audits."""
    by = Window.partitionBy(key).orderBy(*order)
    return feed.withColumn("previous", F.lag(column).over(by)).where(~F.col("previous").eqNullSafe(F.col(column)))

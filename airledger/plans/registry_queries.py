"""Queries of the registry engine over the virtual registry, each with the DuckDB SQL of the same result."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bands, codes, geo
from ..functions import columns as C
from ..operators import areas, assignments, build, detail, licences, markets, paging, reference, refresh, spectrum, textsearch, transmitters
from ..sources.scratch import shared_dir
from .virtual import base_tables, registry, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(views: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name with SQL after the named views."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_views(views.split(), sql) if views else sql
        return f

    return add


def _joined(column: str) -> Column:
    """A list as text, so that results compare by value."""
    return F.concat_ws(",", F.transform(column, lambda x: x.cast("string"))).alias(column)


_STATUS = "CASE license_status WHEN 'A' THEN 'Active' WHEN 'X' THEN 'Term Pending' WHEN 'E' THEN 'Expired' END"
_SERVICE = "CASE radio_service_code WHEN 'MW' THEN 'Microwave Public Safety Pool' WHEN 'IG' THEN 'Industrial/Business Pool, Conventional' WHEN 'CL' THEN 'Cellular' WHEN 'HA' THEN 'Amateur' ELSE radio_service_code END"
#: Occupied band and class of the frequencies view, as SQL.
_BANDS = """fb AS (
SELECT *, CASE WHEN filed_bandwidth < 0.2 * frequency_mhz THEN filed_bandwidth END AS bandwidth_mhz FROM frequencies
), f AS (
SELECT *, frequency_mhz - coalesce(bandwidth_mhz, 0) / 2 AS occ_low, CASE WHEN upper_mhz > frequency_mhz THEN upper_mhz ELSE frequency_mhz END + coalesce(bandwidth_mhz, 0) / 2 AS occ_high FROM fb
)"""


@_query(
    "licenses locations frequencies",
    f"""SELECT usi, callsign, license_status, {_STATUS} AS status_label, {_SERVICE} AS service_label,
  CASE applicant_type WHEN 'I' THEN 'Individual' WHEN 'C' THEN 'Corporation' WHEN 'L' THEN 'Limited Liability Company' END AS applicant_label,
  CASE WHEN is_individual THEN NULL ELSE licensee_name END AS licensee_name, is_individual AS licensee_redacted,
  (SELECT count(*) FROM locations WHERE locations.usi = licenses.usi) AS site_count, (SELECT count(frequency_mhz) FROM frequencies WHERE frequencies.usi = licenses.usi) AS frequency_count
FROM licenses WHERE license_status = 'A' AND radio_service_code = 'MW' AND expired_date >= '2008-01-01' AND expired_date <= '2009-12-31'""",
)
def q1_search_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence that meets equality and date criteria, with labels, counts and redaction."""
    r = registry(spark, sf_dir)
    search = licences.LicenceSearch(radio_service="MW", expires_after="2008-01-01", expires_before="2009-12-31").normalised()
    shown = licences.summaries(r, licences.matching(r, search))
    return shown.select("usi", "callsign", "license_status", "status_label", "service_label", "applicant_label", "licensee_name", "licensee_redacted", "site_count", "frequency_count")


@_query(
    "licenses",
    """SELECT callsign, usi, license_status FROM licenses WHERE license_status IN ('A', 'X') AND (callsign > 'K300' OR (callsign = 'K300' AND usi > 200))
ORDER BY callsign NULLS FIRST, usi LIMIT 25""",
)
def q1_page_after_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page (its size is the feature) that follows a cursor in callsign order."""
    r = registry(spark, sf_dir)
    live = r.licenses.where(F.col("license_status").isin("A", "X"))
    made = paging.page(live, licences.CALLSIGN_ORDER, 25, ("g", "c"), paging.encode(("g", "c"), ["K300", 200]))
    return made.rows.select("callsign", "usi", "license_status")


@_query("licenses", "SELECT callsign, usi FROM licenses WHERE license_status = 'A' AND (callsign IS NOT NULL OR usi > 500)")
def q1_after_blank_callsign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows after a key whose first part is null: nulls come first."""
    r = registry(spark, sf_dir)
    return r.licenses.where("license_status = 'A'").where(paging.after(licences.CALLSIGN_ORDER, [None, 500])).select("callsign", "usi")


_RANK = """--more
t AS (SELECT usi, [x FOR x IN regexp_split_to_array(lower(licensee_name), '[^a-z0-9]+') IF x <> ''] AS w FROM licenses WHERE licensee_name IS NOT NULL),
h AS (SELECT usi, len(w) AS n, len([x FOR x IN w IF starts_with(x, 'ri')]) AS a, len([x FOR x IN w IF starts_with(x, 'small')]) AS b FROM t WHERE len(w) > 0),
s AS (SELECT avg(n) AS mean, sum(CASE WHEN a > 0 THEN 1 ELSE 0 END) AS na, sum(CASE WHEN b > 0 THEN 1 ELSE 0 END) AS nb, (SELECT count(*) FROM licenses) AS total FROM h)
SELECT h.usi, round(-(greatest(ln((total - na + 0.5) / (na + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + greatest(ln((total - nb + 0.5) / (nb + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean))), 9) AS score
FROM h, s, licenses WHERE a > 0 AND b > 0 AND licenses.usi = h.usi AND NOT is_individual AND license_status = 'A'"""


@_query("licenses", _RANK)
def q1_rank_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every active licence whose name has both terms, by BM25 over all names; individuals aren't searched."""
    r = registry(spark, sf_dir)
    found = licences.matching(r, licences.LicenceSearch(licensee="Small Ri").normalised())
    return found.select("usi", F.round("score", 9).alias("score"))


@_query("licenses", _RANK)
def q1_rank_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search by an inverted index of all names, written sorted by term."""
    r, path = registry(spark, sf_dir), f"{shared_dir(spark)}/airledger-names/{uuid.uuid4().hex}"
    made = textsearch.postings(r.licenses, "usi", "licensee_name")
    made.repartitionByRange("term", "usi").sortWithinPartitions("term", "usi").write.parquet(path)
    kept = spark.read.schema(made.schema).parquet(path)
    counts = kept.where("term = ''").agg(F.count("*"), F.count_if(F.col("len") > 0), F.sum("len")).first()
    r.names = textsearch.NameIndex(kept, counts[0], counts[1], counts[2] or 0)
    found = licences.matching(r, licences.LicenceSearch(licensee="Small Ri").normalised())
    return found.select("usi", F.round("score", 9).alias("score"))


@_query(
    "",
    r"""WITH t AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+') IF x <> ''] AS w FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, len(w) AS n, len([i FOR i IN range(1, greatest(len(w), 1)) IF w[i] = 'of' AND starts_with(w[i + 1], 'the')]) AS a FROM t WHERE len(w) > 0),
s AS (SELECT avg(n) AS mean, count(*) FILTER (a > 0) AS na, (SELECT count(*) FROM documents) AS total FROM h)
SELECT doc_id, round(-(greatest(ln((total - na + 0.5) / (na + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean))), 9) AS score FROM h, s WHERE a > 0""",
)
def text_phrase_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrase `of the*` ranked over whole document texts: phrase search is independent of licences."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return textsearch.rank(docs, "doc_id", "text", [["of", "the"]]).select("doc_id", F.round("score", 9).alias("score"))


@_query(
    "licenses",
    """SELECT usi, callsign, license_status, callsign_rank FROM (SELECT *, row_number() OVER (PARTITION BY callsign ORDER BY license_status = 'A' DESC, coalesce(last_action_date, effective_date, grant_date, '') DESC, usi DESC) AS callsign_rank
FROM licenses WHERE callsign IS NOT NULL)""",
)
def q2_resolve_callsigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which record each callsign stands for, and the order of its others."""
    return licences.resolve_callsigns(registry(spark, sf_dir).licenses).select("usi", "callsign", "license_status", F.col("callsign_rank").cast("long").alias("callsign_rank"))


@_query("licenses", "SELECT callsign, usi, license_status, radio_service_code FROM licenses WHERE callsign LIKE 'K34%' ORDER BY callsign, usi LIMIT 5")
def q2_prefix_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five callsigns (the feature's limit) that begin with a prefix."""
    return licences.prefix_candidates(registry(spark, sf_dir).licenses, "K34")


_SUMMARY = """summary AS (
SELECT usi, location_number, sum(s) AS sites, count(DISTINCT a) + sum(u) AS antennas, sum(f) AS frequencies, sum(p) AS paths FROM (
  SELECT usi, location_number, 1 AS s, NULL::BIGINT AS a, 0 AS u, 0 AS f, 0 AS p FROM locations
  UNION ALL SELECT usi, location_number, 0, antenna_number, CASE WHEN antenna_number IS NULL THEN 1 ELSE 0 END, 0, 0 FROM antennas
  UNION ALL SELECT usi, location_number, 0, antenna_number, 0, 1, 0 FROM frequencies
  UNION ALL SELECT usi, location_number, 0, antenna_number, 0, 0, 1 FROM paths) GROUP BY usi, location_number
)"""
_PARTS = "locations antennas frequencies paths"


@_query(_PARTS, f"--more\n{_SUMMARY} SELECT usi, location_number::BIGINT AS location_number, sites::BIGINT AS sites, antennas::BIGINT AS antennas, frequencies::BIGINT AS frequencies, paths::BIGINT AS paths FROM summary")
def q2_location_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each location number of every licence has, of four tables together."""
    return detail.location_summary(registry(spark, sf_dir))


@_query(
    _PARTS,
    f"""--more
{_SUMMARY}, placed AS (SELECT *, row_number() OVER (PARTITION BY usi ORDER BY location_number) - 1 AS position FROM summary),
run AS (SELECT *, sum(sites) OVER w AS rs, sum(antennas) OVER w AS ra, sum(paths) OVER w AS rp, sum(frequencies) OVER w AS rf FROM placed WHERE position >= 1 WINDOW w AS (PARTITION BY usi ORDER BY location_number ROWS UNBOUNDED PRECEDING))
SELECT usi, location_number::BIGINT AS location_number, position::BIGINT AS position, rf > 4 AND rf - frequencies <= 4 AS cut FROM run WHERE (rs <= 4 AND ra <= 8 AND rp <= 3) OR position = 1""",
)
def q2_location_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole locations that a second page lists within its budgets, for every licence."""
    made = detail.location_windows(detail.location_summary(registry(spark, sf_dir)), offset=1, max_frequencies=4, budgets=(4, 8, 3))
    return made.select("usi", "location_number", F.col("position").cast("long").alias("position"), "cut")


@_query(_PARTS, f"--more\n{_SUMMARY} SELECT usi, count(*) FILTER (location_number < 4)::BIGINT AS \"offset\" FROM summary GROUP BY usi")
def q2_offset_of_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a window begins that starts at a location number."""
    return detail.offset_of(detail.location_summary(registry(spark, sf_dir)), 4)


@_query(
    "licenses locations",
    """SELECT l.usi, location_number, site_seq, CASE location_type WHEN 'F' THEN 'Fixed' WHEN 'M' THEN 'Mobile' END AS location_type_label, CASE location_class WHEN 'T' THEN 'Transmit Location' ELSE 'Receive Location' END AS location_class_label,
  CASE WHEN asr_number = '9999999' OR length(asr_number) <> 7 THEN NULL ELSE asr_number END AS asr_number, CASE WHEN is_individual THEN NULL ELSE address END AS address, lat, lon
FROM locations l JOIN licenses USING (usi)""",
)
def q2_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of every licence as a detail shows them."""
    r = registry(spark, sf_dir)
    return detail.sites(r, r.locations.select("usi", "location_number").distinct()).select("usi", "location_number", "site_seq", "location_type_label", "location_class_label", "asr_number", "address", "lat", "lon")


@_query(
    "antennas",
    """SELECT usi, location_number, antenna_number, CASE WHEN count(DISTINCT gain_dbi) = 1 AND count(gain_dbi) = count(*) THEN max(gain_dbi) END AS gain_dbi,
  CASE WHEN count(DISTINCT polarization) = 1 AND count(polarization) = count(*) THEN max(polarization) END AS polarization, CASE WHEN count(*) > 1 THEN count(*) END AS record_count
FROM antennas WHERE antenna_number IS NOT NULL GROUP BY 1, 2, 3
UNION ALL SELECT usi, location_number, NULL, gain_dbi, polarization, NULL FROM antennas WHERE antenna_number IS NULL""",
)
def q2_antennas_agreed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Antennas, numbered ones merged where their records agree."""
    return detail.agreed(registry(spark, sf_dir).antennas, ["gain_dbi", "polarization"])


@_query(
    "frequencies",
    """SELECT usi, location_number, antenna_number, freq_seq_id, place FROM (SELECT *, row_number() OVER (PARTITION BY usi ORDER BY location_number, antenna_number, freq_seq_id, filed) AS place FROM frequencies) WHERE place <= 3""",
)
def q2_frequencies_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three frequency rows (the feature's cap) of every licence."""
    r = registry(spark, sf_dir)
    window = detail.location_summary(r).where("frequencies > 0")
    return detail.frequencies_capped(r, window, 3).select("usi", "location_number", "antenna_number", "freq_seq_id", F.col("place").cast("long").alias("place"))


@_query(
    "locations antennas paths",
    """SELECT p.usi, p.location_number, p.path_number, p.receive_location_number, p.receive_antenna_number, CASE WHEN e.n = 1 THEN e.lat END AS receive_lat, CASE WHEN e.n = 1 THEN e.lon END AS receive_lon,
  CASE WHEN coalesce(e.n, 0) <> 1 THEN coalesce(e.n, 0) END AS receive_sites, CASE WHEN p.receive_antenna_number IS NOT NULL AND a.usi IS NULL THEN false END AS receive_antenna_filed
FROM paths p LEFT JOIN (SELECT usi, location_number, count(*) AS n, max(lat) AS lat, max(lon) AS lon FROM locations GROUP BY 1, 2) e ON e.usi = p.usi AND e.location_number = p.receive_location_number
LEFT JOIN (SELECT DISTINCT usi, location_number, antenna_number FROM antennas WHERE antenna_number IS NOT NULL) a ON a.usi = p.usi AND a.location_number = p.receive_location_number AND a.antenna_number = p.receive_antenna_number""",
)
def q2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with their receive ends."""
    return detail.paths(registry(spark, sf_dir)).select("usi", "location_number", "path_number", "receive_location_number", "receive_antenna_number", "receive_lat", "receive_lon", "receive_sites", "receive_antenna_filed")


@_query(
    "licenses lease_links",
    """SELECT k.lease_usi, k.parent_usi, coalesce(k.parent_callsign, callsign) AS parent_callsign, CASE WHEN NOT is_individual THEN licensee_name END AS parent_name, license_status AS parent_status, is_individual AS parent_redacted FROM lease_links k LEFT JOIN licenses ON usi = parent_usi""",
)
def q2_leases_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leases with their parents, missing ones included."""
    return detail.leases_held(registry(spark, sf_dir)).select("lease_usi", "parent_usi", "parent_callsign", "parent_name", "parent_status", "parent_redacted")


@_query(
    "licenses lease_links",
    """SELECT parent_usi, lease_usi, callsign AS lease_callsign, CASE WHEN is_individual THEN NULL ELSE licensee_name END AS licensee_name, is_individual AS licensee_redacted FROM lease_links JOIN licenses ON usi = lease_usi""",
)
def q2_leases_granted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each parent's leases, as its detail's first page lists them."""
    return detail.leases_granted(registry(spark, sf_dir)).select("parent_usi", "lease_usi", "lease_callsign", "licensee_name", "licensee_redacted")


@_query(
    "market_blocks",
    """SELECT usi, CASE WHEN lower > 0 THEN lower END AS low_mhz, CASE WHEN lower > 0 THEN coalesce(upper, lower) END AS high_mhz, CASE WHEN NOT lower > 0 THEN upper END AS channel_width_mhz,
  coalesce(string_agg(DISTINCT nullif(partition_area_id, 0)::VARCHAR, ',' ORDER BY nullif(partition_area_id, 0)::VARCHAR), '') AS partition_areas FROM market_blocks GROUP BY usi, lower, upper""",
)
def q2_market_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market blocks collapsed over their partition areas."""
    return detail.market_blocks(registry(spark, sf_dir)).select("usi", "low_mhz", "high_mhz", "channel_width_mhz", _joined("partition_areas"))


@_query("")
def q2_licence_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested detail document of every licence; its parts are compared one by one by the queries before."""
    r = registry(spark, sf_dir, dealt=True)
    return detail.documents(r, r.licenses.select("usi"), dealt=True)


_POINT = (26.0, -118.25)
_DISTANCE = f"2 * 6371.0088 * asin(sqrt(least(1.0, power(sin(radians(lat - {_POINT[0]}) / 2), 2) + cos(radians({_POINT[0]})) * cos(radians(lat)) * power(sin(radians(lon - {_POINT[1]}) / 2), 2))))"


@_query(
    "licenses locations frequencies",
    f"""--more
{_BANDS}, hit AS (SELECT l.*, {_DISTANCE} AS d FROM locations l WHERE {_DISTANCE} <= 230)
SELECT hit.usi, hit.location_number, site_seq, round(d, 3) AS distance_km, callsign, CASE WHEN is_individual THEN NULL ELSE licensee_name END AS licensee_name, CASE WHEN is_individual THEN NULL ELSE address END AS address
FROM hit JOIN licenses USING (usi) WHERE license_status IN ('A', 'L', 'X') AND location_type = 'F'
AND EXISTS (SELECT 1 FROM f WHERE f.usi = hit.usi AND f.location_number = hit.location_number AND occ_low <= 912 + 5e-7 AND occ_high >= 902 - 5e-7)""",
)
def q3_sites_in_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fixed site within 230 km of a point whose number has a frequency in a band."""
    from ..operators.redact import redact

    r = registry(spark, sf_dir)
    found = transmitters.sites_in_radius(r, transmitters.RadiusSearch(*_POINT, 230, band=(902.0, 912.0), location_type="F", status="any"))
    return redact(found).select("usi", "location_number", "site_seq", F.round("distance_km", 3).alias("distance_km"), "callsign", "licensee_name", "address")


@_query(
    "frequencies",
    f"""--more
{_BANDS} SELECT usi, location_number, frequency_mhz, upper_mhz, max(bandwidth_mhz) AS bandwidth_mhz, max(erp_w) AS erp_w, max(eirp_dbm) AS eirp_dbm, string_agg(DISTINCT class_station, ',' ORDER BY class_station) AS class_stations,
string_agg(DISTINCT emission, ',' ORDER BY emission) AS emissions FROM f GROUP BY 1, 2, 3, 4""",
)
def q3_site_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies collapsed by site number."""
    return transmitters.frequency_rows(registry(spark, sf_dir).frequencies).select("usi", "location_number", "frequency_mhz", "upper_mhz", "bandwidth_mhz", "erp_w", "eirp_dbm", _joined("class_stations"), _joined("emissions"))


@_query(
    "licenses locations frequencies",
    f"""--more
{_BANDS}, hit AS (SELECT l.*, callsign, {_DISTANCE} AS d FROM locations l JOIN licenses USING (usi) WHERE {_DISTANCE} <= 200 AND license_status = 'A' ORDER BY d, usi, location_number, site_seq LIMIT 25),
g AS (SELECT usi, location_number, frequency_mhz, coalesce(upper_mhz, 0) AS u, max(erp_w) AS e, string_agg(DISTINCT class_station, '+' ORDER BY class_station) AS k FROM f GROUP BY usi, location_number, frequency_mhz, upper_mhz),
c AS (SELECT usi, location_number, count(*) AS n, list(concat_ws('/', cast(round(frequency_mhz * 100) AS BIGINT), cast(round(u * 100) AS BIGINT), cast(round(e * 100) AS BIGINT), k) ORDER BY frequency_mhz, u) AS l FROM g GROUP BY 1, 2)
SELECT hit.usi, hit.location_number, site_seq, round(d, 3) AS distance_km, coalesce(n, 0) AS frequency_count, coalesce(array_to_string(l[1:10], ','), '') AS frequencies FROM hit LEFT JOIN c USING (usi, location_number)""",
)
def q3_transmitter_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page (the feature's 25 rows) of a radius search, with each site's frequencies."""
    made = transmitters.find_transmitters(registry(spark, sf_dir), transmitters.RadiusSearch(*_POINT, 200))
    cents = lambda c: F.round(c * 100).cast("long")
    shown = F.transform("frequencies", lambda f: F.concat_ws("/", cents(f["frequency_mhz"]), cents(f["upper_key"]), cents(f["erp_w"]), F.array_join(f["class_stations"], "+")))
    return made.rows.select("usi", "location_number", "site_seq", "distance_km", "frequency_count", F.coalesce(F.array_join(shown, ","), F.lit("")).alias("frequencies"))


_SITE_SIDE = """site AS (
SELECT frequency_mhz, usi, location_number, upper_mhz, max(bandwidth_mhz) AS bandwidth_mhz, max(erp_w) AS erp_w, string_agg(DISTINCT class_station, ',' ORDER BY class_station) AS class_stations, string_agg(DISTINCT emission, ',' ORDER BY emission) AS emissions
FROM f WHERE occ_low <= 915 + 5e-7 AND occ_high >= 905 - 5e-7 GROUP BY 1, 2, 3, 4
), numbers AS (SELECT usi, location_number, count(*) AS site_count, CASE WHEN count(*) = 1 THEN min(lat) END AS lat FROM locations GROUP BY 1, 2)"""
_MARKET_SIDE = """market AS (
SELECT usi, lower, upper, coalesce(string_agg(DISTINCT nullif(partition_area_id, 0)::VARCHAR, ',' ORDER BY nullif(partition_area_id, 0)::VARCHAR), '') AS partition_areas
FROM market_blocks WHERE lower <= 915 + 5e-7 AND lower > 0 AND coalesce(upper, lower) >= 905 - 5e-7 GROUP BY 1, 2, 3)"""


@_query(
    "licenses locations frequencies",
    f"""--more
{_BANDS}, {_SITE_SIDE}
SELECT frequency_mhz, usi, location_number, upper_mhz, bandwidth_mhz, erp_w, class_stations, emissions, coalesce(site_count, 0) AS site_count, lat, callsign FROM site JOIN licenses USING (usi) LEFT JOIN numbers USING (usi, location_number)
WHERE license_status = 'A' AND EXISTS (SELECT 1 FROM locations l WHERE l.usi = site.usi AND l.location_number = site.location_number AND l.site_state = 'TX')""",
)
def q4_site_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site assignments in a band and state."""
    found = spectrum.site_assignments(registry(spark, sf_dir), spectrum.SpectrumSearch(905, 915, "site", state="TX"))
    return found.select("frequency_mhz", "usi", "location_number", "upper_mhz", "bandwidth_mhz", "erp_w", _joined("class_stations"), _joined("emissions"), "site_count", "lat", "callsign")


@_query("licenses market_blocks", f"--more\n{_MARKET_SIDE} SELECT usi, lower, upper, partition_areas, callsign, frn FROM market JOIN licenses USING (usi) WHERE license_status IN ('A', 'L', 'X') AND market_code LIKE 'BTA%'")
def q4_market_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market blocks in a band with their licences."""
    found = spectrum.market_assignments(registry(spark, sf_dir), spectrum.SpectrumSearch(905, 915, "market", status="any"))
    return found.where(F.col("market_code").startswith("BTA")).select("usi", "lower", "upper", _joined("partition_areas"), "callsign", "frn")


@_query(
    "licenses locations frequencies market_blocks",
    f"""--more
{_BANDS}, {_SITE_SIDE}, {_MARKET_SIDE}
SELECT kind, frequency_mhz, usi, location_key, upper_key, {_SERVICE} AS service_label, CASE WHEN is_individual THEN NULL ELSE licensee_name END AS licensee_name FROM (
  SELECT 'site' AS kind, frequency_mhz, usi, location_number::BIGINT AS location_key, coalesce(upper_mhz, 0) AS upper_key FROM site
  UNION ALL SELECT 'market', lower, usi, 0, coalesce(upper, 0) FROM market) JOIN licenses USING (usi) WHERE license_status = 'A'""",
)
def q4_search_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of a spectrum search, all pages."""
    found = spectrum.search_frequencies(registry(spark, sf_dir), spectrum.SpectrumSearch(905, 915))
    return found.select("kind", "frequency_mhz", "usi", "location_key", "upper_key", "service_label", "licensee_name")


@_query(
    "licenses locations frequencies market_blocks",
    f"""--more
{_BANDS}, {_SITE_SIDE}, {_MARKET_SIDE}
SELECT kind, frequency_mhz, usi, location_key, upper_key FROM (
  SELECT 'site' AS kind, 1 AS o, frequency_mhz, usi, location_number::BIGINT AS location_key, coalesce(upper_mhz, 0) AS upper_key FROM site
  UNION ALL SELECT 'market', 0, lower, usi, 0, coalesce(upper, 0) FROM market) JOIN licenses USING (usi) WHERE license_status = 'A' AND frequency_mhz > 910 ORDER BY frequency_mhz, o, usi, location_key, upper_key LIMIT 50""",
)
def q4_page_after_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page (the feature's 50 rows) of both sides after a cursor."""
    r, search = registry(spark, sf_dir), spectrum.SpectrumSearch(905, 915)
    made = spectrum.frequency_page(r, search, cursor=paging.encode(spectrum.page_binding(search, "g"), [910.0, 2, 0, 0, 0.0]), generation="g")
    return made.rows.select("kind", "frequency_mhz", "usi", "location_key", "upper_key")


@_query(
    "licenses locations frequencies market_blocks",
    f"""--more
{_BANDS}, {_SITE_SIDE}, {_MARKET_SIDE}
SELECT kind, frequency_mhz, usi, location_key, upper_key, bandwidth_mhz, erp_w, class_stations, emissions, partition_areas, site_count, lat, callsign FROM (
  SELECT 'site' AS kind, frequency_mhz, usi, location_number::BIGINT AS location_key, coalesce(upper_mhz, 0) AS upper_key, bandwidth_mhz, erp_w, class_stations, emissions, '' AS partition_areas, coalesce(site_count, 0) AS site_count, lat FROM site LEFT JOIN numbers USING (usi, location_number)
  UNION ALL SELECT 'market', lower, usi, 0, coalesce(upper, 0), NULL, NULL, '', '', partition_areas, NULL, NULL FROM market) JOIN licenses USING (usi) WHERE license_status IN ('A', 'L', 'X')""",
)
def q4_search_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of a spectrum search with all their values, from an index of assignments."""
    index = _spectrum_index(spark, registry(spark, sf_dir))
    found = assignments.found(index, spectrum.SpectrumSearch(905, 915, status="any").normalised())
    return found.select("kind", "frequency_mhz", "usi", "location_key", "upper_key", "bandwidth_mhz", "erp_w", _joined("class_stations"), _joined("emissions"), _joined("partition_areas"), "site_count", "lat", "callsign")


@_query(
    "licenses frequencies market_blocks",
    f"""--more
{_BANDS}, {_SITE_SIDE.split("), numbers")[0]}), {_MARKET_SIDE}, every AS (
  SELECT 'site' AS kind, 1 AS o, frequency_mhz, usi, location_number::BIGINT AS location_key, coalesce(upper_mhz, 0) AS upper_key FROM site JOIN licenses USING (usi) WHERE license_status = 'A'
  UNION ALL SELECT 'market', 0, lower, usi, 0, coalesce(upper, 0) FROM market JOIN licenses USING (usi) WHERE license_status = 'A')
SELECT kind, frequency_mhz, usi, location_key, upper_key, (SELECT count(*) FROM every) AS total FROM every WHERE frequency_mhz > 910 ORDER BY frequency_mhz, o, usi, location_key, upper_key LIMIT 50""",
)
def q4_page_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page (the feature's 50 rows) after a cursor and the total of all pages, from an index of assignments and its counts."""
    r, search = registry(spark, sf_dir), spectrum.SpectrumSearch(905, 915)
    r.spectrum = _spectrum_index(spark, r)
    made = spectrum.frequency_page(r, search, cursor=paging.encode(spectrum.page_binding(search, "g"), [910.0, 2, 0, 0, 0.0]), generation="g")
    return made.rows.select("kind", "frequency_mhz", "usi", "location_key", "upper_key", F.lit(made.total()).alias("total"))


def _spectrum_index(spark: SparkSession, r: build.Registry) -> assignments.SpectrumIndex:
    """An index of a registry's assignments, written in its order."""
    path, made = f"{shared_dir(spark)}/airledger-spectrum/{uuid.uuid4().hex}", spectrum.entries(r)
    # Ranges are told by a run over the rows, which would make them twice.
    made.write.parquet(f"{path}/made")
    spark.read.schema(made.schema).parquet(f"{path}/made").repartitionByRange(*assignments.KEPT).sortWithinPartitions(*assignments.KEPT).write.parquet(f"{path}/entries")
    rows = spark.read.schema(made.schema).parquet(f"{path}/entries")
    assignments.counted(rows).repartitionByRange(1, "edge", "bin").sortWithinPartitions("edge", "bin").write.parquet(f"{path}/counts")
    return assignments.SpectrumIndex(rows, spark.read.schema(assignments.COUNTS_SCHEMA).parquet(f"{path}/counts"))


@_query(
    "licenses locations",
    """SELECT usi, market_code FROM licenses WHERE NOT coalesce(market_code LIKE 'NW%', false) AND NOT coalesce(market_code = 'BTA011', false)
AND (market_code IN ('BTA003', 'BTA007') OR regexp_matches(market_code, '^[CD]48[0-9]{3}$') OR market_name LIKE '%, ND-%' OR usi IN (SELECT usi FROM locations WHERE site_state = 'ND'))""",
)
def q4_state_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences whose market is in a state by any of four rules."""
    r = registry(spark, sf_dir)
    return spectrum.state_rule(r.licenses, r.locations, "ND", _areas(spark), "48").select("usi", "market_code")


def _areas(spark: SparkSession) -> DataFrame:
    """Which states market areas lie in; one lies in none."""
    return spark.createDataFrame([("BTA003", "ND"), ("BTA007", "ND"), ("BTA007", "SD"), ("BTA009", "SD"), ("BTA011", None)], "market_code string, state string")


@_query(
    "licenses locations frequencies market_blocks",
    f"""--more
{_BANDS}, {_SITE_SIDE}, {_MARKET_SIDE},
there AS (SELECT DISTINCT usi, location_number FROM locations WHERE site_state = 'ND')
SELECT kind, frequency_mhz, usi, location_key, upper_key, callsign FROM (
  SELECT 'site' AS kind, frequency_mhz, site.usi, site.location_number::BIGINT AS location_key, coalesce(upper_mhz, 0) AS upper_key FROM site JOIN there ON there.usi = site.usi AND there.location_number = site.location_number
  UNION ALL SELECT 'market', lower, usi, 0, coalesce(upper, 0) FROM market JOIN (SELECT usi AS m FROM licenses WHERE NOT coalesce(market_code LIKE 'NW%', false) AND NOT coalesce(market_code = 'BTA011', false)
    AND (market_code IN ('BTA003', 'BTA007') OR regexp_matches(market_code, '^[CD]48[0-9]{{3}}$') OR market_name LIKE '%, ND-%' OR usi IN (SELECT usi FROM there))) ON m = usi) JOIN licenses USING (usi) WHERE license_status IN ('A', 'L', 'X')""",
)
def q4_search_in_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of a spectrum search in a state, as a user writes it: in GHz, with areas, counties and an area in no state."""
    asked = spectrum.SpectrumSearch(0.905, 0.915, state="north dakota", status="Any", unit="ghz")
    found = spectrum.search_frequencies(registry(spark, sf_dir), asked, True, _areas(spark), "48")
    return found.select("kind", "frequency_mhz", "usi", "location_key", "upper_key", "callsign")


@_query(
    "frequencies market_blocks",
    f"""--more
{_BANDS}, m AS (SELECT lower, coalesce(upper, lower) AS top, count(DISTINCT usi) AS licences FROM market_blocks WHERE lower > 0 GROUP BY 1, 2)
SELECT lower, top, any_value(licences) AS licences, count(*) AS frequency_rows, sum(usi)::BIGINT AS usis, sum(freq_seq_id)::BIGINT AS sequences, min(occ_low) AS lowest, max(occ_high) AS highest FROM f JOIN m ON occ_low <= top + 5e-7 AND occ_high >= lower - 5e-7 GROUP BY lower, top""",
)
def j15_band_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every site frequency against the band of every market block: what each market band holds. Equal bands are one."""
    r = registry(spark, sf_dir)
    blocks = r.market_blocks.where("lower > 0").groupBy("lower", F.coalesce("upper", "lower").alias("top")).agg(F.count_distinct("usi").alias("licences"))
    rows = r.frequencies.select("usi", "freq_seq_id", "occ_low", "occ_high")
    found = bands.occupancy(rows, blocks, ("occ_low", "occ_high"), ("lower", "top"), ["usi", "freq_seq_id"]).where("n > 0")
    return found.select("lower", "top", "licences", F.col("n").alias("frequency_rows"), F.col("usi").alias("usis"), F.col("freq_seq_id").alias("sequences"), "lowest", "highest")


@_query(
    "frequencies market_blocks",
    f"""--more
{_BANDS}, m AS (SELECT DISTINCT lower, coalesce(upper, lower) AS top FROM market_blocks WHERE lower > 0), s AS (SELECT frequency_mhz, min(occ_low) AS low, max(occ_high) AS high, count(*) AS filed FROM f WHERE bandwidth_mhz < 0.05 AND upper_mhz IS NULL GROUP BY 1)
SELECT lower, top, frequency_mhz, filed FROM s JOIN m ON low <= top + 5e-7 AND high >= lower - 5e-7""",
)
def j15_band_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a market band and a frequency that narrow emissions are filed on and that it holds."""
    r = registry(spark, sf_dir)
    blocks = r.market_blocks.where("lower > 0").select("lower", F.coalesce("upper", "lower").alias("top")).distinct()
    narrow = r.frequencies.where("bandwidth_mhz < 0.05 AND upper_mhz IS NULL").groupBy("frequency_mhz").agg(F.min("occ_low").alias("low"), F.max("occ_high").alias("high"), F.count("*").alias("filed"))
    return bands.overlap_join(narrow, blocks, ("low", "high"), ("lower", "top")).select("lower", "top", "frequency_mhz", "filed")


@_query(
    "frequencies",
    f"""--more
{_BANDS} SELECT usi, location_number, freq_seq_id, filed, bandwidth_mhz, occ_low, occ_high, CASE WHEN occ_high - occ_low <= power(2, -14) THEN -14 ELSE (SELECT min(c) FROM range(-13, 15) r(c) WHERE c = 14 OR occ_high - occ_low <= power(2, c)) END::INT AS band_class FROM f""",
)
def x8_occupied_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plausible bandwidth, occupied band and class of every frequency row."""
    return registry(spark, sf_dir).frequencies.select("usi", "location_number", "freq_seq_id", F.col("_seq").alias("filed"), "bandwidth_mhz", "occ_low", "occ_high", "band_class")


_CODES = "(VALUES ('6M00D1D'), ('11K2F3E'), ('100HA1A'), ('1G25X'), ('12K'), ('K123F3E'), ('6M000'), ('bad'), (' 16k0f3e')) AS e(code)"


@_query(
    "",
    f"""SELECT l_orderkey AS usi, l_linenumber AS line, l_suppkey AS filed, code AS emission_code, CASE trim(code) WHEN '6M00D1D' THEN 6.0 WHEN '11K2F3E' THEN 0.0112 WHEN '100HA1A' THEN 0.0001 WHEN '1G25X' THEN 1250.0 WHEN 'K123F3E' THEN 0.000123 WHEN '6M000' THEN 6.0 WHEN '16k0f3e' THEN 0.016 END::DOUBLE AS mhz
FROM lineitem, {_CODES}""",
)
def x7_emission_bandwidths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bandwidths of emission designators, filed in several ways."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("usi"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("filed"))
    listed = F.array(*[F.lit(c) for c in ("6M00D1D", "11K2F3E", "100HA1A", "1G25X", "12K", "K123F3E", "6M000", "bad", " 16k0f3e")])
    return rows.withColumn("emission_code", F.explode(listed)).withColumn("mhz", C.emission_mhz(F.col("emission_code")))


@_query(
    "",
    """WITH e AS (SELECT l_orderkey AS usi, l_linenumber AS n, l_suppkey % 4 AS a, 1 + l_partkey % 2 AS s, p_retailprice AS mhz, l_quantity AS q FROM lineitem JOIN part ON l_partkey = p_partkey),
fr AS (SELECT usi, n, a, s, min(mhz) AS frequency_mhz FROM e GROUP BY 1, 2, 3, 4), em AS (SELECT DISTINCT usi, n, a, s, cast(cast(q AS INT) + 100 AS VARCHAR) || 'KF3E' AS code, (cast(q AS INT) + 100) / 1000.0::DOUBLE AS mhz FROM e WHERE q > 10)
SELECT usi, n AS location_number, a AS antenna_number, s AS freq_seq_id, frequency_mhz, coalesce(string_agg(DISTINCT code, ',' ORDER BY code), '') AS emissions, max(CASE WHEN em.mhz < 0.2 * frequency_mhz THEN em.mhz END) AS bandwidth_mhz FROM fr LEFT JOIN em USING (usi, n, a, s) GROUP BY ALL""",
)
def j2_emission_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency rows with the emissions filed under their four keys."""
    t = base_tables(spark, sf_dir)
    e = t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("usi"), F.col("l_linenumber").alias("location_number"), (F.col("l_suppkey") % 4).alias("antenna_number"), (1 + F.col("l_partkey") % 2).alias("freq_seq_id"), F.col("p_retailprice").alias("frequency_mhz"), "l_quantity")
    keys = ["usi", "location_number", "antenna_number", "freq_seq_id"]
    fr = e.groupBy(*keys).agg(F.min("frequency_mhz").alias("frequency_mhz")).withColumn("upper_mhz", F.lit(None).cast("double"))
    em = e.where("l_quantity > 10").select(*keys, F.concat((F.col("l_quantity").cast("int") + 100).cast("string"), F.lit("KF3E")).alias("emission_code"))
    return build.with_emissions(fr, em).select(*keys, "frequency_mhz", _joined("emissions"), "bandwidth_mhz")


@_query(
    "frequencies paths",
    """SELECT usi, location_number, antenna_number, path_number AS freq_seq_id FROM paths p WHERE NOT EXISTS (SELECT 1 FROM frequencies f WHERE f.usi = p.usi AND f.location_number = p.receive_location_number AND f.antenna_number = p.antenna_number AND f.freq_seq_id = p.path_number)""",
)
def j3_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose four keys no frequency row has."""
    r = registry(spark, sf_dir)
    probe = r.paths.select("usi", F.col("receive_location_number").alias("location_number"), "antenna_number", F.col("path_number").alias("freq_seq_id"), F.col("location_number").alias("own"))
    return build.orphan_emissions(probe, r.frequencies).select("usi", F.col("own").alias("location_number"), "antenna_number", "freq_seq_id")


@_query("", "SELECT l_orderkey AS usi, arg_min(l_partkey, l_shipdate::VARCHAR || lpad(l_partkey::VARCHAR, 12, '0') || lpad(l_suppkey::VARCHAR, 12, '0')) AS first_part FROM lineitem GROUP BY 1")
def a1_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each key in an order."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("usi"), F.col("l_partkey").alias("first_part"), "l_shipdate", "l_suppkey")
    return build.first_rows(rows, ["usi"], ["l_shipdate", "first_part", "l_suppkey"]).select("usi", "first_part")


@_query("locations", "SELECT usi, location_number, address, row_number() OVER (PARTITION BY usi, location_number ORDER BY site_seq)::INT AS site_seq FROM locations")
def w1_site_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites numbered within their location number."""
    rows = registry(spark, sf_dir).locations.drop("site_seq")
    return build.with_site_numbers(rows).select("usi", "location_number", "address", "site_seq")


_LINES = """SELECT concat_ws('|', 'LO', cast(l_orderkey AS VARCHAR), '', '', '', '', 'F', ' T ', CASE WHEN l_linenumber = 7 THEN 'x7' ELSE cast(l_linenumber AS VARCHAR) END, '', '', 'a', 'b', 'c', 'tx', '1e1', '', '', '-3.5',
cast(25 + l_partkey % 40 AS VARCHAR), cast(l_suppkey % 62 AS VARCHAR), '30.0', 'N', cast(60 + l_partkey % 60 AS VARCHAR), '15', '0', 'W', '', '', '', '', '', '', '', '', '', '', cast(l_partkey AS VARCHAR), '', '12abc', '', '', '', '', '', '', '', '', '', '', '')"""


@_query(
    "",
    f"""WITH l AS (SELECT *, l_linenumber <> 7 AS ok FROM lineitem)
SELECT l_orderkey AS usi, l_linenumber::BIGINT AS location_number, 'T' AS location_class, 10.0::DOUBLE AS radius_km, -3.5::DOUBLE AS ground_elevation_m, 
CASE WHEN l_suppkey % 62 < 60 THEN (25 + l_partkey % 40)::DOUBLE + (l_suppkey % 62)::DOUBLE / 60 + 30.0::DOUBLE / 3600 END AS lat, CASE WHEN l_suppkey % 62 < 60 THEN -((60 + l_partkey % 60)::DOUBLE + 15.0::DOUBLE / 60 + 0.0::DOUBLE / 3600) END AS lon,
(25 + l_partkey % 40)::VARCHAR || '-' || (l_suppkey % 62)::VARCHAR || '-30.0 N ' || (60 + l_partkey % 60)::VARCHAR || '-15-0 W' AS coord_dms, l_partkey::VARCHAR AS asr_number, NULL::DOUBLE AS overall_height_m FROM l WHERE ok""",
)
def s9_decode_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Location records decoded from pipe-delimited lines, malformed keys left out."""
    from ..sources import records

    line = base_tables(spark, sf_dir)["lineitem"]
    text = lambda c: F.col(c).cast("string")
    fields: list = [F.lit("")] * 51
    for at, value in {
        1: F.lit("LO"), 2: text("l_orderkey"), 7: F.lit("F"), 8: F.lit(" T "), 9: F.when(F.col("l_linenumber") == 7, "x7").otherwise(text("l_linenumber")), 12: F.lit("a"), 15: F.lit("tx"), 16: F.lit("1e1"), 19: F.lit("-3.5"),
        20: (25 + F.col("l_partkey") % 40).cast("string"), 21: (F.col("l_suppkey") % 62).cast("string"), 22: F.lit("30.0"), 23: F.lit("N"), 24: (60 + F.col("l_partkey") % 60).cast("string"), 25: F.lit("15"), 26: F.lit("0"), 27: F.lit("W"), 38: text("l_partkey"), 40: F.lit("12abc"),
    }.items():
        fields[at - 1] = value
    lines = line.select(F.concat_ws("|", *fields).alias("value"), F.lit(0).alias("_seq"))
    return records.decode(lines, "LO").select("usi", "location_number", "location_class", "radius_km", "ground_elevation_m", "lat", "lon", "coord_dms", "asr_number", "overall_height_m")


@_query(
    "",
    """SELECT 'HD' AS record_type, count(*) AS lines_read, count(*) FILTER (o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0) AS lines_kept, count(*) FILTER (o_orderkey % 5 = 0 OR o_orderkey % 7 = 0) AS lines_rejected FROM orders""",
)
def a14_line_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines read, kept and rejected of a record type: short lines and blank keys are rejected."""
    from ..sources import records

    orders = base_tables(spark, sf_dir)["orders"]
    key = F.when(F.col("o_orderkey") % 5 == 0, F.lit(" ")).otherwise(F.col("o_orderkey").cast("string"))
    tail = F.when(F.col("o_orderkey") % 7 == 0, F.lit("|A")).otherwise(F.repeat(F.lit("|"), 57))
    return records.line_statistics(orders.select(F.concat(F.lit("HD|"), key, tail).alias("value"), F.lit(0).alias("_seq")), "HD")


@_query(
    "licenses",
    """SELECT usi, coalesce(applicant_type = 'I', false) OR (applicant_type IS NULL AND radio_service_code = 'HA') OR (coalesce(applicant_type, 'H') = 'H' AND NOT coalesce(licensee_name LIKE 'red %', false)) AS is_individual, CASE WHEN market_name LIKE '%, ND-MN' THEN 'ND,MN' WHEN market_name LIKE '%, NV/CA' THEN 'NV,CA' ELSE '' END AS states FROM licenses""",
)
def x12_derived_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The individual flag by its rules (a name with an organisation word is none), and states of a market's name."""
    rows = registry(spark, sf_dir).licenses.withColumn("name", F.regexp_replace("licensee_name", "^red ", "Red L.L.C. "))
    flag = C.is_individual(F.col("applicant_type"), F.col("radio_service_code"), F.lit(False), F.col("name"))
    return rows.select("usi", flag.alias("is_individual"), F.coalesce(F.concat_ws(",", "market_states"), F.lit("")).alias("states"))


@_query("licenses", "SELECT radio_service_code, count(*) AS record_count FROM licenses GROUP BY 1")
def a10_service_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each service."""
    return reference.service_counts(registry(spark, sf_dir).licenses)


@_query(
    "licenses locations frequencies",
    """SELECT service_group, count(*) AS records, coalesce(sum(s), 0)::BIGINT AS sites, coalesce(sum(f), 0)::BIGINT AS frequencies FROM licenses LEFT JOIN (SELECT usi, count(*) AS s FROM locations GROUP BY 1) USING (usi) LEFT JOIN (SELECT usi, count(*) AS f FROM frequencies GROUP BY 1) USING (usi) GROUP BY 1""",
)
def a9_group_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, sites and frequency rows of each service group."""
    return reference.group_statistics(registry(spark, sf_dir))


@_query("frequencies market_blocks", f"--more\n{_BANDS} SELECT (SELECT max(occ_high - occ_low) FROM f) AS widest_site_mhz, (SELECT max(coalesce(upper, lower) - lower) FROM market_blocks WHERE lower > 0) AS widest_market_mhz")
def a11_widest_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The widest site and market bands."""
    return reference.widest_bands(registry(spark, sf_dir))


@_query(
    "licenses",
    "--more\nt(code, label) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in codes.RADIO_SERVICES.items()) + """), n AS (SELECT radio_service_code AS code, count(*) AS c FROM licenses GROUP BY 1)
SELECT code, coalesce(label, code) AS label, coalesce(c, 0) AS record_count FROM t FULL JOIN n USING (code)""",
)
def q5_radio_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The service vocabulary with record counts, and services beyond it."""
    return reference.list_reference(spark, "radio_services", registry=registry(spark, sf_dir))


@_query("", "SELECT code, label FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in codes.RADIO_SERVICES.items()) + ") t(code, label) WHERE lower(code || ' ' || label) LIKE '%micro%' AND lower(code || ' ' || label) LIKE '%pub%'")
def q5_filtered_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services that have both words of a filter somewhere."""
    return reference.list_reference(spark, "radio_services", "Micro-Púb")


_FEED = """feed AS (SELECT event_id, user_id, event_type, value, cast(ts AS DATE) AS day FROM events)"""


@_query(
    "",
    f"""WITH {_FEED}, old AS (SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM feed WHERE day < DATE '2024-01-10' GROUP BY 1), new AS (SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM feed WHERE day = DATE '2024-01-10' GROUP BY 1)
SELECT * FROM old WHERE user_id NOT IN (SELECT user_id FROM new) UNION ALL SELECT * FROM new""",
)
def r4_replace_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's rows replace those of the same keys."""
    feed = base_tables(spark, sf_dir)["events"].withColumn("day", F.to_date("ts"))
    latest = lambda df: refresh.latest_by_key(df, ["user_id"], ["event_id"]).select("user_id", "event_type", "value")
    return refresh.replace_by_key(latest(feed.where("day < DATE '2024-01-10'")), latest(feed.where("day = DATE '2024-01-10'")), ["user_id"])


@_query(
    "",
    f"""WITH {_FEED}, c AS (SELECT DISTINCT user_id, day FROM feed), s AS (SELECT user_id, min(day) AS a, max(day) AS b FROM c GROUP BY 1)
SELECT user_id, d::DATE AS day FROM (SELECT user_id, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM s) e WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = e.user_id AND c.day = e.d::DATE)""",
)
def r3_coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that a key's feed lacks between its first and last."""
    covered = base_tables(spark, sf_dir)["events"].select("user_id", F.to_date("ts").alias("day")).distinct()
    return refresh.coverage_gaps(covered, "user_id", "day")


@_query(
    "",
    "SELECT event_id, user_id, previous, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events) WHERE previous IS DISTINCT FROM event_type",
)
def r_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a feed at which a key's value changes."""
    return refresh.chained_changes(base_tables(spark, sf_dir)["events"], "user_id", ["event_id"], "event_type").select("event_id", "user_id", "previous", "event_type")


@_query(
    "licenses",
    """SELECT o_orderkey + 14000 AS usi, coalesce(l.service_group, g.service_group) AS service_group FROM orders LEFT JOIN licenses l ON l.usi = o_orderkey + 14000 LEFT JOIN (VALUES ('2-HIGH', 'micro'), ('3-MEDIUM', 'cell')) g(code, service_group) ON g.code = o_orderpriority WHERE l.usi IS NOT NULL OR g.code IS NOT NULL""",
)
def j5_applicable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily heads that belong to a held licence or a known service."""
    heads = base_tables(spark, sf_dir)["orders"].select((F.col("o_orderkey") + 14000).alias("usi"), F.col("o_orderpriority").alias("radio_service_code"))
    services = spark.createDataFrame([("2-HIGH", "micro"), ("3-MEDIUM", "cell")], "code string, service_group string")
    return refresh.applicable(heads, registry(spark, sf_dir).licenses, services).select("usi", "service_group")


@_query(
    "locations",
    """SELECT usi, location_number, site_seq, CASE WHEN lat >= 30 AND lat < 40 AND lon >= -110 + (lat - 40) / -1 AND lon < -100 AND NOT (lon >= -103 AND lon < -101 AND lat >= 36 AND lat < 38) THEN 'AA' WHEN lat >= 30 AND lat < 45 AND lon >= -105 AND lon < -90 THEN 'BB' END AS state_at FROM locations""",
)
def j20_state_of_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state whose polygon, less its hole, holds a site; western and southern edges belong to it, the others don't."""
    triangle = [(-110.0, 40.0), (-100.0, 30.0), (-100.0, 40.0)]
    hole = [(-103.0, 36.0), (-101.0, 36.0), (-101.0, 38.0), (-103.0, 38.0)]
    square = [(-105.0, 30.0), (-90.0, 30.0), (-90.0, 45.0), (-105.0, 45.0)]
    rows = registry(spark, sf_dir).locations
    return rows.select("usi", "location_number", "site_seq", geo.state_of(F.col("lat"), F.col("lon"), [("AA", [triangle, hole]), ("BB", [square])]).alias("state_at"))


#: Wavy outlines of 5,500 edges: state, ring, corners, longitude and latitude of the middle, radius, waves.
_OUTLINES = [("AA", 0, 3000, -105.003, 37.007, 8.0, 25), ("AA", 1, 1000, -104.003, 36.007, 2.0, 7), ("BB", 2, 1500, -95.003, 35.007, 9.0, 40)]


def _outline(corners: int, x: float, y: float, radius: float, waves: int) -> list[tuple[float, float]]:
    """A circle whose radius swings by a seventh."""
    turn = [2 * math.pi * i / corners for i in range(corners)]
    return [(x + radius * (1 + math.sin(waves * t) / 7) * math.cos(t), y + radius * (1 + math.sin(waves * t) / 7) * math.sin(t)) for t in turn]


@_query(
    "locations",
    f"""--more
o(state, ring, corners, x, y, radius, waves) AS (VALUES {", ".join(str((s, r, n, float(x), float(y), d, w)) for s, r, n, x, y, d, w in _OUTLINES)}),
corner AS (SELECT state, ring, i, corners, x + radius * (1 + sin(waves * t) / 7) * cos(t) AS x, y + radius * (1 + sin(waves * t) / 7) * sin(t) AS y
  FROM (SELECT state, ring, corners, x::DOUBLE AS x, y::DOUBLE AS y, radius::DOUBLE AS radius, waves, i, 2 * pi() * i / corners AS t FROM (SELECT *, unnest(range(corners)) AS i FROM o))),
edge AS (SELECT a.state, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, least(a.y, b.y) AS low, greatest(a.y, b.y) AS high FROM corner a JOIN corner b ON a.ring = b.ring AND b.i = (a.i + 1) % a.corners),
point AS (SELECT DISTINCT lat, lon FROM locations),
held AS (SELECT lat, lon, state FROM point JOIN edge ON lat >= low AND lat < high WHERE lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT usi, location_number, site_seq, s.state AS state_at FROM locations LEFT JOIN (SELECT lat, lon, min(state) AS state FROM held GROUP BY 1, 2) s USING (lat, lon)""",
)
def j20_states_by_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every site among outlines of thousands of edges, by an index of cells: edges are tried at borders only."""
    rings = {ring: _outline(n, x, y, radius, waves) for _, ring, n, x, y, radius, waves in _OUTLINES}
    index = areas.StateCells(spark, [("AA", [rings[0], rings[1]]), ("BB", [rings[2]])])
    return index.locate(registry(spark, sf_dir).locations, "state_at").select("usi", "location_number", "site_seq", "state_at")


@_query("licenses locations antennas frequencies market_blocks lease_links paths", "\nUNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in ("licenses", "lease_links", "locations", "antennas", "frequencies", "market_blocks", "paths")))
def a15_table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table."""
    return reference.table_counts(registry(spark, sf_dir))


@_query("", "SELECT coalesce(a.record_type, b.record_type) AS record_type, upstream_lines, lines_read, lines_rejected, coalesce(upstream_lines = lines_read, false) AS agrees FROM (SELECT event_type AS record_type, count(*) AS upstream_lines FROM events GROUP BY 1) a FULL JOIN (SELECT event_type AS record_type, count(*) AS lines_read, count(*) FILTER (value < 1) AS lines_rejected FROM (SELECT CASE event_type WHEN 'click' THEN 'clicks' ELSE event_type END AS event_type, value FROM events UNION ALL SELECT 'view', 5.0) GROUP BY 1) b ON a.record_type = b.record_type")
def a15_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upstream counts against what was read: one type is missing on either side, and one has a line more."""
    events = base_tables(spark, sf_dir)["events"]
    upstream = events.groupBy(F.col("event_type").alias("record_type")).agg(F.count("*").alias("upstream_lines"))
    named = events.select(F.when(F.col("event_type") == "click", "clicks").otherwise(F.col("event_type")).alias("event_type"), "value")
    read = named.unionByName(spark.createDataFrame([("view", 5.0)], "event_type string, value double")).groupBy(F.col("event_type").alias("record_type")).agg(F.count("*").alias("lines_read"), F.count_if(F.col("value") < 1).alias("lines_rejected"))
    return reference.verify(upstream, read)


@_query("", f"WITH {_FEED} SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM feed GROUP BY 1")
def r_stream_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed applied as a stream: eight micro-batches, in the feed's order, that replace rows by key."""
    from ..streaming import feed

    base = f"{shared_dir(spark)}/airledger-feed/{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "value", "event_id")
    last = events.agg(F.max("event_id")).first()[0] or 0
    schema = "user_id bigint, event_type string, value double, event_id bigint"
    table = feed.VersionedTable(spark, f"{base}/table", schema, buckets=8)
    for part in range(8):  # files of a feed come one after the other
        here = F.floor(F.col("event_id") * 8 / (last + 1)) == part
        events.where(here).coalesce(1).write.mode("append").parquet(f"{base}/in")
    feed.start_feed(feed.read_feed(spark, f"{base}/in", schema), table, ["user_id"], ["event_id"], f"{base}/checkpoint").awaitTermination()
    return table.read()


#: A county table of customers: six states, one of them at sea, and numbers in every area column.
_COUNTIES = """
SELECT CASE c_nationkey % 6 WHEN 0 THEN 'North Dakota' WHEN 1 THEN ' minnesota' WHEN 2 THEN 'California' WHEN 3 THEN 'Gulf of Mexico' WHEN 4 THEN 'American Samoas' ELSE 'Nowhere' END AS STATE,
  concat(CASE c_nationkey % 6 WHEN 0 THEN '38' WHEN 1 THEN '27' WHEN 2 THEN '06' WHEN 3 THEN '99' WHEN 4 THEN '06' ELSE '00' END, lpad(cast(c_custkey % 1000 AS STRING), 3, '0')) AS FIPS,
  cast(c_custkey % 305 AS STRING) AS CMA, c_custkey % 177 AS EA, c_custkey % 52 AS MEA, c_custkey % 51 AS MTA, concat(' ', cast(c_custkey % 493 AS STRING)) AS BTA, c_custkey % 12 AS REA,
  CASE WHEN c_custkey % 7 = 0 THEN '' ELSE cast(c_custkey % 6 AS STRING) END AS EAG_220, c_custkey % 6 AS EAG_700, c_custkey % 55 AS RPC, c_custkey % 42 AS VPC
FROM {customer}"""
_AREA_SQL = " UNION ALL ".join(f"SELECT '{p}' || lpad(cast({c} + {markets.NUMBERED_FROM.get(c, 0)} AS VARCHAR), 3, '0') AS market_code, state FROM n WHERE {c} <> 0" for c, own in markets.AREA_COLUMNS.items() for p in own)
_COUNTY_SQL = f"""WITH counties AS ({_COUNTIES.format(customer="customer")}), n AS (
SELECT CASE lower(trim(STATE)) WHEN 'north dakota' THEN 'ND' WHEN 'minnesota' THEN 'MN' WHEN 'california' THEN 'CA' WHEN 'american samoas' THEN 'AS' END AS state, STATE AS filed, substr(FIPS, 1, 2) AS prefix,
  {", ".join(f"coalesce(try_cast(trim(cast({c} AS VARCHAR)) AS INTEGER), 0) AS {c}" for c in markets.AREA_COLUMNS)} FROM counties),
m(market_code, ea) AS (VALUES {", ".join(f"('{c}', {n})" for c, n in markets.maritime_parts())})"""


@_query(
    "",
    f"""{_COUNTY_SQL}, slc AS (SELECT 'SLC' || lpad(cast(row_number() OVER (ORDER BY s) AS VARCHAR), 3, '0') AS market_code, s AS state FROM (SELECT unnest([{", ".join(repr(s) for s in [*codes.USPS_STATES, "PW"])}]) AS s)),
p AS (SELECT s_suppkey % 400 + 1 AS number, CASE s_nationkey % 4 WHEN 0 THEN 'GM' WHEN 1 THEN 'TX' WHEN 2 THEN 'NY' ELSE '??' END AS state FROM supplier),
every AS ({_AREA_SQL} UNION ALL SELECT market_code, state FROM m JOIN n ON n.EA = m.ea UNION ALL SELECT unnest(['BTA494', 'BTA495']), NULL UNION ALL SELECT * FROM slc WHERE state <> 'PW'
  UNION ALL SELECT 'PEA' || lpad(cast(number AS VARCHAR), 3, '0'), CASE WHEN state IN ('TX', 'NY') THEN state END FROM p),
g AS (SELECT market_code, list(DISTINCT state) FILTER (state IS NOT NULL) AS states FROM every GROUP BY 1)
SELECT market_code, unnest(coalesce(states, [NULL])) AS state FROM g""",
)
def market_area_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states of every market area, of a county table made of customers and partial areas made of suppliers."""
    counties = spark.sql(_COUNTIES, customer=base_tables(spark, sf_dir)["customer"])
    partial = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey % 400 + 1 AS number", "CASE s_nationkey % 4 WHEN 0 THEN 'GM' WHEN 1 THEN 'TX' WHEN 2 THEN 'NY' ELSE '??' END AS state")
    return markets.area_states(counties, partial)


@_query(
    "",
    f"""{_COUNTY_SQL} SELECT DISTINCT 'unknown state' AS problem, filed AS what FROM n WHERE state IS NULL AND filed <> 'Gulf of Mexico'
UNION ALL SELECT 'prefix of two states', prefix FROM n WHERE state IS NOT NULL GROUP BY prefix HAVING count(DISTINCT state) > 1
UNION ALL SELECT 'maritime part of no county', m.market_code || ' ' || m.ea FROM m WHERE m.ea NOT IN (SELECT EA FROM n)""",
)
def market_county_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the same county table."""
    return markets.county_problems(spark.sql(_COUNTIES, customer=base_tables(spark, sf_dir)["customer"]))

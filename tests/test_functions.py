"""Parameters, decoding, bands, geometry and paging on small cases."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from airledger.functions import bands, geo, parameters
from airledger.functions import columns as C
from airledger.functions.parameters import QueryError
from airledger.operators import build, detail, paging, refresh, textsearch
from airledger.operators.redact import redact
from airledger.sources import bulk, records


def test_parameters():
    assert [parameters.callsign(x) for x in ("n0call/4", " w1aw / kh6", "KH6/W1AW", "k1a")] == ["N0CALL", "W1AW/KH6"[:4], "KH6/W1AW", "K1A"]
    assert parameters.frn("123-4567") == "0001234567" and parameters.market_code("pea16") == "PEA016" and parameters.market_code("d6037") == "D06037"
    assert parameters.state("new  york") == "NY" and parameters.state("tx") == "TX" and parameters.status("Cancelled") == "C" and parameters.status("ANY") == "any"
    assert parameters.band(0.8510125, None, "GHz") == (851.0125, 851.0125)
    for bad in ((None, 1.0), (2.0, 1.0), (1.0, 400000.0)):
        with pytest.raises(QueryError, match="high|max"):
            parameters.band(*bad)
    assert parameters.name_phrases("AT&T  Wireless É") == [["at", "t"], ["wireless"], ["e"]]
    assert parameters.coordinate("47-37-13.8 N", "latitude") == pytest.approx(47.62050)
    assert parameters.coordinate("122 20 57.5 W", "longitude") == pytest.approx(-122.349305, abs=1e-5)
    assert parameters.coordinate("91", "latitude") is None
    assert parameters.eastern_wall_time(dt.datetime(2026, 11, 1, 1, 30)) is None
    assert parameters.eastern_wall_time(dt.datetime(2026, 3, 8, 2, 30)) is None
    assert parameters.eastern_wall_time(dt.datetime(2026, 9, 27, 9, 38)) == dt.datetime(2026, 9, 27, 13, 38, tzinfo=dt.UTC)
    assert parameters.daily_code("l_PG_mon.zip") == "pg" and parameters.daily_code("l_pg.zip") is None


def test_fields(spark):
    rows = spark.createDataFrame([("  x ",), ("",), ("1e3",), ("0x10",), ("NaN",), ("02/30/2024",), (None,)], "v string")
    got = rows.select(C.text(F.col("v")), C.number(F.col("v")), C.date(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [("x", None, None), (None, None, None), ("1e3", 1000.0, None), ("0x10", None, None), ("NaN", None, None), ("02/30/2024", None, "2024-02-30"), (None, None, None)]
    names = spark.createDataFrame([("Acme L.L.C.",), ("TOWNSEND, Bob",), ("City of X",), ("P. A. Smith",), ("Smith-Jones LLP",)], "n string")
    assert [r[0] for r in names.select(C.has_organization_word(F.col("n"))).collect()] == [True, False, True, False, True]


def test_records(spark):
    hd = lambda usi, callsign, status: "|".join(["HD", usi, "", "", callsign, status, "MW"] + [""] * 52)
    lines = spark.createDataFrame([(hd("1", "K1", "a"), 0), (hd("1", "K2", "A"), 1), (hd("x", "K3", "A"), 2), ("HD|1", 3)], "value string, _seq long")
    made = records.decode(lines, "HD")
    assert [(r.usi, r.callsign, r.license_status) for r in made.orderBy("_seq").collect()] == [(1, "K1", "A"), (1, "K2", "A")]
    assert [tuple(r) for r in records.line_statistics(lines, "HD").collect()] == [("HD", 4, 2, 2)]
    assert [r.callsign for r in build.first_rows(made, ["usi"], ["_seq"]).collect()] == ["K1"]
    an = lambda number: "|".join(["AN", "1", "", "", "", "", number, "2"] + [""] * 30)
    lines = spark.createDataFrame([(an(""), 0), (an("3"), 1), (an("z"), 2)], "value string, _seq long")
    assert [r.antenna_number for r in records.decode(lines, "AN").orderBy("_seq").collect()] == [None, 3]


def test_lines_are_in_the_order_of_files_and_places(spark, tmp_path):
    for name, n in (("b.dat", 3), ("a.dat", 40_000)):
        (tmp_path / name).write_text("".join(f"{name} {i:06d}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        lines = records.read_lines(spark, str(tmp_path))
        assert lines.select(F.spark_partition_id()).distinct().count() > 2
        values = [r.value for r in lines.orderBy("_seq").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert values == sorted(values) and len(values) == 40_003


def test_lines_keep_inner_returns(spark, tmp_path):
    (tmp_path / "x.dat").write_bytes(b"a\rb\r\n\nc\xff\n")
    assert [r.value for r in records.read_lines(spark, str(tmp_path / "x.dat")).orderBy("_seq").collect()] == ["a\rb", "c�"]


def test_bulk_zip(spark, tmp_path):
    import zipfile

    (tmp_path / "complete").mkdir()
    with zipfile.ZipFile(tmp_path / "complete/l_micro.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("hd.DAT", "one\r\ntwo\n\n")
        z.writestr("counts", "File Creation Date: Sun Sep 27 09:38:53 EDT 2026\n 2 ./HD.dat\n")
    got = bulk.read_bulk(spark, str(tmp_path), "HD").orderBy("_seq").collect()
    assert [(r.service_group, r.value) for r in got] == [("micro", "one"), ("micro", "two")]
    counts = bulk.parse_counts("File Creation Date: Sun Sep 27 09:38:53 EDT 2026\n 2 ./HD.dat\n")
    assert counts.created_at == "2026-09-27T13:38:53Z" and counts.lines == {"HD": 2}
    page = '<a href="l_am_sun.zip">x</a> 2026-09-27 09:00 <a href="l_am_sun.zip">x</a> 2026-09-27 10:00 <a href="b.zip">b</a> 2026-09-27 10:00'
    assert [(x.name, x.modified is None) for x in bulk.parse_listing(page)] == [("b.zip", False), ("l_am_sun.zip", True)]


def test_bulk_zip_misses_nothing(spark, tmp_path):
    import zipfile

    (tmp_path / "complete").mkdir()
    head = lambda usi: "|".join(["HD", usi, "", "", "K1", "A", "MW"] + [""] * (records.LAYOUTS["HD"].fields - 7))
    with zipfile.ZipFile(tmp_path / "complete/l_micro.zip", "w") as z:
        z.writestr("HD.dat", "\n".join(head(str(i)) for i in range(1, 200)))
    got = bulk.read_bulk(spark, f"file://{tmp_path}", "HD", ["micro"])
    assert got.count() == 199 and got.select(F.spark_partition_id()).distinct().count() > 1
    hd = records.decode(got, "HD")
    none = {t: records.decode(got.where("false"), t) for t in ("EN", "AM", "MK")}
    assert {r.service_group for r in build.join_licences(hd, none["EN"], none["AM"], none["MK"]).collect()} == {"micro"}
    for root, groups in ((tmp_path, ["micro", "cell"]), (tmp_path / "none", None), (tmp_path, ["cell"])):
        with pytest.raises(Exception, match="missing_zip|l_"):
            bulk.read_bulk(spark, str(root), "HD", groups).collect()


def test_search_with_a_state_takes_areas_and_counties(spark):
    from airledger.operators import spectrum
    from airledger.plans.virtual import registry

    reg = registry(spark, "/root/testdata/sf0.001")
    areas = spark.createDataFrame([("BTA003", "ND"), ("BTA007", "ND"), ("BTA009", "SD")], "market_code string, state string")
    search = spectrum.SpectrumSearch(900, 1500, "market", state="ND")
    gulf = areas.unionByName(spark.createDataFrame([("BTA003", None)], areas.schema))
    assert spectrum.market_assignments(reg, search, True, gulf).where("market_code = 'BTA003'").count() == 0
    want = {(r.usi, r.lower, r.upper) for r in spectrum.market_assignments(reg, search, True, areas, "48").collect()}
    fewer = {(r.usi, r.frequency_mhz, r.upper_mhz) for r in spectrum.search_frequencies(reg, search).collect()}
    got = {(r.usi, r.frequency_mhz, r.upper_mhz) for r in spectrum.search_frequencies(reg, search, True, areas, "48").collect()}
    assert got == want and fewer < got
    assert spectrum.frequency_page(reg, search, area_states=areas, county_prefix="48").all_rows.count() == len(got)


def test_overlap_join_equals_nested_loop(spark):
    r = random.Random(5)
    side = lambda n: [(i, a := round(r.uniform(0, 3000), 4), round(a + r.choice([0, 0.01, 2, 90, 900, 2900]), 4)) for i in range(n)]
    a, b = side(300) + [(900, None, 1.0), (901, 5.0, 4.0)], side(200)
    x, y = spark.createDataFrame(a, "i long, lo double, hi double"), spark.createDataFrame(b, "j long, lo2 double, hi2 double")
    got = sorted((q.i, q.j) for q in bands.overlap_join(x, y, ("lo", "hi"), ("lo2", "hi2")).collect())
    want = sorted((i, j) for i, lo, hi in a for j, lo2, hi2 in b if lo is not None and lo <= hi and lo <= hi2 + bands.TOLERANCE and hi >= lo2 - bands.TOLERANCE)
    assert got == want


def test_market_areas_of_counties(spark):
    from airledger.operators import markets

    columns = ["STATE", "FIPS", *markets.AREA_COLUMNS]
    county = lambda state, fips, **areas: tuple([state, fips, *(str(areas.get(c, "")) for c in markets.AREA_COLUMNS)])
    rows = [
        county("North Dakota", "38017", CMA=580, EA=113, BTA=138, EAG_700=3), county("Minnesota", "27027", CMA=" 580 ", EA=113, BTA=0, EAG_220=2),
        county("Gulf of Mexico", "99001", EA=176), county("American Samoas", "60010", MTA=50), county("District of Columbia", "11001", EA=13), county("Atlantis", "11999", EA=174, RPC="x"), county(None, None),
    ]
    counties = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    partial = spark.createDataFrame([(1, "NY"), (1, "CT"), (417, "GM"), (2, "XX")], "number int, state string")
    got = {}
    for x in markets.area_states(counties, partial).collect():
        got.setdefault(x.market_code, []).append(x.state)
    got = {c: sorted(s, key=str) for c, s in got.items()}
    own = {"CMA580": ["MN", "ND"], "IVM580": ["MN", "ND"], "BEA113": ["MN", "ND"], "BTA138": ["ND"], "EAG703": ["ND"], "EAG002": ["MN"], "BEA176": [None], "MTA050": ["AS"], "BEA013": ["DC"], "BEA174": [None]}
    own |= {"AMT002": ["DC"], "AMT003": [None], "AMT004": ["MN", "ND"], "BTA494": [None], "BTA495": [None], "PEA001": ["CT", "NY"], "PEA417": [None], "PEA002": [None]}
    assert {c: s for c, s in got.items() if c[:3] != "SLC"} == own
    slc = {c: s for c, s in got.items() if c[:3] == "SLC"}
    assert len(slc) == 56 and slc["SLC001"] == ["AK"] and slc["SLC057"] == ["WY"] and ["PW"] not in slc.values()
    assert {x.county_prefix: x.state for x in markets.county_prefixes(counties).collect()} == {"38": "ND", "27": "MN", "60": "AS", "11": "DC"}
    problems = {(x.problem, x.what) for x in markets.county_problems(counties).collect()}
    assert ("unknown state", "Atlantis") in problems and ("maritime part of no county", "AMT008 172") in problems and ("maritime part of no county", "AMT004 113") not in problems
    assert ("prefix of two states", "38") in {(x.problem, x.what) for x in markets.county_problems(counties.unionByName(counties.withColumn("STATE", F.lit("Utah")))).collect()}
    assert markets.area_states(counties.limit(0)).where("market_code NOT LIKE 'SLC%'").count() == 2  # what lies at sea


def test_index_ranks_as_names_do(spark):
    r = random.Random(4)
    words = ["AT&T", "T-Mobile", "mobile", "Société", "du", "d", "Mob", "tt", "Radio", "42"]
    rows = [(i, r.choice([None, "", " - ", *(" ".join(r.choice(words) for _ in range(r.randint(1, 7))) for _ in range(12))])) for i in range(400)]
    df = spark.createDataFrame(rows, "usi long, n string")
    made = textsearch.postings(df, "usi", "n")
    counts = made.where("term = ''").agg(F.count("*"), F.count_if(F.col("len") > 0), F.sum("len")).first()
    index = textsearch.NameIndex(made, *counts)
    for asked in ("mob", "t-mob", "at&t mobile", "d", "du d", "societe du", "tt-tt", "radio radio mob", "none"):
        phrases = parameters.name_phrases(asked)
        want, got = ({x.usi: x.score for x in f.collect()} for f in (textsearch.rank(df, "usi", "n", phrases), textsearch.rank_by_index(index, "usi", phrases)))
        assert want.keys() == got.keys() and all(abs(want[u] - got[u]) < 1e-12 for u in want), asked
    assert textsearch.rank_by_index(textsearch.NameIndex(made.limit(0), 0, 0, 0), "usi", [["a"]]).count() == 0


def test_occupancy_equals_pairs(spark):
    r = random.Random(21)
    edge = lambda w: (lo := r.randint(0, 400) / 4, lo + r.choice([0, 0.25, 1, w]))
    rows = [(i, *edge(60), r.randint(1, 9)) for i in range(300)] + [(300, None, 5.0, 1), (301, 9.0, 2.0, 1), (302, 50.0, 50.0, None)]
    held = [(j, *edge(30)) for j in range(60)] + [(60, None, 1.0), (61, 7.0, 3.0), (62, 1000.0, 1001.0), (63, -5.0, 2000.0)]
    x, y = spark.createDataFrame(rows, "i long, lo double, hi double, w long"), spark.createDataFrame(held, "j long, lo2 double, hi2 double")
    want = {}
    for j, lo, hi in held:
        met = [q for q in rows if None not in (lo, hi, q[1], q[2]) and q[1] <= q[2] and lo <= hi and q[1] <= hi + bands.TOLERANCE and q[2] >= lo - bands.TOLERANCE]
        want[j] = (len(met), *((sum(q[0] for q in met), sum(q[3] or 0 for q in met), min(q[1] for q in met), max(q[2] for q in met)) if met else (None,) * 4))
    got = bands.occupancy(x, y, ("lo", "hi"), ("lo2", "hi2"), ["i", "w"])
    assert got.columns == ["j", "lo2", "hi2", "n", "i", "w", "lowest", "highest"]
    assert {q.j: (q.n, q.i, q.w, q.lowest, q.highest) for q in got.collect()} == want
    empty = bands.occupancy(x.limit(0), y, ("lo", "hi"), ("lo2", "hi2"), ["i"]).collect()
    assert len(empty) == 64 and {(q.n, q.i, q.lowest) for q in empty} == {(0, None, None)}
    assert bands.occupancy(x, y.limit(0), ("lo", "hi"), ("lo2", "hi2"), ["i"]).count() == 0


def test_overlap_join_compares_a_small_multiple_of_what_it_finds(spark):
    r = random.Random(7)
    for left, right in (([0, 0.0125], [0.025, 5]), ([0.01], [2500]), ([0.01, 3, 400], [0.0, 90, 2900])):
        side = lambda n, widths: [(a := r.uniform(0, 3000), a + r.choice(widths)) for _ in range(n)]  # noqa: B023, E731
        x, y = spark.createDataFrame(side(2000, left), "lo double, hi double"), spark.createDataFrame(side(500, right), "lo2 double, hi2 double")
        found = bands.overlap_join(x, y, ("lo", "hi"), ("lo2", "hi2")).count()
        assert bands.meetings(x, y, ("lo", "hi"), ("lo2", "hi2")).count() <= 4 * found + 200


def test_searches_check_what_is_asked(spark):
    from airledger.operators import licences, spectrum, transmitters
    from airledger.plans.virtual import registry

    reg = registry(spark, "/root/testdata/sf0.001")
    for ask, reason in (
        (lambda: spectrum.search_frequencies(reg, spectrum.SpectrumSearch(915, 905)), "invalid_frequency_range"),
        (lambda: spectrum.search_frequencies(reg, spectrum.SpectrumSearch(905, 915, unit="GHz")), "invalid_frequency_range"),
        (lambda: spectrum.search_frequencies(reg, spectrum.SpectrumSearch(905, 915, "sites")), "invalid_kind"),
        (lambda: spectrum.search_frequencies(reg, spectrum.SpectrumSearch(905, 915, status="Expired")), "invalid_status"),
        (lambda: spectrum.frequency_page(reg, spectrum.SpectrumSearch(905, 915, radio_service="zv")), "service_not_indexed"),
        (lambda: spectrum.search_frequencies(reg, spectrum.SpectrumSearch(905, 915, radio_service="??")), "unknown_radio_service"),
        (lambda: transmitters.find_transmitters(reg, transmitters.RadiusSearch(26.0, -118.25, 231)), "invalid_radius"),
        (lambda: transmitters.find_transmitters(reg, transmitters.RadiusSearch("26 N", -118.25, 200)), "invalid_coordinate"),
        (lambda: transmitters.find_transmitters(reg, transmitters.RadiusSearch(26.0, -181, 200)), "invalid_coordinate"),
        (lambda: transmitters.find_transmitters(reg, transmitters.RadiusSearch(26.0, -118.25, 200, radio_service="??")), "unknown_radio_service"),
        (lambda: licences.search_licences(reg, licences.LicenceSearch(radio_service="??")), "unknown_radio_service"),
        (lambda: licences.search_licences(reg, licences.LicenceSearch()), "no_criteria"),
        (lambda: licences.search_licences(reg, licences.LicenceSearch(expires_after="2030-01-01", expires_before="2020-01-01")), "invalid_date_range"),
    ):
        with pytest.raises(QueryError) as e:
            ask()
        assert e.value.reason == reason
    asked = transmitters.RadiusSearch("26-0-0 N", "118-15-0 W", 200, band=(0.902, 0.912), unit="ghz", location_type="f")
    same = transmitters.RadiusSearch(26.0, -118.25, 200, band=(902.0, 912.0), location_type="F")
    ids = lambda s: sorted((x.usi, x.location_number, x.site_seq) for x in transmitters.sites_in_radius(reg, s).collect())
    assert ids(asked) == ids(same) and ids(same)


def test_licence_pages_and_their_cursors(spark):
    from airledger.operators import licences
    from airledger.plans.virtual import registry

    reg = registry(spark, "/root/testdata/sf0.001")
    by_name = licences.LicenceSearch(licensee="Small", status="any")
    first = licences.search_licences(reg, by_name, 5, generation="g", refreshed="0-")
    names = [x.licensee_name for x in first.rows.collect()]
    assert first.total() > 5 and len(names) == 5 and all("small" in n.lower() for n in names)
    again = licences.search_licences(reg, licences.LicenceSearch(licensee="  SMÁLL ", status="ANY"), 5, first.next_cursor(), "g", refreshed="0-")
    assert {x.usi for x in again.rows.collect()}.isdisjoint({x.usi for x in first.rows.collect()})
    with pytest.raises(QueryError, match="invalid_cursor"):
        licences.search_licences(reg, by_name, 5, first.next_cursor(), "g", refreshed="1-x")
    by_state = licences.search_licences(reg, licences.LicenceSearch(radio_service="mw"), 5, generation="g", refreshed="0-")
    assert licences.search_licences(reg, licences.LicenceSearch(radio_service="MW"), 500, by_state.next_cursor(), "g", refreshed="1-x").rows.count() == by_state.total() - 5


def test_documents_equal_a_plain_builder(spark):
    import json

    from airledger.plans.virtual import registry

    reg = registry(spark, "/root/testdata/sf0.001")
    got = {x.usi: json.loads(x.document) for x in detail.documents(reg, reg.licenses.select("usi")).collect()}
    rows = {t: [x.asDict(recursive=True) for x in getattr(reg, t).collect()] for t in ("licenses", "locations", "antennas", "frequencies", "market_blocks", "paths", "lease_links")}
    by = lambda t, key="usi": {u: [x for x in rows[t] if x[key] == u] for u in {x[key] for x in rows[t]}}
    own = {t: by(t) for t in ("locations", "antennas", "frequencies", "market_blocks", "paths")}
    heads = {x["usi"]: x for x in rows["licenses"]}
    assert set(got) == set(heads)
    for usi, head in heads.items():
        d, mine = got[usi], {t: own[t].get(usi, []) for t in own}
        assert d["licensee_redacted"] == (head["is_individual"] is not False) and ("licensee_name" in d) == (head["licensee_name"] is not None and head["is_individual"] is False)
        numbers = {x["location_number"] for t in ("locations", "antennas", "frequencies", "paths") for x in mine[t]}
        assert d.get("location_count", 0) == len(numbers)
        assert [(x["location_number"], x["site_seq"]) for x in d.get("sites", [])] == sorted((x["location_number"], x["site_seq"]) for x in mine["locations"])
        numbered = {(x["location_number"], x["antenna_number"]) for x in mine["antennas"] if x["antenna_number"] is not None}
        assert len(d.get("antennas", [])) == len(numbered) + sum(x["antenna_number"] is None for x in mine["antennas"])
        assert sorted((x["location_number"], x["antenna_number"], x["freq_seq_id"]) for x in d.get("frequencies", [])) == sorted((x["location_number"], x["antenna_number"], x["freq_seq_id"]) for x in mine["frequencies"])
        assert len(d.get("paths", [])) == len(mine["paths"]) and len(d.get("market_blocks", [])) == len({(x["lower"], x["upper"]) for x in mine["market_blocks"]})
        held = [x for x in rows["lease_links"] if x["lease_usi"] == usi]
        assert [x.get("parent_callsign") for x in d.get("leases_held", [])] == [x["parent_callsign"] or heads.get(x["parent_usi"], {}).get("callsign") for x in held]
        granted = [x for x in rows["lease_links"] if x["parent_usi"] == usi and x["lease_usi"] in heads]
        assert [x["lease_usi"] for x in d.get("leases_granted", [])] == [x["lease_usi"] for x in granted] and "notice" not in d
        assert None not in d.values()


def test_radius_box_holds_circle(spark):
    r = random.Random(3)
    points = [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(3000)]
    df = spark.createDataFrame(points, "lat double, lon double")
    for lat0, lon0 in ((10.0, 179.5), (89.5, 0.0), (-45.0, -179.9)):
        near = F.col("d") <= 900
        d = df.withColumn("d", geo.distance_km(F.col("lat"), F.col("lon"), lat0, lon0))
        assert d.where(near).count() == d.where(near & geo.in_box(F.col("lat"), F.col("lon"), lat0, lon0, 900)).count() > 0


def test_cursor_walk_lists_every_row_once(spark):
    r = random.Random(1)
    rows = [(r.choice([None, "a", "b"]), i) for i in range(57)]
    df = spark.createDataFrame(rows, "k string, i long")
    keys, seen, cursor = [paging.Key("k"), paging.Key("i")], [], None
    while True:
        page = paging.page(df, keys, 10, ("g", "d"), cursor)
        seen += [(x.k, x.i) for x in page.rows.collect()]
        if (cursor := page.next_cursor()) is None:
            break
    assert seen == sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", x[1]))
    with pytest.raises(QueryError, match="invalid_cursor"):
        paging.decode(("other", "d"), paging.encode(("g", "d"), ["a", 1]), 2)


def test_window_budget_equals_greedy(spark):
    r = random.Random(2)
    rows = [(u, n, r.randint(0, 4), r.randint(0, 5), r.randint(0, 9), r.randint(0, 3)) for u in range(40) for n in range(r.randint(1, 9))]
    df = spark.createDataFrame(rows, "usi long, location_number long, sites long, antennas long, frequencies long, paths long")
    got = {}
    for x in detail.location_windows(df, 1, 10, (6, 9, 5)).orderBy("usi", "location_number").collect():
        got.setdefault(x.usi, []).append(x.location_number)
    want = {}
    for u in range(40):
        own, total = [x for x in rows if x[0] == u][1:], [0, 0, 0]
        for i, x in enumerate(own):
            total = [total[0] + x[2], total[1] + x[3], total[2] + x[5]]
            if i and (total[0] > 6 or total[1] > 9 or total[2] > 5):
                break
            want.setdefault(u, []).append(x[1])
    assert got == want


def test_redaction(spark):
    df = spark.createDataFrame([(1, True, "a", "t"), (2, False, "b", "t"), (3, None, "c", "t")], "usi long, is_individual boolean, licensee_name string, trustee_name string")
    assert [(x.licensee_name, x.trustee_name, x.licensee_redacted) for x in redact(df).orderBy("usi").collect()] == [(None, None, True), ("b", None, False), (None, None, True)]
    assert [x.licensee_name for x in redact(df, False).orderBy("usi").collect()] == ["a", "b", "c"]


def test_folded_names(spark):
    df = spark.createDataFrame([(1, "Société Générale"), (2, "societe of ÅNGSTRÖM"), (3, None)], "usi long, n string")
    got = textsearch.rank(df, "usi", "n", parameters.name_phrases("sociét")).collect()
    assert sorted(x.usi for x in got) == [1, 2]


def test_refresh():
    at = lambda d, h=12: dt.datetime(2026, 9, d, h, tzinfo=dt.UTC)
    daily = lambda d, code="am", group="amat": refresh.Daily(f"l_{code}_{d}", code, dt.date(2026, 9, d), at(d, 20), group)
    files = [daily(22), daily(21), daily(23, "zz", None)]
    assert [f.day.day for f in refresh.pending(files, {"amat"}, at(20), {"l_am_21": at(21, 20)})] == [22]
    refresh.check_complete([daily(21), daily(22)], {"am"}, at(20))
    for bad in ([daily(22)], [daily(28), *[daily(d) for d in range(21, 28)]]):
        with pytest.raises(QueryError, match="stale_checkpoint|am"):
            refresh.check_complete(bad, {"am"}, at(20))


def test_generations(spark, tmp_path):
    from airledger.plans.virtual import registry
    from airledger.sources.generations import Manifest, Store

    store = Store(spark, f"file://{tmp_path}/store")
    with pytest.raises(QueryError, match="index_not_ready"):
        store.current()
    reg = registry(spark, "/root/testdata/sf0.001")
    name = store.new_name(dt.datetime(2026, 9, 27))
    store.write(reg, Manifest(name, ["micro"], "2026-09-27T00:00:00Z"), files=2)
    store.publish(name)
    assert sum(p.rows for p in store.current().base["licenses"].values()) == 1500 and store.damaged(store.current()) == [] and store.open().locations.count() == 6000
    assert store.new_name(dt.datetime(2026, 9, 27)) != name and store.collect_garbage(set()) == []


def test_get_licence(spark):
    from airledger.operators import reference
    from airledger.plans.virtual import registry

    reg = registry(spark, "/root/testdata/sf0.001")
    for bad, reason in (({}, "identifier_required"), ({"callsign": "K1", "usi": 1}, "identifier_required"), ({"usi": 1, "location_offset": 1, "location_number": 1}, "location_start_conflict")):
        with pytest.raises(QueryError) as e:
            detail.get_licence(reg, **bad)
        assert e.value.reason == reason
    made = detail.get_licence(reg, callsign="k 150", location_offset=1)
    head = made["licence"].first()
    assert head.callsign == "K150" and made["other_records"].count() == 2
    assert [x.position for x in made["locations"].collect()][:1] == [1]
    assert {x.location_number for x in made["sites"].collect()} <= {x.location_number for x in made["locations"].collect()}
    assert detail.get_licence(reg, usi=head.usi, location_number=3)["locations"].count() <= made["locations"].count() + 1
    assert list(detail.get_licence(reg, callsign="K1500")) == ["candidates"]
    assert '"callsign":"K150"' in detail.licence_document(reg, "K150").first().document
    with pytest.raises(QueryError, match="K1500"):
        detail.licence_document(reg, "K1500")
    assert reference.require_service("MW", {"MW"}) == "MW"
    for code, reason in (("CL", "service_not_indexed"), ("??", "unknown_radio_service")):
        with pytest.raises(QueryError) as e:
            reference.require_service(code, {"MW"})
        assert e.value.reason == reason


def test_refresh_falls_back_once():
    calls = []

    def stale():
        calls.append("refresh")
        if calls.count("refresh") == 1:
            raise QueryError("stale_checkpoint")

    assert refresh.refresh_or_rebuild(stale, lambda: calls.append("rebuild") or True) == "rebuilt" and calls == ["refresh", "rebuild", "refresh"]
    calls.clear()
    with pytest.raises(QueryError):
        refresh.refresh_or_rebuild(stale, lambda: False)


def test_build_from_records(spark):
    def line(type_, **values):
        layout = records.LAYOUTS[type_]
        fields = [type_] + [""] * (layout.fields - 1)
        for position, name, _ in layout.columns():
            fields[position - 1] = str(values.get(name, ""))
        return "|".join(fields)

    filed = {
        "HD": [line("HD", usi=1, callsign="K1", license_status="a", radio_service_code="MW"), line("HD", usi=1, callsign="K9", license_status="A", radio_service_code="MW"), line("HD", usi=2, callsign="L000000001", license_status="E", radio_service_code="HA"), line("HD", usi=3, license_status="", radio_service_code="MW")],
        "EN": [line("EN", usi=1, entity_type="L", entity_name="Acme L.L.C.", state="ND"), line("EN", usi=1, entity_type="CL", entity_name="contact"), line("EN", usi=2, entity_type="L", entity_name="A Person", part_1="A")],
        "AM": [line("AM", usi=2, operator_class="E")],
        "MK": [line("MK", usi=1, market_code="BTA001", market_name="Fargo, ND-MN")],
        "LL": [line("LL", lease_usi=2, parent_usi=1)],
        "LO": [line("LO", usi=1, location_number=1, lat_d=40, lat_m=30, lat_s=0, lat_h="N", lon_d=100, lon_m=0, lon_s=0, lon_h="W"), line("LO", usi=1, location_number=1, lat_d=0, lat_m=0, lat_s=0, lat_h="N", lon_d=0, lon_m=0, lon_s=0, lon_h="E"), line("LO", usi=2, location_number=1)],
        "AN": [line("AN", usi=1, location_number=1, antenna_number=""), line("AN", usi=1, location_number=1, antenna_number="x")],
        "FR": [line("FR", usi=1, location_number=1, antenna_number=1, freq_seq_id=1, frequency_mhz=470), line("FR", usi=1, location_number=1, antenna_number=1, freq_seq_id=2, frequency_mhz=100, upper_mhz=101)],
        "EM": [line("EM", usi=1, location_number=1, antenna_number=1, freq_seq_id=1, emission_code=c) for c in ("11K2F3E", "6M00D1D", "5G75C3F", "11K2F3E")],
        "MF": [line("MF", usi=1, lower=700, upper=710), line("MF", usi=1, lower=0, upper=5)],
        "PA": [line("PA", usi=1, path_number=1, location_number=1, antenna_number=1, receive_location_number=2, passive_receiver="y")],
    }
    decoded = {t: records.decode(spark.createDataFrame([(x, i) for i, x in enumerate(own)], "value string, _seq long"), t) for t, own in filed.items()}
    reg = build.build(decoded)
    got = {x.usi: x for x in reg.licenses.collect()}
    assert sorted(got) == [1, 2] and got[1].callsign == "K1" and got[1].market_states == ["ND", "MN"] and not got[1].is_individual
    assert got[2].is_individual and got[2].is_lease and got[2].operator_class == "E"
    assert [(x.site_seq, x.lat, x.lon) for x in reg.locations.orderBy("site_seq").collect()] == [(1, 40.5, -100.0), (2, None, None)]
    fr = {x.freq_seq_id: x for x in reg.frequencies.collect()}
    assert fr[1].emissions == ["11K2F3E", "5G75C3F", "6M00D1D"] and (fr[1].bandwidth_mhz, fr[1].occ_low, fr[1].occ_high, fr[1].band_class) == (6.0, 467.0, 473.0, 3)
    assert (fr[2].bandwidth_mhz, fr[2].occ_low, fr[2].occ_high, fr[2].band_class) == (None, 100.0, 101.0, 0)
    assert reg.antennas.count() == 1 and [x.band_class for x in reg.market_blocks.orderBy("lower").collect()] == [None, 4]
    assert [x.passive_receiver for x in reg.paths.collect()] == [True] and reg.lease_links.count() == 1


def test_site_states_filed_and_derived(spark, tmp_path):
    import json

    square = [[-105.0, 30.0], [-90.0, 30.0], [-90.0, 45.0], [-105.0, 45.0], [-105.0, 30.0]]
    hole = [[-100.0, 35.0], [-95.0, 35.0], [-95.0, 40.0], [-100.0, 40.0], [-100.0, 35.0]]
    far = [[[[10.0, 10.0], [11.0, 10.0], [11.0, 11.0], [10.0, 10.0]]]]
    features = [{"properties": {"state": "BB"}, "geometry": {"type": "Polygon", "coordinates": [square, hole]}}, {"properties": {"state": "CC"}, "geometry": {"type": "MultiPolygon", "coordinates": far}}]
    (tmp_path / "states.json").write_text(json.dumps({"features": features}))
    state_at = geo.state_of(F.col("lat"), F.col("lon"), geo.load_polygons(str(tmp_path / "states.json")))
    rows = [(1, "tx", 32.0, -92.0), (2, None, 32.0, -92.0), (3, None, 37.0, -97.0), (4, None, None, None), (5, None, 10.2, 10.5)]
    made = build.with_site_state(spark.createDataFrame(rows, "usi long, state string, lat double, lon double"), state_at)
    got = {x.usi: (x.site_state, x.state_derived) for x in made.collect()}
    assert got == {1: ("TX", False), 2: ("BB", True), 3: (None, False), 4: (None, False), 5: ("CC", True)}


def test_states_by_cells_equal_those_by_all_edges(spark):
    from airledger.operators.areas import StateCells

    r = random.Random(5)
    ring = lambda x, y, d, n: [(x + d * r.uniform(0.6, 1) * math.cos(2 * math.pi * i / n), y + d * r.uniform(0.6, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    polygons = [
        ("AA", [box(-100.0, 30.0, 4.0, 3.0), box(-98.5, 31.25, 0.5, 0.75)]),  # sides on cells' sides, with a hole
        ("BB", [ring(-97.0, 31.0, 3.0, 200), ring(-97.0, 31.0, 0.8, 9)]),  # overlaps the first
        ("CC", [box(-93.93, 30.03, 0.1, 0.1), box(-92.93, 30.03, 0.01, 0.01)]),  # inside one cell each
        ("DD", [[(-92.0, 28.0), (-88.0, 28.0), (-88.1, 33.0), (-90.0, 28.5), (-91.9, 33.0)]]),
        ("EE", [ring(-0.1, 0.1, 2.0, 50)]),  # around both zeros
    ]
    points = [(-100 + i / 16, 27 + j / 16) for i in range(0, 210) for j in range(0, 120)]
    points += [(r.uniform(-101, -87), r.uniform(27, 35)) for _ in range(4000)] + [(r.uniform(-3, 3), r.uniform(-3, 3)) for _ in range(2000)]
    points += [p for _, rings in polygons for own in rings for p in own] + [(r.uniform(-93.95, -93.8), r.uniform(30, 30.15)) for _ in range(300)]
    points += [(None, 31.0), (-99.0, None), (float("nan"), 31.0), (-99.0, float("nan")), (1e300, 31.0), (-99.0, float("-inf")), (-99.0, 30.5), (-99.0, 30.5)]
    df = spark.createDataFrame(points, "lon double, lat double").withColumn("ix", F.lit("clash"))
    df = df.withColumn("want", geo.state_of(F.col("lat"), F.col("lon"), polygons))
    for cells in (1, 4, 16):
        index = StateCells(spark, polygons, cells)
        got = index.locate(df, "got").collect()
        assert len(got) == len(points) and [x for x in got if x["got"] != x["want"]] == []
        assert {x["got"] for x in got} == {"AA", "BB", "CC", "DD", "EE", None}
    index.small = False  # a shuffle gives the same
    assert index.locate(df, "got").where("got IS DISTINCT FROM want").count() == 0
    assert index.locate(df, "got", where=F.col("lat") > 31).where("got IS NOT NULL AND lat <= 31").count() == 0
    none = StateCells(spark, [])
    assert none.locate(df, "got").where("got IS NOT NULL").count() == 0 and index.locate(df.limit(0), "got").count() == 0
    # Few cells hold edges, and those few edges.
    own = index.cover.selectExpr("ix", "explode(polygons) AS p").selectExpr("size(p.edges) AS n").collect()
    assert sum(x.n == 0 for x in own) > 0.7 * len(own) and max(x.n for x in own) < 60
    filed = spark.createDataFrame([(1, "tx", 30.5, -99.0), (2, None, 30.5, -99.0), (3, None, 0.0, -50.0)], "usi long, state string, lat double, lon double")
    assert {x.usi: (x.site_state, x.state_derived) for x in build.with_site_state(filed, index).collect()} == {1: ("TX", False), 2: ("AA", True), 3: (None, False)}
    assert str(StateCells(spark, polygons, 16)) == str(index) != str(StateCells(spark, polygons, 4))


def test_limits_are_clamped(spark):
    from airledger.operators import spectrum
    from airledger.plans.virtual import registry

    assert parameters.clamp(500, 200) == 200 and parameters.clamp(5, 200) == 5
    reg = registry(spark, "/root/testdata/sf0.001")
    page = spectrum.frequency_page(reg, spectrum.SpectrumSearch(900, 1500), limit=5000)
    assert page.rows.count() == 200 < page.total()


def test_designators_are_read_with_one_pattern(spark):
    """What a pattern's groups would give, and a row is matched against one pattern only."""
    codes = ["6M00D1D", " 16k0f3e ", "12K3", "K123F3E", "120H", "1G25X", "12K", "6M0", "1M2M", "bad", "", None, "12K\n", "123", "1234", "١M00", "12K3", "12K3\n", ".M00", "1.5M"]
    made = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, c string").select("i", C.emission_mhz(F.col("c")).alias("mhz"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan and plan.count("RLIKE") == 1
    expected = [6.0, 0.016, 0.0123, 0.000123, 120 / 1e6, 1250.0] + [None] * 11 + [0.0123] + [None] * 2
    assert [r.mhz for r in made.orderBy("i").collect()] == expected


def test_summaries_and_windows_have_one_shuffle(spark):
    """Narrow rows are dealt by licence once, in as many tasks as shuffles have: neither groups nor windows deal again."""
    from airledger.plans.virtual import registry

    reg = registry(spark, "/root/testdata/sf0.001")
    # The virtual frequencies have a join of their own.
    reg.frequencies = reg.antennas.select("usi", "location_number", "antenna_number")
    summary = detail.location_summary(reg)
    for made in (summary, detail.location_windows(summary), detail.offset_of(summary, 4)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(usi") == plan.count("Exchange") == 1
    assert detail.location_summary(reg, 1).rdd.getNumPartitions() == 1
    assert sorted(map(tuple, detail.location_summary(reg, 1).collect())) == sorted(map(tuple, summary.collect()))


def test_first_pages_are_the_windows_as_ranges(spark):
    r = random.Random(5)
    rows = [(u, n, r.randint(0, 20), r.randint(0, 40), r.randint(0, 60), r.randint(0, 30)) for u in range(60) for n in r.sample([None, *range(12)], r.randint(1, 9))]
    df = spark.createDataFrame(rows, "usi long, location_number long, sites long, antennas long, frequencies long, paths long")
    windows = {}
    for x in detail.location_windows(df).orderBy("usi", "position").collect():
        windows.setdefault(x.usi, []).append(x)
    pages = {x.usi: x for x in detail.first_pages(df).collect()}
    assert pages.keys() == windows.keys()
    for u, own in windows.items():
        page, numbers = pages[u], [n for _, n, *_ in [x for x in rows if x[0] == u]]
        held = lambda last: {n for n in numbers if n is not None and last is not None and page.first <= n <= last}  # noqa: E731, B023
        assert held(page.last) == {x.location_number for x in own} - {None}
        before, some = 0, set()
        for x in own:
            some |= {x.location_number} if before < 100 else set()
            before += x.frequencies
        assert held(page.last_frequency) == some - {None}
        assert (page.location_count, page["__listed"], page["__cut"]) == (len(numbers), len(own), any(x.cut for x in own))


def test_documents_group_their_lists_once(spark):
    """Lists of all parts are made by one grouping; targets that are told twice, or that no licence has, add nothing."""
    from airledger.plans.virtual import registry

    reg = registry(spark, "/root/testdata/sf0.001")
    some = reg.licenses.where("usi < 40").select("usi")
    made = detail.documents(reg, some.unionByName(some).unionByName(spark.createDataFrame([(-5,)], "usi long")))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert len([line for line in plan.splitlines() if "Aggregate" in line and "collect_list" in line]) == 1
    got = made.collect()
    assert len(got) == some.count() and {x.usi for x in got} == {x.usi for x in some.collect()}


def test_dealt_documents_are_grouped_as_they_lie(spark):
    """Rows that lie in buckets of the licence are summed up, listed and grouped without a shuffle; documents are the same."""
    from airledger.plans.catalogue import QUERIES
    from airledger.plans.virtual import registry

    sf = "/root/testdata/sf0.001"
    made = QUERIES["q2_licence_documents"](spark, sf)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Union")]
    # What is shuffled: leases, to parents or lessees and back, and market blocks, whose lines are broadcast here.
    assert plan.count("Exchange hashpartitioning") == 8
    reg = registry(spark, sf)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, detail.documents(reg, reg.licenses.select("usi")).collect()))


def test_path_ends_in_groups_are_those_of_joins(spark):
    r = random.Random(8)
    some = lambda *values: r.choice([None, *values])
    locations = [(some(1, 2, 3), some(1, 2, 3), some(10.0, 20.0), some(-1.0, -2.0)) for _ in range(25)]
    antennas = [(some(1, 2, 3), some(1, 2, 3), some(1, 2, 2**40)) for _ in range(25)]
    rows = [(some(1, 2, 3), some(1, 2, 3, 4), some(1, 2, 3), i) for i in range(120)]
    reg = build.Registry(None, None, spark.createDataFrame(locations, "usi long, location_number int, lat double, lon double"), spark.createDataFrame(antennas, "usi long, location_number int, antenna_number long"), None, None, spark.createDataFrame(rows, "usi long, receive_location_number int, receive_antenna_number int, path_number int"))
    got = detail.paths(reg)
    assert got.columns == ["usi", "receive_location_number", "receive_antenna_number", "path_number", "receive_lat", "receive_lon", "receive_sites", "receive_antenna_filed"]
    want = []
    for u, n, a, i in rows:
        own = [x for x in locations if None not in x[:2] and x[:2] == (u, n)]
        one = own[0][2:] if len(own) == 1 and None not in own[0] else (None, None)
        want.append((u, n, a, i, *one, None if len(own) == 1 else len(own), None if a is None or (u, n, a) in antennas and None not in (u, n) else False))
    assert sorted(map(tuple, got.collect()), key=lambda x: x[3]) == want

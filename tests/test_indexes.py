"""Pages and totals from kept assignments and counts, and radius pages by rings, against searches of the plain tables."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from airledger.functions import geo
from airledger.functions.parameters import QueryError
from airledger.operators import assignments, build, spectrum, transmitters
from airledger.sources.generations import CLUSTERED, Manifest, Store
from airledger.sources.ingest import Ingest
from tests.test_ingest import daily_feed, feed  # noqa: F401

SHOWN = ["kind", "frequency_mhz", "usi", "location_key", "upper_key", "bandwidth_mhz", "erp_w", "class_stations", "emissions", "site_count", "site_state", "lat", "callsign", "licensee_name", "service_label"]


def small(spark, seed=3):
    """A registry with repeated rows, bands around one frequency, blocks that end before they begin and odd bandwidths."""
    r = random.Random(seed)
    licences = [(u, f"K{u}", r.choice("AALXEC"), r.choice(["MW", "CL"]), f"Name {u}", f"{u % 3:010d}", r.choice(["BTA001", None]), u % 5 == 0, "micro", []) for u in range(40)]
    sites = [(u, n, s, s, 30 + r.random() * 4, -100 + r.random() * 4, "F", "T", "A St", "Town", None, "TX") for u in range(40) for n in (1, 2) for s in range(1, r.randint(1, 3))]
    rows = []
    for u in range(40):
        for _ in range(30):
            mhz = r.choice([100.0, 100.25, 100.1, 101.0, 99.999, 450.0])
            rows.append((u, r.choice([1, 2, 3]), r.choice([1, None]), 1, r.choice(["FB", "MO", None]), mhz, r.choice([None, None, mhz + 0.5, mhz - 1]), r.choice([None, 0.0, 0.1, 0.5, 2.0, -0.3]), r.choice([None, 5.0, 9.0]), None, r.choice([None, ["11K2F3E"], ["1M00W7D", "11K2F3E"]])))
    rows += rows[:50] + [(1, 1, 1, 1, "FB", None, None, None, None, None, None)]
    blocks = [(r.randint(0, 39), r.choice([0.0, 100.0, 100.5, None]), r.choice([None, 100.0, 100.75, 90.0]), r.choice([0, 1, 2])) for _ in range(60)]
    frame = spark.createDataFrame
    frequencies = frame(rows, "usi long, location_number int, antenna_number int, freq_seq_id int, class_station string, frequency_mhz double, upper_mhz double, bandwidth_mhz double, erp_w double, eirp_dbm double, emissions array<string>")
    return build.Registry(
        frame(licences, "usi long, callsign string, license_status string, radio_service_code string, licensee_name string, frn string, market_code string, is_individual boolean, service_group string, market_states array<string>"),
        frame([], "lease_usi long, parent_usi long"),
        frame(sites, "usi long, location_number int, site_seq int, _seq int, lat double, lon double, location_type string, location_class string, address string, city string, asr_number string, site_state string"),
        frame([], "usi long"),
        build.with_band(frequencies),
        build.market_block_rows(frame(blocks, "usi long, lower double, upper double, partition_area_id int")),
        frame([], "usi long"),
    )


def rows_of(df, like=None):
    return sorted(str(tuple(x)) for x in df.select(*[c for c in SHOWN if c in (like or df).columns]).collect())


def test_index_finds_what_tables_hold(spark):
    plain = small(spark)
    held = spectrum.entries(plain).cache()
    kept = replace(plain, spectrum=assignments.SpectrumIndex(held, assignments.counted(held).cache()))
    assert {r.role for r in held.select("role").distinct().collect()} == {assignments.OTHER, assignments.WIDEST, assignments.ODD}
    asked = [spectrum.SpectrumSearch(100.0), spectrum.SpectrumSearch(100.25, 100.25), spectrum.SpectrumSearch(99, 101, "site"), spectrum.SpectrumSearch(90, 500, status="any"), spectrum.SpectrumSearch(99.9, 100.6, "market", status="any"), spectrum.SpectrumSearch(99, 101, radio_service="MW", status="any"), spectrum.SpectrumSearch(99, 451, frn="1"), spectrum.SpectrumSearch(700, 800)]
    r = random.Random(5)
    asked += [spectrum.SpectrumSearch(low, low + r.choice([0.0, 0.01, 1.0]), r.choice(["site", "both"]), status=r.choice(["A", "any"])) for low in (r.uniform(98.5, 101.5) for _ in range(4))]
    for search in asked:
        every, by_index = spectrum.search_frequencies(plain, search), spectrum.frequency_page(kept, search)
        normal = search.normalised()
        assert rows_of(every) == rows_of(spectrum.redact(assignments.found(kept.spectrum, normal).withColumn("service_label", spectrum.C.label(F.col("radio_service_code"), spectrum.codes.RADIO_SERVICES))), every), search
        assert by_index.total() == every.count(), search


def test_pages_follow_each_other(spark):
    plain = small(spark, 4)
    held = spectrum.entries(plain).cache()
    kept = replace(plain, spectrum=assignments.SpectrumIndex(held, assignments.counted(held).cache()))
    search, key = spectrum.SpectrumSearch(90, 500, status="any"), [k.name for k in spectrum.ORDER]
    wanted = [tuple(x) for x in spectrum.frequency_page(plain, search, 200).rows.select(*key).collect()]
    cursor, got = None, []
    for _ in range(5):
        page = spectrum.frequency_page(kept, search, 40, cursor, "g")
        got += [tuple(x) for x in page.rows.select(*key).collect()]
        cursor = page.next_cursor()
        assert page.total() == spectrum.frequency_page(plain, search, 40, cursor, "g").total() > 200
    assert got == wanted and assignments.page_end(kept.spectrum, search.normalised(), None, 40) is not None
    with pytest.raises(QueryError, match="invalid_cursor"):
        spectrum.frequency_page(kept, search, cursor="x")
    empty = replace(plain, spectrum=assignments.SpectrumIndex(held.limit(0), assignments.counted(held.limit(0))))
    none = spectrum.frequency_page(empty, search)
    assert none.total() == 0 and none.rows.count() == 0 and none.next_cursor() is None


def test_rings_hold_a_page(spark):
    plain = small(spark, 6)
    kept = replace(plain, site_cells=transmitters.sites_by_cell(plain.locations, plain.licenses).cache())
    key = [k.name for k in transmitters.ORDER]
    for search in (transmitters.RadiusSearch(32.0, -98.0, 230, status="any"), transmitters.RadiusSearch(30.1, -99.9, 200), transmitters.RadiusSearch(32.0, -98.0, 5), transmitters.RadiusSearch(32.0, -98.0, 230, location_type="F")):
        wanted = [tuple(x) for x in transmitters.sites_in_radius(plain, search).orderBy(*[k.order() for k in transmitters.ORDER]).select(*key).collect()]
        cursor, got = None, []
        while True:
            page = transmitters.find_transmitters(kept, search, 4, cursor=cursor, generation="g")
            got += [tuple(x) for x in page.all_rows.orderBy(*[k.order() for k in transmitters.ORDER]).limit(4).select(*key).collect()]
            assert page.total() == len(wanted)
            if (cursor := page.next_cursor()) is None or len(got) > 11:
                break
        assert got == wanted[: len(got)] and (len(got) > 11 or len(got) == len(wanted))
    wide = transmitters.RadiusSearch(32.0, -98.0, 230, status="any").normalised()
    first, next_one = (transmitters.ring(kept.site_cells, wide, 4, start) for start in (0.0, 60.0))
    assert first < next_one < 230 and transmitters.ring(kept.site_cells, wide, 10_000) is None
    assert transmitters.ring(kept.site_cells, replace(wide, location_type="F"), 4) is None


def test_curve(spark):
    points = spark.createDataFrame([(-90.0, -180.0), (90.0, 180.0), (None, None), (0.0, 0.0), (30.0, -100.0), (30.001, -100.001)], "lat double, lon double")
    got = [r[0] for r in points.selectExpr(geo.curve("lat", "lon")).collect()]
    assert got[0] == got[2] == 0 and got[1] == 2**32 - 1 and got[3] == 2**31 + 2**30 and abs(got[4] - got[5]) < 64
    # Of 256 ranges of equal size, a 50 km box meets far fewer along the curve than along latitude.
    many = spark.range(200_000).select((24 + F.rand(1) * 25).alias("lat"), (-125 + F.rand(2) * 58).alias("lon")).cache()
    (south, north), ((west, east),) = geo.box(38.0, -97.0, 50)

    def met(order):
        ranges = many.select("lat", "lon", F.ntile(256).over(build.Window.orderBy(F.expr(order))).alias("t")).groupBy("t").agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d"))
        return ranges.where((F.col("a") <= north) & (F.col("b") >= south) & (F.col("c") <= east) & (F.col("d") >= west)).count()

    assert met(geo.curve("lat", "lon")) * 2 <= met("lat")


def test_indexes_are_kept_through_refreshes(spark, tmp_path, feed):  # noqa: F811
    ingest = Ingest(spark, Store(spark, f"file://{tmp_path}/s", buckets=4), f"file://{feed}")
    ingest.rebuild()
    built = ingest.store.current()
    daily_feed(feed, 2, ("mw", "cl"))
    assert ingest.refresh()
    r = ingest.store.open()
    plain = replace(r, spectrum=None, site_cells=None)
    assert rows_of(r.spectrum.entries) == rows_of(spectrum.entries(plain))
    counts = lambda df, *by: sorted(tuple(x) for x in df.groupBy(*by).agg(F.sum("n").alias("n")).where("n > 0").collect())
    by = ("kind_order", "license_status", "edge", "bin")
    assert counts(r.spectrum.counts, *by) == counts(assignments.counted(spectrum.entries(plain)), *by) != []
    by = ("y", "x", "license_status")
    assert counts(r.site_cells, *by) == counts(transmitters.sites_by_cell(plain.locations, plain.licenses), *by) != []
    for search in (spectrum.SpectrumSearch(100, 140), spectrum.SpectrumSearch(105, status="any")):
        assert spectrum.frequency_page(r, search).total() == spectrum.frequency_page(plain, search).total()
    assert ingest.verify() == [] and ingest.store.open(built.name).spectrum.counts.count() > 0


def test_a_page_reads_its_own_range(spark, tmp_path):
    from airledger.plans.virtual import registry

    store = Store(spark, f"file://{tmp_path}/s", buckets=4)
    store.write(registry(spark, "/root/testdata/sf0.001"), Manifest("generation-20260101T000000Z", ["micro"], ""))
    store.publish("generation-20260101T000000Z")
    r = store.open()
    page = spectrum.frequency_page(r, spectrum.SpectrumSearch(900, 1500), 20)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        plan = page.rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert plan.count("FileScan") == 1 and "LessThan(frequency_mhz," in plan and "GreaterThanOrEqual(occ_high," in plan
    assert "Join" not in plan and set(CLUSTERED) <= set(store.current().base)


def test_entries_deal_frequencies_and_sites_once(spark):
    """One shuffle of both by licence: only licences and blocks are dealt besides, and a number's sites are as before."""
    from airledger.operators import assignments

    licences = spark.createDataFrame([(u, f"K{u}", "A", "MW", "n", "f", None, False) for u in range(5)], "usi long, callsign string, license_status string, radio_service_code string, licensee_name string, frn string, market_code string, is_individual boolean")
    frequencies = spark.createDataFrame(
        [(u, n, 100.0 + u, None, 99.9 + u - w, 100.1 + u + w, 0.2, 1.0 + w, c, [e]) for u in range(5) for n in (None, 1, 2, 3) for w, c, e in ((0.0, "FX", "b"), (0.5, "FB", "a"), (0.5, None, "a"))],
        "usi long, location_number long, frequency_mhz double, upper_mhz double, occ_low double, occ_high double, bandwidth_mhz double, erp_w double, class_station string, emissions array<string>",
    )
    locations = spark.createDataFrame([(u, n, f"city {u}", 10.0 + u, 20.0) for u in range(4) for n in (None, 1, 2, 2)], "usi long, location_number long, city string, lat double, lon double")
    blocks = spark.createDataFrame([(1, 50.0, 60.0, [1]), (9, 50.0, 60.0, [1])], "usi long, lower double, upper double, partition_areas array<long>")
    made = assignments.entries(licences, frequencies, locations, blocks)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = assignments.entries(licences, frequencies, locations, blocks)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(usi") == plan.count("Exchange hashpartitioning") == 4
    sites = [x for x in made.collect() if x.kind_order == 1]
    assert len(sites) == 5 * 4 * 2 and made.where("kind_order = 0").count() == 1
    for x in sites:
        has = 0 if x.usi == 4 else {1: 1, 2: 2}.get(x.location_number, 0)
        assert (x.site_count, x.city, x.lat) == (has, *((f"city {x.usi}", 10.0 + x.usi) if has == 1 else (None, None)))
        assert (x.role == assignments.WIDEST) == (x.erp_w == 1.5) == (x.emissions == ["a"]) == (x.class_stations == ["FB"])

"""From zips to a published registry, through daily refreshes, to verification."""

import datetime as dt
import io
import json
import os
import random
import re
import struct
import subprocess
import sys
import zipfile
from dataclasses import asdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from airledger.functions import codes, parameters
from airledger.functions.parameters import QueryError
from airledger.operators import licences, reference, spectrum, textsearch, transmitters
from airledger.sources import bulk, records
from airledger.sources.generations import CLUSTERED, Manifest, Store, data_as_of, newest_applied
from airledger.sources.ingest import Ingest


def line(type_, **values):
    layout = records.LAYOUTS[type_]
    fields = [type_] + [""] * (layout.fields - 1)
    for position, name, _ in layout.columns():
        fields[position - 1] = str(values.get(name, ""))
    return "|".join(fields)


def write_zip(path, at, created, files, counts=None):
    os.makedirs(path.parent, exist_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for t, own in files.items():
            z.writestr(f"{t}.dat", "\r\n".join(own) + "\n")
        number = {t: len(own) for t, own in files.items()} | (counts or {})
        z.writestr("counts", f"File Creation Date: {created}\n" + "".join(f" {n} ./{t}.dat\n" for t, n in number.items()))
    os.utime(path, (at.timestamp(), at.timestamp()))


def head(usi, callsign, status="A", service="MW"):
    return line("HD", usi=usi, callsign=callsign, license_status=status, radio_service_code=service)


def site(usi, n, lat=40):
    return line("LO", usi=usi, location_number=n, lat_d=lat, lat_m=0, lat_s=0, lat_h="N", lon_d=100, lon_m=0, lon_s=0, lon_h="W", state="nd")


def frequency(usi, n, mhz):
    return line("FR", usi=usi, location_number=n, antenna_number=1, freq_seq_id=1, frequency_mhz=mhz)


DAY = lambda d, h=14: dt.datetime(2026, 9, d, h, tzinfo=dt.UTC)


@pytest.fixture
def feed(tmp_path):
    root = tmp_path / "feed"
    name = lambda usi, n: line("EN", usi=usi, entity_type="L", entity_name=n, applicant_type="C")
    write_zip(root / "complete/l_cell.zip", DAY(20), "Sun Sep 20 05:00:00 EDT 2026", {"HD": [head(1, "K1", service="CL"), head(2, "K2", service="CL")], "EN": [name(1, "First Cell"), name(2, "Second Cell")], "LO": [site(1, 1), site(2, 1)], "FR": [frequency(1, 1, 850), frequency(2, 1, 851)]})
    write_zip(root / "complete/l_micro.zip", DAY(20, 15), "Sun Sep 20 06:00:00 EDT 2026", {"HD": [head(2, "WRONG"), head(3, "K3"), head(3, "LATER"), head(4, "", "E"), "HD|short"], "EN": [name(3, "Micro One")], "LO": [site(3, 1), site(3, 1, 41), site(4, 1)], "FR": [frequency(3, 1, 6000)], "LL": [line("LL", lease_usi=3, parent_usi=1)]})
    return root


def test_build_refresh_verify(spark, tmp_path, feed):
    store = Store(spark, f"file://{tmp_path}/store")
    ingest = Ingest(spark, store, f"file://{feed}")
    with pytest.raises(QueryError, match="index_not_ready"):
        ingest.refresh()
    assert ingest.rebuild() == "rebuilt" and ingest.verify() == [] and ingest.rebuild() == "skipped"
    built = store.current()
    registry = store.open()
    got = {x.usi: (x.callsign, x.service_group, x.licensee_name) for x in registry.licenses.collect()}
    order = {g: i for i, g in enumerate(built.groups)}
    second = ("K2", "cell", "Second Cell") if order["cell"] < order["micro"] else ("WRONG", "micro", "Second Cell")
    assert got == {1: ("K1", "cell", "First Cell"), 2: second, 3: ("K3", "micro", "Micro One"), 4: (None, "micro", None)}
    assert sorted((x.usi, x.site_seq, x.lat) for x in registry.locations.collect()) == [(1, 1, 40.0), (2, 1, 40.0), (3, 1, 40.0), (3, 2, 41.0)]
    assert built.lines["micro"]["HD"] == {"upstream": 5, "read": 5, "kept": 4, "rejected": 1} and built.checkpoint == "2026-09-20T09:00:00Z"
    groups = {x.service_group: (x.records, x.sites, x.frequencies) for x in reference.group_statistics(registry).collect()}
    assert set(groups) == {"cell", "micro"} and sum(v[0] for v in groups.values()) == 4

    # Four days of the feed: a replaced licence, one that ends, a new one of a held service, one of an unknown service.
    micro = next(c for c in ("mw", "micro", "mi") if bulk.daily_group(f"l_{c}_mon.zip")[1] == "micro")
    write_zip(feed / f"daily/l_{micro}_mon.zip", DAY(21), "Mon Sep 21 08:00:00 EDT 2026", {"HD": [head(3, "K3B"), head(9, "K9"), head(10, "K10", service="ZZ")], "LO": [site(3, 1, 45), site(9, 2)], "FR": [frequency(3, 1, 6100), frequency(9, 2, 6200)]})
    write_zip(feed / f"daily/l_{micro}_tue.zip", DAY(22), "Tue Sep 22 08:00:00 EDT 2026", {"HD": [head(1, "K1", "C", "CL")]})
    (feed / f"daily/l_{micro}_wed.zip").write_bytes(b"not a zip")
    os.utime(feed / f"daily/l_{micro}_wed.zip", (DAY(23).timestamp(),) * 2)
    with pytest.raises(Exception, match="central directory"):
        ingest.refresh()
    after = store.current()
    assert len(after.applied) == 2 and after.checkpoint == "2026-09-22T12:00:00Z" and after.built == built.name and store.fs.exists(store.path(f"{built.name}/manifest.json"))
    registry = store.open()
    assert {x.usi: (x.callsign, x.license_status, x.service_group) for x in registry.licenses.collect() if x.usi != 2} == {1: ("K1", "C", "cell"), 3: ("K3B", "A", "micro"), 4: (None, "E", "micro"), 9: ("K9", "A", "micro")}
    assert sorted((x.usi, x.lat) for x in registry.locations.collect()) == [(2, 40.0), (3, 45.0), (9, 40.0)]
    assert sorted((x.usi, x.frequency_mhz) for x in registry.frequencies.collect()) == [(2, 851.0), (3, 6100.0), (9, 6200.0)]
    assert registry.lease_links.count() == 0  # the lease was replaced by a record without a link
    assert after.cursor_names()[0] == built.cursor_names()[0] and after.cursor_names()[1] != built.cursor_names()[1] and data_as_of(after)["daily_files"] == 2

    # Mended, the third file is applied; files that were applied are not applied again.
    write_zip(feed / f"daily/l_{micro}_wed.zip", DAY(23, 16), "Wed Sep 23 08:00:00 EDT 2026", {"HD": [head(9, "K9", "E")]})
    assert ingest.refresh() == [f"l_{micro}_wed.zip"] and ingest.refresh() == [] and ingest.verify() == []
    assert sorted(x.usi for x in store.open().frequencies.collect()) == [2, 3]

    # A gap in the feed: no refresh, but a newer snapshot rebuilds.
    write_zip(feed / f"daily/l_{micro}_sat.zip", DAY(26), "Sat Sep 26 08:00:00 EDT 2026", {"HD": [head(9, "K9")]})
    with pytest.raises(QueryError, match="stale_checkpoint|micro|m"):
        ingest.refresh()
    for g, at in (("cell", DAY(27)), ("micro", DAY(27, 15))):
        with zipfile.ZipFile(feed / f"complete/l_{g}.zip") as z:
            files = {n.removesuffix(".dat"): z.read(n).decode().split("\r\n") for n in z.namelist() if n.endswith(".dat")}
        write_zip(feed / f"complete/l_{g}.zip", at, "Sun Sep 27 05:00:00 EDT 2026", {t: [x.rstrip("\n") for x in own] for t, own in files.items()})
    assert ingest.update() == "rebuilt" and ingest.verify() == []
    assert store.current().built == store.current().name and not store.current().applied


def test_a_broken_build_goes_on(spark, tmp_path, feed):
    store = Store(spark, f"file://{tmp_path}/store")
    ingest = Ingest(spark, store, f"file://{feed}", ["cell", "micro"])
    publish, store.publish = store.publish, lambda name: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError, match="lost"):
        ingest.rebuild()
    with pytest.raises(QueryError, match="index_not_ready"):
        store.current()
    written = {t: os.stat(next((tmp_path / "store").glob(f"parts/build-*/{t}/_SUCCESS"))).st_mtime_ns for t in CLUSTERED}
    store.publish = publish
    assert ingest.rebuild() == "rebuilt" and ingest.verify(decode=True) == []
    assert written == {t: os.stat(next((tmp_path / "store").glob(f"parts/build-*/{t}/_SUCCESS"))).st_mtime_ns for t in CLUSTERED}


def test_verify_finds_what_is_missing(spark, tmp_path, feed):
    write_zip(feed / "complete/l_cell.zip", DAY(20), "Sun Sep 20 05:00:00 EDT 2026", {"HD": [head(1, "K1", service="CL")]}, {"HD": 7})
    store = Store(spark, f"file://{tmp_path}/store")
    ingest = Ingest(spark, store, f"file://{feed}", ["cell"])
    ingest.rebuild()
    assert ingest.verify() == ["cell HD: read 1 of 7 lines"]
    with pytest.raises(QueryError, match="l_paging|missing"):
        Ingest(spark, store, f"file://{feed}", ["cell", "paging"]).rebuild()


def test_searches_on_a_stored_generation(spark, tmp_path):
    from airledger.plans.virtual import registry

    reg = registry(spark, "/root/testdata/sf0.001")
    store = Store(spark, f"file://{tmp_path}/store")
    name = store.new_name(dt.datetime(2026, 9, 27))
    store.write(reg, Manifest(name, ["micro"], "2026-09-27T00:00:00Z"), files=3)
    store.publish(name)
    kept = store.open()
    same = lambda f: sorted(map(str, f(reg).collect())) == sorted(map(str, f(kept).collect())) != []
    assert same(lambda r: spectrum.search_frequencies(r, spectrum.SpectrumSearch(905, 915)).drop("_seq"))
    assert same(lambda r: transmitters.sites_in_radius(r, transmitters.RadiusSearch(26.0, -118.25, 230)).drop("_seq"))
    assert same(lambda r: licences.search_licences(r, licences.LicenceSearch(radio_service="MW", status="any"), 30).rows)
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = spectrum.site_assignments(kept, spectrum.SpectrumSearch(905, 915))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "LessThanOrEqual(occ_low" in plan and "GreaterThanOrEqual(occ_high" in plan  # the band's edges reach the scan


def test_old_generations_go(spark, tmp_path, feed):
    store = Store(spark, f"file://{tmp_path}/store")
    ingest = Ingest(spark, store, f"file://{feed}")
    ingest.rebuild()
    first = store.current().name
    store._write(f"{'generation-20200101T000000Z'}/manifest.json", "{}")
    assert store.collect_garbage(set()) == ["generation-20200101T000000Z"] and store.current().name == first
    store._write("current.json", "{}")
    assert ingest.published() is None and ingest.rebuild() == "rebuilt"


def test_newest_applied(spark):
    rows = [("a", "2026-09-21T00:00:00Z", "2026-09-20T00:00:00Z"), ("a", "2026-09-22T00:00:00Z", "2026-09-21T00:00:00Z"), ("b", None, "2026-09-19T00:00:00Z")]
    files = spark.createDataFrame(rows, "service_group string, applied_at string, counts_created string")
    assert sorted((x.service_group, x.newest_applied, x.checkpoint) for x in newest_applied(files).collect()) == [("a", "2026-09-22T00:00:00Z", "2026-09-20T00:00:00Z"), ("b", None, "2026-09-19T00:00:00Z")]


def entries_of(content):
    file = io.BytesIO(content)
    return [(e.name, [x for lines in bulk.entry_lines(file, e) for x in lines]) for e in bulk.central_directory(file)]


def zipped(entries, method=zipfile.ZIP_DEFLATED):
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w", method) as z:
        for name, text in entries.items():
            z.writestr(name, text)
    return made.getvalue()


def test_zips_that_are_refused():
    good = zipped({"HD.dat": "x", "counts": "y" * 70_000})
    with pytest.raises(QueryError) as e:
        bulk.small_entry(io.BytesIO(good), bulk.central_directory(io.BytesIO(good))[1])
    assert e.value.reason == "bad_entry"
    at = good.rfind(b"PK\x05\x06")
    (directory,) = struct.unpack_from("<I", good, at + 16)
    put = lambda i, b: good[:i] + b + good[i + len(b) :]
    for bad, why in (
        (put(at + 4, b"\x01"), "more than one disk"),
        (put(at + 8, b"\xff\xff\xff\xff"), "ZIP64"),
        (put(directory + 20, b"\xff\xff\xff\xff"), "ZIP64"),
        (put(directory + 8, b"\x01"), "encrypted"),
        (put(directory + 10, b"\x0c"), "neither stored nor deflated"),
        (put(directory, b"xx"), "malformed"),
        (b"text", "no end"),
        (b"", "no end"),
    ):
        with pytest.raises(QueryError, match=why):
            bulk.central_directory(io.BytesIO(bad))
    for bad, why in ((put(directory + 16, b"\x00\x00\x00\x00"), "checksum"), (put(0, b"xx"), "local header")):
        with pytest.raises(QueryError, match=why):
            entries_of(bad)
    with pytest.raises(QueryError) as e:
        entries_of(zipped({"HD.dat": "z" * 16_385}))
    assert e.value.reason == "bad_line"
    with pytest.raises(QueryError):  # refused long before its end is read
        entries_of(zipped({"HD.dat": "z" * 30_000_000}))


@pytest.mark.parametrize("method", [zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED])
def test_entries_are_read_in_pieces(method, monkeypatch):
    text = "first\r\n\ninner\rreturn\n" + "é" * 16_384 + "\nbad \udcff byte\n" + "".join(f"line {i}\n" for i in range(50_000)) + "last"
    raw = text.encode("utf-8", "surrogateescape")
    want = [(i, x) for i, x in enumerate(y.removesuffix("\r") for y in raw.decode("utf-8", "replace").split("\n")) if x]
    content = zipped({"a/HD.dat": raw, "empty.dat": ""}, method)
    for chunk in (1 << 20, 777):
        monkeypatch.setattr(bulk, "_CHUNK", chunk)
        monkeypatch.setattr(bulk, "_INFLATED", 3 * chunk)
        assert entries_of(content) == [("a/HD.dat", want), ("empty.dat", [])]


def test_an_entry_is_a_task(spark, tmp_path):
    types = [*records.LAYOUTS]
    write_zip(tmp_path / "l_micro.zip", DAY(20), "Sun Sep 20 05:00:00 EDT 2026", {t: [f"{t}|{i}" for i in range(5)] for t in types})
    (tmp_path / "l_cell.zip").write_bytes(b"no zip")
    got = bulk.read_zips(spark, [f"file://{tmp_path}/l_micro.zip", f"file:{tmp_path}/l_cell.zip"])
    assert got.rdd.getNumPartitions() == len(types) + 2  # eleven record files, counts, and the zip that can't be read
    rows = got.collect()
    assert sorted((x.record_type, x.value) for x in rows if x.place == 0 and x.record_type != "counts") == sorted((t, f"{t}|{i}") for t in types for i in range(5))
    assert [(x.record_type, "no end" in x.value) for x in rows if x.place == 1] == [(bulk.ERROR, True)]
    # A file system that Arrow doesn't know: the same rows by Spark's reader of whole files.
    plans = [None, None]
    again = bulk.read_zips(spark, [f"file://{tmp_path}/l_micro.zip", f"file://{tmp_path}/l_cell.zip"], plans).collect()
    strip = lambda r: (r.place, r.record_type, r._seq, r.value)
    assert sorted(map(strip, again)) == sorted(map(strip, rows))
    assert bulk.plan_zip("nowhere://host/x.zip", "") is None


def test_executors_without_the_package_read_zips(tmp_path):
    """Workers that don't find the package get it with the job."""
    write_zip(tmp_path / "feed/complete/l_micro.zip", DAY(20), "Sun Sep 20 05:00:00 EDT 2026", {"HD": [head(1, "K1")]})
    root = Path(__file__).resolve().parents[1]
    code = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
sys.path.insert(0, {str(root)!r})
from airledger.sources import bulk
print("LINES", bulk.read_bulk(spark, "file://{tmp_path}/feed", "HD").count())
spark.stop()
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "LINES 1" in done.stdout, done.stderr[-2000:]


def state(store):
    """All rows of the published generation's tables."""
    r = store.open()
    return {t: sorted(str(sorted(x.asDict().items())) for x in getattr(r, t).collect()) for t in CLUSTERED}


def without_order(rows):
    """Rows without _seq, whose places depend on which files came together."""
    return {t: sorted(re.sub(r"\('_seq', \d+\), ", "", x) for x in own) for t, own in rows.items()}


def daily_feed(root, days=3, codes=("mw", "xx", "cl")):
    """Files of some codes on days after the 20th: changes, ends, new licences and services that become known."""
    r = random.Random(8)
    for d in range(days):
        for i, c in enumerate(codes):
            usis = r.sample(range(1, 40), 6)
            hd = [head(u, f"K{u}d{d}{c}", r.choice("AAAXEC"), r.choice(["MW", "CL", "ZZ", "YY"])) for u in usis] + [head(usis[0], "SECOND")]
            if d == 0 and i == 0:
                hd.append(head(1, "K1", "A", "YY"))  # a held licence makes its service known to the files after this
            lo = [site(u, n, 30 + r.randint(0, 15)) for u in usis for n in range(1, r.randint(2, 4))]
            name = f"l_{c}_{'mon tue wed thu fri sat sun'.split()[d]}.zip"
            write_zip(root / "daily" / name, DAY(21 + d, 13 + i), f"Mon Sep {21 + d} 08:00:00 EDT 2026", {"HD": hd, "LO": lo, "FR": [frequency(u, 1, 100 + u) for u in usis], "LL": [line("LL", lease_usi=usis[1], parent_usi=usis[2])], "EN": [line("EN", usi=u, entity_type="L", entity_name=f"N{u}") for u in usis]})


def test_many_files_at_once_equal_one_after_another(spark, tmp_path, feed):
    once, often = (Ingest(spark, Store(spark, f"file://{tmp_path}/{n}", buckets=4), f"file://{feed}") for n in ("once", "often"))
    once.rebuild(), often.rebuild()
    daily_feed(feed, 2, ("mw", "xx"))
    names = sorted((f for f in (feed / "daily").iterdir()), key=lambda f: (f.stat().st_mtime, f.name))
    assert len(names) == 4
    assert sorted(once.refresh()) == sorted(f.name for f in names)
    for i in range(len(names)):  # one file more each time, the others out of sight
        moved = {f: f.with_suffix(".later") for f in names[i + 1 :]}
        for f, later in moved.items():
            f.rename(later)
        assert often.refresh() == [names[i].name]
        for f, later in moved.items():
            later.rename(f)
    assert without_order(state(once.store)) == without_order(state(often.store)) and once.verify() == often.verify() == []
    assert once.store.current().services == often.store.current().services
    for asked in ("n1", "n2 n", "first cell", "n"):
        r, phrases = once.store.open(), parameters.name_phrases(asked)
        ranked = [{x.usi: round(x.score, 9) for x in f.collect()} for f in (textsearch.rank(r.licenses, "usi", "licensee_name", phrases), textsearch.rank_by_index(r.names, "usi", phrases), textsearch.rank_by_index(often.store.open().names, "usi", phrases))]
        assert ranked[0] == ranked[1] == ranked[2]
    plan = textsearch.rank_by_index(once.store.open().names, "usi", [["n1"]])._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,n1)" in plan
    plain = plain_licences(feed, names)
    assert {x.usi: (x.callsign, x.license_status, x.radio_service_code) for x in once.store.open().licenses.collect()} == plain
    assert once.status()["newest"].keys() >= {"cell", "micro"} and once.status()["daily_files"] == len(names)


def plain_licences(feed, names):
    """Licences after files, applied one by one in memory."""
    def heads_of(path):
        with zipfile.ZipFile(path) as z:
            own = {}
            for x in z.read("HD.dat").decode().split("\r\n"):
                f = x.strip().split("|")
                if len(f) == 59 and f[1] and f[5] and f[6]:
                    own.setdefault(int(f[1]), (f[4] or None, f[5], f[6]))
            return own

    held = {}
    for g in ("cell", "micro") if codes.DEFAULT_SERVICE_GROUPS.index("cell") < codes.DEFAULT_SERVICE_GROUPS.index("micro") else ("micro", "cell"):
        held = heads_of(feed / f"complete/l_{g}.zip") | held
    known = {x[2] for x in held.values()}
    for path in names:
        new = {u: x for u, x in heads_of(path).items() if u in held or x[2] in known}
        held |= new
        known |= {x[2] for x in new.values()}
    return held


def test_a_refresh_is_as_large_for_many_files(spark, tmp_path, feed):
    """Scans of an opened table, after one file and after 30 more."""
    ingest = Ingest(spark, Store(spark, f"file://{tmp_path}/store", buckets=4), f"file://{feed}")
    ingest.rebuild()
    scans = lambda: {t: getattr(ingest.store.open(), t)._jdf.queryExecution().executedPlan().toString().count("FileScan") for t in CLUSTERED}
    daily_feed(feed, 1, ("mw",))
    ingest.refresh()
    one = scans()
    daily_feed(feed, 6, ("mw", "cl", "xx", "yy", "zz"))
    assert len(ingest.pending()) >= 29
    ingest.refresh()
    assert all(n <= 4 for n in scans().values()) and all(n <= 4 for n in one.values()) and ingest.verify() == []


def test_buckets_that_no_file_touches_stay(spark, tmp_path, feed):
    write_zip(feed / "complete/l_cell.zip", DAY(20), "Sun Sep 20 05:00:00 EDT 2026", {"HD": [head(u, f"K{u}", service="CL") for u in range(100, 400)], "LO": [site(u, 1) for u in range(100, 400)]})
    ingest = Ingest(spark, Store(spark, f"file://{tmp_path}/store", buckets=4), f"file://{feed}", ["cell"])
    ingest.rebuild()
    built = ingest.store.current()
    write_zip(feed / "daily/l_cl_mon.zip", DAY(21), "Mon Sep 21 08:00:00 EDT 2026", {"HD": [head(100, "NEW", service="CL")], "LO": [site(100, 1, 44)]})
    assert ingest.refresh() == ["l_cl_mon.zip"]
    after = ingest.store.current()
    assert after.base == built.base and len(after.touched) == 1 and sum(p.rows for p in after.delta["licenses"].values()) == 1
    # Beyond a tenth of a bucket's licences it is rewritten, the others are left.
    bucket = next(iter(after.touched))
    own = [r.usi for r in ingest.store.read_parts([built.base["licenses"][bucket]], "usi long").collect()]
    write_zip(feed / "daily/l_cl_tue.zip", DAY(22), "Tue Sep 22 08:00:00 EDT 2026", {"HD": [head(u, "MANY", service="CL") for u in own[: len(own) // 5]]})
    ingest.refresh()
    last = ingest.store.current()
    assert not last.touched and {b for b in last.base["licenses"] if last.base["licenses"][b] != built.base["licenses"][b]} == {bucket}
    assert ingest.store.open().licenses.count() == 300 and ingest.verify() == []


def test_runs_that_break_after_every_step(spark, tmp_path, feed):
    """Each run gets one step further; what it leaves is what a run that never breaks makes."""
    daily_feed(feed, 1)
    whole, lost = (Ingest(spark, Store(spark, f"file://{tmp_path}/{n}", buckets=2), f"file://{feed}", ["cell", "micro"]) for n in ("whole", "lost"))
    whole.rebuild(), whole.refresh()
    step, seen = lost.store.step, set()

    def once(kind, inputs, make):
        out = step(kind, inputs, make)
        if (kind, str(inputs)) not in seen:
            seen.add((kind, str(inputs)))
            raise RuntimeError("lost")
        return out

    lost.store.step = once
    for f in (lost.rebuild, lost.refresh):
        for _ in range(20):
            try:
                f()
                break
            except RuntimeError:
                pass
    assert len(seen) == 12 and {k for k, _ in seen} == {"stage", "records", "build", "counts", "daily", "heads", "delta", "edges", "compact"}
    assert lost.verify() == [] and state(lost.store) == state(whole.store)


def test_a_newer_zip_after_a_lost_build(spark, tmp_path, feed):
    store = Store(spark, f"file://{tmp_path}/store", buckets=2)
    ingest = Ingest(spark, store, f"file://{feed}", ["cell", "micro"])
    publish, store.publish = store.publish, lambda name: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError, match="lost"):
        ingest.rebuild()
    staged = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "store/parts").glob("stage-*")}
    store.publish = publish
    write_zip(feed / "complete/l_micro.zip", DAY(25, 15), "Fri Sep 25 06:00:00 EDT 2026", {"HD": [head(3, "K3NEW"), head(77, "K77")]})
    assert ingest.rebuild() == "rebuilt" and ingest.verify(decode=True) == [] and ingest.rebuild() == "skipped"
    assert {x.usi: x.callsign for x in store.open().licenses.collect()} == {1: "K1", 2: "K2", 3: "K3NEW", 77: "K77"}
    now = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "store/parts").glob("stage-*")}
    assert len(now) == 2 and len(now.items() & staged.items()) == 1  # the group that didn't change wasn't read again


def test_verify_finds_changed_lost_and_missing_rows(spark, tmp_path, feed):
    ingest = Ingest(spark, Store(spark, f"file://{tmp_path}/store", buckets=2), f"file://{feed}", ["cell", "micro"])
    ingest.rebuild()
    built = ingest.store.current()
    assert ingest.verify(decode=True) == []
    bucket, part = next(iter(built.base["locations"].items()))
    at, rows = f"{ingest.store.root}/{part.folder}", ingest.store.read_parts([part], ingest.store.schemas(built)["locations"])
    changed = rows.withColumn("lat", F.col("lat") + 1).toPandas()
    spark.createDataFrame(changed, rows.schema).write.mode("overwrite").parquet(at)
    assert ingest.verify() == [f"locations base bucket {bucket}: rows have changed"]
    spark.createDataFrame(changed[:0], rows.schema).write.mode("overwrite").parquet(at)
    assert ingest.verify() == [f"locations base bucket {bucket}: 0 rows, {part.rows} written"]
    assert f"locations: rows differ from those that the staged lines give" in ingest.verify(decode=True)
    built.loaded["cell"] += 1
    ingest.store._write(f"{built.name}/manifest.json", json.dumps(asdict(built)))
    assert "cell: 2 licences, 3 accepted at the build" in ingest.verify()

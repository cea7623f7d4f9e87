"""The daily feed as a stream."""

import datetime as dt
import os

import pytest

from airledger.streaming import feed

SCHEMA = "k long, v string, at long"


def test_stream_replaces_by_key_and_resumes(spark, tmp_path):
    days = [[(1, "a", 1), (2, "b", 2)], [(1, "c", 3), (1, "d", 4), (3, "e", 5)], [(2, "f", 6)]]
    table = feed.VersionedTable(spark, f"file://{tmp_path}/table", SCHEMA)
    assert table.read().count() == 0

    def run():
        stream = feed.read_feed(spark, f"{tmp_path}/in", SCHEMA)
        feed.start_feed(stream, table, ["k"], ["at"], f"file://{tmp_path}/checkpoint").awaitTermination()
        return sorted(tuple(r) for r in table.read().collect())

    for n, rows in enumerate(days):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if n == 1:
            assert run() == [(1, "d", 4), (2, "b", 2), (3, "e", 5)]
    assert run() == [(1, "d", 4), (2, "f", 6), (3, "e", 5)]
    assert run() == [(1, "d", 4), (2, "f", 6), (3, "e", 5)]
    assert len(table.versions()) <= 2


def test_replayed_batch_gives_the_same_version(spark, tmp_path):
    table = feed.VersionedTable(spark, f"file://{tmp_path}/table", SCHEMA)
    apply = feed.replacing_sink(table, ["k"], ["at"])
    one, two = (spark.createDataFrame(r, SCHEMA) for r in ([(1, "a", 1)], [(1, "b", 2), (2, "c", 3)]))
    apply(one, 0)
    apply(two, 1)
    first = sorted(map(tuple, table.read().collect()))
    apply(two, 1)
    assert sorted(map(tuple, table.read().collect())) == first == [(1, "b", 2), (2, "c", 3)]


def test_windowed_counts(spark, tmp_path):
    rows = [("2024-01-01 01:00:00", 1), ("2024-01-01 23:00:00", 1), ("2024-01-02 00:00:00", 2)]
    spark.createDataFrame(rows, "t string, k long").selectExpr("cast(t AS timestamp) AS t", "k").write.parquet(f"{tmp_path}/in")
    counted = feed.windowed_counts(feed.read_feed(spark, f"{tmp_path}/in", "t timestamp, k long"), "t", "k")
    q = counted.writeStream.outputMode("complete").format("memory").queryName("windowed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.k, r.changes) for r in spark.table("windowed").collect()) == [(1, 2), (2, 1)]


def test_daily_zips_as_a_stream(spark, tmp_path):
    from airledger.sources.generations import CLUSTERED, Store
    from airledger.sources.ingest import Ingest
    from airledger.streaming import daily
    from tests.test_ingest import DAY, frequency, head, line, site, write_zip

    root = tmp_path / "feed"
    name = lambda usi, n: line("EN", usi=usi, entity_type="L", entity_name=n, applicant_type="C")
    write_zip(root / "complete/l_micro.zip", DAY(20), "Sun Sep 20 05:00:00 EDT 2026", {"HD": [head(i, f"K{i}") for i in range(1, 9)], "EN": [name(1, "One")], "LO": [site(1, 1), site(2, 1)], "FR": [frequency(1, 1, 6000)]})

    def put(day, call, week=0, n=1):
        at = DAY(21) + dt.timedelta(days=day + 7 * week)
        write_zip(root / f"daily/l_mw_{'mon tue wed thu fri sat sun'.split()[day]}.zip", at, f"{at:%a %b %d} 08:00:00 EDT {at:%Y}", {"HD": [head(n, call)], "LO": [site(n, 1, 30 + day)]})

    ingest = Ingest(spark, Store(spark, f"file://{tmp_path}/store", buckets=4), f"file://{root}", ["micro"])
    apply = daily.Applying(ingest)

    def run(**options):
        daily.start_daily(ingest, f"file://{tmp_path}/checkpoint", **options).awaitTermination()
        return {x.usi: x.callsign for x in ingest.store.open().licenses.collect() if x.callsign != f"K{x.usi}"}

    # A first start builds, as nothing is published, and applies; without new files nothing happens.
    put(0, "MON")
    assert run() == {1: "MON"} and apply.outcome(0)["done"] == "rebuilt" and apply.outcome(1) is None
    first = ingest.store.current().name
    assert run() == {1: "MON"} and apply.outcome(1) is None and ingest.store.current().name == first

    # A day is missing: what follows waits, and the batch that brings it applies both in order.
    put(2, "WED", n=2)
    assert run() == {1: "MON"} and apply.outcome(1)["done"] == "waiting" and "mw" in apply.outcome(1)["waiting_for"].lower()
    put(1, "TUE", n=2)
    assert run() == {1: "MON", 2: "WED"} and apply.outcome(2)["done"] == "refreshed"
    held, tables = ingest.store.current(), {t: sorted(map(str, getattr(ingest.store.open(), t).collect())) for t in CLUSTERED}

    # A batch that runs again publishes the same generation, with its outcome written or lost.
    apply(None, 2)
    (tmp_path / "store/streams/daily/2.json").unlink()
    apply(None, 2)
    assert ingest.store.current() == held and apply.outcome(2)["generation"] == held.name
    assert {t: sorted(map(str, getattr(ingest.store.open(), t).collect())) for t in CLUSTERED} == tables

    # A batch lost after it has published, before the stream has noted it, is run again by the next start.
    put(3, "THU", n=3)

    def lost(batch, number):
        apply(batch, number)
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run(apply=lost)
    held = ingest.store.current()
    assert run() == {1: "MON", 2: "WED", 3: "THU"} and ingest.store.current() == held

    # A zip that can't be read fails its batch; written anew it is applied. The next week's files have the same names.
    put(4, "FRI", n=4)
    whole = (root / "daily/l_mw_fri.zip").read_bytes()
    (root / "daily/l_mw_fri.zip").write_bytes(whole[:40])
    os.utime(root / "daily/l_mw_fri.zip", (DAY(25).timestamp(),) * 2)
    with pytest.raises(Exception, match="central directory"):
        run()
    put(4, "FRI", n=4)
    assert run()[4] == "FRI"
    for day in (5, 6):
        put(day, f"D{day}", n=5)
    assert run()[5] == "D6"
    put(0, "NEXT", week=1)
    assert run() == {1: "NEXT", 2: "WED", 3: "THU", 4: "FRI", 5: "D6"}
    assert ingest.verify() == []

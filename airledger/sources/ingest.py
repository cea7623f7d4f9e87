"""The registry's life: a weekly build from zips, daily refreshes, and verification of what was built.

Each zip's lines are staged by record type, decoded from there and written as parts that a manifest names; one rename
publishes it. Every step is in the store's journal under a digest of its inputs (a zip counts by its time and content),
so a run that breaks goes on with what is still true of the feed, and does again what is not.
"""

from __future__ import annotations

import datetime as dt
import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import codes
from ..functions.parameters import QueryError, eastern_date
from ..operators import refresh as R
from ..operators.areas import StateCells
from ..operators.build import Registry, build, heads
from . import bulk, records
from .generations import CLUSTERED, COMPACT_SHARE, COUNTED, ENTRIES, KEYS, MOST_BROADCAST, NAME_TERMS, Manifest, Part, Store, bucket_of, content, data_as_of, needs_rebuild


#: What a folder of parts holds.
TABLES = (*CLUSTERED, NAME_TERMS, ENTRIES)


def iso(at: dt.datetime) -> str:
    """A UTC instant as text that sorts by time."""
    return at.astimezone(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _instant(text: str) -> dt.datetime:
    return dt.datetime.strptime(text, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=dt.UTC)


class Ingest:
    """Builds and refreshes the registry of a store from a root folder with `complete` and `daily` zips.

    state_at gives a site's state by its coordinates (operators.areas.StateCells, or an expression as functions.geo.state_of
    makes), for sites that file none.
    """

    def __init__(self, spark: SparkSession, store: Store, root: str, groups: list[str] | None = None, state_at: Column | StateCells | None = None):
        self.spark, self.store, self.root, self.groups, self.state_at = spark, store, str(root).rstrip("/"), groups, state_at

    def _stage(self, kind: str, paths: list[str], times: list[str], first: int = 0) -> dict:
        """Stages zips as one step: the folder of their lines by record type, and of each zip by its place, what its
        `counts` says and why it could not be read. The zips' places start at `first`."""
        with ThreadPoolExecutor(16) as pool:
            plans = list(pool.map(bulk.plan_zip, paths, times))
        # Where only Spark's readers reach a zip, its path and time stand for its content.
        identities = [p.identity if p else f"{path} {at}" for p, path, at in zip(plans, paths, times, strict=True)]

        def make(folder: str) -> dict:
            lines = bulk.read_zips(self.spark, paths, plans)
            lines.withColumns({"place": F.col("place") + first, "_seq": F.col("_seq") + (first << 40)}).write.mode("overwrite").partitionBy("record_type").parquet(f"{self.store.root}/{folder}")
            small = self._lines([folder]).where(F.col("record_type").isin(bulk.COUNTS, bulk.ERROR)).select("place", "record_type", "value").orderBy("place").collect()
            return {"folder": folder, "counts": {str(r["place"]): r["value"] for r in small if r["record_type"] == bulk.COUNTS}, "errors": {str(r["place"]): r["value"] for r in small if r["record_type"] == bulk.ERROR}}

        return self.store.step(kind, [identities, first], make)

    def _lines(self, folders: list[str]) -> DataFrame:
        """Staged lines of folders."""
        schema = "path string, place int, _seq long, value string, record_type string"
        parts = [self.spark.read.schema(schema).parquet(f"{self.store.root}/{f}") for f in folders]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @staticmethod
    def _decoded(staged: DataFrame, group: Column) -> dict[str, DataFrame]:
        """Records by type; heads have the service group that an expression gives."""
        own = lambda t: staged.where(F.col("record_type") == t).select("_seq", "value", group.alias("service_group"))
        return {t: records.decode(own(t), t) for t in records.LAYOUTS}

    def _records(self, inputs: list, folders: list[str], staged: DataFrame, group: Column) -> dict[str, DataFrame]:
        """Records by type, decoded once as a step: heads alone are read for every table. A type without lines is empty."""
        there = {t for t in records.LAYOUTS if any(self.store.fs.exists(self.store.path(f"{f}/record_type={t}")) for f in folders)}
        decoded = self._decoded(staged, group)

        def make(folder: str) -> dict:
            with ThreadPoolExecutor(4) as pool:
                list(pool.map(lambda t: decoded[t].write.mode("overwrite").parquet(f"{self.store.root}/{folder}/{t}"), sorted(there)))
            return {"folder": folder}

        made = self.store.step("records", inputs, make)
        return {t: self.spark.read.schema(df.schema).parquet(f"{self.store.root}/{made['folder']}/{t}") if t in there else self.spark.createDataFrame([], df.schema) for t, df in decoded.items()}

    def published(self) -> Manifest | None:
        """The published generation's manifest; None if there is none, or its pointer is malformed."""
        try:
            return self.store.current()
        except QueryError as e:
            if e.reason in ("index_not_ready", "bad_pointer"):
                return None
            raise

    def rebuild(self) -> str:
        """Builds and publishes a generation of the weekly snapshots; returns `rebuilt`, or `skipped` if none is newer.

        Of a usi that several groups file, the first group of the build counts, then the first line. The published
        generation is left as it is until the new one is whole; generations besides these two are deleted. A zip that
        can't be read fails the build.
        """
        paths = bulk.snapshot_paths(self.spark, self.root, self.groups)
        times = {g: iso(bulk.modified(self.spark, p)) for g, p in paths.items()}
        held = self.published()
        if not needs_rebuild(held, list(paths), times):
            return "skipped"
        order = list(paths)
        with ThreadPoolExecutor(4) as pool:  # a step for each group: one newer zip is staged anew, the others are not
            staged = list(pool.map(lambda i: self._stage("stage", [paths[order[i]]], [times[order[i]]], i), range(len(order))))
        if broken := [e for s in staged for e in s["errors"].values()]:
            raise QueryError("bad_zip", "; ".join(broken))
        folders = [s["folder"] for s in staged]
        lines, group = self._lines(folders), F.element_at(F.array(*[F.lit(g) for g in order]), F.col("place") + 1)
        inputs = [folders, order, str(self.state_at)]
        decoded = self._records(inputs[:2], folders, lines, group)

        def tables(folder: str) -> dict:
            registry = build(decoded, self.state_at)
            return {"parts": self.store.write_tables({t: getattr(registry, t) for t in CLUSTERED}, folder), "schemas": {t: getattr(registry, t).schema.json() for t in CLUSTERED}}

        def counted(folder: str) -> dict:
            own = heads(decoded["HD"])  # what was accepted, apart from what tables hold
            counts = {int(p): bulk.parse_counts(v) for s in staged for p, v in s["counts"].items()}
            services = own.where("service_group IS NOT NULL").groupBy("radio_service_code").agg(F.min_by("service_group", "_seq").alias("g")).collect()
            return {"created": [c.created_at for c in counts.values()], "lines": self._statistics(lines, decoded, order, counts), "loaded": {r["service_group"]: r["count"] for r in own.groupBy("service_group").count().collect()}, "services": {r["radio_service_code"]: r["g"] for r in services}}

        made, stats = self.store.step("build", inputs, tables), self.store.step("counts", inputs, counted)
        name = self.store.new_name(_instant(min(times.values())))
        base = {t: {b: Part(**p) for b, p in by.items()} for t, by in made["parts"].items()}
        manifest = Manifest(name, order, min(stats["created"]) if stats["created"] else min(times.values()), snapshots=times, lines=stats["lines"], loaded=stats["loaded"], services=stats["services"], staged=folders, base=base)
        manifest.names = self.store.counted_names(manifest)
        schemas = self.store.all_schemas({t: StructType.fromJson(json.loads(s)) for t, s in made["schemas"].items()})
        counts = self.store.step("edges", inputs, lambda folder: self.store.write_counts(manifest, schemas, folder))
        manifest.base |= {t: {b: Part(**p) for b, p in by.items()} for t, by in counts.items()}
        self.store.seal(manifest, made["schemas"])
        self.store.publish(name)
        self.store.collect_garbage({held.name} if held and held.schema_version == manifest.schema_version else set())
        return "rebuilt"

    def _statistics(self, staged: DataFrame, decoded: dict[str, DataFrame], order: list[str], counts: dict[int, bulk.Counts]) -> dict[str, dict[str, dict[str, int]]]:
        """Lines by group and record type: upstream (where `counts` says), read, kept and rejected."""
        out: dict[str, dict[str, dict[str, int]]] = {g: {t: {"upstream": n} for t, n in counts[i].lines.items()} if i in counts else {} for i, g in enumerate(order)}
        kept = None
        for t, rows in decoded.items():
            part = rows.groupBy(F.shiftright("_seq", 40).cast("int").alias("place")).agg(F.count("*").alias("kept")).withColumn("record_type", F.lit(t))
            kept = part if kept is None else kept.unionByName(part)
        read = staged.where(F.col("record_type").isin(*decoded)).groupBy("place", "record_type").agg(F.count("*").alias("read"))
        for r in read.join(kept, ["place", "record_type"], "left").collect():  # a row for each zip and record type
            own = out[order[r["place"]]].setdefault(r["record_type"], {})
            own |= {"read": r["read"], "kept": r["kept"] or 0, "rejected": r["read"] - (r["kept"] or 0)}
        return out

    def pending(self) -> list[R.Daily]:
        """Daily files to apply, oldest first; raises index_not_ready, or stale_checkpoint if the feed has a gap."""
        manifest = self.store.current()
        checkpoint = _instant(manifest.checkpoint)
        files = []
        for path, at in bulk.daily_files(self.spark, self.root):
            code, group = bulk.daily_group(path.rsplit("/", 1)[-1])
            known = code in codes.DAILY_CODE_GROUPS
            if not known or group in manifest.groups:  # a code of a group that isn't held is skipped
                files.append(R.Daily(path, code or "", eastern_date(at), at, group))
        held = {c for c, g in codes.DAILY_CODE_GROUPS.items() if g in manifest.groups}
        R.check_complete(files, held & {f.code for f in files}, checkpoint)
        return R.pending(files, {*manifest.groups, None}, checkpoint, {p: _instant(t) for p, t in manifest.applied.items()})

    def refresh(self) -> list[str]:
        """Applies pending daily files, oldest first, and publishes the result as one generation; returns their names.

        All files are staged together and a licence's last file counts, so a refresh is the same few passes over what the
        files hold, however many there are: base tables are read for the keys that files name, and rewritten only in
        buckets whose delta has grown too large. If a file can't be read, those before it are applied and published
        before bad_zip is raised.
        """
        manifest = self.store.current()
        files = self.pending()
        if not files:
            return []
        staged = self._stage("daily", [f.path for f in files], [iso(f.modified) for f in files])
        first_bad = min(map(int, staged["errors"]), default=len(files))
        done = files[:first_bad]
        if done:
            new = self._applied(manifest, staged, first_bad)
            created = [bulk.parse_counts(v).created_at for p, v in staged["counts"].items() if int(p) < first_bad]
            new.checkpoint, new.applied = max(manifest.checkpoint, *created) if created else manifest.checkpoint, manifest.applied | {f.path: iso(f.modified) for f in done}
            new.name = self.store.new_name(_instant(new.checkpoint))
            self.store.seal(new)
            self.store.publish(new.name)
            self.store.collect_garbage({manifest.name})
        if first_bad < len(files):
            raise QueryError("bad_zip", staged["errors"][str(first_bad)])
        return [f.path.rsplit("/", 1)[-1] for f in done]

    def _applied(self, manifest: Manifest, staged: dict, before: int) -> Manifest:
        """A manifest in which the staged files with places below `before` are applied, in their order."""
        lines, schemas = self._lines([staged["folder"]]).where(F.col("place") < before), self.store.schemas(manifest)
        inputs = [manifest.name, manifest.applied, staged["folder"], before]
        decoded = self._records(inputs[2:], [staged["folder"]], lines, F.lit(None).cast("string"))
        place = F.shiftright("_seq", 40).cast("int")

        def chosen(folder: str) -> dict:
            moves = self._kept(R.head_moves(decoded["HD"].drop("service_group").withColumn("place", place)), f"{folder}/moves")
            keys = moves.select("usi").distinct()
            held = self.store.merged("licenses", manifest, schemas["licenses"]).select("usi", F.col("service_group").alias("held"), F.lit(True).alias("is_held"))
            held = held.join(F.broadcast(keys) if moves.count() <= MOST_BROADCAST else keys, "usi", "left_semi")
            last, services = R.applied_last(self._kept(moves.join(held, "usi", "left"), f"{folder}/known"), manifest.services)
            self._kept(last, f"{folder}/last")
            return {"last": f"{folder}/last", "services": services}

        choice = self.store.step("heads", inputs, chosen)
        last = self.spark.read.schema("usi long, place int, service_group string").parquet(f"{self.store.root}/{choice['last']}")

        def delta(folder: str) -> dict:
            own = {}
            for t, rows in decoded.items():
                key = "lease_usi" if t == "LL" else "usi"
                met = rows.drop("service_group").withColumn("place", place).join(last.select(F.col("usi").alias(key), "place", "service_group"), [key, "place"])
                own[t] = (met if t == "HD" else met.drop("service_group")).drop("place")
            fresh = build(own, self.state_at)
            keys = last.select("usi")
            hit = {str(r["b"]) for r in keys.select(bucket_of("usi", self.store.buckets).alias("b")).distinct().collect()}
            old_keys = self.store.read_parts([p for b, p in manifest.touched.items() if b in hit], "usi long")
            out = {}
            for t in CLUSTERED:
                before_ = self.store.read_parts([p for b, p in manifest.delta.get(t, {}).items() if b in hit], schemas[t])
                out[t] = R.replace_by_key(before_, getattr(fresh, t).select(*schemas[t].fieldNames()), [KEYS[t]], keys.withColumnRenamed("usi", KEYS[t]))
            return {"hit": sorted(hit), "parts": self.store.write_tables(out | {"touched": old_keys.union(keys).distinct()}, folder)}

        made = self.store.step("delta", inputs, delta)
        hit, parts = set(made["hit"]), {t: {b: Part(**p) for b, p in by.items()} for t, by in made["parts"].items()}
        merged = lambda old, new: {b: p for b, p in old.items() if b not in hit} | new
        new = Manifest("", manifest.groups, "", built=manifest.built, snapshots=manifest.snapshots, lines=manifest.lines, loaded=manifest.loaded, services=choice["services"], staged=manifest.staged, base=manifest.base, buckets=manifest.buckets)
        new.delta = {t: merged(manifest.delta.get(t, {}), parts[t]) for t in TABLES}
        new.touched = merged(manifest.touched, parts["touched"])
        new.names = {b: n for b, n in manifest.names.items() if b not in hit} | self.store.counted_names(new, hit)
        counts = self.store.step("edges", [inputs, sorted(hit)], lambda folder: self.store.write_counts(new, schemas, folder, hit))
        new.base = new.base | {t: merged(manifest.base.get(t, {}), {b: Part(**p) for b, p in counts[t].items()}) for t in COUNTED}
        return self._compacted(new, schemas, inputs)

    def _kept(self, df: DataFrame, at: str) -> DataFrame:
        """df, written under the store and read again."""
        df.write.mode("overwrite").parquet(f"{self.store.root}/{at}")
        return self.spark.read.schema(df.schema).parquet(f"{self.store.root}/{at}")

    def _compacted(self, manifest: Manifest, schemas: dict, inputs: list) -> Manifest:
        """The manifest with the buckets rewritten whose delta replaces too large a share of their licences."""
        rows = lambda b: manifest.base["licenses"][b].rows if b in manifest.base.get("licenses", {}) else 0
        due = {b for b, p in manifest.touched.items() if p.rows * COMPACT_SHARE > rows(b)}
        if not due:
            return manifest

        def make(folder: str) -> dict:
            return self.store.write_tables({t: self.store.merged(t, manifest, schemas[t], due) for t in CLUSTERED}, folder)

        made = self.store.step("compact", [inputs, sorted(due)], make)
        without = lambda by: {b: p for b, p in by.items() if b not in due}
        manifest.base = manifest.base | {t: without(manifest.base.get(t, {})) | {b: Part(**p) for b, p in made[t].items()} for t in TABLES}
        manifest.delta, manifest.touched = {t: without(by) for t, by in manifest.delta.items()}, without(manifest.touched)
        return manifest

    def update(self) -> str:
        """Refreshes, or rebuilds and refreshes once if the feed no longer reaches back to the checkpoint."""
        return R.refresh_or_rebuild(self.refresh, lambda: self.rebuild() == "rebuilt")

    def status(self) -> dict:
        """How current the published generation is, as a whole and by group."""
        return data_as_of(self.store.current(), lambda name: bulk.daily_group(name)[1])

    def verify(self, decode: bool = False) -> list[str]:
        """What is wrong with the published generation, as text; nothing if all agrees.

        Read lines must be as many as upstream says; every bucket of every table must hold the rows that were written,
        by count and content; and until a refresh, each group's licences must be as many as its accepted heads made, no
        more and no fewer. decode: a build without refreshes is also decoded from its staged lines once more, and each
        table's rows must be the same.
        """
        manifest, problems = self.store.current(), []
        for group, types in manifest.lines.items():
            for t, n in types.items():
                if n.get("upstream") is not None and n["upstream"] != n.get("read", 0):
                    problems.append(f"{group} {t}: read {n.get('read', 0)} of {n['upstream']} lines")
        problems += self.store.damaged(manifest)
        registry = self.store.open(manifest.name)
        if not manifest.applied:
            indexed = {r["service_group"]: r["count"] for r in registry.licenses.groupBy("service_group").count().collect()}
            for g in sorted({*indexed, *manifest.loaded}, key=str):
                if indexed.get(g, 0) != manifest.loaded.get(g, 0):
                    problems.append(f"{g}: {indexed.get(g, 0)} licences, {manifest.loaded.get(g, 0)} accepted at the build")
            if decode and manifest.staged:
                group = F.element_at(F.array(*[F.lit(g) for g in manifest.groups]), F.col("place") + 1)
                again = build(self._decoded(self._lines(manifest.staged), group), self.state_at)
                for t in CLUSTERED:
                    columns = getattr(registry, t).columns
                    if content(getattr(registry, t).select(*columns)).collect() != content(getattr(again, t).select(*columns)).collect():
                        problems.append(f"{t}: rows differ from those that the staged lines give")
        return problems

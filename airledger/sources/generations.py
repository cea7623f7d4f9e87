"""Published snapshots: base parts by bucket of the licence, one delta over them, and a pointer to the current manifest.

A table's rows lie in buckets of their licence's hash. A generation names, for each bucket, the folder of its base rows
and, where refreshes have changed licences of it, the folders of the changed licences' keys and of their new rows. Base
rows of changed licences are left out when a table is opened, so a refresh writes no more than what changed, however many
files it applies, and a bucket is rewritten once its delta has grown to a share of it. Folders are shared by generations
and never changed.

Steps that write are named by a digest of all that goes into them, and a journal holds what each has made: a run that
breaks goes on with the steps whose inputs are still the same, and with no others.

All access is by Hadoop's file systems, so a store may be on any of them. A pointer is written beside and renamed over
the old one; readers see one generation or the other.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.parameters import QueryError
from ..operators import assignments, spectrum, transmitters
from ..operators.build import Registry
from ..operators.textsearch import NameIndex, postings

SCHEMA_VERSION = 4
NAME_SCHEMA = "term string, usi long, len int, positions array<int>"
_NAME = re.compile(r"generation-[0-9]{8}T[0-9]{6}Z(-[0-9]+)?")
#: How each table is ordered within its files, so that their statistics prune what a query's ranges exclude; sites by a
#: curve through both coordinates, as a box is a short range of either.
CLUSTERED = {"licenses": ["usi"], "lease_links": ["parent_usi"], "locations": [geo.curve("lat", "lon"), "usi"], "antennas": ["usi"], "frequencies": ["band_class", "occ_low"], "market_blocks": ["band_class", "lower"], "paths": ["usi"]}
#: The index of names, kept beside the tables; it is made of the licences of the same folder.
NAME_TERMS, NAME_ORDER = "name_terms", ["term", "usi"]
#: The assignments of the same folder's rows; counts of them by bin and of sites by cell, which have no delta, as those of a
#: bucket are made anew.
ENTRIES, COUNTS, SITE_CELLS = "spectrum_entries", "spectrum_counts", "site_cells"
COUNTED = {COUNTS: assignments.COUNTS_SCHEMA, SITE_CELLS: "y int, x int, license_status string, n long"}
DERIVED = {NAME_TERMS: NAME_ORDER, ENTRIES: assignments.KEPT, COUNTS: ["edge", "bin"], SITE_CELLS: ["y", "x"]}
#: The licence that a row belongs to, by which it is replaced.
KEYS = {t: "lease_usi" if t == "lease_links" else "usi" for t in [*CLUSTERED, NAME_TERMS, ENTRIES]}
#: A bucket is rewritten when its delta replaces over one in so many of its licences.
COMPACT_SHARE = 10
#: Keys of changed licences that are broadcast at most (8 bytes each); more meet the base rows by a shuffle.
MOST_BROADCAST = 1_000_000


@dataclass
class Part:
    """Rows of one bucket of a table: where they are, how many, and a digest of them that is free of their order."""

    folder: str
    rows: int
    digest: str


@dataclass
class Manifest:
    """What a generation holds."""

    name: str
    groups: list[str]
    checkpoint: str
    applied: dict[str, str] = field(default_factory=dict)
    schema_version: int = SCHEMA_VERSION
    #: The build that refreshes have gone on from (its own name), when its snapshots were last modified, and lines by
    #: group and record type: upstream, read, kept and rejected.
    built: str = ""
    snapshots: dict[str, str] = field(default_factory=dict)
    lines: dict[str, dict[str, dict[str, int]]] = field(default_factory=dict)
    #: Licences that each group's accepted heads made at the build, and the group that a service had first.
    loaded: dict[str, int] = field(default_factory=dict)
    services: dict[str, str] = field(default_factory=dict)
    #: Folders of the build's staged lines.
    staged: list[str] = field(default_factory=list)
    #: Parts by table and bucket; of `touched`, the keys of licences that the delta replaces, by bucket.
    buckets: int = 16
    base: dict[str, dict[str, Part]] = field(default_factory=dict)
    delta: dict[str, dict[str, Part]] = field(default_factory=dict)
    touched: dict[str, Part] = field(default_factory=dict)
    #: Of each bucket's licences: names, those with a term, and terms.
    names: dict[str, list[int]] = field(default_factory=dict)

    @staticmethod
    def parsed(text: str) -> Manifest:
        """A manifest of its JSON; fields of other schema versions are left out."""
        values = {k: v for k, v in json.loads(text).items() if k in Manifest.__dataclass_fields__}
        if values.get("schema_version") == SCHEMA_VERSION:
            for kind in ("base", "delta"):
                values[kind] = {t: {b: Part(**p) for b, p in parts.items()} for t, parts in values.get(kind, {}).items()}
            values["touched"] = {b: Part(**p) for b, p in values.get("touched", {}).items()}
        return Manifest(**values)

    def cursor_names(self) -> tuple[str, str]:
        """(generation, refreshed) that cursors are bound to: the build, and how its refreshes stand."""
        return self.built or self.name, f"{len(self.applied)}-{max(self.applied.values(), default='')}"

    def folders(self) -> set[str]:
        """Every folder, relative to the store, that the generation reads."""
        parts = [p for kind in (self.base, self.delta) for by in kind.values() for p in by.values()]
        return {p.folder.split("/bucket=")[0] for p in [*parts, *self.touched.values()]} | set(self.staged)


def bucket_of(key: str, buckets: int) -> Column:
    """The bucket of a licence's key."""
    return F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(buckets)).cast("int")


def content(rows: DataFrame, *by: str) -> DataFrame:
    """by, rows and digest: the sum of all rows' hashes, which a changed, lost or repeated row changes."""
    own = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*own).cast("decimal(38,0)")).cast("string").alias("digest"))


class Store:
    """Generations under a root path."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.jvm = spark.sparkContext._jvm
        self.path = lambda p: self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _write(self, name: str, text: str) -> None:
        out = self.fs.create(self.path(f"{name}.new"), True)
        out.write(bytearray(text.encode()))
        out.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(self.path(f"{name}.new"), self.path(name), options)

    def _read(self, name: str) -> str | None:
        if not self.fs.exists(self.path(name)):
            return None
        return "\n".join(r[0] for r in self.spark.read.text(f"{self.root}/{name}").collect())

    def current(self) -> Manifest:
        """The published generation's manifest; raises index_not_ready without one, bad_pointer for a malformed one."""
        text = self._read("current.json")
        if text is None:
            raise QueryError("index_not_ready")
        try:
            name = json.loads(text)["generation"]
        except (ValueError, KeyError, TypeError) as e:
            raise QueryError("bad_pointer") from e
        if not isinstance(name, str) or not _NAME.fullmatch(name):
            raise QueryError("bad_pointer")
        return self.manifest(name)

    def manifest(self, name: str) -> Manifest:
        """A generation's manifest."""
        text = self._read(f"{name}/manifest.json")
        if text is None:
            raise QueryError("bad_pointer", name)
        return Manifest.parsed(text)

    def new_name(self, at: dt.datetime) -> str:
        """A name that no generation has yet."""
        base = f"generation-{at:%Y%m%dT%H%M%SZ}"
        taken = {s.getPath().getName() for s in (self.fs.listStatus(self.path("")) if self.fs.exists(self.path("")) else [])}
        return next(n for n in [base, *(f"{base}-{i}" for i in range(2, 1000))] if n not in taken)

    def step(self, kind: str, inputs: object, make: Callable[[str], object]) -> object:
        """What make(folder) returns, or returned when this step, with the same inputs, was last done.

        inputs are anything JSON can hold, and all that the outcome depends on. The folder is new to the step; the journal
        has an entry only for a step that is done, so nothing of a broken one is used.
        """
        digest = hashlib.sha256(json.dumps([SCHEMA_VERSION, self.buckets, kind, inputs], sort_keys=True).encode()).hexdigest()[:32]
        if (done := self._read(f"journal/{digest}.json")) is not None:
            return json.loads(done)["outcome"]
        outcome = make(f"parts/{kind}-{digest}")
        self._write(f"journal/{digest}.json", json.dumps({"kind": kind, "inputs": inputs, "folder": f"parts/{kind}-{digest}", "outcome": outcome}))
        return outcome

    def write_parts(self, tables: dict[str, DataFrame], folder: str, files: int | None = None, keys: dict[str, str] = KEYS) -> dict[str, dict[str, dict]]:
        """Writes tables by bucket under a folder and returns their parts as plain dicts; empty buckets have none.

        Rows are dealt by ranges of bucket and order, then sorted: a file's statistics tell what it can hold. Tables are
        written side by side, so that small ones don't wait for large ones.
        """
        n = files or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

        def one(table: str) -> dict[str, dict]:
            own = tables[table] if table in COUNTED else tables[table].withColumn("bucket", bucket_of(keys[table], self.buckets))
            # What isn't a column is computed once, not at every comparison.
            by = {c if c in own.columns else f"__by{i}": c for i, c in enumerate((CLUSTERED | DERIVED).get(table) or [keys[table]])}
            rows = own.withColumns({name: F.expr(c) for name, c in by.items() if name != c})
            rows.repartitionByRange(n, "bucket", *by).sortWithinPartitions("bucket", *by).select(*own.columns).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{folder}/{table}")
            schema = own.schema  # an empty table has no files to tell it
            found = content(self.spark.read.schema(schema).parquet(f"{self.root}/{folder}/{table}"), "bucket").collect()
            return {str(r["bucket"]): {"folder": f"{folder}/{table}/bucket={r['bucket']}", "rows": r["rows"], "digest": r["digest"]} for r in found}

        with ThreadPoolExecutor(len(tables)) as pool:
            return dict(zip(tables, pool.map(one, tables), strict=True))

    def write_tables(self, tables: dict[str, DataFrame], folder: str, files: int | None = None) -> dict[str, dict[str, dict]]:
        """Writes the tables of a registry, and others, and then the indexes of names and assignments of what was written."""
        made = self.write_parts(tables, folder, files, KEYS | {t: "usi" for t in tables if t not in KEYS})
        written = Registry(**{t: self.read_parts([Part(**p) for p in made[t].values()], tables[t].schema) for t in CLUSTERED})
        return made | self.write_parts({NAME_TERMS: postings(written.licenses, "usi", "licensee_name"), ENTRIES: spectrum.entries(written)}, folder, files)

    def counted_names(self, manifest: Manifest, only: set[str] | None = None) -> dict[str, list[int]]:
        """What Manifest.names holds, of all buckets or some, from their rows of no term."""
        own = self.merged(NAME_TERMS, manifest, self.spark.createDataFrame([], NAME_SCHEMA).schema, only).where("term = ''")
        found = own.groupBy(bucket_of("usi", self.buckets).alias("b")).agg(F.count("*").alias("n"), F.count_if(F.col("len") > 0).alias("named"), F.sum("len").cast("long").alias("terms"))
        return {str(r["b"]): [r["n"], r["named"], r["terms"]] for r in found.collect()}

    def write_counts(self, manifest: Manifest, schemas: dict, folder: str, only: set[str] | None = None) -> dict[str, dict[str, dict]]:
        """Writes the counts of all buckets, or some; reads a few narrow columns of three tables."""
        rows = {t: self.merged(t, manifest, schemas[t], only).withColumn("bucket", bucket_of("usi", self.buckets)) for t in (ENTRIES, "locations", "licenses")}
        return self.write_parts({COUNTS: assignments.counted(rows[ENTRIES], "bucket"), SITE_CELLS: transmitters.sites_by_cell(rows["locations"], rows["licenses"], "bucket")}, folder, 1)

    def write(self, registry: Registry, manifest: Manifest, files: int | None = None) -> Manifest:
        """Writes a generation whose base is a registry; it isn't published yet."""
        tables = {t: getattr(registry, t) for t in CLUSTERED}
        parts = self.write_tables(tables, f"parts/{manifest.name}", files)
        manifest.base = {t: {b: Part(**p) for b, p in by.items()} for t, by in parts.items()}
        manifest.names = self.counted_names(manifest)
        counts = self.write_counts(manifest, self.all_schemas({t: df.schema for t, df in tables.items()}), f"parts/{manifest.name}")
        manifest.base |= {t: {b: Part(**p) for b, p in by.items()} for t, by in counts.items()}
        return self.seal(manifest, {t: df.schema.json() for t, df in tables.items()})

    def seal(self, manifest: Manifest, schemas: dict[str, str] | None = None) -> Manifest:
        """Writes a generation's manifest and, of a build, its tables' schemas."""
        manifest.built, manifest.buckets = manifest.built or manifest.name, self.buckets
        if schemas is not None:
            self._write(f"{manifest.name}/schemas.json", json.dumps(schemas))
        self._write(f"{manifest.name}/manifest.json", json.dumps(asdict(manifest)))
        return manifest

    def publish(self, name: str) -> None:
        """Makes a written generation the current one."""
        if not self.fs.exists(self.path(f"{name}/manifest.json")):
            raise QueryError("index_not_ready", name)
        self._write("current.json", json.dumps({"generation": name}))

    def schemas(self, manifest: Manifest) -> dict[str, object]:
        """The schema of each table of a generation."""
        from pyspark.sql.types import StructType

        text = self._read(f"{manifest.built}/schemas.json")
        if text is None:
            raise QueryError("bad_pointer", manifest.built)
        return self.all_schemas({t: StructType.fromJson(json.loads(s)) for t, s in json.loads(text).items()})

    def all_schemas(self, tables: dict) -> dict:
        """The tables' schemas and those of what is derived of them."""
        empty = lambda schema: self.spark.createDataFrame([], schema)
        return tables | {NAME_TERMS: empty(NAME_SCHEMA).schema, **{t: empty(c).schema for t, c in COUNTED.items()}, ENTRIES: spectrum.entries(Registry(**{t: empty(tables[t]) for t in CLUSTERED})).schema}

    def read_parts(self, parts: list[Part], schema) -> DataFrame:
        """The rows of parts."""
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p.folder}" for p in parts]) if parts else self.spark.createDataFrame([], schema)

    def merged(self, table: str, manifest: Manifest, schema, only: set[str] | None = None) -> DataFrame:
        """A table's rows, of all buckets or some: base rows but those of changed licences, and the delta's.

        Buckets without a delta are scanned as they are. The plan is the same after any number of refreshes.
        """
        held = lambda by: {b: p for b, p in by.items() if only is None or b in only}
        base, delta, touched = held(manifest.base.get(table, {})), held(manifest.delta.get(table, {})), held(manifest.touched)
        out = self.read_parts([p for b, p in sorted(base.items()) if b not in touched], schema)
        if touched:
            keys = self.read_parts([p for _, p in sorted(touched.items())], "usi long").withColumnRenamed("usi", KEYS[table])
            keys = F.broadcast(keys) if sum(p.rows for p in touched.values()) <= MOST_BROADCAST else keys
            changed = self.read_parts([p for b, p in sorted(base.items()) if b in touched], schema).join(keys, KEYS[table], "left_anti").select(*schema.fieldNames())
            out = out.unionByName(changed).unionByName(self.read_parts([p for _, p in sorted(delta.items())], schema))
        return out

    def open(self, name: str | None = None) -> Registry:
        """The tables of the current, or a named, generation."""
        manifest = self.manifest(name) if name else self.current()
        schemas = self.schemas(manifest)
        names = NameIndex(self.merged(NAME_TERMS, manifest, schemas[NAME_TERMS]), *(sum(v[i] for v in manifest.names.values()) for i in range(3)))
        counts = {t: self.read_parts([p for _, p in sorted(manifest.base.get(t, {}).items())], schemas[t]) for t in COUNTED}
        index = assignments.SpectrumIndex(self.merged(ENTRIES, manifest, schemas[ENTRIES]), counts[COUNTS])
        return Registry(**{t: self.merged(t, manifest, schemas[t]) for t in CLUSTERED}, names=names, spectrum=index, site_cells=counts[SITE_CELLS])

    def damaged(self, manifest: Manifest) -> list[str]:
        """Parts whose rows are no longer those that were written: by count or, where counts agree, by digest."""
        schemas, out = self.schemas(manifest), []
        kinds = [("base", manifest.base), ("delta", manifest.delta)]
        for kind, table, by in [(k, t, by) for k, tables in kinds for t, by in tables.items()] + [("touched", "usi", manifest.touched)]:
            if not by:
                continue
            schema = "usi long" if kind == "touched" else schemas[table]
            number = F.regexp_extract(F.col("_metadata.file_path"), r"/bucket=(\d+)/", 1)
            found = {r["b"]: r for r in content(self.read_parts(list(by.values()), schema).select("*", number.alias("b")), "b").collect()}
            for b, p in sorted(by.items(), key=lambda x: int(x[0])):
                rows, digest = (found[b]["rows"], found[b]["digest"]) if b in found else (0, None)
                if rows != p.rows:
                    out.append(f"{table} {kind} bucket {b}: {rows} rows, {p.rows} written")
                elif digest != p.digest:
                    out.append(f"{table} {kind} bucket {b}: rows have changed")
        return out

    def collect_garbage(self, keep: set[str]) -> list[str]:
        """Deletes generations besides the published one and those to keep, and steps that neither reads; returns names."""
        kept = [self.current(), *(self.manifest(n) for n in keep if self.fs.exists(self.path(f"{n}/manifest.json")))]
        names, used = keep | {m.name for m in kept} | {m.built for m in kept}, {f for m in kept for f in m.folders()}
        gone = [n for s in self.fs.listStatus(self.path("")) if _NAME.fullmatch(n := s.getPath().getName()) and n not in names]
        for n in gone:
            self.fs.delete(self.path(n), True)
        steps = {f.split("/")[1] for f in used}
        for folder in ("parts", "journal"):
            for s in self.fs.listStatus(self.path(folder)) if self.fs.exists(self.path(folder)) else []:
                own = s.getPath().getName()
                if not any(own == x or x.endswith(f"-{own.removesuffix('.json')}") for x in steps):
                    self.fs.delete(s.getPath(), True)
        return gone


def needs_rebuild(manifest: Manifest | None, groups: list[str], snapshot_times: dict[str, str]) -> bool:
    """Whether a new weekly build is due: none yet, an older schema, a missing group, or a newer snapshot."""
    if manifest is None or manifest.schema_version != SCHEMA_VERSION or set(groups) - set(manifest.groups):
        return True
    return any(t > manifest.snapshots.get(g, manifest.checkpoint) for g, t in snapshot_times.items() if g in groups)


def data_as_of(manifest: Manifest, group_of: Callable[[str], str | None] = lambda name: None) -> dict:
    """How current a generation is: its checkpoint, how many daily files it has applied, and each group's newest.

    A group without a daily file is as of its snapshot. group_of tells a daily file's group by its name.
    """
    newest = dict(manifest.snapshots)
    for path, at in manifest.applied.items():
        if (group := group_of(path.rsplit("/", 1)[-1])) is not None:
            newest[group] = max(at, newest.get(group, ""))
    return {"generation": manifest.name, "checkpoint": manifest.checkpoint, "daily_files": len(manifest.applied), "newest": newest}


def newest_applied(files):
    """service_group: the newest applied file's time and the earliest checkpoint, of a table of ingested files."""
    return files.groupBy("service_group").agg(F.max("applied_at").alias("newest_applied"), F.min("counts_created").alias("checkpoint"))

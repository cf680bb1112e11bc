"""Warehouse tables as Parquet folders under one root, switched all at once.

Every load writes new folders (``<table>/load=<id>``) and then one small manifest
file that names the folders each table consists of. Readers follow the newest
manifest, so a load is seen whole or not at all, and a failed one leaves only
folders nobody refers to, until ``vacuum``. Tables are plain Parquet; the root has
to be on a file system that all executors share and that can refuse a name that
exists (``EXCLUSIVE``): stores that copy on rename would let two loads publish.

Hubs and satellites lie in hash buckets of their key, one folder and one file each. The
folders are read as a bucketed table, so a load's join leaves them where they are and
shuffles the stage alone; only the buckets that the stage's keys fall into are read and
written again, the others stay in the manifest as they are.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tillvault.schemas import BAD_LINES, CALENDAR, FILES, JOURNAL, PAIRS, POSITIONS, RECEIPTS, hub_columns, sat_columns, struct

MONTH = "monat"
BUCKET = "eimer"

TABLES: dict[str, dict[str, str]] = {
    "kassenjournal_t": JOURNAL,
    "kassenbons_t": RECEIPTS,
    "kassenbons_pos_t": POSITIONS,
    "kalender_t": CALENDAR,
    "dateien_t": FILES,
    "schlechte_zeilen_t": BAD_LINES,
    **{p.hub: hub_columns(p) for p in PAIRS.values()},
    **{p.sat: sat_columns(p) for p in PAIRS.values()},
}
# Partition columns on disk: months of the till tables; open and closed versions; buckets of keys.
PARTITIONS: dict[str, dict[str, str]] = {
    **dict.fromkeys(("kassenjournal_t", "kassenbons_t", "kassenbons_pos_t"), {MONTH: "string"}),
    **{p.hub: {BUCKET: "int"} for p in PAIRS.values()},
    **{p.sat: {"gueltig": "boolean", BUCKET: "int"} for p in PAIRS.values()},
}


# File systems that can refuse a name that exists: by rename, locally by a link.
EXCLUSIVE = ("file", "hdfs", "viewfs")


class ConcurrentLoad(RuntimeError):
    """Another load was published since this one began."""


def bucket_of(count: int) -> Column:
    """The bucket of a row of a hub, satellite or stage: the one Spark puts it in when it buckets by ``hash``."""
    return F.pmod(F.hash("hash"), F.lit(count))


class Store:
    """``buckets``: into how many parts hubs and satellites are divided, for a big one about its
    bytes by 128 MB. Unless given, as many as the store has, and for a new one as many as the
    session's shuffles have. With another number than it has, a table is divided anew by its next load.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None) -> None:
        if buckets is not None and buckets < 1:
            raise ValueError("buckets must be at least 1")
        self.spark = spark
        self.buckets = buckets
        self.root = root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        if self._fs.getUri().getScheme() not in EXCLUSIVE:
            raise ValueError(f"{root}: loads can only be published on {', '.join(EXCLUSIVE)}")

    # files ------------------------------------------------------------------------

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def _manifest_file(self, version: int) -> str:
        return f"{self.root}/_manifest/{version:012d}.json"

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.root}/_manifest")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[: -len(".json")]) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> tuple[int, dict]:
        """The newest manifest, or one that ``vacuum`` has kept."""
        versions = self._versions()
        if not versions:
            return 0, {"tables": {}}
        chosen = versions[-1] if version is None else version
        stream = self._fs.open(self._path(self._manifest_file(chosen)))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return chosen, json.loads(text)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes staging, manifests but the newest ``keep``, and folders those do not name.

        Not to be run while a load is: what it has written is not named yet. Gives
        the removed folders.
        """
        versions = self._versions()
        named = {
            f"{table}/{folder}"
            for version in versions[-max(1, keep) :]
            for table, folders in self.manifest(version)[1]["tables"].items()
            for folder in folders
        }
        in_use = {name[:at] for name in named for at in range(len(name)) if name[at] == "/"}

        def unnamed(path: str) -> list[str]:
            if path in named:
                return []
            if path not in in_use:
                return [path]
            return [found for name in self._names(path) if "=" in name for found in unnamed(f"{path}/{name}")]

        removed = [found for table in TABLES for name in self._names(table) for found in unnamed(f"{table}/{name}")]
        removed += [f"_stage/{name}" for name in self._names("_stage")]
        for folder in removed:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)
        for version in versions[: -max(1, keep)]:
            self._fs.delete(self._path(self._manifest_file(version)), False)
        return removed

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _publish(self, version: int, content: dict) -> None:
        target = self._path(self._manifest_file(version))
        part = self._path(f"{self.root}/_manifest/.{uuid.uuid4().hex}.part")
        out = self._fs.create(part, False)
        try:
            out.write(bytearray(json.dumps(content, indent=1).encode()))
        finally:
            out.close()
        if not self._moved(part, target):
            self._fs.delete(part, False)
            raise ConcurrentLoad(f"manifest {version} exists already")

    def _moved(self, part, target) -> bool:
        """Gives the file its name unless another has it."""
        if self._fs.getUri().getScheme() != "file":
            return not self._fs.exists(target) and self._fs.rename(part, target)
        # Local renames replace a target; a link does not.
        try:
            os.link(part.toUri().getPath(), target.toUri().getPath())
        except FileExistsError:
            return False
        self._fs.delete(part, False)
        return True

    # tables -----------------------------------------------------------------------

    def read(
        self, table: str, months: tuple[str, str] | None = None, open_only: bool = False, version: int | None = None
    ) -> DataFrame:
        """A table as of the newest manifest, or an older one that is kept.

        ``months`` (first and last, as ``yyyy-MM``) restricts a till table to the
        folders of these months, ``open_only`` a satellite to its open versions.
        """
        folders = self.manifest(version)[1]["tables"].get(table, [])
        if open_only:
            folders = [f for f in folders if "gueltig=false" not in f]
        return self._frame(table, folders, months)

    def _frame(self, table: str, folders: list[str], months: tuple[str, str] | None = None) -> DataFrame:
        columns = TABLES[table]
        schema = struct({**columns, **PARTITIONS.get(table, {})})
        if folders:
            base = f"{self.root}/{table}"
            paths = [f"{base}/{f}" for f in folders]
            found = self.spark.read.schema(schema).option("basePath", base).parquet(*paths)
        else:
            found = self.spark.createDataFrame([], schema)
        if months:
            found = found.filter(F.col(MONTH).between(*months))
        return found.select(*columns)

    def months(self, table: str) -> DataFrame:
        """The months of a till table, in order, by the names of its folders: no column of it is read."""
        folders = self.manifest()[1]["tables"].get(table, [])
        schema = struct({**TABLES[table], **PARTITIONS[table]})
        if not folders:
            return self.spark.createDataFrame([], schema).select(MONTH)
        base = f"{self.root}/{table}"
        rows = self.spark.read.schema(schema).option("basePath", base).parquet(*(f"{base}/{f}" for f in folders))
        return rows.select(MONTH).distinct().orderBy(MONTH)

    def begin(self) -> Load:
        version, content = self.manifest()
        own = content.get("buckets", {})
        default = self.buckets or max(own.values(), default=int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return Load(self, version, content["tables"], own, default)


@dataclass
class Load:
    """One load: writes folders, then ``commit`` makes them the tables' content."""

    store: Store
    version: int
    tables: dict[str, list[str]]
    divided: dict[str, int]  # buckets that tables have
    buckets: int  # buckets that they get
    id: str = field(default_factory=lambda: f"l{uuid.uuid4().hex}")
    rows: dict[str, int] = field(default_factory=dict)  # what stage() and append() have written, by name
    _names: list[str] = field(default_factory=list)

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        """Writes an intermediate result and reads it back: later steps do not repeat it."""
        path = f"{self.store.root}/_stage/{name}/load={self.id}"
        self.rows[name] = _counted(df, F.count(F.lit(1)), lambda rows: rows.write.parquet(path))
        return self.store.spark.read.schema(df.schema).parquet(path)

    def append(self, table: str, df: DataFrame) -> DataFrame:
        """Adds rows; gives the added rows back as written."""
        folder = f"load={self.id}"
        path, parts = f"{self.store.root}/{table}/{folder}", list(PARTITIONS.get(table, {}))

        def write(rows: DataFrame) -> None:
            (rows.write.partitionBy(*parts) if parts else rows.write).parquet(path)

        self.rows[table] = _counted(df, F.count(F.lit(1)), write)
        self.tables.setdefault(table, []).append(folder)
        return self.store._frame(table, [folder])

    def current(self, table: str) -> DataFrame:
        return self.store._frame(table, self.tables.get(table, []))

    # buckets ----------------------------------------------------------------------

    def touched(self, stage: DataFrame, *tables: str) -> list[int]:
        """The buckets that the stage's keys fall into; all of them where a table is to be divided anew."""
        if any(self.divided.get(t, self.buckets) != self.buckets for t in tables):
            return list(range(self.buckets))
        return sorted(row[0] for row in stage.select(bucket_of(self.buckets)).distinct().collect())

    def _live(self, table: str) -> dict[int, str]:
        """The folder of each bucket: hub rows, or open versions."""
        folders = [f for f in self.tables.get(table, []) if "gueltig=false" not in f]
        return {int(f.rpartition("=")[2]): f for f in folders}

    def in_buckets(self, table: str, buckets: list[int]) -> DataFrame:
        """Hub rows or open versions of some buckets, as Spark knows them to be bucketed by ``hash``."""
        live = self._live(table)
        if self.divided.get(table, self.buckets) != self.buckets:
            return self.store._frame(table, list(live.values()))
        found = {b: live[b] for b in buckets if b in live}
        if not found:
            return self.store._frame(table, [])
        name = self._table(table, [BUCKET], f"{self.store.root}/{table}")
        places = (f"PARTITION ({BUCKET} = {b}) LOCATION '{self.store.root}/{table}/{f}'" for b, f in found.items())
        self.store.spark.sql(f"ALTER TABLE {name} ADD {' '.join(places)}")
        rows = self.store.spark.table(name)
        if "gueltig" in PARTITIONS[table]:
            rows = rows.withColumn("gueltig", F.lit(True))
        return rows.select(*TABLES[table])

    def replace_buckets(self, table: str, df: DataFrame, buckets: list[int], count: Column) -> int:
        """Writes the next state of some buckets; gives ``count`` of the rows written.

        Of a satellite that is its open versions; versions closed before stay, those
        closed now are added. ``df`` may have columns for ``count`` that are not kept.
        """
        parts = list(PARTITIONS[table])
        folder = f"load={self.id}"
        live = self._live(table)
        if self.divided.get(table, self.buckets) != self.buckets or not any(b in live for b in buckets):
            # Nothing has brought the rows into buckets yet.
            df = df.repartition(self.buckets, "hash")
        name = self._table(table, parts, f"{self.store.root}/{table}/{folder}")
        columns = [c for c in TABLES[table] if c not in parts]
        places = [bucket_of(self.buckets).alias(c) if c == BUCKET else F.col(c) for c in parts]
        counted = _counted(df, count, lambda rows: rows.select(*columns, *places).write.insertInto(name))

        opened = f"{folder}/gueltig=true" if "gueltig" in parts else folder
        written = {int(n.rpartition("=")[2]): f"{opened}/{n}" for n in self.store._names(f"{table}/{opened}") if "=" in n}
        closed = [f for f in self.tables.get(table, []) if "gueltig=false" in f]
        if self.store.exists(f"{self.store.root}/{table}/{folder}/gueltig=false"):
            closed.append(f"{folder}/gueltig=false")
        kept = {} if len(buckets) == self.buckets else {b: f for b, f in live.items() if b not in set(buckets)}
        self.tables[table] = closed + [f for _, f in sorted((kept | written).items())]
        self.divided[table] = self.buckets
        return counted

    def rewrite(self, table: str) -> list[int]:
        """All buckets, where the whole table is going to be written: nothing of it stays."""
        self.tables[table] = []
        return list(range(self.buckets))

    def _table(self, table: str, parts: list[str], path: str) -> str:
        """A bucketed table of the session over ``path``, until ``close``."""
        types = TABLES[table] | PARTITIONS[table]
        columns = [c for c in types if c not in PARTITIONS[table]] + parts
        name = f"tillvault_{uuid.uuid4().hex}"
        self.store.spark.sql(
            f"""CREATE TABLE {name} ({", ".join(f"`{c}` {types[c]}" for c in columns)}) USING parquet
            PARTITIONED BY ({", ".join(parts)}) CLUSTERED BY (hash) INTO {self.buckets} BUCKETS LOCATION '{path}'"""
        )
        self._names.append(name)
        return name

    def close(self) -> None:
        """Forgets the session's tables; the files stay."""
        while self._names:
            self.store.spark.sql(f"DROP TABLE IF EXISTS {self._names.pop()}")

    def commit(self) -> int:
        self.store._publish(self.version + 1, {"tables": self.tables, "buckets": self.divided})
        return self.version + 1


def _counted(df: DataFrame, count: Column, write: Callable[[DataFrame], None]) -> int:
    """Writes ``df`` and gives ``count`` over its rows, observed while they are written: nothing is read again."""
    seen = Observation()
    write(df.observe(seen, count.alias("n")))
    return seen.get["n"]

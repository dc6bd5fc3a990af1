"""Operator 3: shards with size-tiered compaction and a versioned manifest.

A store is a folder with immutable data files and manifests ``v<number>.json``, each of which lists
all shards of one version. append() writes an arrival as small shards and commits a version that adds
them; append_dealt() deals a table's rows to several arrivals in turn, writes them all in one pass them one after another. compact() merges runs of shards of one size tier (tiers grow by FANOUT) into files of about the
target size and commits a version that has these in place of their inputs; files of the target size
are left alone. A version is committed by renaming a finished file to its name, which fails if another
writer has taken that number; then the change is made anew on top of the newer version, or given up if
its inputs are gone. Readers see one version as a whole; earlier ones stay until vacuum().

Merging reads each group of shards in one task and writes one file: there is no shuffle, and a group
is bounded by the target size. Groups are handled in jobs of at most JOB_GROUPS.

Rows are kept as they are, with all columns, nulls, very long texts and repeated rows. An arrival
without rows adds a version without shards. Columns of one store must not change.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seqloom.llm.scratch import file_system

TARGET_BYTES, SMALLEST, FANOUT, JOB_GROUPS = 128 << 20, 1 << 20, 4, 32


class Conflict(Exception):
    """Another writer took the version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES, fanout: int = FANOUT) -> None:
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target, fanout
        self.fs, path = file_system(spark, self.root)
        self.fs.mkdirs(self._path("manifests"))
        self.fs.mkdirs(self._path("data"))

    def _path(self, name: str):  # noqa: ANN202
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path("manifests"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """A version's number, schema and shards (name and bytes); 0 stands for the empty store."""
        known = self.versions()
        version = (known or [0])[-1] if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        stream = self.fs.open(self._path(f"manifests/v{version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> int:
        """Make the manifest visible under its number in one step, or raise Conflict."""
        sc = self.spark.sparkContext
        fs = sc._jvm.org.apache.hadoop.fs
        own, to = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/v{manifest['version']}.json")
        stream = self.fs.create(own, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        none = sc._gateway.new_array(getattr(fs, "Options$Rename"), 0)
        try:
            fs.FileContext.getFileContext(own.toUri() if own.toUri().getScheme() else self.fs.getUri(), sc._jsc.hadoopConfiguration()).rename(own, to, none)
        except Exception as error:
            self.fs.delete(own, False)
            if self.fs.exists(to):
                raise Conflict(str(to)) from error
            raise
        return manifest["version"]

    def _files(self, name: str) -> list[dict]:
        """Name and bytes of the data files in a folder and below, by name."""
        found, top = [], self.fs.makeQualified(self._path("x")).getParent().toString().rstrip("/")
        each = self.fs.listFiles(self._path(name), True)
        while each.hasNext():
            s = each.next()
            if s.getPath().getName().startswith("part-"):
                found.append({"name": s.getPath().toString()[len(top) + 1 :], "bytes": s.getLen()})
        return sorted(found, key=lambda s: s["name"])

    def _written(self, df: DataFrame) -> list[dict]:
        """Write a frame and return its shards."""
        name = f"data/{uuid.uuid4().hex}"
        # else the union of groups of one partition each becomes one partition
        key, conf = "spark.sql.unionOutputPartitioning", self.spark.conf
        before = conf.get(key, None)
        conf.set(key, "false")
        try:
            df.write.parquet(f"{self.root}/{name}")
        finally:
            conf.unset(key) if before is None else conf.set(key, before)
        return self._files(name)

    def _added(self, shards: list[dict], schema: dict) -> int:
        """Commit a version with more shards."""
        while True:
            now = self.manifest()
            if now["schema"] is not None and [f["name"] for f in now["schema"]["fields"]] != [f["name"] for f in schema["fields"]]:
                raise ValueError("the arrival's columns are not those of the store")
            try:
                return self._commit({"version": now["version"] + 1, "schema": now["schema"] or schema, "shards": now["shards"] + shards})
            except Conflict:
                continue

    def append(self, arrival: DataFrame) -> int:
        """Write an arrival as it is partitioned, one shard a task, and commit it. Returns the version."""
        return self._added(self._written(arrival), arrival.schema.jsonValue())

    def append_dealt(self, table: DataFrame, arrivals: int) -> int:
        """Deal a table's rows to arrivals and commit each. Returns the last version.

        A task writes one shard for each arrival that it has rows of; the table is read once."""
        name, column = f"data/{uuid.uuid4().hex}", f"arrival_{uuid.uuid4().hex}"
        table.withColumn(column, F.monotonically_increasing_id() % arrivals).write.partitionBy(column).parquet(f"{self.root}/{name}")
        shards, version = self._files(name), 0
        for k in range(arrivals):
            version = self._added([s for s in shards if f"/{column}={k}/" in s["name"]], table.schema.jsonValue())
        return version

    def tier(self, size: int) -> int:
        tier, edge = 0, SMALLEST
        while size > edge:
            tier, edge = tier + 1, edge * self.fanout
        return tier

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """Groups to merge: runs of one tier with at least FANOUT shards, or enough bytes for a file."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            if s["bytes"] < self.target // 2:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        groups = []
        for _, run in sorted(tiers.items()):
            if len(run) < self.fanout and sum(s["bytes"] for s in run) < self.target:
                continue
            group: list[dict] = []
            for s in run:
                if group and sum(g["bytes"] for g in group) + s["bytes"] > self.target:
                    groups.append(group)
                    group = []
                group.append(s)
            groups.append(group)
        return [g for g in groups if len(g) > 1]

    def compact(self) -> int:
        """Merge until no tier has a run to merge. Returns the version."""
        while groups := self.plan(self.manifest()["shards"])[:JOB_GROUPS]:
            schema = StructType.fromJson(self.manifest()["schema"])
            read = self.spark.read.schema(schema)
            parts = [read.parquet(*(f"{self.root}/{s['name']}" for s in g)).coalesce(1) for g in groups]
            merged = self._written(reduce(DataFrame.union, parts))
            inputs = {s["name"] for g in groups for s in g}
            while True:
                now = self.manifest()
                if not inputs <= {s["name"] for s in now["shards"]}:
                    break  # another writer has merged some of them; what was written stays unreferenced
                kept = [s for s in now["shards"] if s["name"] not in inputs]
                try:
                    self._commit({"version": now["version"] + 1, "schema": now["schema"], "shards": kept + merged})
                    break
                except Conflict:
                    continue
        return self.manifest()["version"]

    def vacuum(self, keep: int = 1) -> None:
        """Delete all but the last ``keep`` versions, and data that none of these lists. Not while others write."""
        known = self.versions()
        for v in known[:-keep]:
            self.fs.delete(self._path(f"manifests/v{v}.json"), False)
        used = {s["name"] for v in known[-keep:] for s in self.manifest(v)["shards"]}
        folders = {n.split("/")[1] for n in used}
        for folder in self.fs.listStatus(self._path("data")):
            if folder.getPath().getName() not in folders:
                self.fs.delete(folder.getPath(), True)
        for s in self._files("data"):
            if s["name"] not in used:
                self.fs.delete(self._path(s["name"]), False)

    def read(self, version: int | None = None) -> DataFrame:
        manifest = self.manifest(version)
        if manifest["schema"] is None:
            raise ValueError("the store has no version yet")
        schema = StructType.fromJson(manifest["schema"])
        if not manifest["shards"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{s['name']}" for s in manifest["shards"]))

"""Sharding by size-tiered compaction behind a versioned manifest.

Arrivals are appended as small immutable Parquet shards.  Compaction merges
runs of similar size, a fixed number at a time, until they reach the target
size; the merge is planned on sizes alone, so every row is rewritten once per
compaction.  A manifest names the shards of a version; it is written aside and
renamed into place without overwriting, so readers see a whole version and of
two writers that race one fails.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import spare_name

MB = 1 << 20
#: Groups of shards that one job merges, a task each.
JOB_GROUPS = 64


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class Shard:
    path: str
    size: int


def tier(size: int, smallest: int, fan_in: int) -> int:
    return max(0, int(math.log(max(size, 1) / smallest, fan_in))) if size > smallest else 0


def plan(shards: list[Shard], target: int, fan_in: int = 4, smallest: int = MB) -> list[list[Shard]]:
    """Groups of shards to merge, each into one file of at most about ``target`` bytes.

    While ``fan_in`` runs of one tier fit the target together they become one
    run, which then stands in its own tier; shards at the target stay alone.
    """
    runs = [(s.size, [s]) for s in sorted(shards, key=lambda s: (s.size, s.path))]
    done: list[list[Shard]] = []
    while runs:
        tiers: dict[int, list] = {}
        for run in sorted(runs, key=lambda r: (r[0], r[1][0].path)):
            tiers.setdefault(tier(run[0], smallest, fan_in), []).append(run)
        runs, merged = [], False
        for own in tiers.values():
            held: list = []
            for run in own:
                if run[0] >= target:
                    done.append(run[1])
                    continue
                if held and sum(r[0] for r in held) + run[0] > target:
                    # The target is reached with fewer runs: they are merged and final.
                    done.append([s for r in held for s in r[1]])
                    held = []
                held.append(run)
                if len(held) == fan_in:
                    runs.append((sum(r[0] for r in held), [s for r in held for s in r[1]]))
                    held, merged = [], True
            runs += held
        if not merged:
            done += [r[1] for r in runs]
            break
    return [g for g in done if len(g) > 1]


class ShardStore:
    """A folder of shards and manifests, on any file system that Spark can write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(self.root).getFileSystem(self.conf)
        self.context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(self.root).toUri(), self.conf)
        self.fs.mkdirs(self.path(f"{self.root}/manifests"))

    def versions(self) -> list[int]:
        found = self.fs.listStatus(self.path(f"{self.root}/manifests"))
        return sorted(int(n[1:-5]) for s in found if (n := s.getPath().getName()).startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version (the latest when None); an empty store has version 0."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "schema": None, "shards": []}
        stream = self.fs.open(self.path(f"{self.root}/manifests/v{version:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, base: dict, schema: str, shards: list[Shard]) -> dict:
        """Make ``shards`` the version after ``base``; raises CommitConflict if that exists."""
        new = {"version": base["version"] + 1, "schema": schema, "shards": [[s.path, s.size] for s in shards]}
        aside = self.path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        stream = self.fs.create(aside, False)
        stream.write(bytearray(json.dumps(new).encode()))
        stream.close()
        none = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        target = self.path(f"{self.root}/manifests/v{new['version']:08d}.json")
        try:
            self.context.rename(aside, target, none)
        except Exception as e:
            self.fs.delete(aside, False)
            if self.fs.exists(target):
                raise CommitConflict(f"version {new['version']} exists") from e
            raise
        return new

    def files(self, folder: str) -> list[Shard]:
        if not self.fs.exists(self.path(folder)):
            return []
        return [Shard(s.getPath().toString(), s.getLen()) for s in self.fs.listStatus(self.path(folder)) if s.getPath().getName().endswith(".parquet") and s.getLen()]

    @staticmethod
    def shards(manifest: dict) -> list[Shard]:
        return [Shard(*x) for x in manifest["shards"]]

    def append(self, rows: DataFrame, arrival: Column | None = None, arrivals: int = 1, most_rows: int = 20_000) -> dict:
        """Write ``rows`` as small shards and commit them, one version for each of ``arrivals``.

        ``arrival`` numbers the arrivals from 0; all are written by one job
        without a shuffle.
        """
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        number = F.lit(0) if arrival is None else F.coalesce(arrival.cast("int"), F.lit(0))
        name = spare_name(rows, "arrival")
        try:
            rows.withColumn(name, number).write.option("maxRecordsPerFile", most_rows).partitionBy(name).parquet(folder)
            manifest = self.manifest()
            for i in range(arrivals):
                manifest = self.commit(manifest, rows.schema.json(), self.shards(manifest) + self.files(f"{folder}/{name}={i}"))
        except Exception:
            self.discard(folder)
            raise
        return manifest

    def discard(self, folder: str) -> None:
        """Delete a folder of files unless some version names one of them."""
        named = {p for v in self.versions() for p, _ in self.manifest(v)["shards"]}
        where = self.path(folder)
        if self.fs.exists(where) and not any(folder.rsplit("/", 1)[1] in p for p in named):
            self.fs.delete(where, True)

    def compact(self, target: int = 128 * MB, fan_in: int = 4) -> dict:
        """Merge shards by size tiers and commit; a compaction with nothing to merge commits nothing.

        A task reads the shards of one group and writes its file, without a
        shuffle; a job has JOB_GROUPS of them, and as many jobs run at once as
        the cluster's cores can take.
        """
        manifest = self.manifest()
        groups = plan(self.shards(manifest), target, fan_in)
        if not groups:
            return manifest
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        folder = f"{self.root}/data/{uuid.uuid4().hex}"

        def merge(job: int) -> list[Shard]:
            own = groups[job : job + JOB_GROUPS]
            tasks = [self.spark.read.schema(schema).parquet(*(s.path for s in g)).coalesce(1) for g in own]
            reduce(DataFrame.unionAll, tasks).write.parquet(f"{folder}/{job}")
            return self.files(f"{folder}/{job}")

        # Else Spark would zip inputs of one partition each into one partition.
        conf, key = self.spark.conf, "spark.sql.unionOutputPartitioning"
        before = conf.get(key, None)
        conf.set(key, "false")
        try:
            jobs = range(0, len(groups), JOB_GROUPS)
            with ThreadPoolExecutor(max(1, -(-self.spark.sparkContext.defaultParallelism // JOB_GROUPS))) as pool:
                merged = [s for out in pool.map(merge, jobs) for s in out]
            gone = {s.path for g in groups for s in g}
            return self.commit(manifest, manifest["schema"], [s for s in self.shards(manifest) if s.path not in gone] + merged)
        except Exception:
            self.discard(folder)
            raise
        finally:
            conf.set(key, before) if before is not None else conf.unset(key)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the latest when None)."""
        manifest = self.manifest(version)
        if manifest["schema"] is None:
            raise ValueError("the store has no version yet")
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        paths = [p for p, _ in manifest["shards"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def vacuum(self, keep: int = 1, orphans_after: float = 86_400) -> int:
        """Delete files that none of the last ``keep`` versions names; returns how many.

        Of files that no version ever named (left by a writer that died) those
        older than ``orphans_after`` seconds go too; younger ones may be about
        to be committed.
        """
        versions = self.versions()
        used = {p for v in versions[-keep:] for p, _ in self.manifest(v)["shards"]}
        gone = {p for v in versions[:-keep] for p, _ in self.manifest(v)["shards"]} - used
        old = (time.time() - orphans_after) * 1000
        there = self.fs.listFiles(self.path(f"{self.root}/data"), True) if self.fs.exists(self.path(f"{self.root}/data")) else None
        while there is not None and there.hasNext():
            s = there.next()
            if s.getPath().toString() not in used and s.getModificationTime() < old:
                gone.add(s.getPath().toString())
        for p in gone:
            self.fs.delete(self.path(p), False)
        for v in versions[:-keep]:
            self.fs.delete(self.path(f"{self.root}/manifests/v{v:08d}.json"), False)
        return len(gone)


def shard_documents(docs: DataFrame, root: str, arrivals: int = 8, target: int = 128 * MB, fan_in: int = 4) -> ShardStore:
    """Append ``docs`` in ``arrivals`` batches (by hash of doc_id) and compact them under ``root``.

    All rows and columns are kept as they are: nulls, repeated rows and empty
    or very long texts included.  An empty table gives a version without shards.
    """
    store = ShardStore(docs.sparkSession, root)
    store.append(docs, F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)), arrivals)
    store.compact(target, fan_in)
    return store

"""A table in buckets by key, whose updates rewrite only the buckets they meet.

Rows lie in files of one bucket each, a bucket being the key's hash modulo their number. A version of the table is a manifest, one small file that names the files of every bucket; the newest manifest is the
table. A change writes new files beside the old ones and then the next manifest, which is put there in one step and only if no other writer has put it: readers see all of a change or nothing, a
crash leaves the version before, and of two writers the second one is told and starts again on what the first one wrote. So a check and what rests on it, such as that no key occurs twice, are one
step. A manifest also remembers the last batch of each stream that wrote, so a batch that runs again does nothing.

Old files go with vacuum(). The manifest's size depends on buckets and files, not rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenry.functions.lineage import cut
from lumenry.operators.store import duplicates, updated

#: Rows of updates that are sent to the buckets they meet; more are joined by shuffle.
MOST_SENT = 1_000_000
#: How often a change starts again because another writer was first.
TRIES = 20


class Overtaken(Exception):
    """Another writer put the next version."""


class BucketTable:
    """The table in a folder; made with `buckets` buckets if it isn't there."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "custom_id", buckets: int = 256):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)
        if self.version() < 0:
            try:
                self._commit(-1, {"buckets": buckets, "files": {}, "batches": {}})
            except Overtaken:
                pass
        self.buckets = self.manifest()["buckets"]

    # versions

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def version(self) -> int:
        """The number of the newest manifest, -1 if there is none."""
        found = self._fs.globStatus(self._at("manifests/*.json")) or []
        return max((int(s.getPath().getName().split(".")[0]) for s in found), default=-1)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        stream = self._fs.open(self._at(f"manifests/{version:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")) | {"version": version}
        finally:
            stream.close()

    def _commit(self, base: int, manifest: dict) -> int:
        """Puts the version after `base`; it is written beside and renamed, which fails if it is there."""
        beside, at = self._at(f"manifests/.{uuid.uuid4().hex}"), self._at(f"manifests/{base + 1:012d}.json")
        stream = self._fs.create(beside, False)
        stream.write(bytearray(json.dumps({k: v for k, v in manifest.items() if k != "version"}).encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        plain = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(beside, at, plain)
        except Exception as e:
            self._fs.delete(beside, False)
            if "FileAlreadyExists" in str(e):
                raise Overtaken(at.toString()) from e
            raise
        return base + 1

    def _again(self, change: Callable[[dict], dict | None]) -> int | None:
        """Makes a manifest from the newest one and puts it, anew where another writer was first."""
        for _ in range(TRIES):
            base = self.manifest()
            made = change(base)
            if made is None:
                return None
            try:
                return self._commit(base["version"], made)
            except Overtaken:
                continue
        raise Overtaken(self.path)

    # rows

    def bucket(self, key: Column | str | None = None) -> Column:
        return F.pmod(F.xxhash64(self.key if key is None else key), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets."""
        files = self.manifest(version)["files"]
        paths = [f"{self.path}/{x}" for b, own in files.items() if buckets is None or int(b) in buckets for x in own]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def find(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys, from their buckets only."""
        return self.read(buckets=self._met(keys)).join(keys.select(self.key), self.key, "left_semi")

    def _met(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self.bucket()).distinct().collect()]  # at most one for each bucket

    def _write(self, rows: DataFrame) -> dict[str, list[str]]:
        """Files of rows by bucket, one each."""
        folder = f"data/{uuid.uuid4().hex}"
        named = rows.select(*self.schema.names).withColumn("_bucket", self.bucket())
        named.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        out: dict[str, list[str]] = {}
        for s in self._fs.globStatus(self._at(f"{folder}/_bucket=*/*.parquet")) or []:
            at = s.getPath()
            out.setdefault(at.getParent().getName().split("=")[1], []).append(f"{folder}/{at.getParent().getName()}/{at.getName()}")
        return out

    def append(self, rows: DataFrame, stream: str | None = None, batch: int | None = None) -> int | None:
        """Adds rows; refuses all of them if a key would occur twice. The new version, or None if the stream's batch was added before."""
        rows = cut(rows.select(*self.schema.names))  # looked at more than once, and again if another writer is first

        def change(base: dict) -> dict | None:
            if stream is not None and base["batches"].get(stream, -1) >= batch:
                return None
            had = self.read(base["version"], self._met(rows)).select(self.key)
            if not duplicates(rows, self.key).isEmpty() or not had.join(rows.select(self.key), self.key, "left_semi").isEmpty():
                raise ValueError(f"a {self.key} occurs twice")
            new = self._write(rows)
            files = {b: [*base["files"].get(b, []), *new.get(b, [])] for b in {*base["files"], *new}}
            return base | {"files": files, "batches": base["batches"] | ({stream: batch} if stream is not None else {})}

        return self._again(change)

    def _rewritten(self, made: Callable[[DataFrame], DataFrame], keys: DataFrame, base: dict) -> dict:
        met = self._met(keys)
        new = self._write(made(self.read(base["version"], met)))
        files = {b: x for b, x in base["files"].items() if int(b) not in met} | new
        return base | {"files": files}

    def update(self, updates: DataFrame, columns: dict[str, str] | None = None) -> int | None:
        """Puts the columns of updates (new name by old) into the rows of the same key; matched nulls replace too. Only buckets of the updates' keys are read and written."""
        updates = cut(updates)
        if updates.isEmpty():
            return None
        few = F.broadcast(updates) if updates.count() <= MOST_SENT else updates
        return self._again(lambda base: self._rewritten(lambda rows: updated(rows, few, self.key, columns), updates, base))

    def upsert(self, rows: DataFrame, stream: str | None = None, batch: int | None = None) -> int | None:
        """Rows in place of those of the same key, or new ones; a key that comes twice is refused."""
        rows = cut(rows.select(*self.schema.names))
        if not duplicates(rows, self.key).isEmpty():
            raise ValueError(f"a {self.key} occurs twice")

        def change(base: dict) -> dict | None:
            if stream is not None and base["batches"].get(stream, -1) >= batch:
                return None
            done = {stream: batch} if stream is not None else {}
            return self._rewritten(lambda old: old.join(rows.select(self.key), self.key, "left_anti").unionByName(rows.select(*self.schema.names)), rows, base) | {"batches": base["batches"] | done}

        return self._again(change)

    def delete(self, keys: DataFrame) -> int | None:
        keys = cut(keys.select(self.key))
        return self._again(lambda base: self._rewritten(lambda rows: rows.join(keys.select(self.key), self.key, "left_anti"), keys, base))

    def compact(self, most_files: int = 1) -> int | None:
        """Buckets of more than so many files become one file each."""

        def change(base: dict) -> dict | None:
            many = [int(b) for b, x in base["files"].items() if len(x) > most_files]
            if not many:
                return None
            new = self._write(self.read(base["version"], many))
            return base | {"files": {b: x for b, x in base["files"].items() if int(b) not in many} | new}

        return self._again(change)

    def changed(self, since: int, until: int | None = None) -> list[int]:
        """Buckets whose files differ between two versions."""
        a, b = self.manifest(since)["files"], self.manifest(until)["files"]
        return sorted(int(k) for k in {*a, *b} if a.get(k) != b.get(k))

    def vacuum(self, versions: int = 2) -> int:
        """Deletes files and manifests that none of the last versions needs; how many files went. Not while another writer is at work."""
        newest = self.version()
        kept = {x for v in range(max(0, newest - versions + 1), newest + 1) for own in self.manifest(v)["files"].values() for x in own}
        gone = 0
        for s in self._fs.globStatus(self._at("data/*/_bucket=*/*.parquet")) or []:
            name = "/".join(s.getPath().toString().split("/")[-4:])
            if name not in kept:
                gone += self._fs.delete(s.getPath(), False)
        for v in range(max(0, newest - versions + 1)):
            self._fs.delete(self._at(f"manifests/{v:012d}.json"), False)
        return gone

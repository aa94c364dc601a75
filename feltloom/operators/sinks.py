"""Durable tables on plain Parquet with an atomic commit of several at once.

A commit writes each changed table to a new version directory and then one manifest file whose name is
the commit's number; readers go by the highest manifest. The manifest is written under a temporary name and then
renamed, which is the commit point: a commit that dies before it leaves nothing that is read, and a commit that is run
again for the same batch is passed over. Of older commits the last ``KEPT`` stay for readers that began on them.
All files go through Spark's own file systems, so the store may lie anywhere that Spark can write.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feltloom.model import ALIASES, ANNOUNCE_STATE, DOCUMENTS, FEED_ITEMS, FETCH_STATE, HELD, KEYED_TIME, LIVE, PENDING, REJECTS, TRACKS

TABLES = {"feed_items": FEED_ITEMS, "live": LIVE, "first_seen": KEYED_TIME, "item_dates": KEYED_TIME, "fetch_state": FETCH_STATE, "rejects": REJECTS, "change_state": "source_id string, version int, revision bigint", "baseline": "source_id string, guid string, title string, link string, metadata string, ord int", "announced": "source_id string, guid string, name string", "announce_state": ANNOUNCE_STATE, "aliases": ALIASES, "tracks": TRACKS, "held": HELD, "pending": PENDING, "documents": DOCUMENTS}

#: Commits whose tables stay readable.
KEPT = 20
#: The form that tables are written in. A store of a later one is refused, tables of an earlier one are brought up to it as they are read.
STORE_VERSION = 1
#: By version: what makes a table (by name) of that version one of the next.
UPGRADES: dict[int, dict[str, Callable[[DataFrame], DataFrame]]] = {0: {"announced": lambda old: with_column(old, "name", F.lit(None).cast("string"))}}


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows, in a form that the optimizer sees through: joins and unions with it go."""
    return spark.createDataFrame([], schema).limit(0)


class Store:
    """Versioned tables under ``path``; absent tables are empty, absent columns null."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.cuts = spark, path.rstrip("/"), []
        self._read_at: dict | None = None

    def _fs(self):
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def refresh(self) -> None:
        """Go by the manifest that is the last one now; until the next commit or refresh all reads go by it, so a poll never mixes versions."""
        self._read_at = self.manifest()

    def manifest(self) -> dict:
        """Of the last commit: number, batch, tables (name to directory)."""
        fs, folder = self._fs()
        if not fs.exists(folder):
            return {"number": 0, "batch": None, "tables": {}}
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        if not names:
            return {"number": 0, "batch": None, "tables": {}}
        found = self._read(fs, self.spark._jvm.org.apache.hadoop.fs.Path(folder, names[-1]))
        if max(found.get("versions", {}).values(), default=0) > STORE_VERSION:
            raise ValueError("the store was written by a later version")
        return found

    def _read(self, fs, path) -> dict:
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def table(self, name: str) -> DataFrame:
        if self._read_at is None:
            self.refresh()
        folder = self._read_at["tables"].get(name)
        if folder is None:
            return empty(self.spark, TABLES[name])
        version = self._read_at.get("versions", {}).get(name, 0)
        if version == STORE_VERSION:
            return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{folder}")
        frame = self.spark.read.parquet(f"{self.path}/{folder}")
        for step in range(version, STORE_VERSION):
            frame = UPGRADES.get(step, {}).get(name, lambda old: old)(frame)
        fields = [c.split(" ", 1) for c in re.split(r", (?=\w+ )", TABLES[name])]
        return frame.select(*[F.col(c).cast(kind).alias(c) for c, kind in fields])

    def cut(self, frame: DataFrame) -> DataFrame:
        """``frame``, written beside the tables until the next commit has ended: work that a commit's tables share is done once."""
        folder = f"{self.path}/cuts/{uuid.uuid4().hex}"
        self.cuts.append(folder)
        frame.write.parquet(folder)
        return self.spark.read.schema(frame.schema).parquet(folder)

    def commit(self, tables: dict[str, DataFrame], batch: int | None = None) -> bool:
        """Write all of ``tables`` (whole new contents), then the manifest. False if ``batch`` was committed before."""
        try:
            return self._commit(tables, batch)
        finally:
            fs, _ = self._fs()
            while self.cuts:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.cuts.pop()), True)

    def _commit(self, tables: dict[str, DataFrame], batch: int | None) -> bool:
        now = self.manifest()
        if self._read_at is not None and self._read_at["number"] != now["number"]:
            self._read_at = None
            raise RuntimeError("another writer committed since these tables were read")
        if batch is not None and now["batch"] is not None and batch <= now["batch"]:
            return False
        folders, versions = dict(now["tables"]), dict(now.get("versions", {}))
        for name, frame in tables.items():
            folder = f"{name}/v{now['number'] + 1:08d}-{uuid.uuid4().hex[:8]}"
            columns = [c.split()[0] for c in TABLES[name].split(", ")]
            frame.select(*columns).write.parquet(f"{self.path}/{folder}")
            folders[name], versions[name] = folder, STORE_VERSION
        fs, folder = self._fs()
        fs.mkdirs(folder)
        number = now["number"] + 1
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        target, draft = path(folder, f"{number:08d}.json"), path(folder, f"{number:08d}-{uuid.uuid4().hex}.tmp")
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps({"number": number, "batch": batch, "tables": folders, "versions": versions}).encode()))
        finally:
            stream.close()
        self._publish(fs, draft, target)
        self._read_at = None
        self._retire(fs, folder)
        return True

    def _publish(self, fs, draft, target) -> None:
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise RuntimeError(f"another writer committed {target.getName()} first")

    def _retire(self, fs, folder) -> None:
        """Delete manifests before the last ``KEPT``, and the tables that no later one names."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        old = names[:-KEPT]
        if not old:
            return
        used = {t for name in names[-KEPT:] for t in self._read(fs, path(folder, name))["tables"].values()}
        for name in old:
            for table in set(self._read(fs, path(folder, name))["tables"].values()) - used:
                fs.delete(path(f"{self.path}/{table}"), True)
            fs.delete(path(folder, name), False)


class Draft:
    """What a step sees and changes of a store, for several steps to be committed at once; ``views`` stand for whole tables."""

    def __init__(self, store: Store, views: dict[str, DataFrame] | None = None):
        self.store, self.changed = store, dict(views or {})

    def table(self, name: str) -> DataFrame:
        return self.changed[name] if name in self.changed else self.store.table(name)

    def cut(self, frame: DataFrame) -> DataFrame:
        return self.store.cut(frame)

    def commit(self, tables: dict[str, DataFrame], batch: int | None = None) -> bool:
        self.changed |= tables
        return True


def replace_source(stored: DataFrame, new: DataFrame, sources: DataFrame) -> DataFrame:
    """Snapshot replace: rows of the polled sources go, even if nothing comes in their place."""
    return stored.join(sources.select("source_id").distinct(), "source_id", "left_anti").unionByName(new, allowMissingColumns=True)


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new row wins, all fields."""
    return stored.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_ignore(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The stored row wins: what was published stays as it was."""
    return stored.unionByName(new.join(stored.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def insert_unique(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Append; reading the result fails if a key is there twice."""
    from feltloom.operators.gates import unique_or_fail

    return unique_or_fail(stored.unionByName(new, allowMissingColumns=True), keys)


def keep_earliest(stored: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """First-seen times: the earlier one, by a partial aggregate."""
    return stored.unionByName(new, allowMissingColumns=True).groupBy(*keys).agg(F.min(at).alias(at))


def with_column(frame: DataFrame, name: str, default: Column) -> DataFrame:
    """Schema migration on read: a column added since is filled with its default."""
    return frame if name in frame.columns else frame.withColumn(name, default)

"""Named tables that grow by deltas, apart for each workspace, and the registry of store classes.

A table is a folder with two parts. ``rows`` holds Parquet, partitioned by
workspace and commit; ``log`` holds one small JSON file a version of a
workspace's table, which names the commit, says whether it is a base or a delta
on what stands before it, and gives keys and schema. A commit is written to a
folder of its own first and becomes a version when its log file is created,
which fails if another writer has created that version meanwhile. A reader sees
the versions that it finds, whole ones only.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from quillgraph.operators import store

#: Name -> class of a store; classes take (spark, root, workspace).
STORES: dict[str, type] = {}


def register(cls: type) -> type:
    STORES[cls.__name__] = cls
    return cls


def open_store(kind: str, spark: SparkSession, root: str, workspace: str = "default"):
    """A store by the name of its class."""
    if kind not in STORES:
        raise ValueError(f"unknown store {kind}; there are {', '.join(sorted(STORES))}")
    return STORES[kind](spark, root, workspace)


register(store.TableStore)


class ConcurrentWrite(RuntimeError):
    """Others have written the table each time that this writer tried to."""


@register
class DeltaStore:
    """Tables of one workspace under a root folder.

    An upsert or delete writes the rows that it changes, with their keys, and
    nothing else; a read takes the newest row of each key that a delta has, and
    the base for all others. After ``fold`` deltas the next write folds them
    into a new base. Rows of a key that occurs several times in an upsert: one
    of them counts. A key with a null equals no other.
    """

    def __init__(self, spark: SparkSession, root: str, workspace: str = "default", fold: int = 8, attempts: int = 5):
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", workspace):
            raise ValueError(f"a workspace is named by letters, digits, dots, dashes and underscores: {workspace!r}")
        self.spark, self.root, self.workspace, self.fold, self.attempts = spark, root.rstrip("/"), workspace, fold, attempts
        self.on_retry = lambda: None

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def log(self, name: str) -> list[dict]:
        """Versions of a table in order: version, commit, kind, keys, schema."""
        files, path = self._path(name, "log", self.workspace)
        if not files.exists(path) or not files.listStatus(path):
            return []
        rows = self.spark.read.schema("version long, commit string, kind string, keys array<string>, schema string").json(path.toString()).filter("commit IS NOT NULL").collect()
        return sorted((r.asDict() for r in rows), key=lambda r: r["version"])

    def versions(self, name: str) -> list[int]:
        return [r["version"] for r in self.log(name)]

    def exists(self, name: str) -> bool:
        return bool(self.log(name))

    def _rows(self, name: str, commits: list[dict]) -> DataFrame:
        """The rows of some commits with their version."""
        base = f"{self.root}/{name}/rows"
        schema = StructType.fromJson(json.loads(commits[-1]["schema"])).add("_gone", "boolean").add("workspace", StringType()).add("commit", StringType())
        paths = [f"{base}/workspace={self.workspace}/commit={c['commit']}" for c in commits]
        found = self.spark.read.option("basePath", base).schema(schema).parquet(*paths).filter(F.col("workspace") == self.workspace)
        number = F.create_map(*(F.lit(x) for c in commits for x in (c["commit"], c["version"])))
        return found.withColumn("_version", number[F.col("commit")]).drop("workspace", "commit")

    def _merged(self, name: str, log: list[dict]) -> DataFrame:
        start = max(i for i, c in enumerate(log) if c["kind"] == "base")
        rows, deltas, keys = self._rows(name, log[start : start + 1]).drop("_gone", "_version"), log[start + 1 :], log[-1]["keys"]
        if not deltas:
            return rows
        changed = self._rows(name, deltas)
        last = changed.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in changed.columns if c not in keys)), "_version").alias("_l"))
        now = last.filter(~F.coalesce("_l._gone", F.lit(False))).select(*(F.col(c) if c in keys else F.col(f"_l.{c}").alias(c) for c in rows.columns))
        # keys of deltas are few beside the base: Spark broadcasts them while they are below its size threshold
        return rows.join(changed.select(*keys).distinct(), keys, "left_anti").select(*rows.columns).unionByName(now)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The table as it is, or as it was at a version that has not been folded away."""
        log = [c for c in self.log(name) if version is None or c["version"] <= version]
        if not any(c["kind"] == "base" for c in log):
            raise ValueError(f"no table {name} in workspace {self.workspace}" + ("" if version is None else f" at version {version}"))
        return self._merged(name, log)

    def _write_rows(self, name: str, df: DataFrame) -> str:
        commit = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/{name}/rows/workspace={self.workspace}/commit={commit}")
        return commit

    def _publish(self, name: str, version: int, commit: str, kind: str, keys: list[str], schema: str) -> bool:
        """Makes a commit a version; false where somebody else has made that version."""
        files, path = self._path(name, "log", self.workspace, f"{version:012d}.json")
        if files.exists(path):
            return False
        try:
            out = files.create(path, False)
        except Exception as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        out.write(bytearray(json.dumps({"version": version, "commit": commit, "kind": kind, "keys": keys, "schema": schema}).encode()))
        out.close()
        return True

    def _discard(self, name: str, commit: str) -> None:
        files, path = self._path(name, "rows", f"workspace={self.workspace}", f"commit={commit}")
        files.delete(path, True)

    def _commit(self, name: str, keys: list[str], change) -> None:
        """Tries until what change(log) gives, (kind, rows) or nothing, has become the next version."""
        for _ in range(self.attempts):
            log = self.log(name)
            found = change(log)
            if found is None:
                return
            kind, rows = found
            schema = rows.drop("_gone").schema.json() if kind == "base" else log[-1]["schema"]
            commit = self._write_rows(name, rows)
            if self._publish(name, (log[-1]["version"] if log else 0) + 1, commit, kind, keys, schema):
                if kind == "delta" and len(log) - max(i for i, c in enumerate(log) if c["kind"] == "base") >= self.fold:
                    self.compact(name)
                return
            self._discard(name, commit)
            self.on_retry()
        raise ConcurrentWrite(f"{name} of workspace {self.workspace} was written by others {self.attempts} times")

    def write(self, name: str, df: DataFrame, keys: str | list[str] | None = None) -> DataFrame:
        """The whole table anew."""
        keys = [keys] if isinstance(keys, str) else keys
        self._commit(name, keys or (self.log(name) or [{"keys": [df.columns[0]]}])[-1]["keys"], lambda log: ("base", df))
        return self.read(name)

    def upsert(self, name: str, new: DataFrame, key: str | list[str], mode: str = "absent") -> DataFrame:
        """absent: stored rows stay; fields: new values that are not null win; rows: new rows win."""
        keys = [key] if isinstance(key, str) else list(key)
        new = new.dropDuplicates(keys)

        def change(log):
            if not log:
                return "base", new
            old = self._merged(name, log)
            if mode == "absent":
                rows = new.join(old.select(*keys), keys, "left_anti")
            elif mode == "rows":
                rows = new
            elif mode == "fields":
                both = new.alias("n").join(old.alias("o"), keys, "left")
                rows = both.select(*(F.col(c) if c in keys else F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}") for c in old.columns))
            else:
                raise ValueError(f"unknown mode {mode}")
            rows = rows.select(*old.columns, F.lit(False).alias("_gone"))
            return None if rows.isEmpty() else ("delta", rows)

        self._commit(name, keys, change)
        return self.read(name)

    def delete(self, name: str, gone: DataFrame) -> None:
        """Rows with the keys of gone go; it needs the table's key columns only."""

        def change(log):
            if not log:
                return None
            old, keys = self._merged(name, log), log[-1]["keys"]
            rows = old.select(*keys).join(gone.select(*keys).distinct(), keys, "left_semi")
            schema = {f.name: f.dataType for f in old.schema}
            rows = rows.select(*(F.col(c) if c in keys else F.lit(None).cast(schema[c]).alias(c) for c in old.columns), F.lit(True).alias("_gone"))
            return None if rows.isEmpty() else ("delta", rows)

        log = self.log(name)
        self._commit(name, log[-1]["keys"] if log else [], change)

    def compact(self, name: str) -> None:
        """Folds deltas into a base; commits before the last base but one go. Gives way to a writer who comes first."""
        log = self.log(name)
        commit = self._write_rows(name, self._merged(name, log))
        if not self._publish(name, log[-1]["version"] + 1, commit, "base", log[-1]["keys"], log[-1]["schema"]):
            self._discard(name, commit)
            return
        kept = max(i for i, c in enumerate(log) if c["kind"] == "base")
        for old in log[:kept]:
            files, path = self._path(name, "log", self.workspace, f"{old['version']:012d}.json")
            files.delete(path, False)
            self._discard(name, old["commit"])

    def drop(self, name: str) -> None:
        """No rows are left; versions are."""
        if self.exists(name):
            self.write(name, self.read(name).limit(0))

"""Table-to-table store semantics. Parquet has no MERGE: each function returns the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_absent(stored: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """Stored rows win; also MERGE with insert only."""
    return stored.unionByName(new.join(stored, key, "left_anti").select(*stored.columns))


def overwrite_fields(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New non-null fields win, others stay."""
    both = stored.alias("o").join(new.alias("n"), F.col(f"o.{key}").eqNullSafe(F.col(f"n.{key}")), "full")
    return both.select(*[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}") for c in stored.columns])


def overwrite_rows(stored: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """New rows win; of several new rows of a key the last by order."""
    line = Window.partitionBy(*key).orderBy(F.col("_v").desc(), *[F.col(c).desc() for c in order])
    all_ = stored.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    return all_.withColumn("_r", F.row_number().over(line)).filter("_r = 1").drop("_r", "_v")


def missing_keys(keys: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return keys.join(stored, key, "left_anti")


def by_ids(ids: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Requested ids(pos, key) in order, nulls for those not stored."""
    return ids.join(stored, key, "left")


def delete_where(table: DataFrame, gone: Column) -> DataFrame:
    return table.filter(~F.coalesce(gone, F.lit(False)))


def delete_nodes(nodes: DataFrame, edges: DataFrame, names: DataFrame, detach: bool = True) -> tuple[DataFrame, DataFrame]:
    """Without the nodes of names(name); detach: nor edges at either end."""
    left = nodes.join(names, "name", "left_anti")
    if not detach:
        return left, edges
    gone_src, gone_tgt = names.select(F.col("name").alias("src")), names.select(F.col("name").alias("tgt"))
    return left, edges.join(gone_src, "src", "left_anti").join(gone_tgt, "tgt", "left_anti").select(*edges.columns)


def add_guideline(papers: DataFrame, pmid: Column, guideline: str) -> DataFrame:
    """The guideline added to the set of the papers that match."""
    now = F.coalesce("guidelines", F.array().cast("array<string>"))
    return papers.withColumn("guidelines", F.when(pmid, F.array_union(now, F.array(F.lit(guideline)))).otherwise(F.col("guidelines")))


def write_back(table: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """column updated where values has the key."""
    new = values.select(key, F.col(column).alias("_new"))
    return table.join(new, key, "left").withColumn(column, F.coalesce("_new", F.col(column))).drop("_new").select(*table.columns)


def split_results(results: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """Main rows and dead letters."""
    return results.filter(ok), results.filter(~F.coalesce(ok, F.lit(False)))


class TableStore:
    """Named Parquet tables under one folder; an upsert writes a new version beside the one it reads.

    The newest version that was written to its end (Spark's _SUCCESS mark) is
    the table, so any session on the folder sees the same, and a write that
    fails changes nothing. The version before it stays for those who read it.
    """

    def __init__(self, spark, root: str, workspace: str | None = None):
        self.spark, self.root = spark, root.rstrip("/") + (f"/workspace={workspace}" if workspace else "")

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self, name: str) -> list[int]:
        files, path = self._folder(name)
        if not files.exists(path):
            return []
        done = [s.getPath() for s in files.listStatus(path) if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName()[1:]) for p in done if p.getName()[1:].isdigit())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}/v{max(self.versions(name), default=0)}"

    def exists(self, name: str) -> bool:
        return bool(self.versions(name))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def write(self, name: str, df: DataFrame) -> DataFrame:
        old = self.versions(name)
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v{max(old, default=0) + 1}")
        files, path = self._folder(name)
        for version in old[:-1]:
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path, f"v{version}"), True)
        return self.read(name)

    def upsert(self, name: str, new: DataFrame, key: str | list[str], mode: str = "absent") -> DataFrame:
        if not self.exists(name):
            return self.write(name, new)
        old, new = self.read(name), new.dropDuplicates([key] if isinstance(key, str) else key)
        merged = {"absent": lambda: insert_absent(old, new, key), "fields": lambda: overwrite_fields(old, new, key), "rows": lambda: overwrite_rows(old, new, [key] if isinstance(key, str) else key, [])}[mode]()
        return self.write(name, merged)

    def delete(self, name: str, gone: DataFrame) -> None:
        """Rows that agree with one of gone in all of its columns go."""
        self.write(name, self.read(name).join(gone, gone.columns, "left_anti"))

    def drop(self, name: str) -> None:
        if self.exists(name):
            self.write(name, self.read(name).limit(0))

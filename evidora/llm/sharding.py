"""Immutable shards with size-tiered compaction and versioned manifests.

A store is a folder. append() writes an arrival as small Parquet files, which never change; compact() merges
runs of similar size (a tier: sizes within a factor of `fanout`) into files of about `target_bytes`: each group of a run is
read by one task and becomes one file, without a shuffle. Which files make up the store is said by manifests
alone: `manifest/v<number>` names an entries table, and is committed by making a file, whole, under a name that must be
free, so that readers see one version or the next and of two writers of a version one fails. Older versions and files
stay readable until vacuum().

Files have places, which rise from arrival to arrival and from file to file of one; a merged file has the place of its
first member. A store that keeps its order (`in_order`) merges neighbours alone, rows sorted by place and row, so that
its files by place hold all rows in the order in which they came, however often they were merged. Its tiers
have no fixed borders: neighbours are of one tier if the largest is within a factor of `fanout` of the least.

Entries are a table (at, path, bytes, rows, tier), read and written by Spark; the driver holds the plan of one
compaction, whose groups name as many files as are being merged, and the paths of what read() opens, as Spark's own
index of files does. To plan with neighbours it holds the path of every file.

Defined results: an empty arrival makes a version without files; columns are stored as they are; all rows are
kept once, also repeated ones and those with nulls.
"""

from __future__ import annotations

import itertools
import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..tables import materialize, put_if_absent

#: Groups that one job merges, and the files in them from which on no group is added.
GROUPS, FILES = 128, 100_000
UNION = "spark.sql.unionOutputPartitioning"
ENTRY = "at long, path string, bytes long, rows long, tier int"


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass
class ShardStore:
    spark: SparkSession
    root: str
    target_bytes: int = 128 << 20
    fanout: int = 4
    min_bytes: int = 1 << 20
    in_order: bool = False

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _list(self, path: str) -> list[tuple[str, int]]:
        fs, p = self._fs(path)
        return [(s.getPath().toString(), s.getLen()) for s in fs.listStatus(p)] if fs.exists(p) else []

    def tier(self, size: int) -> int:
        """0 up to min_bytes, then one more for each factor of fanout."""
        return 0 if size <= self.min_bytes else 1 + int(math.log(size / self.min_bytes, self.fanout))

    def versions(self) -> list[int]:
        return sorted(int(n[1:]) for p, _ in self._list(f"{self.root}/manifest") if (n := p.rsplit("/", 1)[-1]).startswith("v") and n[1:].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "entries": path or None, "files", "rows", "bytes", "next": the least place above all files', "in_order"}; version 0 is the empty store."""
        version = version if version is not None else max(self.versions(), default=0)
        if not version:
            return {"version": 0, "entries": None, "files": 0, "rows": 0, "bytes": 0, "next": 0, "in_order": self.in_order}
        return json.loads(self.spark.read.text(f"{self.root}/manifest/v{version:08d}", wholetext=True).first()[0])

    def _base(self) -> dict:
        """The manifest of the last version; a store that has kept its order goes on doing so."""
        m = self.manifest()
        self.in_order = self.in_order or m["in_order"]
        return m

    def entries(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        return self.spark.read.schema(ENTRY).parquet(m["entries"]) if m["entries"] else self.spark.createDataFrame([], ENTRY)

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows of a version, with `shard` (the file of a row) and `tier`, and `place` of the shard if the store keeps its order (numbered if the rows have such columns); None for a store without files."""
        found = [(r["path"], r["tier"]) for r in self.entries(version).select("path", "tier").collect()]
        if not found:
            return None
        rows = self.spark.read.parquet(*(p for p, _ in found))
        shard, tier = free_name("shard", rows.columns), free_name("tier", rows.columns)
        path = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
        more = [F.col("tier").alias(tier)]
        if self.manifest(version)["in_order"]:
            more.append(F.col("at").alias(free_name("place", rows.columns)))
        tiers = self.entries(version).select(F.element_at(F.split("path", "/"), -1).alias(shard), *more)
        return rows.withColumn(shard, path).join(F.broadcast(tiers) if len(found) <= 100_000 else tiers, shard).select(*(F.col(f"`{c}`") for c in rows.columns), *(F.col(c) for c in tiers.columns))

    def _write(self, df: DataFrame) -> list[tuple[int, str, int, int, int]]:
        """Write a file for each partition that has rows; (number of the partition, path, bytes, rows, tier) of the files, in that order."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("maxRecordsPerFile", 0).parquet(folder)
        sizes = {p.rsplit("/", 1)[-1]: (p, n) for p, n in self._list(folder) if p.endswith(".parquet")}
        counts = {}
        if sizes:
            counted = self.spark.read.parquet(folder).groupBy(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name")).agg(F.count("*").alias("rows"))
            counts = {r["name"]: r["rows"] for r in counted.collect()}
        return sorted((int(name.split("-")[1]), p, n, counts[name], self.tier(n)) for name, (p, n) in sizes.items() if counts.get(name))  # part-<number>-...

    def commit(self, entries: DataFrame, base: int) -> int:
        """Make entries version base + 1. Raises CommitConflict if that version exists."""
        version = base + 1
        path = f"{self.root}/entries/{uuid.uuid4().hex}"
        entries.coalesce(8).write.parquet(path)
        total = self.spark.read.schema(ENTRY).parquet(path).agg(F.count("*"), F.sum("rows"), F.sum("bytes"), F.max("at")).first()
        body = json.dumps({"version": version, "entries": path, "files": total[0], "rows": total[1] or 0, "bytes": total[2] or 0, "next": 0 if total[3] is None else total[3] + 1, "in_order": self.in_order})
        if not put_if_absent(self.spark, f"{self.root}/manifest/v{version:08d}", body):
            raise CommitConflict(f"version {version} of {self.root} exists")
        return version

    def append(self, df: DataFrame) -> int:
        m = self._base()
        made = [(m["next"] + i, *file) for i, (_, *file) in enumerate(self._write(df))]
        return self.commit(self.entries(m["version"]).unionByName(self.spark.createDataFrame(made, ENTRY)), m["version"])

    def plan(self, entries: list[tuple[str, int, int]]) -> list[list[tuple[str, int]]]:
        """Groups to merge of (path, bytes, tier): in each tier below the target, runs of files that add up to about it.

        A tier merges when it has `fanout` files or more.
        """
        by_tier: dict[int, list[tuple[str, int]]] = {}
        for path, size, tier in sorted(entries):
            if size < self.target_bytes // 2:
                by_tier.setdefault(tier, []).append((path, size))
        groups = []
        for _, files in sorted(by_tier.items()):
            if len(files) >= self.fanout:
                groups += self._cut(files)
        return groups

    def plan_in_order(self, files: list[tuple[str, int]]) -> list[list[tuple[str, int]]]:
        """Groups to merge of (path, bytes), which are all files in the order of their places: in each run of neighbours below the target, parts that add up to about it.

        A run is of `fanout` files or more, the largest within a factor of fanout of the least (min_bytes where it has less).
        """
        groups, i = [], 0
        while i < len(files):
            least, most, j = math.inf, 0, i
            while j < len(files) and files[j][1] < self.target_bytes // 2:
                size = max(files[j][1], self.min_bytes)
                if max(most, size) > self.fanout * min(least, size):
                    break
                least, most, j = min(least, size), max(most, size), j + 1
            if j - i >= self.fanout:
                groups += self._cut(files[i:j])
                i = j
            else:
                i += 1
        return groups

    def _cut(self, files: list[tuple[str, int]]) -> list[list[tuple[str, int]]]:
        """The files in groups of about target_bytes, without those of one file."""
        groups, group, held = [], [], 0
        for path, size in files:
            if group and held + size > self.target_bytes:
                groups.append(group)
                group, held = [], 0
            group.append((path, size))
            held += size
        return [g for g in [*groups, group] if len(g) > 1]

    def compact(self) -> int | None:
        """One round of merges; the new version, or None if there is nothing to merge."""
        base = self._base()["version"]
        entries = self.entries(base)
        if self.in_order:
            found = sorted(entries.select("at", "path", "bytes").collect())
            groups = self.plan_in_order([(r["path"], r["bytes"]) for r in found])
        else:
            found = entries.filter(F.col("bytes") < self.target_bytes // 2).select("at", "path", "bytes", "tier").collect()
            groups = self.plan([(r["path"], r["bytes"], r["tier"]) for r in found])
        if not groups:
            return None
        at = {r["path"]: r["at"] for r in found}
        merged = []
        gone = [p for g in groups for p, _ in g]
        schema = self.spark.read.parquet(gone[0]).schema
        together = self.spark.conf.get(UNION, "true")
        self.spark.conf.set(UNION, "false")  # else tasks of several groups become one
        try:
            for job in _jobs(groups):
                merged += [(min(at[p] for p, _ in job[k]), *file) for k, *file in self._write(self._merged(job, schema, at))]
        finally:
            self.spark.conf.set(UNION, together)
        old = self.spark.createDataFrame([(p,) for p in gone], "path string")
        kept = entries.join(F.broadcast(old) if len(gone) <= 100_000 else old, "path", "left_anti")
        return self.commit(kept.select(*entries.columns).unionByName(self.spark.createDataFrame(merged, ENTRY)), base)

    def _merged(self, groups: list[list[tuple[str, int]]], schema: StructType, at: dict[str, int]) -> DataFrame:
        """The rows of the groups, one partition a group; in the order of the files' places and of the rows in them, if the store keeps its order."""
        rows, file, row = None, free_name("_at_file", schema.names), free_name("_at_row", schema.names)
        for g in groups:
            one = self.spark.read.schema(schema).parquet(*(p for p, _ in g))
            if self.in_order:
                name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
                one = one.select(*(F.col(f"`{c}`") for c in schema.names), name.alias(file), F.col("_metadata.row_index").alias(row))
            one = one.coalesce(1)
            rows = one if rows is None else rows.union(one)
        if not self.in_order:
            return rows
        place = free_name("_at_place", schema.names)
        places = self.spark.createDataFrame([(p.rsplit("/", 1)[-1], at[p]) for g in groups for p, _ in g], f"{file} string, {place} long")
        return rows.join(F.broadcast(places), file).sortWithinPartitions(place, row).select(*(F.col(f"`{c}`") for c in schema.names))

    def vacuum(self) -> list[str]:
        """Delete data folders of which no version's entries name a file; their names."""
        named = set()
        for v in self.versions():
            named |= {r[0] for r in self.entries(v).select(F.element_at(F.split("path", "/"), -2)).distinct().collect()}
        gone = [p for p, _ in self._list(f"{self.root}/data") if p.rsplit("/", 1)[-1] not in named]
        for p in gone:
            fs, q = self._fs(p)
            fs.delete(q, True)
        return gone

    def expire(self, keep: int = 1) -> None:
        """Forget all but the last `keep` versions, then vacuum."""
        for v in self.versions()[:-keep]:
            fs, p = self._fs(f"{self.root}/manifest/v{v:08d}")
            fs.delete(p, False)
        self.vacuum()


def _jobs(groups: list[list[tuple[str, int]]]) -> Iterator[list[list[tuple[str, int]]]]:
    """The groups in lists that one job merges."""
    job, files = [], 0
    for g in groups:
        if job and (len(job) == GROUPS or files >= FILES):
            yield job
            job, files = [], 0
        job.append(g)
        files += len(g)
    yield job


def free_name(name: str, columns: list[str]) -> str:
    """The name, or the first of name_1, name_2 and so on that no column has."""
    taken, n, out = {c.lower() for c in columns}, 0, name
    while out.lower() in taken:
        n += 1
        out = f"{name}_{n}"
    return out


def shard_in_order(store: ShardStore, docs: DataFrame) -> DataFrame | None:
    """Append rows in the order of the files that they are read from (by name) and of the rows in them, compacting as tiers fill; the rows of the last version.

    As many arrivals as the fanout, each a run of the files (one arrival, if there are fewer files), come one after the other as
    files of about target_bytes / fanout ** 2. The store keeps its order. Rows that are read from no files are written to some.
    """
    store.in_order = True
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        docs = materialize(docs, "unsharded")
    files = sorted(docs.select("_metadata.file_path", "_metadata.file_size").distinct().collect())
    if not files:
        return shard(store, [docs])
    many = store.fanout if len(files) >= store.fanout else 1
    cuts = [len(files) * i // many for i in range(many + 1)]
    file, row = free_name("_at_file", docs.columns), free_name("_at_row", docs.columns)
    at = docs.select(*(F.col(f"`{c}`") for c in docs.columns), F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    arrivals = []
    for some in (files[a:b] for a, b in itertools.pairwise(cuts)):
        parts = max(1, -(-sum(f["file_size"] for f in some) * store.fanout**2 // store.target_bytes))
        one = at.filter(F.col(file).between(some[0]["file_path"], some[-1]["file_path"]))
        arrivals.append(one.repartitionByRange(parts, file, row).sortWithinPartitions(file, row).drop(file, row))
    return shard(store, arrivals)


def shard(store: ShardStore, arrivals: list[DataFrame], rounds: int = 8) -> DataFrame | None:
    """Append arrivals one after the other, compacting after each as tiers fill; the rows of the last version."""
    for a in arrivals:
        store.append(a)
        for _ in range(rounds):
            if store.compact() is None:
                break
    return store.read()

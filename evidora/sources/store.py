"""A content-addressed store as Parquet tables: objects by kind and digest, hash-chained logs, tombstones.

Objects never change; a put of a known object adds nothing. They lie in the folder that the last generation file names;
compact() writes them without the forgotten ones into a new folder and commits it by the next generation file, so that
readers see one or the other. A log's rows carry their number and the digest of the row before; an append is one file,
named by its first number and made only if that name is free, so that of two writers one fails. forget() writes
tombstones, which hide objects at once.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernel.canonical import PREFIX, canonical
from ..operators.sets import strays
from ..operators.windows import chain_check
from ..tables import put_if_absent

OBJECTS = "kind string, key string, bytes binary"
LOGS = "log string, sequence long, previous string, entry_sha256 string, body string"


class StaleHead(RuntimeError):
    """The log has grown since its head was read."""


def object_key(kind: str, data: bytes) -> str:
    return hashlib.sha256(f"{PREFIX}:{kind}\x00".encode() + data).hexdigest()


def text_key(name: str) -> str:
    """The folder of a log."""
    return "log-" + hashlib.sha256(name.encode()).hexdigest()[:32]


def entry_digest(log: str, sequence: int, previous: str | None, body: str) -> str:
    return hashlib.sha256(canonical([log, sequence, previous, body]).encode()).hexdigest()


@dataclass
class Store:
    spark: SparkSession
    root: str

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _read(self, what: str, schema: str, form: str = "parquet") -> DataFrame:
        fs, p = self._fs(f"{self.root}/{what}")
        if not fs.exists(p):
            return self.spark.createDataFrame([], schema)
        read = self.spark.read.schema(schema).format(form).option("recursiveFileLookup", form == "json")
        return read.load(f"{self.root}/{what}")

    def generation(self) -> int:
        """The number of the last compaction that was committed; 0 before the first."""
        fs, p = self._fs(f"{self.root}/generations")
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return max((int(n[1:]) for n in names if n.startswith("g") and n[1:].isdigit()), default=0)

    def _folder(self, generation: int) -> str:
        return self.spark.read.text(f"{self.root}/generations/g{generation:08d}", wholetext=True).first()[0] if generation else "objects-0"

    def forgotten(self) -> DataFrame:
        return self._read("forgotten", "kind string, key string, date string")

    def objects(self, kind: str | None = None) -> DataFrame:
        """Live objects; a kind reads its partition alone."""
        rows = self._read(self._folder(self.generation()), OBJECTS)
        rows = rows.filter(F.col("kind") == kind) if kind else rows
        return rows.join(self.forgotten().select("kind", "key").distinct(), ["kind", "key"], "left_anti")

    def put(self, rows: DataFrame) -> None:
        """Add objects (kind, bytes) that are not there yet."""
        key = F.sha2(F.concat(F.concat(F.lit(f"{PREFIX}:"), F.col("kind"), F.lit("\x00")).cast("binary"), F.col("bytes")), 256)
        rows = rows.select("kind", key.alias("key"), "bytes").dropDuplicates(["kind", "key"])
        while True:
            at = self.generation()
            folder = self._folder(at)
            new = rows.join(self._read(folder, OBJECTS).select("kind", "key"), ["kind", "key"], "left_anti")
            new.write.mode("append").partitionBy("kind").parquet(f"{self.root}/{folder}")
            if self.generation() == at:  # else a compaction may have missed these objects
                return

    def forget(self, keys: DataFrame, date: str) -> None:
        keys.select("kind", "key", F.lit(date).alias("date")).write.mode("append").parquet(f"{self.root}/forgotten")

    def compact(self, keep: int = 1) -> None:
        """Write objects without the forgotten ones into a new folder and commit it; folders before the last `keep` go.

        Raises StaleHead if another compaction is committed first. An object put meanwhile puts itself again (see put()).
        """
        at = self.generation()
        fresh = f"objects-{uuid.uuid4().hex}"
        self.objects().write.partitionBy("kind").parquet(f"{self.root}/{fresh}")
        if not put_if_absent(self.spark, f"{self.root}/generations/g{at + 1:08d}", fresh):
            raise StaleHead(f"generation {at + 1} exists")
        for old in range(max(0, at + 1 - keep)):
            fs, p = self._fs(f"{self.root}/{self._folder(old)}")
            fs.delete(p, True)

    def log(self, name: str | None = None) -> DataFrame:
        rows = self._read(f"logs/{text_key(name)}" if name else "logs", LOGS, "json")
        return rows.filter(F.col("log") == name) if name else rows

    def head(self, name: str) -> tuple[int, str | None]:
        r = self.log(name).agg(F.max_by(F.struct("sequence", "entry_sha256"), "sequence").alias("r")).first()["r"]
        return (r["sequence"], r["entry_sha256"]) if r else (0, None)

    def append(self, name: str, bodies: list[str], head: tuple[int, str | None] | None = None) -> tuple[int, str | None]:
        """Add entries after the head that the writer has seen, all or none; the new head. Raises StaleHead if another writer was first."""
        now = self.head(name)
        if head is not None and head != now:
            raise StaleHead(f"{name} is at {now[0]}")
        number, last = now
        rows = []
        for body in bodies:
            number += 1
            digest = entry_digest(name, number, last, body)
            rows.append(json.dumps({"log": name, "sequence": number, "previous": last, "entry_sha256": digest, "body": body}) + "\n")
            last = digest
        if rows and not put_if_absent(self.spark, f"{self.root}/logs/{text_key(name)}/{now[0] + 1:012d}.json", "".join(rows)):
            raise StaleHead(f"{name} has grown past {now[0]}")
        return number, last

    def check(self) -> DataFrame:
        """(problem, kind, key): objects whose bytes do not match their key, log rows that break their chain."""
        key = F.sha2(F.concat(F.concat(F.lit(f"{PREFIX}:"), F.col("kind"), F.lit("\x00")).cast("binary"), F.col("bytes")), 256)
        damaged = self.objects().filter(key != F.col("key")).select(F.lit("damaged").alias("problem"), "kind", "key")
        broken = chain_check(self.log(), ["log"], "sequence", "entry_sha256", "previous").filter(~F.col("linked"))
        return damaged.unionByName(broken.select(F.lit("broken").alias("problem"), F.col("log").alias("kind"), F.col("sequence").cast("string").alias("key")))

    def orphans(self, named: DataFrame) -> DataFrame:
        """(problem, kind, key): named (kind, key) without an object, and objects that nothing names."""
        return strays(named, self.objects().select("kind", "key"), ["kind", "key"])

"""An append-only log of episodes in a folder of Parquet files, with commits that only one writer can win."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.sources.episodes import EPISODES

KEY, HASH = "__idempotency_key", "__idempotency_hash"
RESERVED = "__"


class Conflict(RuntimeError):
    """Another writer was first, or a key came back with another payload."""


class Moved(Conflict):
    """The head is no longer where the writer has seen it."""


#: How often an idempotent append looks for its keys again, when other writers were first.
ATTEMPTS = 8


class Log:
    """Episodes under path/data, one folder a commit, and path/commits, one small file a commit that says where it
    begins. A commit's file is made only if it isn't there, so of two writers at the same head one fails and nothing of it
    is seen. Readers see whole commits. Sequence numbers have no gaps."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self.fs = self._at(self.path).getFileSystem(spark._jsc.sc().hadoopConfiguration())
        self.fs.mkdirs(self._at(f"{self.path}/commits"))

    # reading

    def commits(self) -> list[dict]:
        """first, n, folder and last_hlc of each commit, in order. A commit is a batch of any size, so these are few."""
        names = sorted(x.getPath().getName() for x in self.fs.listStatus(self._at(f"{self.path}/commits")) if x.getPath().getName().endswith(".json"))
        if not names:
            return []
        rows = self.spark.read.schema("first bigint, n bigint, folder string, last_hlc bigint").json(f"{self.path}/commits/*.json").collect()
        out, at = [], 0
        for r in sorted(rows, key=lambda r: (r["first"], -r["n"])):
            if r["first"] == at:
                out.append(r.asDict())
                at += r["n"]
        return out

    def head(self) -> int:
        """The sequence number that the next episode gets."""
        return sum(c["n"] for c in self.commits())

    def episodes(self, ceiling: int | None = None) -> DataFrame:
        """All episodes, or those below a ceiling; commits beyond it aren't read."""
        found = [c["folder"] for c in self.commits() if ceiling is None or c["first"] < ceiling]
        if not found:
            return self.spark.createDataFrame([], EPISODES)
        df = self.spark.read.schema(EPISODES).parquet(*(f"{self.path}/data/{f}" for f in found))
        return df if ceiling is None else df.where(F.col("lsn") < ceiling)

    def scan(self, first: int = 0, to: int | None = None, most: int | None = None) -> DataFrame:
        df = self.episodes(to).where(F.col("lsn") >= first)
        return df if most is None else df.orderBy("lsn").limit(most)

    def read(self, lsn: int) -> DataFrame:
        return self.scan(lsn, lsn + 1)

    # writing

    def append(self, batch: DataFrame, expected: int | None = None) -> tuple[int, int]:
        """(first, n) of the episodes of batch, numbered in the order of its files. Columns that batch lacks get
        defaults; lsn and ts_hlc are assigned. expected: the head that the writer has seen; another one is a conflict.

        Rows are written as they are, and numbered by file and place when they are read back: no shuffle, no sort."""
        names = set(batch.columns)
        bad = batch.where(F.exists(F.map_keys("attrs"), lambda k: k.startswith(RESERVED) & ~k.isin(KEY, HASH))) if "attrs" in names else None
        if bad is not None and not bad.isEmpty():
            raise ValueError(f"attributes that begin with {RESERVED} are reserved")
        commits = self.commits()
        head = sum(c["n"] for c in commits)
        if expected is not None and expected != head:
            raise Moved(f"the head is {head}, not {expected}")
        defaults = {"id": F.uuid(), "agent_id": F.lit(""), "session_id": F.lit(""), "kind": F.lit("Observation"), "attrs": F.create_map().cast("map<string,string>"), "parents": F.array().cast("array<string>")}
        cols = [f for f in EPISODES.fields if f.name not in ("lsn", "ts_hlc")]
        shaped = batch.select(*(F.coalesce(F.col(f.name), defaults[f.name]).alias(f.name) if f.name in names and f.name in defaults else F.col(f.name).cast(f.dataType).alias(f.name) if f.name in names else defaults.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in cols))
        staged = f"{self.path}/staging/{uuid.uuid4().hex}"
        shaped.write.parquet(staged)
        rows = self.spark.read.schema(shaped.schema).parquet(staged)
        rows = rows.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        files = rows.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))
        before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
        files = files.select("__file", "__n", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
        n = files.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
        if not n:
            self.fs.delete(self._at(staged), True)
            return head, 0
        last = max([c["last_hlc"] for c in commits], default=-1)
        base = max(int(time.time() * 1000) << 16, last + 1)
        place = F.col("__before") + F.col("__row")
        folder = f"{head:020d}-{uuid.uuid4().hex}"
        rows.join(files, "__file").withColumn("lsn", head + place).withColumn("ts_hlc", base + place).select(*EPISODES.fieldNames()).write.parquet(f"{self.path}/data/{folder}")
        self.fs.delete(self._at(staged), True)
        self._commit({"first": head, "n": n, "folder": folder, "last_hlc": base + n - 1})
        return head, n

    def _commit(self, what: dict) -> None:
        name = self._at(f"{self.path}/commits/{what['first']:020d}.json")
        try:
            out = self.fs.create(name, False)
        except Exception as e:
            self.fs.delete(self._at(f"{self.path}/data/{what['folder']}"), True)
            raise Moved(f"another writer was first at {what['first']}") from e
        out.write(bytearray(json.dumps(what).encode()))
        out.close()

    def append_idempotent(self, batch: DataFrame, key: str = "key") -> DataFrame:
        """(key, lsn, duplicate) for each key of batch. A key that is in the log, or comes twice, is appended once; with
        another payload than before it is a conflict, and nothing is appended; another writer that appends after the
        keys were read makes the call look again."""
        for attempt in range(ATTEMPTS):
            try:
                return self._append_new(batch, key)
            except Moved:
                if attempt == ATTEMPTS - 1:
                    raise
        raise AssertionError

    def _append_new(self, batch: DataFrame, key: str) -> DataFrame:
        own = [c for c in batch.columns if c not in (key, "lsn", "ts_hlc", "id")]
        hashed = batch.withColumn(HASH, F.sha2(F.to_json(F.struct(*(F.sort_array(F.map_entries(c)).alias(c) if c == "attrs" else F.col(c) for c in sorted(own)))), 256))
        one = hashed.groupBy(key).agg(F.min(HASH).alias("__h"), F.countDistinct(HASH).alias("__kinds"))
        # Keys are read up to a head, and the append holds only if that is still the head.
        head = self.head()
        there = self.keys(head)
        clash = one.join(there, one[key] == there["k"], "left").where((F.col("__kinds") > 1) | (F.col("h").isNotNull() & (F.col("h") != F.col("__h"))))
        if not clash.isEmpty():
            raise Conflict("a key came with another payload")
        attrs = F.coalesce(F.col("attrs"), F.create_map().cast("map<string,string>")) if "attrs" in batch.columns else F.create_map().cast("map<string,string>")
        fresh = hashed.join(there.select(F.col("k").alias(key)), key, "left_anti").dropDuplicates([key])
        self.append(fresh.withColumn("attrs", F.map_concat(attrs, F.create_map(F.lit(KEY), F.col(key).cast("string"), F.lit(HASH), F.col(HASH)))).drop(key, HASH), expected=head)
        before = there.select("k").withColumn("duplicate", F.lit(True))
        now = self.keys()
        return one.select(key).join(now.select(F.col("k").alias(key), "lsn"), key).join(before.withColumnRenamed("k", key), key, "left").select(key, "lsn", F.coalesce("duplicate", F.lit(False)).alias("duplicate"))

    def keys(self, to: int | None = None) -> DataFrame:
        a = F.col("attrs")
        return self.episodes(to).where(a[KEY].isNotNull()).select(a[KEY].alias("k"), a[HASH].alias("h"), "lsn")

    def compact(self, rows_per_file: int = 1 << 20) -> None:
        """Every commit in one folder, ranges of sequence numbers in files of a bounded number of rows."""
        commits = self.commits()
        if len(commits) < 2:
            return
        n, folder = sum(c["n"] for c in commits), f"{0:020d}-{uuid.uuid4().hex}"
        self.episodes().repartitionByRange(max(1, -(-n // rows_per_file)), "lsn").sortWithinPartitions("lsn").write.parquet(f"{self.path}/data/{folder}")
        name = self._at(f"{self.path}/commits/{0:020d}.{n:020d}.json")
        out = self.fs.create(name, False)
        out.write(bytearray(json.dumps({"first": 0, "n": n, "folder": folder, "last_hlc": max(c["last_hlc"] for c in commits)}).encode()))
        out.close()


def deleted(episodes: DataFrame) -> DataFrame:
    """(id) of what tombstones name."""
    return episodes.select(F.col("attrs")["tombstone_of"].alias("id")).where("id IS NOT NULL").distinct()


def cold_compaction(rows: DataFrame, tombstones: DataFrame, ratio: float = 0.3, least: int = 1024) -> DataFrame | None:
    """rows without those that tombstones (id) name, or None where too few are dead or there are too few in all."""
    n = rows.count()
    if n < least:
        return None
    dead = rows.join(tombstones, "id", "left_semi").count()
    return rows.join(tombstones, "id", "left_anti") if dead / n >= ratio else None


def duplicates_merged(view: DataFrame, tail: DataFrame) -> DataFrame:
    """A view and the tail of the log as one: of rows with the same id the last counts."""
    both = view.unionByName(tail)
    return both.groupBy("id").agg(F.max_by(F.struct(*both.columns), "lsn").alias("x")).select("x.*")

"""Messages delivered more than once (problem 3): a partitioned store with an identifier index.

The store keeps one row per identifier, the earliest by (received_at, line_no),
in partitions by month of arrival. A merge

1. reduces the incoming messages to one candidate per identifier (an aggregate
   with map-side combine, so a hot identifier is no hot task),
2. looks the candidates up in the identifier index and so finds the historical
   partitions that hold any of them; the index is cut into buckets by a hash of the identifier,
   and only the buckets that incoming identifiers fall into are read,
3. combines just these partitions with the candidates and recomputes the winners,
4. writes new versions of these partitions (and additions to others) beside the
   old ones, and commits by renaming one manifest into place, so that readers
   see the old state or the new one. Two concurrent merges cannot both commit.

Rows with NULL identifier are not stored. A NULL arrival time comes last.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.session import shared_dir

BUCKETS = 16  #: of a store's index; the same for its whole life. Some million identifiers a bucket are fine


def bucket(n: int) -> F.Column:
    return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")


def winners(df: DataFrame, payload: Sequence[str] = ()) -> DataFrame:
    """One row per identifier: the smallest (received_at with NULLs last, line_no)."""
    m = F.min(F.struct(F.col("received_at").isNull().alias("late"), "received_at", "line_no", *payload))
    return df.filter(F.col("id").isNotNull()).groupBy("id").agg(m.alias("__m")).select("id", *[F.col(f"__m.{c}").alias(c) for c in ("received_at", "line_no", *payload)])


def part_of() -> F.Column:
    return F.coalesce(F.date_format("received_at", "yyyy-MM"), F.lit("none"))


class MessageStore:
    """A folder with ``data`` per partition version, ``index`` per version and bucket (identifier and the data folder that holds it), and numbered manifests.

    Index rows that name a data folder the manifest no longer names are out of date and are ignored.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, payload: Sequence[str] = (), buckets: int = BUCKETS):
        self.spark, self.payload, self.buckets = spark, tuple(payload), buckets
        self.path = path or f"{shared_dir(spark)}/messages-{uuid.uuid4().hex}"
        jvm = spark._jvm
        self._p = jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._p(f"{self.path}/manifest"))

    def _manifest(self) -> tuple[int, dict[str, list[str]]]:
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._p(f"{self.path}/manifest")) if s.getPath().getName().endswith(".json"))
        if not names:
            return 0, {}
        text = "".join(r[0] for r in self.spark.read.text(f"{self.path}/manifest/{names[-1]}", wholetext=True).collect())
        return int(names[-1][:-5]), json.loads(text)

    def _commit(self, version: int, parts: dict[str, list[str]]) -> None:
        tmp, to = self._p(f"{self.path}/manifest/.{uuid.uuid4().hex}"), self._p(f"{self.path}/manifest/{version:08d}.json")
        out = self._fs.create(tmp, False)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        jvm, gw = self.spark._jvm, self.spark.sparkContext._gateway
        fc = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        fc.rename(tmp, to, gw.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))  # fails if that version exists

    def _read(self, dirs: list[str]) -> DataFrame:
        schema = "id string, received_at timestamp, line_no bigint" + "".join(f", {c} string" for c in self.payload)
        if not dirs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{d}" for d in dirs])

    def _holders(self, cand: DataFrame, live: list[str]) -> list[str]:
        """The live data folders that hold any of the identifiers, by the index buckets these fall into."""
        wanted = {f"bucket={r[0]}" for r in cand.select(bucket(self.buckets)).distinct().collect()}  # at most one row per bucket
        dirs = []
        for v in sorted({d.split("/")[0] for d in live}):
            have = {x.getPath().getName() for x in self._fs.listStatus(self._p(f"{self.path}/index/{v}")) if x.isDirectory()}
            dirs += [f"{self.path}/index/{v}/{b}" for b in sorted(have & wanted)]
        if not dirs:
            return []
        hit = self.spark.read.schema("id string, dir string").parquet(*dirs).join(cand.select("id"), "id", "left_semi").select("dir").distinct()
        return sorted({r[0] for r in hit.collect()} & set(live))  # at most one row per partition version

    def read(self) -> DataFrame:
        """The current messages, one per identifier."""
        return self._read([d for ds in self._manifest()[1].values() for d in ds])

    def merge(self, incoming: DataFrame) -> dict:
        """Add messages (id, received_at, line_no, payload...); returns which partitions were rewritten and extended."""
        version, parts = self._manifest()
        new = f"v{version + 1:08d}-{uuid.uuid4().hex[:8]}"
        cand = winners(incoming, self.payload)
        affected: list[str] = []
        if parts:
            stage = f"{self.path}/stage/{new}"
            cand.write.parquet(stage)
            cand = self.spark.read.parquet(stage)
            held = self._holders(cand, [d for ds in parts.values() for d in ds])
            affected = sorted({p for p, ds in parts.items() if set(ds) & set(held)})
            hist = self._read([d for p in affected for d in parts[p]])
            cand = winners(hist.unionByName(cand), self.payload)
        # gathered by partition for few files; the hint lets the planner split a large month over several tasks
        cand.withColumn("part", part_of()).hint("rebalance", "part").write.partitionBy("part").parquet(f"{self.path}/data/{new}")
        written = [s.getPath().getName() for s in self._fs.listStatus(self._p(f"{self.path}/data/{new}")) if s.isDirectory()]
        got = {w.split("=", 1)[1]: f"{new}/{w}" for w in written if w.startswith("part=")}
        if got:
            data = self.spark.read.option("basePath", f"{self.path}/data/{new}").schema("id string, part string").parquet(f"{self.path}/data/{new}")
            index = data.select("id", F.concat(F.lit(f"{new}/part="), "part").alias("dir"), bucket(self.buckets).alias("bucket"))
            index.write.partitionBy("bucket").parquet(f"{self.path}/index/{new}")
        after = {p: ds for p, ds in parts.items() if p not in affected}
        for p, d in got.items():
            after[p] = [*after.get(p, []), d]
        self._commit(version + 1, after)
        if parts:
            self._fs.delete(self._p(f"{self.path}/stage/{new}"), True)
        return {"version": version + 1, "rewritten": affected, "extended": sorted(p for p in got if p in parts and p not in affected), "kept": sorted(p for p in parts if p not in affected and p not in got)}

    def vacuum(self) -> int:
        """Delete partition versions that the current manifest does not name; returns how many."""
        live = {d for ds in self._manifest()[1].values() for d in ds}
        n = 0
        root = self._p(f"{self.path}/data")
        for v in self._fs.listStatus(root) if self._fs.exists(root) else []:
            version = v.getPath().getName()
            for s in self._fs.listStatus(v.getPath()):
                if s.isDirectory() and f"{version}/{s.getPath().getName()}" not in live:
                    self._fs.delete(s.getPath(), True)
                    n += 1
            if not any(d.split("/")[0] == version for d in live):
                self._fs.delete(self._p(f"{self.path}/index/{version}"), True)
        return n

    def drop(self) -> None:
        self._fs.delete(self._p(self.path), True)


def deduplicate(messages: DataFrame, batch: str = "batch_id", payload: Sequence[str] = (), history: float = 0.75) -> tuple[MessageStore, DataFrame]:
    """Feed a whole table through a store: the older batches as history, the rest as one merge.

    ``history`` is the share of the range of batch numbers that forms the
    history; rows without a batch number come with the rest. Returns the store
    and the staged messages, which are parsed once.
    """
    spark = messages.sparkSession
    store = MessageStore(spark, payload=payload)
    stage = f"{store.path}/messages"
    messages.select("id", "received_at", "line_no", batch, *payload).filter("id is not null").write.parquet(stage)
    staged = spark.read.parquet(stage)
    lo, hi = staged.agg(F.min(batch), F.max(batch)).first()
    if lo is not None:
        store.merge(staged.filter(F.col(batch) <= lo + (hi - lo) * history))
        store.merge(staged.filter(F.col(batch).isNull() | (F.col(batch) > lo + (hi - lo) * history)))
    else:
        store.merge(staged)
    return store, staged


def surplus(store: MessageStore, staged: DataFrame) -> DataFrame:
    """line_no of every delivered message that is not the stored copy; line numbers are unique."""
    return staged.select("line_no").join(store.read().select("line_no"), "line_no", "left_anti")

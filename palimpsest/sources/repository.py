"""A versioned, deduplicated repository on Parquet.

Four append-only tables below one folder, all partitioned by version: ``journal``
(a row for each change of a path), ``fragments`` (digest, size, block), ``blocks``
(encoded payloads) and ``versions``. A version exists when its row in ``versions``
does; that row is written last, so readers never see half a commit and a failed
one leaves files that ``trim`` removes. Adding what is stored already writes
nothing and makes no version.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from palimpsest.functions import codecs
from palimpsest.operators import diff, journal

JOURNAL = "path string, op string, size long, mtime timestamp_ntz, attr string, hash_alg string, hash string, frags array<string>, version long"
FRAGMENTS = "sha1 string, size long, block_id string, version long"
BLOCKS = "block_id string, codec string, orig_size long, comp_size long, payload binary, version long"
VERSIONS = "ts timestamp_ntz, added long, modified long, deleted long, bytes long, stored long, comment string, version long"
TABLES = {"journal": JOURNAL, "fragments": FRAGMENTS, "blocks": BLOCKS, "versions": VERSIONS}
#: A table of places of fragments goes to all executors up to this size.
BROADCAST_BYTES = 16 << 20


def scratch(spark: SparkSession) -> str:
    """A new folder below the session's shared checkpoint folder; only a session without executors on other hosts may go without one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all hosts share")
    shared = shared or tempfile.mkdtemp(prefix="repository-")
    return f"{shared}/repository-{uuid.uuid4().hex}"


@dataclass
class Repository:
    spark: SparkSession
    root: str
    codec: str = "zstd"
    level: int | None = None
    #: Letters of a text, or bytes, in a fragment.
    fragment: int = 4096

    def _read(self, name: str, last: int | None = None) -> DataFrame:
        """The rows of committed versions; an empty table if there is none yet. The last version is looked up if it isn't given."""
        try:
            rows = self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}")
        except AnalysisException:
            none = self.spark.range(0).where("false")
            return none.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in DataType.fromDDL(TABLES[name])))
        return rows if name == "versions" else rows.where(F.col("version") <= (self.last_version() if last is None else last))

    def versions(self) -> DataFrame:
        return self._read("versions")

    def last_version(self) -> int:
        return self._read("versions").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def history(self) -> DataFrame:
        return self._read("journal")

    def state(self, until: int | None = None) -> DataFrame:
        return journal.state_at(self._read("journal"), ["path"], "version", F.col("op") == "-", until)

    def add(self, files: DataFrame, comment: str | None = None, always: bool = False, delete: bool = True) -> int | None:
        """Commit files (path, size, mtime, attr, content) as a new version; its number, or None if nothing changed.

        Contents are read once for their digests, and once more where they hold new fragments; only digests are held.
        """
        last = self.last_version()
        digests = self._digests(files).persist()
        scanned = digests.where("ord = 0").drop("ord", "sha1")
        old = journal.state_at(self._read("journal", last), ["path"], "version", F.col("op") == "-")
        old = old.persist() if last else old
        plan = diff.incremental(old, scanned, always, delete).where("action <> 'same'").persist()
        try:
            counts = {r.action: r["count"] for r in plan.groupBy("action").count().collect()}
            if not counts:
                return None
            version = last + 1
            self._drop_above(last)
            stored = self._write(version, files, digests, old, plan)
            row = {"added": counts.get("add", 0), "modified": counts.get("modify", 0) + counts.get("attr", 0), "deleted": counts.get("delete", 0), "bytes": stored[0], "stored": stored[1]}
            made = self.spark.range(0, 1, 1, 1).select(F.current_timestamp().cast("timestamp_ntz").alias("ts"), *(F.lit(n).cast("long").alias(c) for c, n in row.items()), F.lit(comment).cast("string").alias("comment"))
            self._append("versions", made, version)
            return version
        finally:
            for held in (plan, old, digests):
                held.unpersist()

    def _digests(self, files: DataFrame) -> DataFrame:
        """A row for each fragment of each file: what is known of the file, ord and sha1. Contents are read and let go; the first fragment, which even an empty file has, stands for the file."""
        hashed = files.select("path", "size", "mtime", F.coalesce("attr", F.lit("")).alias("attr"), F.lit("sha256").alias("hash_alg"), F.sha2("content", 256).alias("hash"), "content")
        n = F.greatest(F.ceil(F.octet_length("content") / self.fragment) - 1, F.lit(0)).cast("int")
        cut = hashed.select("*", F.explode(F.sequence(F.lit(0), n)).alias("ord"))
        return cut.withColumn("sha1", F.sha1(self._piece(F.col("ord")))).drop("content")

    def _piece(self, ord: Column) -> Column:
        return F.substring("content", ord * self.fragment + 1, F.lit(self.fragment))

    def _write(self, version: int, files: DataFrame, digests: DataFrame, old: DataFrame, plan: DataFrame) -> tuple[int, int]:
        cut = digests.select("path", "ord", "sha1").join(plan.where("action in ('add', 'modify')").select("path"), "path")
        lists = cut.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "sha1"))), lambda x: x["sha1"]).alias("frags"), F.count_if(F.col("ord") == 0).alias("files")).persist()
        # a new fragment is taken from one place, so contents travel once, and only where they hold one
        places = cut.groupBy("sha1").agg(F.min(F.struct("path", "ord")).alias("at")).join(self._read("fragments", version - 1).select("sha1"), "sha1", "left_anti")
        takes = places.groupBy("at.path").agg(F.collect_list(F.struct("at.ord", "sha1")).alias("takes")).persist()
        try:
            n, width = takes.agg(F.coalesce(F.sum(F.size("takes")), F.lit(0)), F.coalesce(F.sum(F.octet_length("path") + 64 * F.size("takes")), F.lit(0))).first()
            sums = self._write_blocks(version, files, F.broadcast(takes) if width <= BROADCAST_BYTES else takes.hint("shuffle_hash"), n, lists.agg(F.max("files")).first()[0] > 1) if n else (0, 0)
            scanned = digests.where("ord = 0").drop("ord", "sha1")
            fresh = scanned.join(plan, "path").join(lists.select("path", "frags"), "path", "left").join(old.select("path", F.col("frags").alias("old_frags")), "path", "left")
            op = F.when(F.col("action") == "add", "+").otherwise("#")
            rows = fresh.select("path", op.alias("op"), "size", "mtime", "attr", "hash_alg", "hash", F.coalesce("frags", "old_frags").alias("frags"))
            gone = plan.where("action = 'delete'").join(old, "path").select("path", F.lit("-").alias("op"), "size", "mtime", "attr", "hash_alg", "hash", "frags")
            self._append("journal", rows.unionByName(gone), version)
            return sums
        finally:
            takes.unpersist()
            lists.unpersist()

    def _write_blocks(self, version: int, files: DataFrame, takes: DataFrame, n: int, repeated: bool) -> tuple[int, int]:
        """Write the n fragments that takes (path, takes of ord and sha1) names, read again from the files; their bytes, and those of their blocks."""
        taken = files.select("path", "content").join(takes, "path").select("content", F.explode("takes").alias("take"))
        pieces = taken.select("take.sha1", self._piece(F.col("take.ord")).alias("piece")).where(F.sha1("piece").eqNullSafe(F.col("sha1")))
        if repeated:  # a path that stands for several files holds its fragments as often
            pieces = pieces.dropDuplicates(["sha1"])
        # a block is named by its content, so numbers do not hang on the order of tasks
        blocks = pieces.select(F.col("sha1").alias("block_id"), F.lit(self.codec).alias("codec"), F.octet_length("piece").cast("long").alias("orig_size"), codecs.encoded(F.col("piece"), self.codec, self.level).alias("payload"))
        self._append("blocks", blocks.select("block_id", "codec", "orig_size", F.octet_length("payload").cast("long").alias("comp_size"), "payload"), version)
        made = self.spark.read.schema("block_id string, orig_size long, comp_size long").parquet(f"{self.root}/blocks/version={version}")
        count, *sums = made.agg(F.count("*"), F.coalesce(F.sum("orig_size"), F.lit(0)), F.coalesce(F.sum("comp_size"), F.lit(0))).first()
        if count != n:
            raise RuntimeError(f"contents changed while they were added: {count} of {n} new fragments are there")
        self._append("fragments", made.select(F.col("block_id").alias("sha1"), F.col("orig_size").alias("size"), "block_id"), version)
        return sums[0], sums[1]

    def _append(self, name: str, rows: DataFrame, version: int) -> None:
        rows.write.mode("append").parquet(f"{self.root}/{name}/version={version}")

    def _keyed(self, until: int | None) -> DataFrame:
        """A state with a key of each list of fragments: files of one content share it."""
        return self.state(until).withColumn("key", F.sha1(F.array_join("frags", ",")))

    def _wholes(self, keyed: DataFrame, digest: bool = False) -> DataFrame:
        """key and content (or its hash) of every different list of fragments, however many files have it. Blocks travel encoded."""
        pieces = keyed.select("key", F.posexplode("frags").alias("ord", "sha1")).distinct()
        last = self.last_version()
        stored = pieces.join(self._read("fragments", last).select("sha1", "block_id"), "sha1").select("key", "ord", "block_id")
        found = self._read("blocks", last).select("block_id", "payload").join(stored.hint("shuffle_hash"), "block_id")
        return codecs.assembled(found.select("key", "ord", "payload"), digest)

    def extract(self, until: int | None = None) -> DataFrame:
        """path, size, mtime, hash, content of a state, put together from fragments."""
        keyed = self._keyed(until)
        return self._wholes(keyed).join(keyed.select("key", "path", "size", "mtime", "hash").hint("shuffle_hash"), "key").select("path", "size", "mtime", "hash", "content")

    def test(self, until: int | None = None) -> DataFrame:
        """path and verdict of every file: ok, bad or missing."""
        keyed = self._keyed(until)
        found = keyed.select("key", "path").join(self._wholes(keyed, digest=True), "key")
        return diff.verify(keyed.select("path", "hash"), found, ["hash"])

    def info(self) -> DataFrame:
        return self.versions().select("version", "added", "modified", "deleted", "bytes", "stored", "comment").orderBy("version")

    def trim(self) -> None:
        """Remove files of versions that were never committed."""
        self._drop_above(self.last_version())

    def crop(self, until: int, kill: bool = False) -> DataFrame:
        """The versions above one; with kill they go, the newest first."""
        above = self.versions().where(F.col("version") > until).select("version").orderBy(F.desc("version"))
        if kill:
            gone = self.spark.createDataFrame(above.collect(), "version long")  # a row for each version
            self._drop_above(until, ("versions",))
            self._drop_above(until)
            return gone
        return above

    def _drop_above(self, version: int, names: tuple[str, ...] = ("journal", "fragments", "blocks")) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for name in names:
            folder = path(f"{self.root}/{name}")
            fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
            if not fs.exists(folder):
                continue
            for status in fs.listStatus(folder):
                own = status.getPath().getName()
                if own.startswith("version=") and int(own[8:]) > version:
                    fs.delete(status.getPath(), True)

    def merge(self, other: Repository) -> None:
        """Take over all tables of an empty repository's counterpart: parts become one, version by version."""
        if self.last_version():
            raise ValueError("the target must be empty")
        for name in ("blocks", "fragments", "journal", "versions"):
            other._read(name).write.mode("append").partitionBy("version").parquet(f"{self.root}/{name}")

    def repack(self, to: str, codec: str, level: int | None = None) -> Repository:
        """A copy whose blocks are encoded anew."""
        out = Repository(self.spark, to, codec, level, self.fragment)
        blocks = codecs.recoded(self._read("blocks"), codec, level).withColumn("codec", F.lit(codec)).withColumn("comp_size", F.octet_length("payload").cast("long"))
        blocks.write.mode("append").partitionBy("version").parquet(f"{to}/blocks")
        for name in ("fragments", "journal", "versions"):
            self._read(name).write.mode("append").partitionBy("version").parquet(f"{to}/{name}")
        return out

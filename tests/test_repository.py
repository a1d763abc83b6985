import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import codecs
from palimpsest.operators import diff
from palimpsest.sources import files as sources
from palimpsest.sources import repository
from palimpsest.sources.repository import Repository
from palimpsest.streaming import ingest

SCHEMA = "path string, size long, mtime timestamp_ntz, attr string, content binary"
T = dt.datetime(2024, 1, 1)


def tree(spark, contents, mtime=T, attr="a"):
    return spark.createDataFrame([(p, len(c), mtime, attr, c) for p, c in contents.items()], SCHEMA)


BASE = {"a.txt": b"one" * 3000, "b/c.txt": b"two", "b/empty": b"", "same": b"one" * 3000}


@pytest.fixture
def repo(spark, tmp_path):
    return Repository(spark, str(tmp_path / "repo"), fragment=1000)


def contents(df):
    return {r.path: bytes(r.content) for r in df.collect()}


def test_versions(spark, repo):
    assert repo.last_version() == 0 and repo.state().count() == 0
    assert repo.add(tree(spark, BASE), comment="first") == 1
    assert repo.add(tree(spark, BASE)) is None  # nothing new, no version
    changed = BASE | {"b/c.txt": b"two, changed"}
    assert repo.add(tree(spark, changed, T + dt.timedelta(1))) == 2
    less = {p: c for p, c in changed.items() if p != "a.txt"}
    assert repo.add(tree(spark, less, T + dt.timedelta(1))) == 3
    assert repo.add(tree(spark, {"b/c.txt": b"two, changed"}, T + dt.timedelta(1)), delete=False) is None
    assert [contents(repo.extract(v)) for v in (1, 2, 3)] == [BASE, changed, less]
    info = repo.info().collect()
    assert [(r.version, r.added, r.modified, r.deleted) for r in info] == [(1, 4, 0, 0), (2, 0, 4, 0), (3, 0, 0, 1)]
    assert info[0].comment == "first" and info[0].bytes < 4000  # equal contents and fragments are stored once
    assert diff.tally(repo.test()).first().asDict() == {"good": 3, "bad": 0, "all_good": True, "code": 0}


def test_attributes_alone_keep_the_content(spark, repo):
    repo.add(tree(spark, BASE))
    assert repo.add(tree(spark, BASE, attr="b")) == 2
    assert contents(repo.extract()) == BASE and repo.info().collect()[1].bytes == 0


def test_damage_is_found(spark, repo):
    repo.add(tree(spark, BASE))
    blocks = repo._read("blocks").withColumn("payload", F.when(F.col("orig_size") == 3, F.unhex(F.lit("00"))).otherwise(F.col("payload"))).collect()
    spark.createDataFrame(blocks, repo._read("blocks").schema).write.mode("overwrite").partitionBy("version").parquet(f"{repo.root}/blocks")
    verdicts = {r.path: r.verdict for r in repo.test().collect()}
    assert verdicts == {"a.txt": "ok", "b/c.txt": "bad", "b/empty": "ok", "same": "ok"}


def test_contents_are_not_held(spark, repo, monkeypatch):
    """What an add keeps in memory or on disk are digests; after it, nothing. (Contents were cached, and the plan stayed so.)"""
    context, append, held = spark.sparkContext._jsc, Repository._append, []

    def watched(self, name, *rest):
        held.append(sum(r.memSize() + r.diskSize() for r in context.sc().getRDDStorageInfo()))
        append(self, name, *rest)

    monkeypatch.setattr(Repository, "_append", watched)
    before = context.getPersistentRDDs().size()
    files = {f"f{n}": np.random.default_rng(n).bytes(200_000) for n in range(20)}
    repo.fragment = 10_000
    assert repo.add(tree(spark, files)) == 1 and repo.add(tree(spark, files | {"f0": b"x"})) == 2
    assert 0 < max(held) < 400_000 and context.getPersistentRDDs().size() == before
    assert contents(repo.extract(1)) == files and contents(repo.extract())["f0"] == b"x"


def test_equal_contents_are_put_together_once(spark, repo):
    repo.add(tree(spark, {f"copy{n}": b"one" * 3000 for n in range(50)} | BASE))
    assert repo._wholes(repo._keyed(None)).count() == 3
    assert repo._wholes(repo._keyed(None), digest=True).where("hash is null").count() == 0
    assert diff.tally(repo.test()).first().good == 54 and len(contents(repo.extract())) == 54


def test_places_beyond_the_broadcast(spark, repo, monkeypatch):
    monkeypatch.setattr(repository, "BROADCAST_BYTES", 0)
    changed = BASE | {"b/c.txt": b"one" * 2000 + b"new" * 1000}
    assert repo.add(tree(spark, BASE)) == 1 and repo.add(tree(spark, changed)) == 2
    assert contents(repo.extract(1)) == BASE and contents(repo.extract()) == changed
    assert repo._read("blocks").count() == repo._read("blocks").select("block_id").distinct().count()


def test_fragments_of_a_path_given_twice_are_stored_once(spark, repo):
    twice = tree(spark, BASE).union(tree(spark, {"same": b"one" * 3000, "b/c.txt": b"other"}))
    assert repo.add(twice) == 1 and repo.info().first().added == 6
    blocks = repo._read("blocks").select("block_id").collect()
    assert len(blocks) == len(set(blocks)) == repo._read("fragments").count() and contents(repo.extract())["a.txt"] == BASE["a.txt"]


def test_null_content_is_missing(spark, repo):
    row = spark.createDataFrame([("none", None, T, "a", None)], SCHEMA)
    assert repo.add(tree(spark, BASE).union(row)) == 1 and repo.add(tree(spark, BASE).union(row)) is None
    assert {r.path: r.verdict for r in repo.test().collect()} == {p: "ok" for p in BASE} | {"none": "missing"}


def test_contents_that_change_during_an_add_are_not_committed(spark, repo, monkeypatch):
    write = Repository._write_blocks
    other = lambda self, version, files, *rest: write(self, version, files.withColumn("content", F.lit(b"other")), *rest)
    with monkeypatch.context() as patch, pytest.raises(RuntimeError, match="changed while"):
        patch.setattr(Repository, "_write_blocks", other)
        repo.add(tree(spark, BASE))
    assert repo.last_version() == 0 and repo.state().count() == 0
    assert repo.add(tree(spark, BASE)) == 1 and contents(repo.extract()) == BASE


def test_trim_crop_merge_repack(spark, repo, tmp_path):
    repo.add(tree(spark, BASE))
    repo.add(tree(spark, BASE | {"new": b"x"}))
    half = repo._read("journal").where("version = 2").drop("version").withColumn("path", F.lit("lost"))
    half.withColumn("version", F.lit(3)).write.mode("append").partitionBy("version").parquet(f"{repo.root}/journal")
    assert "lost" not in contents(repo.extract())  # not committed
    repo.trim()
    again = repo.repack(str(tmp_path / "packed"), "lzma", 9)
    assert contents(again.extract()) == contents(repo.extract()) and set(r.codec for r in again._read("blocks").collect()) == {"lzma"}
    merged = Repository(spark, str(tmp_path / "merged"))
    merged.merge(repo)
    assert contents(merged.extract(1)) == BASE and merged.last_version() == 2
    assert [r.version for r in repo.crop(1).collect()] == [2] and repo.last_version() == 2
    repo.crop(1, kill=True)
    assert repo.last_version() == 1 and contents(repo.extract()) == BASE


def test_stream(spark, repo, tmp_path):
    inbox = str(tmp_path / "in")
    for n in (1, 2):
        tree(spark, {f"f{n}": b"text %d" % n, "same": b"s"}).coalesce(1).write.mode("append").parquet(inbox)
        ingest.drain(spark.readStream.schema(SCHEMA).parquet(inbox), repo, str(tmp_path / "ck"))
    assert contents(repo.extract()) == {"f1": b"text 1", "f2": b"text 2", "same": b"s"} and repo.last_version() == 2


def test_files(spark, tmp_path):
    (tmp_path / "t/sub").mkdir(parents=True)
    (tmp_path / "t/a.txt").write_bytes(b"abc")
    (tmp_path / "t/sub/b.bin").write_bytes(b"\0\1")
    (tmp_path / "list").write_text("a.txt\tout/a\n\nsub/b.bin\n")
    found = sources.scan(spark, str(tmp_path / "t"))
    assert contents(found) == {"a.txt": b"abc", "sub/b.bin": b"\0\1"}
    listed = sources.listed(found, sources.names(spark, str(tmp_path / "list")))
    assert {r.path: r.destination for r in listed.collect()} == {"a.txt": "out/a", "sub/b.bin": "sub/b.bin"}
    for n in (1, 2):
        spark.range(n).write.parquet(str(tmp_path / f"part{n:02}.parquet"))
    assert sorted(r.part_no for r in sources.parts(spark, str(tmp_path / "part*.parquet")).collect()) == [1, 2, 2]
    sources.to_delimited(spark.createDataFrame([(1, None), (2, "x")], "a int, b string"), str(tmp_path / "csv"), ";", "H", "F")
    assert [r.value for r in spark.read.text(str(tmp_path / "csv")).collect()] == ["H", "1;", "2;x", "F"]


def test_preferences(spark):
    wishes = spark.createDataFrame([(1, ["no:1", "zstd:99", "zstd:5"]), (2, ["lzma"]), (3, [])], "id int, wishes array<string>")
    assert dict(codecs.preferred(wishes, codecs.registry(spark)).collect()) == {1: "zstd:5", 2: "lzma", 3: None}

"""Archives read by ranges, and trees and archives on a store that only Spark reads."""

import io
import stat
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from cipherscape.operators import discovery
from cipherscape.sources import files, stores


def _zip(entries, links=(), method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, content in entries.items():
            z.writestr(name, content)
        for name, target in links:
            info = zipfile.ZipInfo(name)
            info.create_system, info.external_attr = 3, (stat.S_IFLNK | 0o777) << 16
            z.writestr(info, target)
    return out.getvalue()


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    files.register(spark)


@pytest.fixture
def store(spark, tmp_path):
    """A URI that only Hadoop's file systems know, and the folder behind it."""
    mount = f"m{tmp_path.name.replace('_', '')}"
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{mount}.link./in", f"file://{tmp_path}")
    return f"viewfs://{mount}/in", tmp_path


def read(spark, path, **options):
    return {(r.snapshot_id, r.path): bytes(r.content) for r in spark.read.format("source_zip").options(**options).load(str(path)).collect()}


def test_an_archive_of_many_members_is_read_by_several_tasks(spark, tmp_path):
    entries = {f"top/d{k % 50}/f{k}.py": b"x = %d\n" % k * (k % 40) for k in range(10_000)}
    (tmp_path / "big.zip").write_bytes(_zip(entries))
    df = spark.read.format("source_zip").load(str(tmp_path / "big.zip"))
    assert df.rdd.getNumPartitions() >= 10
    tasks = df.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == 10_000 and max(r["count"] for r in tasks) <= 1000
    assert {r.path: bytes(r.content) for r in df.collect()} == {n.removeprefix("top/"): c for n, c in entries.items()}
    assert df.filter("size = 0").count() == 250


UNSAFE = {
    "up": _zip({"../escape.py": b"x"}), "deep": _zip({"foo/../../secret.py": b"x"}), "root": _zip({"/etc/passwd": b"x"}), "drive": _zip({"C:/Windows/config": b"x"}), "dot": _zip({"./": b""}),
    "absolute link": _zip({"a.py": b""}, [("link", "/etc/passwd")]), "link out": _zip({"a.py": b""}, [("nested/link", "../../../../etc/passwd")]), "link above": _zip({}, [("top/link", "../x")]),
}


@pytest.mark.parametrize("name", sorted(UNSAFE))
def test_unsafe_archives(spark, tmp_path, name):
    (tmp_path / "bad.zip").write_bytes(UNSAFE[name])
    with pytest.raises(files.UnsafeArchive):
        list(files.zip_rows(str(tmp_path / "bad.zip"), "s"))
    with pytest.raises(Exception, match="UnsafeArchive"):
        read(spark, tmp_path)


def test_names_with_backslashes_and_devices():
    for name in ("..\\escape.py", "foo\\bar.py", "a\0b"):
        info = zipfile.ZipInfo("x")
        info.filename = name
        with pytest.raises(files.UnsafeArchive):
            files.safe_member(info)
    pipe = zipfile.ZipInfo("pipe")
    pipe.external_attr = (stat.S_IFIFO | 0o600) << 16
    with pytest.raises(files.UnsafeArchive):
        files.safe_member(pipe)


def test_links_inside_are_passed_over(spark, tmp_path):
    (tmp_path / "in.zip").write_bytes(_zip({"regular.py": b"x"}, [("docs/link.py", "../regular.py"), ("b.md", "regular.py"), ("docs/up.py", "..")]))
    assert read(spark, tmp_path) == {("in", "regular.py"): b"x"}


def test_ceilings(spark, tmp_path):
    path = tmp_path / "four.zip"
    path.write_bytes(_zip({f"f{k}.py": b"a" * 1024 for k in range(4)}))
    assert len(read(spark, path, max_files=4, max_bytes=4096)) == 4
    for limit in ({"max_files": 3}, {"max_bytes": 4095}, {"max_archive": 100}):
        with pytest.raises(files.ArchiveTooLarge):
            list(files.zip_rows(str(path), "s", **limit))
        with pytest.raises(Exception, match="ArchiveTooLarge"):
            read(spark, path, **limit)
        with pytest.raises(Exception, match="ArchiveTooLarge"):
            stores.archives(spark, str(path), **limit).collect()


def _understated():
    content = b"a" * 100_000
    return _zip({"bomb.py": content}).replace(struct.pack("<I", len(content)), struct.pack("<I", 1))


def _encrypted():
    raw = bytearray(_zip({"a.py": b"secret"}))
    raw[6] |= 1
    raw[raw.index(b"PK\x01\x02") + 8] |= 1
    return bytes(raw)


def _damaged():
    raw = bytearray(_zip({"a.py": bytes(range(256)) * 20}))
    raw[60:70] = b"\xff" * 10
    return bytes(raw)


@pytest.mark.parametrize("content", [b"this is no archive", b"", _zip({"a/b.py": b"x = 1\n" * 9})[:60], _understated(), _encrypted(), _damaged()])
def test_malformed_archives(spark, tmp_path, content):
    (tmp_path / "bad.zip").write_bytes(content)
    with pytest.raises(files.MalformedArchive):
        list(files.zip_rows(str(tmp_path / "bad.zip"), "s"))
    with pytest.raises(Exception, match="MalformedArchive"):
        read(spark, tmp_path)
    if content:  # an empty file is no row of Spark's reader
        with pytest.raises(Exception, match="MalformedArchive"):
            stores.archives(spark, str(tmp_path)).collect()


def test_several_top_levels_stay(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(_zip({"a/one.py": b"1", "b/two.py": b"2"}))
    (tmp_path / "b.zip").write_bytes(_zip({"t/": b"", "t/one.py": b"3"}, method=zipfile.ZIP_STORED))
    (tmp_path / "c.zip").write_bytes(_zip({}))
    want = {("a", "a/one.py"): b"1", ("a", "b/two.py"): b"2", ("b", "one.py"): b"3"}
    assert read(spark, tmp_path) == want == read(spark, f"file://{tmp_path}")
    assert {(r.snapshot_id, r.path): bytes(r.content) for r in stores.archives(spark, str(tmp_path)).collect()} == want


NAMES = ["a.py", "pkg/__init__.py", "_p/.hidden.py", ".git/c.py", "sp ace/per%20cent.py", "d/hash#.py", "d/ü.py", "d/br[ack]{a,b}.py", "d/q?*.py", "d/_x=1.py", "d/n-a.py", "d/n-/n-.py", "d/$1${name}.py", "d/a+b.py", "empty.py"]


def test_a_tree_on_any_store(spark, store):
    uri, folder = store
    for k, name in enumerate(NAMES):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(b"" if name == "empty.py" else b"k%d" % k)
    local = spark.read.format("source_tree").load(str(folder))
    for root in (uri, uri + "/", f"file://{folder}"):
        far = stores.tree(spark, root, "s")
        assert {tuple(r) for r in far.collect()} == {tuple(r) for r in local.collect()}
    assert discovery.content_hash(stores.tree(spark, uri)).first() == discovery.content_hash(local.withColumn("snapshot_id", F.lit("s"))).first()
    assert [n for n, _ in stores.listed(spark, uri)] == sorted(NAMES, key=lambda n: n.split("/"))
    assert stores.tree(spark, f"{uri}/d", "x").filter("path = 'ü.py'").count() == 1
    plan = stores.tree(spark, uri).filter("size < 3").select("path")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.partition("ReadSchema")[2].partition("\n")[0] and "LessThan(length,3)" in plan
    with pytest.raises(files.ArchiveTooLarge):
        stores.tree(spark, uri, max_files=3)
    (folder / "nothing").mkdir()
    assert stores.tree(spark, f"{uri}/nothing").collect() == []


def test_a_tree_is_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """The driver names no file, and tasks grow in number with the files."""
    root = tmp_path / "a b%20c"
    want = {f"d{k % 3}/_e/x{k}.py" if k % 2 else f"y{k}.py": b"k" * (k % 7) for k in range(300)}
    for name, content in {**want, **{n: b"" for n in NAMES}}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    (root / "nothing").mkdir()
    (root / "link.py").symlink_to(root / "a.py")
    (root / "loop").symlink_to(root)
    monkeypatch.setattr(stores, "listed", None)
    monkeypatch.setattr(stores, "DEALT_FILES", 20)
    monkeypatch.setattr(stores, "BATCH_ROWS", 7)
    for name in (str(root), f"file://{root}/"):
        found = stores.tree(spark, name, "s", 315)
        assert {(r.path, r.size, bytes(r.content)) for r in found.collect()} == {(n, len(c), c) for n, c in want.items()} | {(n, 0, b"") for n in NAMES}
        assert found.rdd.getNumPartitions() >= 15
    assert stores.listing(spark, str(root)).agg(F.count("*"), F.sum("size"), F.min("snapshot_id")).first() == (315, sum(map(len, want.values())), "s")
    with pytest.raises(files.ArchiveTooLarge):
        stores.tree(spark, str(root), max_files=314)
    assert stores.tree(spark, str(root / "nothing")).collect() == []


def test_archives_on_any_store(spark, store):
    uri, folder = store
    entries = {f"t/f{k}.py": b"y = %d\n" % k * 50 for k in range(300)}
    (folder / "one.zip").write_bytes(_zip(entries))
    df = stores.archives(spark, uri)
    assert {r.path: bytes(r.content) for r in df.collect()} == {n[2:]: c for n, c in entries.items()}
    assert df.select(F.spark_partition_id()).distinct().count() > 1  # inflated in several tasks

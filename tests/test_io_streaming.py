import io
import random
import tarfile
import zipfile

import pytest

from docmine.functions import batch
from docmine.sources import archives, store, text


def test_fixed_width(spark, tmp_path):
    lines = ["0123456789ABCDEFGHA61K", "0123456789ABCDEFGHA61", "0123456789ABCDEFGHB01JX"]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    out = text.read_fixed_width(spark, str(tmp_path), [("patent_no", 11, 8), ("subclass", 19, 4)], 22)
    assert sorted(tuple(r) for r in out.collect()) == [("ABCDEFGH", "A61K"), ("ABCDEFGH", "B01J")]


def test_archives(spark, tmp_path):
    with tarfile.open(tmp_path / "w.tar", "w") as tar:
        for name in ("a/100.pdf", "a/200.PDF", "a/readme.txt"):
            info = tarfile.TarInfo(name)
            info.size = 3
            tar.addfile(info, io.BytesIO(b"abc"))
    with zipfile.ZipFile(tmp_path / "w.zip", "w") as z:
        z.writestr("b/200.pdf", "xyz")
    keys = spark.createDataFrame([("200",)], "stem string")
    got = archives.read_archive_members(spark, str(tmp_path), ".pdf", keys).collect()
    assert sorted((r["member"], r["stem"], bytes(r["content"])) for r in got) == [
        ("a/200.PDF", "200", b"abc"), ("b/200.pdf", "200", b"xyz"),
    ]
    assert archives.read_archive_members(spark, str(tmp_path), ".pdf").count() == 3


def test_written_archives_are_read_by_place(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"b{i % 3}.{('tar', 'zip')[i % 2]}", f"d/{i}.{('txt', 'bin')[i % 5 == 0]}", rng.randbytes(rng.randrange(0, 4000))) for i in range(300)]
    members = spark.createDataFrame(rows, "archive string, member string, content binary")
    path = str(tmp_path / "boxes")
    written = archives.write_archives(members.repartition(5), path)
    assert {r["archive"]: r["n_members"] for r in written.collect()} == {a: 50 for a, _, _ in rows}
    assert sorted(p.name for p in (tmp_path / "boxes").iterdir()) == sorted({a for a, _, _ in rows})
    with zipfile.ZipFile(tmp_path / "boxes" / "b1.zip") as box:
        assert box.testzip() is None
    index = archives.archive_index(spark, path, ".txt")
    assert index.count() == 240
    # A few bytes to a task: one archive is read by many tasks.
    contents = archives.member_contents(index, path, task_bytes=20_000)
    assert contents.rdd.getNumPartitions() > 10
    got = {(r["archive"].split("/")[-1], r["member"]): bytes(r["content"]) for r in contents.collect()}
    assert got == {(a, m): c for a, m, c in rows if m.endswith("txt")}


def test_only_wanted_bytes_are_read(spark, tmp_path):
    """A member that is not asked for may be broken; one that is asked for may not."""
    with zipfile.ZipFile(tmp_path / "w.zip", "w") as box:
        box.writestr("1.txt", b"a" * 1000)
        box.writestr("2.txt", b"b" * 1000)
    data = (tmp_path / "w.zip").read_bytes()
    (tmp_path / "w.zip").write_bytes(data.replace(b"bbbb", b"bxbb", 1))
    read = lambda k: archives.read_archive_members(spark, str(tmp_path), ".txt", spark.createDataFrame([(k,)], "stem string")).collect()
    assert [bytes(r["content"]) for r in read("1")] == [b"a" * 1000]
    with pytest.raises(Exception, match="checksum"):
        read("2")
    assert read("3") == []


def test_delimited_and_sdf(spark, tmp_path):
    (tmp_path / "n.csv").write_text("patent_no; page; iupac\n1; 0; a,b-c\n1; 0; a,b-c\n")
    df = text.read_delimited(spark, str(tmp_path / "n.csv"), "patent_no bigint, page int, iupac string", ";")
    assert [tuple(r) for r in df.collect()] == [(1, 0, "a,b-c")] * 2
    (tmp_path / "x.sdf").write_text("m1\nM  END\n> <NAME>\none\n\n$$$$\nm2\nM  END\n> <NAME>\ntwo\n\n$$$$\n")
    got = text.read_sdf(spark, str(tmp_path / "x.sdf")).collect()
    assert [(r["molblock"].split("\n")[0], r["properties"]) for r in got] == [("m1", {"NAME": "one"}), ("m2", {"NAME": "two"})]


def test_stage_reuse(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "s")
    for params, n in (({"a": 1}, 3), ({"a": 1}, 3), ({"a": 2}, 3), ({"a": 2}, 4)):
        assert store.reuse_or_build(spark, path, params, n, build).count() == 3
    assert len(calls) == 3


def test_failed_chunk(spark):
    def predict(model, values):
        if -1 in values:
            raise ValueError
        return [model + v for v in values]

    df = spark.createDataFrame([(1, 1), (2, -1), (3, 3)], "id int, v int").coalesce(1)
    got = batch.batch_infer(df, lambda: 10, predict, "v", "id", "bigint", batch=1).collect()
    assert {r["id"]: (r["result"], r["success"]) for r in got} == {1: (11, True), 2: (None, False), 3: (13, True)}
    assert {r["id"]: r["error"] for r in got} == {1: None, 2: "ValueError: ", 3: None}

    def broken():
        raise RuntimeError("no such model")

    with pytest.raises(Exception, match="no such model"):
        batch.batch_infer(df, broken, predict, "v", "id", "bigint").collect()

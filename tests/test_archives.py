"""Archives of delimited text: round trips, partitions, bad rows, damage."""

import io
import tarfile
import zipfile

import pytest

from tallyveil.sources import archives

COLUMNS = [("k", "bigint"), ("name", "string"), ("x", "double")]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def table(spark, n):
    return spark.createDataFrame([(k, None if k % 7 == 0 else f'n"{k}, é\nx' if k % 5 == 0 else f"n{k}", k / 4) for k in range(n)], "k long, name string, x double")


def test_zip_round_trip_over_tasks(spark, tmp_path):
    df = table(spark, 1000)
    home = str(tmp_path / "zips")
    archives.write_archives(df.repartition(3), f"file://{home}", rows=20)
    back = archives.read_archives(spark, home, COLUMNS, partition_bytes=500)
    assert rows_of(back) == rows_of(df)
    assert back.rdd.getNumPartitions() > 20  # members are dealt to tasks
    archives.write_archives(df.where("false"), str(tmp_path / "none"))
    with pytest.raises(Exception, match="no archive"):
        archives.read_archives(spark, str(tmp_path / "none"), COLUMNS).count()


@pytest.mark.parametrize("kind", ["w", "w:gz"])
def test_tar_members(spark, tmp_path, kind):
    path = tmp_path / "all.tar"
    with tarfile.open(path, kind) as t:
        for m in range(12):
            data = "".join(f"{m * 10 + k}  a{k}\t {k}.5 \n" for k in range(10)).encode()
            info = tarfile.TarInfo(f"d/{m}.txt")
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    found = archives.read_archives(spark, str(path), COLUMNS, separator="whitespace", partition_bytes=150)
    assert rows_of(found) == sorted(((m * 10 + k, f"a{k}", k + 0.5) for m in range(12) for k in range(10)), key=repr)
    assert found.rdd.getNumPartitions() == (12 if kind == "w" else 1)


def test_bad_rows(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.csv", "k,name,x\n1,a,2\n2,b\nthree,c,1\n\n4,,\n5,e,6,7\n")
    read = lambda mode: archives.read_archives(spark, str(tmp_path / "a.zip"), COLUMNS, mode=mode, skip=1)
    assert rows_of(read("DROPMALFORMED")) == [(1, "a", 2.0), (4, None, None)]
    kept = rows_of(read("PERMISSIVE"))
    assert [r[3] for r in kept if r[3]] == ["three,c,1", "2,b", "5,e,6,7"] or {r[3] for r in kept} == {None, "2,b", "three,c,1", "5,e,6,7"}
    assert len(kept) == 5
    with pytest.raises(Exception, match="2 fields in place of 3"):
        read("FAILFAST").collect()
    with pytest.raises(Exception, match="mode must be"):
        read("other").collect()


def test_damage_is_an_error_in_every_mode(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.csv", "1,a,2\n" * 500)
    whole = (tmp_path / "a.zip").read_bytes()
    (tmp_path / "cut.zip").write_bytes(whole[:-200])
    (tmp_path / "bits.zip").write_bytes(whole[:200].replace(b"1,a,2", b"1,a,3") + whole[200:])
    with tarfile.open(tmp_path / "b.tar", "w") as t:
        info = tarfile.TarInfo("x.csv")
        info.size = 60_000
        t.addfile(info, io.BytesIO(b"1,a,2\n" * 10_000))
    (tmp_path / "cut.tar").write_bytes((tmp_path / "b.tar").read_bytes()[:30_000])
    with tarfile.open(tmp_path / "c.tgz", "w:gz") as t:
        t.add(tmp_path / "b.tar", "b.csv")
    (tmp_path / "cut.tgz").write_bytes((tmp_path / "c.tgz").read_bytes()[:-40])
    for name in ("cut.zip", "bits.zip", "cut.tar", "cut.tgz"):
        for mode in archives.MODES:
            with pytest.raises(Exception, match="truncated or damaged|no whole"):
                archives.read_archives(spark, str(tmp_path / name), COLUMNS, mode=mode).collect()


def test_paths():
    assert archives.local_path("file:///a/b") == archives.local_path("file:/a/b") == archives.local_path("/a/b") == "/a/b"
    with pytest.raises(ValueError, match="mounted"):
        archives.local_path("viewfs://store/x")

import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.sources import archives as A
from quire.sources import files


def tar_bytes(entries, mode="w", fmt=tarfile.GNU_FORMAT):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode, format=fmt) as tar:
        for name, data in entries:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
        folder = tarfile.TarInfo("folder")
        folder.type = tarfile.DIRTYPE
        tar.addfile(folder)
    return out.getvalue()


ENTRIES = [(f"d/{k}/pg{k}.txt", f"text {k} ".encode() * (k * 50)) for k in range(1, 30)] + [("long" * 40 + "/x.txt", b"x"), ("empty.txt", b"")]


@pytest.mark.parametrize("form", ["zip", "stored", "tar", "pax", "gz", "bz2", "xz", "zip/tar", "zip/stored", "zip/gz"])
def test_every_form_gives_every_member(spark, tmp_path, form, monkeypatch):
    path = f"{tmp_path}/a.bin"
    if form in ("zip", "stored"):
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED if form == "zip" else zipfile.ZIP_STORED) as z:
            z.mkdir("folder")
            for name, data in ENTRIES:
                z.writestr(name, data)
    elif form.startswith("zip/"):
        with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED if form == "zip/stored" else zipfile.ZIP_DEFLATED) as z:
            z.writestr(f"in.tar{'.gz' if form == 'zip/gz' else ''}", tar_bytes(ENTRIES, "w:gz" if form == "zip/gz" else "w"))
    else:
        (tmp_path / "a.bin").write_bytes(tar_bytes(ENTRIES, "w" if form in ("tar", "pax") else f"w:{form}", tarfile.PAX_FORMAT if form == "pax" else tarfile.GNU_FORMAT))
    whole = A.members(spark, path, content="all")
    got = {r.name: bytes(r.content) for r in whole.collect()}
    assert got == dict(ENTRIES)
    listed = A.members(spark, path, r"pg\d*[02468]\.txt$")
    assert listed.filter("content IS NOT NULL OR error IS NOT NULL").isEmpty()
    some = A.fetched(listed.filter("size > 1000").withColumn("note", F.lit(7))).collect()
    assert {r.name: bytes(r.content) for r in some} == {n: d for n, d in ENTRIES if n[-5] in "02468" and "pg" in n and len(d) > 1000}
    assert {r.note for r in some} == {7}


def test_slices_of_a_directory(tmp_path, monkeypatch):
    monkeypatch.setattr(A, "SLICE", 2000)
    with zipfile.ZipFile(f"{tmp_path}/a.zip", "w") as z:
        for name, data in ENTRIES:
            z.writestr(name, data)
    import re

    parts = list(A.slices(f"{tmp_path}/a.zip", re.compile("")))
    assert len(parts) > 10 and [m["name"] for p in parts for m in p.members] == [n for n, _ in ENTRIES]
    assert all(len(p.members) == 1 or sum(m["packed"] for m in p.members) <= 2000 for p in parts)


def test_bundle_of_five_gigabytes(spark, tmp_path):
    """A zip64 archive with holes: what lies before the holes and after them is found by seeking, and nothing else is read."""
    with zipfile.ZipFile(f"{tmp_path}/big.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("1/pg1.txt", "first")
        for k, gap in ((2, 3 << 30), (3, 5 << 30)):
            z.start_dir = gap
            z.writestr(f"{k}/pg{k}.txt", f"text {k}")
        z.writestr("4/pg4.txt", "damaged")
    with open(f"{tmp_path}/big.zip", "r+b") as f:
        at = next(m for m in A.zip_members("", f) if m["name"] == "4/pg4.txt")["at"]
        f.seek(at + 30 + len("4/pg4.txt"))
        f.write(b"\xff\xff\xff\xff")
    assert (tmp_path / "big.zip").stat().st_size > 5 << 30
    gids = lambda *n: spark.createDataFrame([(k,) for k in n], "gid long")
    got = {r.gid: r.text for r in files.bundle_texts(spark, f"{tmp_path}/*.zip", gids(1, 3, 4, 9), gids(1)).collect()}
    assert got == {3: "text 3", 4: None}
    bad = A.members(spark, f"{tmp_path}/big.zip", "pg4", content="all").first()
    assert bad.content is None and bad.error


def test_unwanted_members_are_not_inflated(spark, tmp_path):
    """Members that nobody wants may even be damaged."""
    with zipfile.ZipFile(f"{tmp_path}/a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("1/pg1.txt", "kept")
        z.writestr("2/pg2.txt", "bad " * 100)
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    at = raw.index(b"2/pg2.txt") - 30
    raw[at : at + 4] = b"XXXX"
    (tmp_path / "a.zip").write_bytes(raw)
    wanted = spark.createDataFrame([(1,)], "gid long")
    assert [tuple(r) for r in files.bundle_texts(spark, f"{tmp_path}/a.zip", wanted).collect()] == [(1, "kept")]
    with pytest.raises(Exception, match="nothere"):
        A.members(spark, f"{tmp_path}/nothere.zip").collect()
    assert A.members(spark, f"{tmp_path}/*.none").count() == 0


def test_members_are_written_from_arrow(spark, tmp_path, monkeypatch):
    """Entries reach a zip a value at a time, not as a frame of Python values; null content is an empty member."""
    monkeypatch.setattr(type(spark.range(1)), "mapInPandas", None)
    entries = spark.createDataFrame([("a", b"one"), ("b", None), ("c", b"")], "name string, content binary").coalesce(1)
    assert A.write_zips(entries, f"{tmp_path}/z") == 3
    (path,) = (tmp_path / "z").glob("*.zip")
    with zipfile.ZipFile(path) as z:
        assert {n: z.read(n) for n in z.namelist()} == {"a": b"one", "b": b"", "c": b""}
